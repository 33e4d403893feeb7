"""Markdown reports, in Russian and English, from small result tables."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The reports' texts.
TEXTS: dict[str, dict[str, str]] = {
    "en": {
        "title": "Report on Stress Placement Library Comparison", "about": "Automatically generated report based on comparing library outputs against manual annotations.",
        "general": "General Information", "parameter": "Parameter", "value": "Value", "date": "Test date", "set": "Test set (sentences)", "gold": "Gold standard file", "count": "Number of libraries compared",
        "compared": "Compared Libraries", "performance": "Performance", "performance_about": "Comparison of loading time, processing time, and stability of the libraries.",
        "library": "Library", "load": "Load (sec)", "process": "Process (sec)", "exceptions": "Exceptions", "total": "**Total:** load — {} sec, process — {} sec, exceptions — {}",
        "errors": "Errors in Library Outputs", "errors_about": "Comparison of stress placement quality and word matching against the gold standard.",
        "stress": "Stress Errors", "missing": "Missing Stress", "unmatched_count": "Word Count Mismatch", "unmatched_text": "Word Text Mismatch", "unmatched_sentences": "Sentences with Mismatches",
        "errors_total": "**Total across all libraries:** stress errors — {}, missing — {}, count mismatch — {}, text mismatch — {}, sentences with mismatches — {}",
        "common": "Comparison on Common Words", "common_about": "Words that were successfully annotated by **all** compared libraries. This allows for quality comparison on equal terms.",
        "common_total": "Total Common Words", "accuracy": "Accuracy", "same": "✅ Total number of words annotated by all libraries: **{}** (matches across all libraries).", "differs": "⚠️ Warning: total number of words differs between libraries: {}",
        "details": "Detailed Summary by Library", "sentences": "Sentences processed", "matched": "Words matched with gold standard", "gold_words": "Words with stress in gold standard", "load_time": "Load time", "process_time": "Process time", "sec": "sec",
        "errors_head": "Errors", "wrong": "Incorrectly placed stress", "lacking": "Missing stress", "by_count": "Word count mismatch", "by_text": "Word text mismatch", "in_sentences": "Sentences with mismatches",
        "common_line": "**Common words:** {} words, errors: {}, accuracy: **{}**", "made": "Report generated: {}", "unknown": "not specified",
    },
    "ru": {
        "title": "Отчёт о сравнении библиотек расстановки ударений", "about": "Автоматически сгенерированный отчёт по результатам сравнения с ручной разметкой.",
        "general": "Общая информация", "parameter": "Параметр", "value": "Значение", "date": "Дата тестирования", "set": "Тестовый набор (предложений)", "gold": "Эталонный файл (gold)", "count": "Число сравниваемых библиотек",
        "compared": "Сравниваемые библиотеки", "performance": "Производительность", "performance_about": "Сравнение времени загрузки, обработки и стабильности работы библиотек.",
        "library": "Библиотека", "load": "Загрузка (сек)", "process": "Обработка (сек)", "exceptions": "Исключения", "total": "**Итого:** загрузка — {} сек, обработка — {} сек, исключений — {}",
        "errors": "Ошибки в результатах работы библиотек", "errors_about": "Сравнение качества расстановки ударений и сопоставления слов с эталоном.",
        "stress": "Ошибки ударений", "missing": "Пропущенные ударения", "unmatched_count": "Несовпадение по кол-ву слов", "unmatched_text": "Несовпадение по тексту слов", "unmatched_sentences": "Предложения с несовпадениями",
        "errors_total": "**Итого по всем библиотекам:** ошибки ударений — {}, пропущенные — {}, несовпадение по кол-ву — {}, несовпадение по тексту — {}, предложения с несовпадениями — {}",
        "common": "Сравнение по общим словам (common words)", "common_about": "Слова, которые были успешно размечены **всеми** сравниваемыми библиотеками. Это позволяет сравнивать качество на равных условиях.",
        "common_total": "Всего общих слов", "accuracy": "Точность (accuracy)", "same": "✅ Общее число слов, размеченных всеми библиотеками: **{}** (совпадает у всех библиотек).", "differs": "⚠️ Внимание: общее число слов различается между библиотеками: {}",
        "details": "Детальная сводка по библиотекам", "sentences": "Обработано предложений", "matched": "Сопоставлено слов с эталоном", "gold_words": "Слов с ударением в эталоне", "load_time": "Время загрузки", "process_time": "Время обработки", "sec": "сек",
        "errors_head": "Ошибки", "wrong": "Неверно поставленное ударение", "lacking": "Пропущенное ударение", "by_count": "Несовпадение по кол-ву слов", "by_text": "Несовпадение по тексту слов", "in_sentences": "Предложения с несовпадениями",
        "common_line": "**Общие слова:** {} слов, ошибок: {}, точность: **{}**", "made": "Отчёт сгенерирован: {}", "unknown": "не указано",
    },
}


def number(x: float | int) -> str:
    return f"{x:.4f}" if isinstance(x, float) else f"{x:,}".replace(",", " ")


def percent(part: int, whole: int) -> str:
    return f"{part / whole:.2%}" if whole else "—"


def table(head: list[str], rows: list[list[str]]) -> list[str]:
    return ["| " + " | ".join(r) + " |" for r in (head, ["---"] * len(head), *rows)] + [""]


def report_rows(totals: DataFrame, common: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """A row per annotator with everything that a report shows of it."""
    out = totals.join(common.select("lib", "common", F.col("errors").alias("common_errors")), "lib", "left").na.fill(0, ["common", "common_errors"])
    if performance is None:
        return out.withColumns({"load_time_seconds": F.lit(0.0), "process_time_seconds": F.lit(0.0)})
    return out.drop("exceptions").join(performance, "lib", "left").na.fill(0)


def markdown(rows: DataFrame, language: str = "en", about: Mapping[str, str] | None = None) -> str:
    """The report; `rows` has one row per annotator, which is all that reaches the driver."""
    t, about = TEXTS[language], about or {}
    libs = [r.asDict() for r in rows.orderBy("lib").toLocalIterator()]
    name = lambda r: f"`{r['lib']}`"
    total = lambda c: sum(r[c] for r in libs)
    out = [f"# {t['title']}", "", f"> {t['about']}", "", f"## {t['general']}", ""]
    n_sentences = max((r["sentences"] for r in libs), default=0)
    out += table([t["parameter"], t["value"]], [[t["date"], f"`{about.get('timestamp', t['unknown'])}`"], [t["set"], f"**{number(n_sentences)}**"], [t["gold"], f"`{about.get('gold_file', t['unknown'])}`"], [t["count"], f"**{len(libs)}**"]])
    out += [f"### {t['compared']}", "", *(f"{i}. {name(r)}" for i, r in enumerate(libs, 1)), "", f"## {t['performance']}", "", t["performance_about"], ""]
    out += table([t["library"], t["load"], t["process"], t["exceptions"]], [[name(r), number(r["load_time_seconds"]), number(r["process_time_seconds"]), f"**{r['exceptions']}** ❌" if r["exceptions"] else "0 ✅"] for r in libs])
    if libs:
        out += [t["total"].format(number(total("load_time_seconds")), number(total("process_time_seconds")), total("exceptions")), ""]
    counts = ["stress_errors", "missing_stress", "unmatched_diff", "unmatched_same", "sentences_unmatched"]
    out += [f"## {t['errors']}", "", t["errors_about"], ""]
    out += table([t["library"], t["stress"], t["missing"], t["unmatched_count"], t["unmatched_text"], t["unmatched_sentences"]], [[name(r), *(number(r[c]) for c in counts)] for r in libs])
    if libs:
        out += [t["errors_total"].format(*(number(total(c)) for c in counts)), ""]
    out += [f"## {t['common']}", "", t["common_about"], ""]
    out += table([t["library"], t["common_total"], t["stress"], t["accuracy"]], [[name(r), number(r["common"]), number(r["common_errors"]), percent(r["common"] - r["common_errors"], r["common"])] for r in libs])
    sizes = sorted({r["common"] for r in libs})
    out += [t["same"].format(number(sizes[0])) if len(sizes) == 1 else t["differs"].format(", ".join(map(str, sizes))), "", f"## {t['details']}", ""]
    for r in libs:
        out += [f"### {name(r)}", "", f"- **{t['sentences']}:** {number(r['sentences'])}", f"- **{t['matched']}:** {number(r['matched_pairs'])}", f"- **{t['gold_words']}:** {number(r['gold_words_with_stress'])}"]
        out += [f"- **{t['load_time']}:** {number(r['load_time_seconds'])} {t['sec']}", f"- **{t['process_time']}:** {number(r['process_time_seconds'])} {t['sec']}", f"- **{t['exceptions']}:** {r['exceptions']}", "", f"**{t['errors_head']}:**"]
        out += [f"- {t[k]}: **{number(r[c])}**" for k, c in zip(("wrong", "lacking", "by_count", "by_text", "in_sentences"), counts, strict=True)]
        if r["common"]:
            out += ["", t["common_line"].format(number(r["common"]), number(r["common_errors"]), percent(r["common"] - r["common_errors"], r["common"]))]
        out.append("")
    return "\n".join([*out, "---", "", f"*{t['made'].format(datetime.now().isoformat())}*", ""])
