"""Command line: init, run, status, clean, list-adapters."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akzentor.engine import load_engine
from akzentor.operators import annotators
from akzentor.plans import report
from akzentor.plans.evaluate import evaluate
from akzentor.session import ready
from akzentor.sources import lexicons
from akzentor.sources.config import Cache, Config, Library, file_digest, text_digest
from akzentor.sources.scratch import shared_dir
from akzentor.sources.text import read_lines

KEYS = ["path", "line_no"]
#: Libraries that are this package's own engine, without and with morphology.
OWN = {"engine": False, "engine_morph": True}
log = logging.getLogger("akzentor")


def gold_sentences(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text) of gold files, whatever their encoding."""
    return read_lines(spark, path)


def run(spark: SparkSession, config: Config, gold_path: str, names: list[str], force: bool = False) -> dict[str, str]:
    """Annotates with the chosen libraries, or takes their stored results where they still hold,
    evaluates these and writes the reports; returns language -> report file."""
    ready(spark)
    annotators.discover(config.adapters_dir)
    chosen = config.select(names)
    gold_hash, config_hash, cache = file_digest(gold_path), config.digest(), Cache(config.cache_dir)
    gold = gold_sentences(spark, f"file://{Path(gold_path).resolve()}")
    # Executors write the annotators' results: on a cluster into the folder that all share.
    local = spark.sparkContext.master.startswith("local")
    stored = f"file://{Path(config.cache_dir).resolve()}" if local else f"{shared_dir(spark)}/akzentor-cache"
    runs: list[DataFrame] = []
    for lib in chosen:
        out = f"{stored}/{lib.name}-{gold_hash[:12]}-{config_hash[:12]}.parquet"
        if force or cache.status(lib.name, gold_hash, config_hash) != "VALID":
            log.info("annotating with %s", lib.name)
            if lib.name in OWN and lib.name not in annotators.registered():
                said = annotators.annotate_by_engine(load_engine(spark, config.assets_dir, OWN[lib.name]), gold, lib.name, KEYS)
            else:
                said = annotators.annotate(gold, lib.name, KEYS)
            said.write.mode("overwrite").parquet(out)
            cache.put(lib.name, gold_hash, config_hash, out, text_digest(out))
        runs.append(spark.read.parquet(cache.entries[lib.name].output_file))
    if not runs:
        raise ValueError("no library is configured")
    said = runs[0]
    for other in runs[1:]:
        said = said.unionByName(other)
    dubious = lexicons.read_dubious(spark, config.dubious_file) if config.dubious_file else None
    found = evaluate(gold, said.select("lib", *KEYS, "accented_text", (F.size("errors") > 0).alias("error")), KEYS, [x.name for x in chosen], dubious).stored()
    rows = report.report_rows(found.totals, found.common, annotators.performance(said)).cache()
    Path(config.output_dir).mkdir(parents=True, exist_ok=True)
    written = {}
    for language in config.reports:
        written[language] = f"{config.output_dir}/report_{language}.md"
        Path(written[language]).write_text(report.markdown(rows, language, {"gold_file": gold_path}), encoding="utf-8")
    rows.unpersist()
    return written


def status(config: Config, gold_path: str | None) -> list[tuple[str, str]]:
    """(library, state), with stored libraries that are no longer configured at the end."""
    cache = Cache(config.cache_dir)
    gold = file_digest(gold_path) if gold_path else ""
    names = [x.name for x in config.libraries]
    return [*((n, cache.status(n, gold or (cache.entries[n].gold_hash if n in cache.entries else ""), config.digest())) for n in names), *((n, "NOT CONFIGURED") for n in cache.orphans(names))]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="akzentor", description=__doc__)
    p.add_argument("-c", "--config", default="akzentor.json")
    p.add_argument("-v", "--verbose", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("--force", action="store_true")
    go = sub.add_parser("run")
    go.add_argument("--gold", required=True)
    go.add_argument("--libs", nargs="*", default=[])
    go.add_argument("--force", action="store_true")
    go.add_argument("-o", "--output")
    go.add_argument("--cache-dir")
    go.add_argument("--reports", nargs="*")
    state = sub.add_parser("status")
    state.add_argument("--gold")
    clean = sub.add_parser("clean")
    clean.add_argument("--all", action="store_true")
    clean.add_argument("--lib")
    sub.add_parser("list-adapters")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING)
    if a.command == "init":
        try:
            Config([Library("example")]).write(a.config, a.force)
        except FileExistsError:
            print(f"{a.config} is there; --force writes over it")
            return 1
        return 0
    if not Path(a.config).exists():
        Config([Library("example")]).write(a.config)
        print(f"{a.config} was made; put the libraries into it")
        return 1
    config = Config.read(a.config)
    if a.command == "status":
        for name, what in status(config, a.gold):
            print(f"{name:<24} {what}")
    elif a.command == "clean":
        if not a.all and not a.lib:
            print("--all or --lib NAME is needed")
            return 1
        Cache(config.cache_dir).drop(None if a.all else a.lib)
    elif a.command == "list-adapters":
        print("\n".join(annotators.discover(config.adapters_dir)))
    else:
        config.output_dir, config.cache_dir, config.reports = a.output or config.output_dir, a.cache_dir or config.cache_dir, a.reports or config.reports
        Path(config.output_dir).mkdir(parents=True, exist_ok=True)
        written = logging.FileHandler(f"{config.output_dir}/akzentor.log", encoding="utf-8")
        written.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(written)
        log.setLevel(logging.INFO)
        spark = SparkSession.builder.appName("akzentor").getOrCreate()
        try:
            for language, path in run(spark, config, a.gold, a.libs, a.force).items():
                log.info("%s: %s", language, path)
                print(f"{language}: {path}")
        finally:
            log.removeHandler(written)
            written.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
