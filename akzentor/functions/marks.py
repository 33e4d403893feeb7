"""Stress marks as column expressions: reading, writing and comparing them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from akzentor.functions import scan
from akzentor.functions.alphabet import ACUTE, GRAVE, LETTERS, MARKS, NOT_V, PLUS, VOWELS, WORD, V, in_class


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def remove_marks(text: Column | str) -> Column:
    """The text without plus signs, acutes and graves."""
    return F.translate(_col(text), MARKS, "")


def unmarked(text: Column | str) -> Column:
    """`remove_marks` of long texts."""
    return F.arrow_udf(scan.unmarked, "string")(_col(text))


def to_plus(text: Column | str) -> Column:
    """Combining marks, and pluses that stand after their vowel, as a plus before the vowel."""
    return F.arrow_udf(scan.pluses, "string")(_col(text))


def _units(text: Column) -> Column:
    """Stressed vowels with their mark, and single signs."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(\+{V}|{V}[{GRAVE}{ACUTE}]|.)"), F.lit(1))


def stress_positions(text: Column | str) -> Column:
    """Places of stressed vowels in the text without marks, from 0. Meant for words and for use within expressions, for
    its time grows with the square of their number; `stress_places` is for texts."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, u: Column) -> Column:
        clean, stressed = F.length(remove_marks(u)), F.length(u) == 2
        return F.struct((acc["at"] + clean).alias("at"), F.when(stressed, F.array_append(acc["found"], acc["at"])).otherwise(acc["found"]).alias("found"))

    return F.aggregate(_units(_col(text)), start, step, lambda acc: acc["found"])


def stress_places(text: Column | str) -> Column:
    """`stress_positions` of texts of any length."""
    return F.arrow_udf(scan.stress_places, "array<int>")(_col(text))


def acutes(text: Column | str) -> Column:
    """Marked text with an acute after each stressed vowel and no other mark, in one pass over it."""
    return F.arrow_udf(scan.acutes, "string")(_col(text))


def first_stress(word: Column | str) -> Column:
    """Place of a marked word's first stressed vowel in the word without marks; null if none."""
    w = _col(word)
    upto = F.regexp_extract(w, rf"(?s)^(.*?(?:\+{V}|{V}[{GRAVE}{ACUTE}]))", 1)
    return F.nullif(F.length(remove_marks(upto)), F.lit(0)) - 1


def insert_at(clean: Column | str, positions: Column | str, mark: str = PLUS, after: bool = False) -> Column:
    """The text with a mark before, or after, each of the places; meant for words, for its time
    grows with the text's length times the number of places."""
    at = _col(positions)
    signs = F.split(_col(clean), "")
    return F.array_join(F.transform(signs, lambda c, i: F.when(F.array_contains(at, i), F.concat(c, F.lit(mark)) if after else F.concat(F.lit(mark), c)).otherwise(c)), "")


def annotate(clean: Column | str, positions: Column | str) -> Column:
    """A plus before each stressed vowel."""
    return insert_at(clean, positions)


def accent(clean: Column | str, positions: Column | str) -> Column:
    """A combining acute after each stressed vowel."""
    return insert_at(clean, positions, ACUTE, after=True)


def vowels_of(word: Column | str) -> Column:
    return F.regexp_replace(_col(word), NOT_V + "+", "")


def count_vowels(word: Column | str) -> Column:
    return F.length(vowels_of(word))


def vowel_positions(word: Column | str) -> Column:
    w = _col(word)
    places = F.when(F.length(w) > 0, F.sequence(F.lit(0), F.length(w) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.contains(F.lit(VOWELS), F.substr(w, i + 1, F.lit(1))))


def nth_vowel(word: Column | str, n: Column) -> Column:
    """Place of the vowel with a number, from 0; null if there is none. With all vowels made one,
    it is the length of what stands before that one's nth place."""
    w = _col(word)
    one = VOWELS[0]
    at = F.length(F.call_function("substring_index", F.translate(w, VOWELS, one * len(VOWELS)), F.lit(one), n + 1))
    return F.nullif(at, F.length(w))


def first_vowel(word: Column | str) -> Column:
    """Place of the first vowel; null if there is none."""
    w = _col(word)
    return F.nullif(F.length(F.regexp_extract(w, f"^({NOT_V}*{V})", 1)), F.lit(0)) - 1


def vowel_index(word: Column | str, char_index: Column | str) -> Column:
    """Ordinal among the word's vowels of the vowel at a place; null if there is none."""
    w, at = _col(word), _col(char_index)
    here = F.substr(w, at + 1, F.lit(1))
    return F.when(at.isNotNull() & (F.length(here) == 1) & F.contains(F.lit(VOWELS), here), count_vowels(F.substr(w, F.lit(1), at)))


def fold(word: Column | str) -> Column:
    """Lower case, yo as ye: the form in which words are looked up and compared."""
    return F.translate(F.lower(_col(word)), "ё", "е")


def fold_form(word: Column | str) -> Column:
    """`fold` without combining marks, for morphological look-ups."""
    return F.translate(F.lower(_col(word)), f"ё{ACUTE}{GRAVE}", "е")


def same_word(a: Column | str, b: Column | str) -> Column:
    return fold(a) == fold(b)


def needs_stress(word: Column | str) -> Column:
    """Two vowels or more, and no yo."""
    w = _col(word)
    return (count_vowels(w) >= 2) & ~F.rlike(w, F.lit("[ёЁ]"))


def is_scored(word: Column | str, char_index: Column | str, start: Column | None = None) -> Column:
    """Words that count in an evaluation: they need a stress, have one, and hold no hyphen."""
    w, at = _col(word), _col(char_index)
    out = at.isNotNull() & ~F.contains(w, F.lit("-")) & needs_stress(w)  # the cheap tests first
    return F.coalesce(out if start is None else out & start.isNotNull(), F.lit(False))


def is_russian(word: Column | str) -> Column:
    return F.rlike(_col(word), F.lit("^" + in_class(WORD) + "+$"))


def yo_position(word: Column | str) -> Column:
    """Place of the first small yo, else of the first capital one, else -1."""
    w = _col(word)
    small, capital = F.instr(w, "ё"), F.instr(w, "Ё")
    return F.when(small > 0, small - 1).otherwise(capital - 1)


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common prefix."""
    x, y = _col(a), _col(b)
    n = F.least(F.length(x), F.length(y))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1)))
    miss = F.array_position(same, False)
    return F.when(n == 0, F.lit(0)).when(miss == 0, n).otherwise((miss - 1).cast("int"))


def form_position(word: Column | str, form: Column | str) -> Column:
    """Place in a word of the stress that a marked form shows: the vowel before the form's first
    acute, carried over by its ordinal where form and word differ. Null if the form shows none, the
    sign before the mark is no vowel, or the words' vowels differ in number."""
    w, f = _col(word), _col(form)
    mark = F.instr(f, ACUTE)
    clean = F.translate(f, ACUTE + GRAVE, "")
    at = F.length(F.translate(F.substring_index(f, ACUTE, 1), ACUTE + GRAVE, "")) - 1
    here = F.substr(clean, at + 1, F.lit(1))
    ok = (mark > 1) & F.contains(F.lit(VOWELS), here) & (F.length(here) == 1)
    nth = count_vowels(F.substr(clean, F.lit(1), at))
    moved = F.when(count_vowels(w) == count_vowels(clean), F.get(vowel_positions(w), nth))
    return F.when(ok, F.when(F.lower(clean) == F.lower(w), at).otherwise(moved))


def variant_positions(variants: Column | str) -> Column:
    """Distinct stress places, in order, of a JSON object whose keys are words with a plus."""
    keys = F.filter(F.json_object_keys(_col(variants)), lambda k: F.contains(k, F.lit(PLUS)))
    return F.array_sort(F.array_distinct(F.transform(keys, lambda k: F.instr(k, PLUS) - 1)))


def number_text(x: Column | str, is_float: bool = False) -> Column:
    """Report form of a number: four decimals, or thousands set off by blanks."""
    return F.format_string("%.4f", _col(x)) if is_float else F.replace(F.format_number(_col(x), 0), F.lit(","), F.lit(" "))


def percent_text(part: Column | str, whole: Column | str) -> Column:
    """Report form of a share: two decimals, a dash for none."""
    return F.when(_col(whole) == 0, F.lit("—")).otherwise(F.format_string("%.2f%%", _col(part) / _col(whole) * 100))


assert len(LETTERS) == 33
