"""Letters, vowels and marks, and the one-to-one stand-in for Cyrillic text."""

from __future__ import annotations

VOWELS_LOWER = "аеёиоуыэюя"
VOWELS = VOWELS_LOWER + VOWELS_LOWER.upper()
LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
#: Signs of a word; hyphens belong to it.
WORD = "-" + LETTERS + LETTERS.upper()
GRAVE, ACUTE, PLUS = "\u0300", "\u0301", "+"
MARKS = PLUS + ACUTE + GRAVE
#: What the character model knows, in the order of its ids: a blank and the letters.
MODEL_LETTERS = " " + LETTERS

#: Latin test text is read as Cyrillic sign by sign; vowels stay vowels.
SOURCE = "abcdefghijklmnopqrstuvwxyzéóèñçüêäöí"
TARGET = "абцдефгхийклмнопкрстувшхызеоэнчюеяёи"
LATIN, CYRILLIC = SOURCE + "ß" + SOURCE.upper(), TARGET + "щ" + TARGET.upper()


def in_class(signs: str) -> str:
    """A regular expression's class of these signs, neighbours in the code as ranges: Java tests
    the parts of a class one by one."""
    runs: list[list[int]] = []
    for c in sorted({ord(c) for c in signs if c != "-"}):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(chr(x) if x == y else f"{chr(x)}-{chr(y)}" for x, y in runs) + ("-" if "-" in signs else "") + "]"


V, NOT_V = in_class(VOWELS), "[^" + in_class(VOWELS)[1:]
W, NOT_W = in_class(WORD), "[^" + in_class(WORD)[1:]
#: With stress marks in the text.
MW, NOT_MW = in_class(WORD + MARKS), "[^" + in_class(WORD + MARKS)[1:]
