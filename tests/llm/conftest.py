import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def tokenizer_path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, id string, n string"
LONG = ("слово word ein Wort " * 40_000).strip()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns whose names the
    operators use themselves."""
    rows = [
        (1, "The cat sat on the mat and looked at the dog. <|endoftext|> Again.", "en", "a", 60),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \n ", "fr", "b", 5), (5, LONG, "de", "c", len(LONG)),
        (6, "It's 1999's 'best' offer!!  \t\n\n naïve café 日本語 😀 ٣ ՘", None, "b", 50), (6, "It's 1999's 'best' offer!!  \t\n\n naïve café 日本語 😀 ٣ ՘", None, "b", 50),
        (None, "a text without an id", "en", None, 20), (7, "a" * 70_000, "en", "a", 70_000), (8, "12345 67890 ... !!!", "en", "a", 19),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
