import public_tokenizers
import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = (1 << 60) + 1  # beyond the exact range of doubles


@pytest.fixture(scope="session")
def paths():
    return {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, ties, equal rows, big keys, one very long text, special strings."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000)) + "\nend."
    passage = "first shared line of a passage\nsecond shared line of a passage\nthird shared line of it"
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "  \n\t ", None, None, 5), (BIG, "Grüße an 日本 don't <|endoftext|> 'll 12", "de", "b", 1),
        (None, "no key here at all, still some words to read", "en", "b", 1), (None, None, None, None, None), (7, long, "en", "c", len(long)),
        (8, "same text twice " * 6, "en", "a", 1), (8, "same text twice " * 6, "en", "a", 1), (8, "same key but other words", "en", None, 1),
        (9, "x\n" + passage, "en", "c", 1), (10, passage + "\ny", "en", "a", 1), (11, "a" * 5000, "en", "b", 5000), (12, "<|startoftext|> ÀÉ Σίσυφος ΟΔΟΣ", "el", "a", 1),
    ]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_key(frame, key="doc_id"):
    """Rows as dicts in key order."""
    rows = [r.asDict(recursive=True) for r in frame.collect()]
    return sorted(rows, key=lambda r: (r[key] is not None, r[key] or 0, str(sorted(map(str, r.items())))))
