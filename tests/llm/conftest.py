import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, block string, kept string, score string, slot string, norm string, held_out string, label string"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), 7, "f", "b", "k", "s", "x", "n", "h", "l")


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids, null, empty and very long texts, ties, repeated rows, and columns named like inner ones."""
    long = " ".join(f"word{k % 5000}" for k in range(60_000))
    rows = [
        row(1, "The quick brown fox jumps over the lazy dog."),
        row(2, "The  quick brown\nfox jumps over the lazy dog."),
        row(2, "The  quick brown\nfox jumps over the lazy dog."),
        row(3, None, None, None),
        row(4, ""),
        row(5, " \t\n"),
        row(6, long),
        row(7, long + " end"),
        row(None, "no id here", "de", "b"),
        row(None, None, None, None),
        row(8, "ÄÖÜ äöü ñ é İ \u2028 x", "de", "b"),
        row(9, "x" * 100_000, "de", "b"),
        row(10, "12345 !!! 67", "de", "b"),
        row(11, "the quick brown fox jumps over the lazy dog.", "en", "c"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def prose(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
