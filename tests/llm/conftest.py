import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, fingerprint string, labels string, `spans` string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}" if i % 5 else None, len(t or ""), "a", "b", "c", "d", "e") for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    """Documents of given texts, with extra columns whose names clash with results."""

    def make(texts, first=0, repeat=()):
        rows = rows_of(texts, first)
        return spark.createDataFrame(rows + [rows[i] for i in repeat], SCHEMA)

    return make


@pytest.fixture
def odd_texts():
    return [None, "", " \t\n", "...", "a", "Word", "É ü 漢字 ß", "the quick brown fox " * 3000, "x" * 200_000, "same text here again and again", "same text here again and again", "\x00\x1f mixed\x7f controls", "@@@@ .... ++++ ====", "0123456789" * 50]
