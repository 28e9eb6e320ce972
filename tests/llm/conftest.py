import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(texts, **extra):
        rows = [(x[0], x[1], x[2] if len(x) > 2 else "en", "s", 0) if isinstance(x, tuple) else (k, x, "en", "s", 0) for k, x in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


ODD = ["", None, " \t\n", "one", "One", "word " * 5000, "日本語 テキスト", "a\x00b", "🙂 🙂 🙂", "x" * 30000, "one", "3.4.5.6 +1 (269) 555-3296", "\u0085\x1c"]


@pytest.fixture
def odd():
    """Empty, null, very long and strange texts, ties, repeated rows, a null id."""
    return [(k, t) for k, t in enumerate(ODD)] + [(None, "no id here"), (3, "one"), (3, "one")]
