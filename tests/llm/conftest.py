import pytest

LONG = " ".join(f"word{i % 997} runs{i % 31}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog while nine other animals watch it go by."),
    (2, "The quick brown fox jumps over the lazy dog while nine other animals watch it go by."),
    (3, ""),
    (4, None),
    (None, "A text without an id, of a few words only."),
    (None, None),
    (5, "  \t\n "),
    (6, LONG),
    (6, LONG),
    (7, "É çà ß 漢字 <|endoftext|> 123 \x00 !!"),
    (8, "one"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, h string, w string, fp string, part string, score string, marks string, x string, label string, pii string, `__text` string, component_id string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with the names that the operators use inside."""
    rows = [(i, t, None if i == 3 else "en", "s", len(t or ""), 1, "h", "w", "f", "p", "s", "m", "x", "l", "q", "t", "c") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
