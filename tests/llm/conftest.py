import pytest

#: Nulls, empty and long texts, ties, repeated rows.
HARD = [
    (1, "The idea of a test."), (2, "The idea of a test."), (None, "no id"), (3, None), (4, ""), (5, " "), (6, "a  b\n\nc \t d"),
    (7, "ÀÉÎ õü ß — “quoted”, 日本語 ,. ... !?"), (8, "word " * 30_000), (9, "x" * 5_000), (9, "x" * 5_000), (10, "<|endoftext|> is text, or not."),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Extra columns have the names that operators use for their own."""
    rows = [(i, t, "en", "s", 0, 7, b"x") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, length int, ids binary")
