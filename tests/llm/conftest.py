import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, kept boolean, topic string, weight double, _text string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 5000}." for i in range(60_000))
    texts = ["", None, " \n\t ", "one", "Two words", "same text here again", "same text here again", long, "ünï çødé ½ 😀 <|endoftext|> x", "a | b | c", "#$% &&& ***", "the and of to in the and of to in"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s1", None, i, 0.5, None, "t", 1.0, "clash") for i, t in enumerate(texts)]
    rows += [rows[5], rows[3], (None, "one", None, None, None, 0, None, None, None, None, None), (None, None, None, None, None, 0, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
