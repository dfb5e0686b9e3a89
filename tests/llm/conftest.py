import pytest

LONG = "lorem ipsum dolor sit amet " * 4000

DOCS = [
    (1, "Call me at +1 (988) 555-2485 or a.b@c.example.com. The quick brown fox jumps over the lazy dog again and again today."),
    (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (6, "Released under the MIT License. licensed under cc by nc 4.0"),
    (7, "The quick brown fox jumps over the lazy dog again and again today."), (8, "the quick brown fox jumps over the lazy dog again and again TODAY."),
    (None, "The quick brown fox jumps over the lazy dog again and again today."), (None, None), (9, "é\U0001f600 ünïcode K İ 1.2.3.4 4111 1111 1111 1111"),
    (10, "x"), (10, "another text with the id ten " * 9),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and extra columns whose names clash with operators' own."""
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 2}", None if t is None or k % 5 == 0 else len(t), k, f"e{k}", k % 2 == 0, [k]) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `id` int, `th` string, `quality_score` boolean, `spans` array<int>")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
