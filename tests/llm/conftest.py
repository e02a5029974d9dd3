import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    words = " ".join(f"word{i % 97} and" for i in range(3000))
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, words, "en", "a"), (5, "short text here", "de", None), (5, "short text here", "de", None),
        (None, "a row without an id but with words in it", None, "b"), (7, "日本語 のテキスト です", "ja", "b"), (8, "x" * 50_000, "en", "b"), (9, "1234 5678 !!", None, "a"),
    ]
    rows = [(*r, None if r[1] is None else len(r[1]), "extra", 0, "other") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string, node int, _chosen string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")
