import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, text_crc32 string, n int, start string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(4000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, blanks, a long text, ties, repeated rows, and extra columns with clashing names."""
    passage = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of great and lasting power "
    rows = [
        (1, "", None, 1, "x"), (2, None, "a", None, None), (3, "one two", "b", 2, "y"), (4, "One\ttwo ", None, 3, ""),
        (5, LONG, "c", 4, "z"), (6, LONG + " tail", "c", 4, "z"), (7, passage * 3, None, None, None),
        (8, "Start. " + passage * 3 + "end.", None, 5, "q"), (9, passage * 3, None, 6, "q"),
        (10, "日本語 ①😀 a  b\n\n c\r\n\x00 ▁d", None, 7, None), (11, " \t\n", None, 8, None),
        (12, "same same same same same same same same same", "d", 9, "w"),
        (12, "same same same same same same same same same", "d", 9, "w"), (None, "no id at all here", None, 10, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
