import pytest

LONG = " ".join(f"wort{i % 977}x{i % 31}" for i in range(30_000))
#: Nulls, empty and very long texts, repeated rows, equal texts, a shared id.
EDGE_ROWS = [
    (1, "one two three four five six seven", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "   \n\t ", "fr"),
    (5, LONG, "de"),
    (6, "one two three four five six seven", "en"),
    (6, "one two three four five six seven", "en"),
    (7, "é", "fr"),
    (7, "another text of the same id", "fr"),
    (None, "a text without an id", "en"),
    (None, None, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Edge rows with further columns that are named like the operators' own."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(EDGE_ROWS, "doc_id bigint, text string, lang string")
    clash = ("length", "node", "score", "bucket", "rank", "component", "anchor", "n", "start", "class_id", "cuts", "nats")
    return rows.withColumns({c: F.lit(7) for c in clash})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (5, 1, 0), (7, 0, 1), (None, 1, 1), (2, None, None), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
