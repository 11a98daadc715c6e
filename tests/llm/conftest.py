import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
EDGE_ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, LONG, "en", "b", len(LONG)),
    (5, "one", "en", "b", 3), (6, "The same text of a few words here.", "en", "c", 34), (6, "The same text of a few words here.", "en", "c", 34),
    (7, "The same text of a few words here.", "en", None, 34), (None, "a row without id", None, "c", None), (8, "Ünïcödé ñandú 日本語 \U0001f600 x", "es", "é", 20),
]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Nulls, empty and long texts, repeated rows, and extra columns named like the operators' own."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    frame = spark.createDataFrame(EDGE_ROWS, DOCUMENTS)
    extra = ("size", "score", "code", "row", "shard", "slot", "hash", "__row", "rate", "__mix_rate", "component", "bytes", "label", "word")
    for name in extra:
        frame = frame.withColumn(name, F.lit(7))
    frame.coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], DOCUMENTS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
