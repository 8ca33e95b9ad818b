import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # extra columns whose names the operators use themselves
    T.StructField("key", T.StringType()), T.StructField("row", T.StringType()), T.StructField("size", T.LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang, source)"""
        full = [(*r, *("en", "s")[len(r) - 2:]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(
            [(i, t, g, s, None if t is None else len(t), "k", "r", 5) for i, t, g, s in full], SCHEMA)

    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

    return make


#: null, empty, blank, tiny, repeated rows, repeated ids, null ids
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "two words"), (5, "other"), (None, "x y z"),
        (None, None), (6, "é ü ß 漢字")]
