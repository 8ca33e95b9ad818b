"""Small helpers shared by the text operators.

Operators read only the columns they name, so further columns of the input
(whatever their names) never clash with internal ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ensure_checkpoint_dir

SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()``; later stages survive the loss of
    any executor because the files live in the folder all executors share.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(id_col, text_col):
    """16-byte key of (doc_id, text).  Rows equal in both share a key, and get
    the same result; a hot doc_id or a null one is spread by its texts."""
    shown = F.coalesce(F.concat(F.lit("i"), id_col.cast("string")), F.lit("n"))
    body = F.coalesce(F.concat(F.lit("t"), text_col), F.lit("n"))
    return F.unhex(F.md5(F.concat(shown, F.lit("\u0001"), body)))


def held_out(id_col, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod ``modulus`` is ``remainder`` (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == remainder, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a few hundred rows, so Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def as_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def as_text(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


class Memo(dict):
    """Memo of a pure function of one word; emptied when it has ``limit`` entries,
    so its memory is bounded on any vocabulary."""

    def __init__(self, fn, limit: int = 200_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (multiply / xor-shift finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def labelled_ids(labels: DataFrame, label: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled, not held-out doc_ids in a seeded order.

    A doc_id that is labelled more than once counts with its largest label;
    null ids and null labels are left out.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .filter(~held_out(F.col("doc_id"), modulus, remainder))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    order = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    return ids.select("doc_id", "label", order.alias("ord")).orderBy("ord", "doc_id").limit(bound)


def one_text_per_id(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, text): of rows (doc_id, text, ..) one for each doc_id, the one with the least text hash.
    ``columns`` hold doc_id and what depends on it alone; a hot id is combined before the shuffle."""
    return rows.groupBy(*columns).agg(F.min_by("text", F.md5("text")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int,
                    bound: int) -> DataFrame:
    """The documents of ``labelled_ids``, one row for each id: (ord, doc_id, label, text).

    The id list holds at most ``bound`` rows, which is what makes it safe to
    broadcast; the texts themselves stay distributed.
    """
    ids = labelled_ids(labels, label, modulus, remainder, bound)
    return one_text_per_id(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "ord", "doc_id", "label")
