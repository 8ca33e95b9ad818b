"""Document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of letters and digits, folded to lower case; every other character
but white space is a token of its own, and so is every character of a script that
is written without spaces (Han, kana, Thai, Lao, Khmer, Myanmar).  ``gram``
consecutive tokens are hashed at every place, and of every ``window`` consecutive
hashes the smallest is kept, the rightmost one of equals, with its place.  So any
passage of ``gram + window - 1`` tokens that two texts share leaves a common hash in
both fingerprints, and about 2 / (window + 1) of all hashes are kept.

A hash and its place share one long (33 bits of the hash, then the place counted
down), so that one ``least`` decides by hash and then for the rightmost; the windows'
minima come from log2(window) element-wise passes.  The full 64-bit hash is read
back at the places kept.  Work on a row is linear in its text, in its own task.

* fewer than ``gram`` tokens: one hash of them all; fewer than ``window`` hashes: the smallest
* null, empty and blank texts: an empty fingerprint; two empty ones are alike (1.0), an
  empty one is unlike any other (0.0)
* repeated rows get equal fingerprints; an empty table gives an empty result
* one text's tokens must fit in a task (a few GB at 2^31 characters)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import materialise

_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_ALONE}]]+|\S"
_PLACE = (1 << 31) - 1


@dataclass(frozen=True)
class WinnowParams:
    gram: int = 4  # tokens hashed together
    window: int = 4  # consecutive hashes of which one is kept


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def gram_hashes(words: Column, gram: int) -> Column:
    """Hash of every ``gram`` consecutive elements; of all if there are fewer."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - gram),
                       lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(gram)]))
    empty = F.array().cast("array<bigint>")
    return F.when(n >= gram, each).when(n > 0, F.array(F.xxhash64(words))).otherwise(empty)


def _least(a: Column, ahead: int) -> Column:
    """Minimum of every element and the one ``ahead`` places on."""
    n = F.size(a) - ahead
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(ahead + 1), n), lambda x, y: F.least(x, y))


def window_minima(packed: Column, window: int) -> Column:
    """Minimum of every ``window`` neighbours, by doubling; needs as many elements."""

    def widen(a: Column, width: int) -> Column:
        if width == window:
            return a
        step = min(width, window - width)
        return _bound(_least(a, step), lambda b: widen(b, width + step))

    return widen(packed, 1)


def winnow(text: Column, p: WinnowParams = WinnowParams()) -> Column:
    """array<struct<hash bigint, place int>> of the fingerprint, by place (the gram's first token, from 0)."""

    def kept(hashes: Column) -> Column:
        packed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.lit(_PLACE) - i))
        minima = _bound(packed, lambda a: F.when(F.size(a) >= p.window, window_minima(a, p.window))
                        .when(F.size(a) > 0, F.array(F.array_min(a))).otherwise(a))

        def full(value: Column) -> Column:
            place = (F.lit(_PLACE) - value.bitwiseAND(F.lit(_PLACE))).cast("int")
            return F.struct(F.get(hashes, place).alias("hash"), place.alias("place"))

        return F.transform(F.array_distinct(minima), full)

    return _bound(tokens(text), lambda words: _bound(gram_hashes(words, p.gram), kept))


def fingerprints(docs: DataFrame, p: WinnowParams = WinnowParams(), text: str = "text", to: str = "prints") -> DataFrame:
    """``docs`` with the fingerprint of its column ``text`` in a further column ``to``."""
    return docs.withColumn(to, winnow(F.col(text), p))


def hashes_of(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes (Jaccard) of two arrays of distinct hashes."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, F.lit(1.0)).otherwise(common.cast("double") / both)


def shown(prints: Column) -> Column:
    """``hash@place`` of every print, comma-joined."""
    return F.array_join(F.transform(prints, lambda x: F.concat(
        F.hex(x["hash"]), F.lit("@"), x["place"].cast("string"))), ",")


def beside_next(docs: DataFrame, p: WinnowParams = WinnowParams(), parts: int | None = None) -> DataFrame:
    """(doc_id, text, prints, next_text, next_prints): every row beside the next one in
    descending order of doc_id (null last; rows of one id by a hash of their text); the
    row after the last is the first.

    No task sees the whole order: rows go to ranges of the order by bounds (at most
    ``parts``, from Spark's own range partitioning of the ids), a window looks one row
    back inside each range, and a copy of the last row of the range before (one row a
    range) stands at its head.  Rows that are equal in id and text are told apart by their
    place in the scan, so that a repeated row spreads over ranges too.  Texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("salt"), "text")
    order = ["doc_id", "tie", "salt"]  # ascending, null first: the next document is the row before
    small = materialise(rows.select(*order))
    ranges = small.repartitionByRange(parts, *order).groupBy(F.spark_partition_id()).agg(F.min(F.struct(*order)).alias("head"))
    bounds = materialise(ranges.agg(F.sort_array(F.collect_list("head")).alias("bounds")))  # one row of <= parts bounds
    steps = [1 << k for k in reversed(range(parts.bit_length()))]

    def placed(df: DataFrame) -> DataFrame:
        """The number of bounds that are not above the row, by binary search."""
        key = F.struct(*order)
        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
            F.coalesce(F.get("bounds", at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))
        return df.crossJoin(F.broadcast(bounds)).withColumn("range", found).drop("bounds")  # one row

    # the last row of every range, told to the next range that has rows; at most ``parts`` rows
    last = placed(small).groupBy("range").agg(F.max(F.struct(*order)).alias("last"))
    following = Window.orderBy("range")
    lead = F.coalesce(F.lead("range").over(following), F.min("range").over(Window.partitionBy()))
    last = materialise(last.select(lead.alias("range"), "last.*"))
    found = rows.alias("r").join(
        F.broadcast(last.alias("l")),  # at most ``parts`` rows
        F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.tie") == F.col("l.tie")))
    heads = found.groupBy("l.range", "l.doc_id", "l.tie", "l.salt").agg(F.max("r.text").alias("text"))
    heads = heads.select("doc_id", "tie", "salt", "text", "range", F.lit(True).alias("head"))
    all_ = placed(rows).withColumn("head", F.lit(False)).unionByName(heads)
    all_ = fingerprints(all_.repartition("range"), p)
    near = Window.partitionBy("range").orderBy(F.col("head").desc(), *order)
    beside = all_.select("doc_id", "text", "prints", "head", F.lag("text").over(near).alias("next_text"),
                         F.lag("prints").over(near).alias("next_prints"))
    return beside.filter(~F.col("head")).drop("head")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compared(docs: DataFrame, p: WinnowParams = WinnowParams()) -> DataFrame:
    """The query's columns: fingerprints of every text and of its edited text, and their likeness."""
    rows = beside_next(docs, p).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = fingerprints(rows, p, "edited", "edited_prints")
    rows = rows.select("*", hashes_of(F.col("prints")).alias("own"))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        shown(F.col("prints")).alias("fingerprint"), shown(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("own"), hashes_of(F.col("edited_prints"))).alias("near_edited"),
        likeness(F.col("own"), hashes_of(F.col("next_prints"))).alias("near_next"))
