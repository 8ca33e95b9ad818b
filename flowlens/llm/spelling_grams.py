"""Spelling variants: words one edit apart, found by variable-length grams.

Words are counted over the whole corpus in Spark (a map-side combine takes the
frequent ones).  Words of the vocabulary are near if exactly one inserted, deleted
or replaced code point parts them.  Their search:

1. Gram dictionary: grams of ``min_gram`` to ``max_gram`` symbols of ``^word$`` are
   counted.  A gram is kept in the dictionary while it is frequent (more than T
   occurrences); a rare one is pruned, together with all its extensions.  T is the
   larger of ``list_size`` and positions / ``max_entries``, so that a level of
   the dictionary has fewer than ``max_entries`` grams: its proven size bound.
2. Decomposition: at every place the gram starts with ``min_gram`` symbols and grows
   while it is in the dictionary, up to ``max_gram``: grams are as long as they must be to be rare.
   A gram depends on its own symbols alone, so one edit changes exactly those that span it.
3. Affected grams: for each word the largest number of grams that span one of its
   characters, so all but that many are shared, at the same place from the start or
   from the end, by any near word.  A word has len + 3 - min_gram grams and at most
   ``max_gram`` are affected; with max_gram <= min_word the rest is never empty.
4. List merging: by that bound it is enough to merge the lists of each word's
   (affected + 1) rarest grams, with all that tie in the order.  Lists are keyed by gram
   and place, from the start for words of equal or neighbouring length, from the end
   for neighbouring length; they are joined by Spark, and the edit distance is
   a condition of that join (after a comparison of letter sets, of which one edit
   changes two bits at most), so only near pairs leave it.

The form of a word is its most frequent near word (ties: the smallest in code-point
order) if that is at least ``ratio`` times as frequent; counts at least double along
the forms, so following them ends after log2(n) steps, by pointer jumping.

* null and empty texts have no words; a null doc_id counts as the empty text
* repeated rows count as often as they occur; an empty table gives an empty result
* a vocabulary without near words: form null, root the word itself
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = r"[A-Za-zÀ-ÿ]+"


@dataclass(frozen=True)
class GramParams:
    min_word: int = 5  # code points
    min_count: int = 3
    ratio: int = 2
    min_gram: int = 2
    max_gram: int = 5
    list_size: int = 32  # grams with more occurrences are extended
    max_entries: int = 50_000  # of one length in the dictionary

    def __post_init__(self):
        if not 2 <= self.min_gram <= self.max_gram or self.max_gram + self.min_gram > self.min_word + 2:
            raise ValueError("one edit could change all grams of a shortest word")


def damaged(word: Column, doc_id: Column, modulus: int = 97) -> Column:
    """``word`` without its code point h % length where ``modulus`` divides h, the crc32 of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % modulus == 0, cut).otherwise(word)


def vocabulary(docs: DataFrame, p: GramParams = GramParams(), change=damaged) -> DataFrame:
    """(word, n): changed runs of letters of at least ``min_word`` code points, found ``min_count`` times or more."""
    folded = F.translate("text", UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(folded, F.lit(RUN), F.lit(0))).alias("run"))
    # a change takes one code point at most, so shorter runs can't become words
    words = runs.filter(F.length("run") >= p.min_word).select(change(F.col("run"), F.col("doc_id")).alias("word"))
    counts = words.filter(F.length("word") >= p.min_word).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= p.min_count)


def gram_dictionary(vocab: DataFrame, p: GramParams = GramParams()) -> dict[str, int]:
    """Frequent grams and their counts: fewer than ``max_entries`` of each length (see the module's text)."""
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    positions = vocab.agg(F.sum(F.length("word") + 3 - p.min_gram)).first()[0] or 0
    least = max(p.list_size, ceil(positions / p.max_entries))

    def of_length(q: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("s") - q + 1), lambda i: F.substring(F.col("s"), i, F.lit(q)))

    grams = F.flatten(F.array(*[of_length(q) for q in range(p.min_gram, p.max_gram + 1)]))
    rows = vocab.select("word", marked.alias("s")).select(F.explode(grams).alias("gram"))
    counts = rows.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > least)
    return {r["gram"]: r["n"] for r in counts.toLocalIterator()}


def decompose(word: str, known: dict[str, int], p: GramParams) -> list[tuple[int, str]]:
    """(place, gram) for every place of ``^word$``."""
    s = f"^{word}$"
    out = []
    for at in range(len(s) - p.min_gram + 1):
        size = p.min_gram
        while size < p.max_gram and at + size < len(s) and s[at : at + size] in known:
            size += 1
        out.append((at, s[at : at + size]))
    return out


def affected(grams: list[tuple[int, str]], length: int) -> int:
    """The most grams that one edit of a word of ``length`` characters can change."""
    step = [0] * (length + 3)
    for at, gram in grams:
        step[at] += 1
        step[at + len(gram)] -= 1
    most = now = 0
    for k, x in enumerate(step):
        now += x
        if 1 <= k <= length:
            most = max(most, now)
    return most


def merged_lists(grams: list[tuple[int, str]], length: int, known: dict[str, int]) -> list[tuple[int, str]]:
    """The rarest grams of a word, one more than an edit can change, and those that tie with the last."""
    order = sorted((known.get(g, 0), g, at) for at, g in grams)
    last = order[min(affected(grams, length), len(order) - 1)][:2]
    return [(at, g) for n, g, at in order if (n, g) <= last]


def letters(word: str) -> int:
    """64 bits that stand for the first two occurrences of each letter; one edit changes at most two of them."""
    bits, seen = 0, {}
    for c in word:
        k = seen[c] = seen.get(c, -1) + 1
        if k < 2:
            bits |= 1 << (2 * ord(c) + k) % 64
    return bits - (1 << 64) if bits >> 63 else bits


def postings(vocab: DataFrame, known: dict[str, int], p: GramParams = GramParams()) -> DataFrame:
    """(gram, side, place, word, n, size, letters): entries of the lists that are to be merged.
    side 0: place from the start, 1: from the end."""
    shared = vocab.sparkSession.sparkContext.broadcast(known)  # bounded, see gram_dictionary

    def run(batches):
        for batch in batches:
            words, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            for low in range(0, len(words), 2048):
                row, gram, place, end, size, sets = [], [], [], [], [], []
                for k in range(low, min(low + 2048, len(words))):
                    word, bits = words[k], letters(words[k])
                    for at, g in merged_lists(decompose(word, shared.value, p), len(word), shared.value):
                        row.append(k)
                        gram.append(g)
                        place.append(at)
                        end.append(len(word) - at)
                        size.append(len(word))
                        sets.append(bits)
                of = np.array(row, np.int64)
                for side, where in ((0, place), (1, end)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram, pa.string()), pa.array(np.full(len(row), side, np.int32)),
                         pa.array(where, pa.int32()), batch.column("word").take(pa.array(of)), pa.array(counts[of]),
                         pa.array(size, pa.int32()), pa.array(sets, pa.int64())],
                        ["gram", "side", "place", "word", "n", "size", "letters"])

    return vocab.select("word", "n").mapInArrow(
        run, "gram string, side int, place int, word string, n bigint, size int, letters bigint")


def near_words(vocab: DataFrame, p: GramParams = GramParams()) -> DataFrame:
    """(word, near, n, near_n): all pairs of near words of a written vocabulary, in both directions."""
    lists = postings(vocab, gram_dictionary(vocab, p), p)
    lists = lists.select(F.xxhash64("gram", "side", "place").alias("key"), "side", "word", "n", "size", "letters")
    a, b = lists.alias("a"), lists.alias("b")
    apart = F.abs(F.col("a.size") - F.col("b.size"))
    changed = F.bit_count(F.col("a.letters").bitwiseXOR(F.col("b.letters")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (apart <= 1) & (apart >= F.col("a.side")) & (changed <= 2)
                   & (F.col("a.word") < F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    one = pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"),
                       F.col("a.n").alias("n"), F.col("b.n").alias("near_n")).distinct()
    one = materialise(one)
    return one.unionByName(one.select(F.col("near").alias("word"), F.col("word").alias("near"),
                                      F.col("near_n").alias("n"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms, by pointer jumping."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")))
        going = at.filter("moved").limit(1).count()
        at = at.select("word", "root")
        if not going:
            return at


def spelling_groups(docs: DataFrame, p: GramParams = GramParams(), change=damaged) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    vocab = materialise(vocabulary(docs, p, change))
    best = near_words(vocab, p).groupBy("word", "n").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    wins = -F.col("best.less") >= F.col("n") * p.ratio
    best = materialise(best.select("word", "n_near", F.when(wins, F.col("best.near")).alias("form"),
                                   F.when(wins, -F.col("best.less")).alias("form_n")))
    roots = _roots(best.filter("form IS NOT NULL").select("word", "form"))
    return vocab.join(best, "word", "left").join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))
