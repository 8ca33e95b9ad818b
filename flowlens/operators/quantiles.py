"""Exact linear-interpolated percentiles that scale (numpy ``percentile`` semantics).

Spark's ``percentile`` is exact but keeps every distinct value of a group in
one aggregation buffer; at 100 TB that is one task holding a whole column.
Here every target rank is found by bracketing:

1. count the non-null values per group;
2. while a bracket holds more than ``max_inside`` rows and more than one value:
   tag each row with the brackets that contain it (a broadcast join on the
   group plus a range condition), compute a 1,001-point ``approx_percentile``
   grid per bracket (a mergeable sketch with partial aggregation), propose a
   narrow bracket around the target rank and count the rows below / inside it
   in one more pass.  The counts are exact, so the rank is known to be left of,
   inside or right of the proposal and the bracket always shrinks;
3. count the distinct values of every bracket (ties collapse before the
   shuffle) and run over them; a bracket of one value needs no pass.

The same path serves every size.  Only a handful of scalars per (group,
fraction) reach the driver.  Groups are expected to be few (columns of a table,
labels); for millions of groups use a per-group aggregate instead.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.ordering import ordered_scan
from flowlens.session import scratch_dir

ACCURACY = 100_000
MAX_INSIDE = 100_000
GRID = [i / 1000 for i in range(1001)]


def _brackets_frame(spark, rows):
    return spark.createDataFrame(rows, "_g string, _t int, _lo double, _hi double")


def _tag(values: DataFrame, brackets: DataFrame) -> DataFrame:
    """values (_g, v) x brackets (_g, _t, _lo, _hi) -> (_t, v) for every bracket containing v."""
    return values.join(F.broadcast(brackets), "_g").filter(
        (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
    ).select("_t", "v")


def _values(df: DataFrame, value: str, group: str | None) -> DataFrame:
    g = F.col(group).cast("string") if group else F.lit("")
    # NaN is missing (it would sort above +Inf and fall outside every bracket)
    return df.select(g.alias("_g"), F.col(value).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & F.col("_g").isNotNull()
    )


def _counts(values: DataFrame) -> dict:
    return {r["_g"]: r["n"] for r in values.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}


def grouped_order_statistics(
    df: DataFrame, value: str, group: str | None, wanted: dict, max_inside: int = MAX_INSIDE,
    accuracy: int = ACCURACY, counts: dict | None = None,
) -> dict:
    """``wanted``: {group_key: [0-based ranks]} -> {(group_key, rank): value}.

    Group keys are compared as strings (NULL groups are skipped)."""
    spark = df.sparkSession
    values = _values(df, value, group)
    counts = counts if counts is not None else _counts(values)
    tasks = []
    for key, ks in wanted.items():
        n = counts.get(key, 0)
        for k in sorted(set(ks)):
            if 0 <= k < n:
                tasks.append({"g": key, "k": k, "lo": -math.inf, "hi": math.inf, "below": 0, "inside": n})
    while True:
        # a bracket of one value is the answer, however many rows tie
        todo = [i for i, t in enumerate(tasks) if t["inside"] > max_inside and t["lo"] < t["hi"]]
        if not todo:
            break
        # distinct current brackets: ranks of one group start from the same bracket
        cur: dict[tuple, int] = {}
        for i in todo:
            t = tasks[i]
            t["cb"] = cur.setdefault((t["g"], t["lo"], t["hi"]), len(cur))
        br = _brackets_frame(spark, [(key[0], b, key[1], key[2]) for key, b in cur.items()])
        tagged = _tag(values, br)
        grids = {
            r["_t"]: r["q"] for r in tagged.groupBy("_t").agg(F.percentile_approx("v", GRID, accuracy).alias("q")).collect()
        }
        proposal = {}
        for i in todo:
            t = tasks[i]
            grid = grids[t["cb"]]
            rel = (t["k"] - t["below"]) / max(t["inside"] - 1, 1) * 1000
            lo, hi = float(grid[max(0, math.floor(rel) - 2)]), float(grid[min(1000, math.ceil(rel) + 2)])
            if (lo, hi) == (t["lo"], t["hi"]):  # no narrower: single out one of its values
                lo = hi = float(grid[round(rel)])
            proposal[i] = (lo, hi)
        # exact counts below / inside every proposal from one small histogram per bracket:
        # lt = #boundaries < v, le = #boundaries <= v (no row is multiplied)
        bnds: dict[int, list] = {}
        for i in todo:
            bnds.setdefault(tasks[i]["cb"], set()).update(proposal[i])
        bnds = {b: sorted(v) for b, v in bnds.items()}
        bdf = spark.createDataFrame([(b, v) for b, v in bnds.items()], "_t int, _bs array<double>")
        hist = tagged.join(F.broadcast(bdf), "_t").select(
            "_t",
            F.size(F.filter("_bs", lambda x: x < F.col("v"))).alias("lt"),
            F.size(F.filter("_bs", lambda x: x <= F.col("v"))).alias("le"),
        ).groupBy("_t", "lt", "le").agg(F.count(F.lit(1)).alias("c")).collect()
        by_b: dict[int, list] = {}
        for r in hist:
            by_b.setdefault(r["_t"], []).append((r["lt"], r["le"], r["c"]))
        for i in todo:
            t = tasks[i]
            lo, hi = proposal[i]
            a_idx, h_idx = bnds[t["cb"]].index(lo), bnds[t["cb"]].index(hi)
            cells = by_b.get(t["cb"], [])
            left = sum(c for lt, le, c in cells if le <= a_idx)
            ins = sum(c for lt, le, c in cells if le >= a_idx + 1 and lt <= h_idx)
            k = t["k"] - t["below"]
            if k < left:  # the rank is left of the proposal
                t["hi"], t["inside"] = math.nextafter(lo, -math.inf), left
            elif k < left + ins:
                t["lo"], t["hi"], t["below"], t["inside"] = lo, hi, t["below"] + left, ins
            else:  # or right of it
                t["lo"], t["below"], t["inside"] = (
                    math.nextafter(hi, math.inf), t["below"] + left + ins, t["inside"] - left - ins)
    if not tasks:
        return {}
    # final pass: the distinct values of every open bracket with their counts
    uniq: dict[tuple, int] = {}
    for t in tasks:
        if t["lo"] < t["hi"]:
            t["b"] = uniq.setdefault((t["g"], t["lo"], t["hi"]), len(uniq))
    got = {}
    if uniq:
        br = _brackets_frame(spark, [(key[0], b, key[1], key[2]) for key, b in uniq.items()])
        rows = sorted({(t["b"], t["k"] - t["below"]) for t in tasks if "b" in t})
        wanted_rows = spark.createDataFrame(rows, "_t int, rk long")
        picked = (
            _ranked(_tag(values, br)).join(F.broadcast(wanted_rows), "_t")
            .filter((F.col("rk") >= F.col("_upto") - F.col("_c")) & (F.col("rk") < F.col("_upto")))
            .select("_t", "rk", "v").collect()
        )
        got = {(r["_t"], r["rk"]): r["v"] for r in picked}
    return {(t["g"], t["k"]): got[(t["b"], t["k"] - t["below"])] if "b" in t else t["lo"] for t in tasks}


def _ranked(tagged: DataFrame) -> DataFrame:
    """(_t, v, _c, _upto): distinct values per bracket (ties collapse before the shuffle),
    their counts and running counts; a bracket holds at most ``max_inside`` rows."""
    w = Window.partitionBy("_t").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.groupBy("_t", "v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(w))


def grouped_percentiles(df: DataFrame, value: str, group: str | None, fractions: Sequence[float],
                        groups: Sequence[str] | None = None, max_inside: int = MAX_INSIDE, accuracy: int = ACCURACY) -> dict:
    """{(group_key, fraction): percentile} for every group (or the given ones); None for empty groups."""
    values = _values(df, value, group)
    counts = _counts(values)
    keys = list(groups) if groups is not None else list(counts)
    out: dict = {(key, p): None for key in keys for p in fractions}
    wanted: dict = {}
    plan = {}
    for key in keys:
        n = counts.get(key, 0)
        for p in fractions if n else ():
            r = (n - 1) * float(p)
            lo, hi = math.floor(r), math.ceil(r)
            plan[(key, p)] = (lo, hi, r)
            wanted.setdefault(key, []).extend([lo, hi])
    stats = grouped_order_statistics(df, value, group, wanted, counts=counts, max_inside=max_inside, accuracy=accuracy)
    for (key, p), (lo, hi, r) in plan.items():
        a, b = stats[(key, lo)], stats[(key, hi)]
        out[(key, p)] = a if a == b else a + (b - a) * (r - lo)
    return out


def exact_percentiles(df: DataFrame, col: str, fractions: Sequence[float], max_inside: int = MAX_INSIDE,
                      accuracy: int = ACCURACY) -> list[float | None]:
    """Percentiles at ``fractions`` (0..1) of the non-null values of ``col``."""
    res = grouped_percentiles(df, col, None, fractions, groups=[""], max_inside=max_inside, accuracy=accuracy)
    return [res[("", p)] for p in fractions]


def order_statistics(df: DataFrame, col: str, ks: Sequence[int], max_inside: int = MAX_INSIDE,
                     accuracy: int = ACCURACY, counts: dict | None = None) -> dict[int, float]:
    """Exact k-th smallest values (0-based ranks ``ks``) of the non-null values of ``col``
    (``counts={"": n}`` may pass a known non-null count)."""
    res = grouped_order_statistics(df, col, None, {"": list(ks)}, max_inside=max_inside, accuracy=accuracy, counts=counts)
    return {k: v for (_, k), v in res.items()}


def group_percentile_table(df: DataFrame, value: str, group: str, fractions: Sequence[float],
                           accuracy: int = ACCURACY) -> DataFrame:
    """(group, n, pct): exact percentiles of every group as a table, for any number of groups.

    The brackets are rows joined by group and never reach the driver: a KLL sketch of every group
    proposes one for each fraction, one pass counts what lies below and inside, and
    the values inside are ranked by ``ordered_scan``, so that a group that holds a third of
    the rows is ranked by many tasks.  A group whose sketch misses a rank is ranked as a
    whole.  The join is the planner's: it is broadcast while the table is small.
    Groups are compared as strings; NULL groups and groups without values are left out.
    """
    size = int(min(65535, max(8, accuracy // 25)))
    margin, ps = 7.0 / size**0.97, [float(p) for p in fractions]
    path = scratch_dir(df.sparkSession, "group_percentiles", unique=True)
    spark = df.sparkSession
    values = _values(df, value, group)
    asked = F.array(*[F.lit(x) for p in ps for x in (max(0.0, p - margin), min(1.0, p + margin))])
    sketched = values.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(size)).alias("s"))
    sketched.select("_g", "n", F.kll_sketch_get_quantile_double("s", asked).alias("q")).write.parquet(f"{path}/brackets")
    brackets = spark.read.parquet(f"{path}/brackets")

    def ranks(i):
        r = (F.col("n") - 1) * F.lit(ps[i])
        return F.floor(r), F.ceil(r)

    joined = values.join(brackets, "_g")
    below = joined.groupBy("_g").agg(*[
        f for i in range(len(ps)) for f in (
            F.count(F.when(F.col("v") < F.col("q")[2 * i], 1)).alias(f"b{i}"),
            F.count(F.when(F.col("v") <= F.col("q")[2 * i + 1], 1)).alias(f"u{i}"))])
    checked = brackets.join(below, "_g")
    held = F.lit(True)
    for i in range(len(ps)):
        held = held & (ranks(i)[0] >= F.col(f"b{i}")) & (ranks(i)[1] < F.col(f"u{i}"))
    wide = F.array(*[F.lit(x) for _ in ps for x in (-math.inf, math.inf)])
    checked.select("_g", "n", F.when(held, F.col("q")).otherwise(wide).alias("q"),
                   *[F.when(held, F.col(f"b{i}")).otherwise(0).alias(f"b{i}") for i in range(len(ps))]).write.parquet(f"{path}/checked")
    checked = spark.read.parquet(f"{path}/checked")
    # (group, fraction, value) of what lies inside, distinct values with their counts
    v = F.col("v")
    inside = values.join(checked.select("_g", "q"), "_g").select("_g", "v", F.explode(F.array_compact(F.array(*[
        F.when((v >= F.col("q")[2 * i]) & (v <= F.col("q")[2 * i + 1]), F.lit(i)) for i in range(len(ps))]))).alias("_t"))
    distinct = inside.groupBy("_g", "_t", "v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_scan(distinct, order_cols=["v"], group_cols=["_g", "_t"], sums=["_c"])
    targets = checked.select("_g", "n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("_t"), (ranks(i)[0] - F.col(f"b{i}")).alias("lo"), (ranks(i)[1] - F.col(f"b{i}")).alias("hi"),
                 ((F.col("n") - 1) * F.lit(ps[i]) - ranks(i)[0]).alias("part")) for i in range(len(ps))])).alias("t")).select("_g", "n", "t.*")
    first = F.col("cum__c") - F.col("_c")

    def at(rank):
        return F.max(F.when((F.col(rank) >= first) & (F.col(rank) < F.col("cum__c")), F.col("v")))

    near = ranked.join(targets, ["_g", "_t"]).filter((F.col("hi") >= first) & (F.col("lo") < F.col("cum__c")))
    picked = near.groupBy("_g", "n", "_t", "part").agg(at("lo").alias("a"), at("hi").alias("b"))
    pct = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return picked.select("_g", "n", F.struct("_t", pct.alias("p")).alias("x")).groupBy(F.col("_g").alias(group), "n").agg(
        F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]).alias("pct"))


DIGIT_BITS = 12


def radix_select(df: DataFrame, col: str, k: int, few: int = MAX_INSIDE) -> tuple[int, int, int]:
    """(value, rows below it, rows equal to it) of the k-th smallest (0-based) value of a long column.

    Exact for all 64 bits.  Each round counts the rows by the next ``DIGIT_BITS`` bits among
    those that share the prefix found so far (a map-side count, 4,096 rows to the driver);
    once at most ``few`` rows share it their distinct values are ranked directly.
    """
    # flipped sign bit: unsigned order of the bits is the order of the values
    bits = df.select(F.col(col).cast("long").alias("v")).filter("v IS NOT NULL").select(
        "v", F.col("v").bitwiseXOR(F.lit(-(1 << 63))).alias("u"))
    prefix, left, below, inside = 0, 64, 0, None

    def sharing():
        """The rows that share the prefix (a whole one is a signed long)."""
        top = prefix - (1 << 64) if prefix >> 63 else prefix
        return bits if left == 64 else bits.filter(F.shiftrightunsigned("u", left) == top)

    while left and (inside is None or inside > few):
        width = min(DIGIT_BITS, left)
        digit = F.shiftrightunsigned("u", left - width).bitwiseAND(F.lit((1 << width) - 1))
        counts = sorted((r["d"], r["n"]) for r in sharing().groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        for d, n in counts:
            if k < below + n:
                prefix, inside, left = prefix << width | d, n, left - width
                break
            below += n
        else:
            raise ValueError(f"rank {k} of {below} rows")
    for r in sorted(sharing().groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()):
        if k < below + r["n"]:
            return r["v"], below, r["n"]
        below += r["n"]
    raise ValueError(f"rank {k} of {below} rows")


def _inside(v: Column, lo: float, hi: float) -> Column:
    """Whether ``v`` lies in [lo, hi]; an open end is no condition."""
    low = F.lit(True) if lo == -math.inf else v >= F.lit(lo)
    return low if hi == math.inf else low & (v <= F.lit(hi))


def percentile_columns(df: DataFrame, cols: Sequence[str], fractions: Sequence[float],
                       max_inside: int = MAX_INSIDE, accuracy: int = ACCURACY) -> dict:
    """{(column, fraction): percentile} for many columns at once; None for a column without values.

    Exact, in wide aggregates that never unpivot the table: one scan builds a mergeable KLL
    sketch of every column, which proposes a bracket around each wanted rank; one scan counts
    the rows below and inside all brackets; one scan emits the cells that lie in
    a bracket, and their distinct values are ranked.  Brackets that still hold more than
    ``max_inside`` cells of different values are sketched and counted again first.
    """
    size = int(min(65535, max(8, accuracy // 25)))
    margin = 7.0 / size**0.97  # about three times the sketch's rank error
    value = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in cols}
    counts: dict[str, int] = {}
    tasks: list[dict] = []
    first = True
    while True:
        if first:
            open_ = {(c, -math.inf, math.inf): [{"rel": float(p)} for p in fractions] for c in cols}
        else:
            open_ = {}
            for t in tasks:
                if t["inside"] > max_inside and t["lo"] < t["hi"]:
                    t["rel"] = (t["k"] - t["below"]) / max(t["inside"] - 1, 1)
                    open_.setdefault((t["c"], t["lo"], t["hi"]), []).append(t)
        if not open_ or not fractions:
            break
        # scan 1: a sketch of every open bracket, read at the wanted ranks and a margin around them
        asked, sketches = {}, []
        for i, ((c, lo, hi), ts) in enumerate(open_.items()):
            asked[i] = [x for t in ts for x in (max(0.0, t["rel"] - margin), t["rel"], min(1.0, t["rel"] + margin))]
            v = F.when(_inside(value[c], lo, hi), value[c])
            sketches += [F.kll_sketch_agg_double(v, F.lit(size)).alias(f"s{i}"), F.count(v).alias(f"n{i}")]
        row = df.agg(*sketches).select(*[
            x for i, ranks in asked.items() for x in (
                F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, ranks)))).alias(f"q{i}"),
                F.col(f"n{i}"))]).first()
        if first:
            for i, c in enumerate(cols):
                n = counts[c] = row[f"n{i}"]
                for p, at in zip(fractions, range(0, 3 * len(fractions), 3)) if n else ():
                    r = (n - 1) * float(p)
                    for k in {math.floor(r), math.ceil(r)}:
                        tasks.append({"c": c, "k": k, "lo": -math.inf, "hi": math.inf, "below": 0, "inside": n,
                                      "grid": row[f"q{i}"][at:at + 3]})
            todo = [t for t in tasks if t["inside"] > max_inside]
        else:
            for i, ts in enumerate(open_.values()):
                for j, t in enumerate(ts):
                    t["grid"] = row[f"q{i}"][3 * j:3 * j + 3]
            todo = [t for ts in open_.values() for t in ts]
        first = False
        if not todo:
            break
        for t in todo:
            lo, at, hi = t["grid"]
            t["new"] = (lo, hi) if (lo, hi) != (t["lo"], t["hi"]) else (at, at)  # no narrower: single out one value
        # scan 2: exact counts below and inside every proposal
        cells = {(t["c"], t["lo"], t["hi"], *t["new"]): None for t in todo}
        sums = []
        for i, (c, lo, hi, new_lo, new_hi) in enumerate(cells):
            v = value[c]
            sums += [F.count(F.when(_inside(v, lo, hi) & (v < F.lit(new_lo)), 1)).alias(f"b{i}"),
                     F.count(F.when(_inside(v, new_lo, new_hi), 1)).alias(f"i{i}")]
        row = df.agg(*sums).first()
        for i, cell in enumerate(cells):
            cells[cell] = (row[f"b{i}"], row[f"i{i}"])
        for t in todo:
            lo, hi = t["new"]
            left, inside = cells[(t["c"], t["lo"], t["hi"], lo, hi)]
            k = t["k"] - t["below"]
            if k < left:
                t["hi"], t["inside"] = math.nextafter(lo, -math.inf), left
            elif k < left + inside:
                t["lo"], t["hi"], t["below"], t["inside"] = lo, hi, t["below"] + left, inside
            else:
                t["lo"], t["below"], t["inside"] = math.nextafter(hi, math.inf), t["below"] + left + inside, t["inside"] - left - inside
    # scan 3: the cells inside a bracket, at most ``max_inside`` distinct ones each
    brackets: dict[tuple, int] = {}
    for t in tasks:
        if t["lo"] < t["hi"]:
            t["b"] = brackets.setdefault((t["c"], t["lo"], t["hi"]), len(brackets))
    got = {}
    if brackets:
        found = [F.when(_inside(value[c], lo, hi), F.struct(F.lit(b).alias("_t"), value[c].alias("v")))
                 for (c, lo, hi), b in brackets.items()]
        tagged = df.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*").filter("v IS NOT NULL")
        wanted = df.sparkSession.createDataFrame(sorted({(t["b"], t["k"] - t["below"]) for t in tasks if "b" in t}), "_t int, rk long")
        picked = (
            _ranked(tagged).join(F.broadcast(wanted), "_t")  # two ranks a percentile
            .filter((F.col("rk") >= F.col("_upto") - F.col("_c")) & (F.col("rk") < F.col("_upto"))).select("_t", "rk", "v").collect()
        )
        got = {(r["_t"], r["rk"]): r["v"] for r in picked}
    stats = {(t["c"], t["k"]): got[(t["b"], t["k"] - t["below"])] if "b" in t else t["lo"] for t in tasks}
    out = {}
    for c in cols:
        for p in fractions:
            if not counts.get(c):
                out[(c, p)] = None
                continue
            r = (counts[c] - 1) * float(p)
            low, high = stats[(c, math.floor(r))], stats[(c, math.ceil(r))]
            out[(c, p)] = low if low == high else low + (high - low) * (r - math.floor(r))
    return out


def percentile_row(df: DataFrame, col: str, fractions: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The exact percentiles as a 1-row DataFrame (artifact form)."""
    vals = exact_percentiles(df, col, fractions)
    schema = ", ".join(f"`{nm}` double" for nm in names)
    return df.sparkSession.createDataFrame([tuple(vals)], schema)
