"""Multi-file CSV reading: header quirks, union by name, file order."""

from flowlens.sources import flow_files as FF


def test_normalise_headers_duplicates(spark, tmp_path):
    cases = {
        "a.csv": (' Fwd Header Length,Fwd Header Length ,x,x', ["Fwd Header Length", "Fwd Header Length.1", "x", "x.1"]),
        "b.csv": ('\ufeffa,a.1,a,"b, ""c""",,a', ["a", "a.1", "a.2", 'b, "c"', "", "a.3"]),
        "c.csv": (',z,z.1,z,z.1', ["", "z", "z.1", "z.2", "z.1.1"]),
    }
    for name, (line, _) in cases.items():
        (tmp_path / name).write_text(line + "\n" + "1\n" * 50, encoding="utf-8")
    (tmp_path / "d.csv").write_text("")
    heads = FF.read_headers(spark, FF.list_csv_files(spark, str(tmp_path))).collect()
    assert {h["_file"].rsplit("/", 1)[-1]: h["names"] for h in heads} == {n: names for n, (_, names) in cases.items()}


def test_read_flows_union_and_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text(" a , b ,extra\n3,4,9\n5,6,9\n")
    (tmp_path / "a.csv").write_text(" a , b \n1,2\n7,8\n")
    (tmp_path / "c.csv").write_text(" b \n10\n")
    df, cols = FF.read_flows(spark, str(tmp_path))
    idx = FF.with_row_index(df).orderBy("row_index").collect()
    assert [(r["a"], r["b"], r["extra"]) for r in idx] == [
        ("1", "2", None), ("7", "8", None), ("3", "4", "9"), ("5", "6", "9"), (None, "10", None)]
    assert [r["_source_file"] for r in idx][:2] == ["a.csv", "a.csv"]
    diff = {r["_file"].rsplit("/", 1)[-1]: (r["missing"], r["extra"]) for r in FF.schema_diff(spark, FF.list_csv_files(spark, str(tmp_path))).collect()}
    assert diff["b.csv"] == ([], ["extra"]) and diff["c.csv"] == (["a"], [])


def test_row_index_counts_blocks_and_moves_no_row(spark, tmp_path):
    """Several files of many splits, of two headers; also with more blocks than may be broadcast, and with gaps."""
    import random

    rng, want = random.Random(1), []
    for k, header in enumerate(["a,b", "a,b", "b"]):
        lines = [f"{'x' * rng.randint(1, 40)},{i}" if k < 2 else str(i) for i in range(500 + 300 * k)]
        (tmp_path / f"f{k}.csv").write_text("\n".join([header, *lines]) + "\n")
        want += [(f"f{k}.csv", str(i)) for i in range(len(lines))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df, _ = FF.read_flows(spark, str(tmp_path))
        assert df.select("_file", "_block").distinct().count() > 10
        idx = FF.with_row_index(df)
        plan = idx._jdf.queryExecution().executedPlan().toString()
        rows_side = plan.split("FileScan csv")[0]
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning(_file" not in rows_side.split("BroadcastExchange")[0]
        for got in (idx, FF.with_row_index(df, max_blocks=3)):
            rows = sorted(got.select("row_index", "_source_file", "b").collect())
            assert [tuple(r) for r in rows] == [(i, *w) for i, w in enumerate(want)]
        per_file = FF.with_row_index(df, group=["_file"]).groupBy("_source_file").agg({"row_index": "max"}).collect()
        assert sorted(map(tuple, per_file)) == [("f0.csv", 499), ("f1.csv", 799), ("f2.csv", 1099)]
        odd = FF.with_row_index(df.filter("cast(b as int) % 3 = 1")).select("row_index").collect()
        assert sorted(r[0] for r in odd) == list(range(len(odd)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_headers_are_read_once_and_no_line_is_sorted(spark, tmp_path):
    """First lines of many small files in one task and of a file of many splits; callers reuse the written headers."""
    for k in range(12):
        (tmp_path / f"s{k:02d}.csv").write_text(f"h{k},b\n" + "9,9\n" * (3 * k))
    (tmp_path / "t.csv").write_text("x,y\n" + "1,2\n" * 4000)
    paths = FF.list_csv_files(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        heads = FF.read_headers(spark, paths)
        assert "FileScan text" not in heads._jdf.queryExecution().executedPlan().toString()
        want = {f"s{k:02d}.csv": [f"h{k}", "b"] for k in range(12)} | {"t.csv": ["x", "y"]}
        rows = heads.collect()
        assert len(rows) == 13 and {r["_file"].rsplit("/", 1)[-1]: r["raw"] for r in rows} == want
        lines = spark.read.text(paths).selectExpr("_metadata.file_path AS _file", "value AS line")
        assert "SortAggregate" not in FF._first_lines(lines)._jdf.queryExecution().executedPlan().toString()
        df, _ = FF.read_flows(spark, paths, heads)
        prof = FF.file_profile(spark, paths, df, heads)
        assert "FileScan text" not in prof._jdf.queryExecution().executedPlan().toString()
        assert {r["_file"].rsplit("/", 1)[-1]: (r["n_rows"], r["n_cols"]) for r in prof.collect()} == {
            f"s{k:02d}.csv": (3 * k, 2) for k in range(12)} | {"t.csv": (4000, 2)}
    finally:
        for c in ("files.maxPartitionBytes", "files.openCostInBytes", "execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(f"spark.sql.{c}")
