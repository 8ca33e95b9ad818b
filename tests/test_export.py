"""Export parts in order, summary of many parts, empty tables."""

from flowlens.sources.export import BOM, export_csv


def _lines(spark, path):
    return spark.read.text(path).collect()


def test_parts_follow_the_order(spark, tmp_path):
    rows = spark.range(2000).selectExpr("(id * 7919) % 2000 AS row_index", "id % 3 AS run_id").repartition(7)
    summary = spark.createDataFrame([(k, 5 * k, "x") for k in range(40)], "run_id long, n long, ratio string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = export_csv(rows, summary, str(tmp_path / "out"), order=["run_id", "row_index"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "out" / "rows").glob("part-*.csv"))
    assert len(parts) > 1
    found = []
    for p in parts:
        text = p.read_text("utf-8").splitlines()
        assert text[0] == BOM + "row_index,run_id"
        found += [tuple(map(int, line.split(",")))[::-1] for line in text[1:]]
    assert found == sorted(found) and len(found) == 2000
    back = spark.read.option("header", True).csv(out["summary"])
    assert sorted((int(r.run_id), r.metric, r.value) for r in back.collect()) == sorted(
        x for k in range(40) for x in ((k, "n", str(5 * k)), (k, "ratio", "x")))


def test_empty_export(spark, tmp_path):
    rows = spark.createDataFrame([], "row_index long, run_id long")
    summary = spark.createDataFrame([], "run_id long, n long")
    out = export_csv(rows, summary, str(tmp_path / "out"), order=["run_id"])
    assert all(len(r.value.split(",")) == 2 for r in _lines(spark, out["rows"]))
