"""Result store: latest runs, pages, deletes, uploads and run validation."""

import json

import pytest
from pyspark.sql import functions as F

from flowlens.operators import results as R
from flowlens.sources import result_store as S

RUNS = "run_id long, upload_id long, created_at timestamp_ntz, total_flows long, anomaly_count long, normal_count long, threshold double"


def _runs(spark):
    return spark.createDataFrame([
        (1, 10, None, 2, 1, 1, 1.0), (2, 10, None, 2, 0, 2, 1.0), (3, 11, None, 1, 1, 0, 1.0),
    ], RUNS).withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


def test_latest_run_tie_broken_by_run_id(spark):
    got = {r["upload_id"]: r["run_id"] for r in R.latest_runs(_runs(spark)).collect()}
    assert got == {10: 2, 11: 3}


def test_page_past_the_end_and_metadata(spark):
    preds = spark.createDataFrame([(2, 10, i, float(i), 0) for i in range(5)],
                                  "run_id long, upload_id long, row_index long, reconstruction_error double, prediction int")
    rows = spark.createDataFrame([(10, i, "{}") for i in range(5)], "upload_id long, row_index long, payload string")
    p2 = R.results_page(preds, rows, _runs(spark), 2, 2).collect()
    assert sorted(r["row_index"] for r in p2) == [2, 3]
    assert p2[0]["total_pages"] == 3 and p2[0]["has_previous"] and p2[0]["has_next"]
    assert R.results_page(preds, rows, _runs(spark), 9, 2).count() == 0
    with pytest.raises(ValueError):
        R.results_page(preds, rows, _runs(spark), 1, 101)


def test_delete_missing_upload_raises(spark):
    st = {"uploads": spark.createDataFrame([(10,)], "upload_id long"), "runs": _runs(spark)}
    with pytest.raises(S.StoreError):
        S.delete_upload(st, spark.createDataFrame([(99,)], "upload_id long"))
    kept = S.delete_upload(st, spark.createDataFrame([(10,)], "upload_id long"))
    assert kept["uploads"].count() == 0 and kept["runs"].count() == 1


def test_save_run_rejects_unknown_rows(spark, tmp_path):
    rows = spark.createDataFrame([(10, 0, "{}")], "upload_id long, row_index long, payload string")
    preds = spark.createDataFrame([(7, 10, 0, 0.1, 0), (7, 10, 5, 0.2, 1)],
                                  "run_id long, upload_id long, row_index long, reconstruction_error double, prediction int")
    run = spark.createDataFrame([(7, 10, 2)], "run_id long, upload_id long, total_flows long")
    with pytest.raises(S.StoreError):
        S.save_run(preds, run, rows, str(tmp_path))
    assert not (tmp_path / "predictions").exists()


def test_register_upload_guards_and_rows(spark, tmp_path):
    good = tmp_path / "flows.csv"
    good.write_text("name,value\nx,1\nx,1\n")
    n = S.register_upload(spark, str(good), 1, str(tmp_path / "store"))
    assert n == 2  # duplicates kept
    rows = S.read_committed(spark, str(tmp_path / "store"))["rows"].orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == [0, 1]
    up = S.read_committed(spark, str(tmp_path / "store"))["uploads"].first()
    assert up["row_count"] == 2 and up["col_count"] == 2 and len(up["file_sha256"]) == 64
    txt = tmp_path / "flows.txt"
    txt.write_text("a\n1\n")
    with pytest.raises(S.StoreError):
        S.register_upload(spark, str(txt), 2, str(tmp_path / "store2"))
    empty = tmp_path / "empty.csv"
    empty.write_text("name,value\n")
    with pytest.raises(S.StoreError):
        S.register_upload(spark, str(empty), 3, str(tmp_path / "store3"))


def test_register_uploads_again_replaces_and_rejects_before_storing(spark, tmp_path):
    a, b, empty = (tmp_path / n for n in ("a.csv", "b.csv", "empty.csv"))
    a.write_text("x , y\n1,2\n3,4\n")
    b.write_text("x\n5\n")
    empty.write_text("x\n")
    root = str(tmp_path / "store")
    with pytest.raises(S.StoreError):
        S.register_uploads(spark, {str(a): 1, str(empty): 2}, root)
    assert not (tmp_path / "store").exists()
    for _ in range(2):
        up = {r["upload_id"]: r for r in S.register_uploads(spark, {str(a): 1, str(b): 2}, root).collect()}
    assert (up[1]["columns"], up[1]["row_count"], up[2]["columns"]) == (["x", "y"], 2, ["x"])
    rows = S.read_committed(spark, root)["rows"].orderBy("upload_id", "row_index").collect()
    assert [(r["upload_id"], r["row_index"]) for r in rows] == [(1, 0), (1, 1), (2, 0)]
    assert json.loads(rows[2]["payload"]) == {"x": "5"}


def test_overview_and_activity_without_runs(spark):
    uploads = spark.createDataFrame([(5, "a.csv", 3, 2, None)], "upload_id long, filename string, row_count long, col_count int, created_at timestamp_ntz")
    runs = spark.createDataFrame([], RUNS)
    o = R.overview(uploads, runs).first()
    assert (o["total_uploads"], o["total_uploaded_flows"], o["analyzed_uploads"], o["anomaly_rate"]) == (1, 3, 0, 0.0)
    act = R.latest_activity(uploads, runs).first()
    assert act["upload_id"] == 5 and act["run_id"] is None
    assert R.find_run(uploads, runs).first()["status"] == "no_run"
    pending = R.list_uploads(uploads, runs, "pending", 1, 20).first()
    assert pending["status"] == "pending" and pending["anomaly_count"] == 0


def test_export_summary_without_ground_truth(spark):
    exp = spark.createDataFrame([(1, "N/A"), (1, "N/A")], "run_id long, compare_result string")
    s = R.export_summary(exp).first()
    assert s["has_ground_truth"] == "false" and s["tp"] == "N/A"
    assert s["accuracy"] == "N/A" and s["f1_score"] == "N/A"


def test_histogram_empty_run_gives_no_rows(spark):
    df = spark.createDataFrame([], "run_id long, reconstruction_error double, prediction int")
    assert R.histogram(df, ["run_id"]).count() == 0


def test_severity_counts_keep_zero_levels(spark):
    preds = spark.createDataFrame([(2, 10, 0, 3.5, 1)], "run_id long, upload_id long, row_index long, reconstruction_error double, prediction int")
    got = {r["severity"]: r["n"] for r in R.severity_counts(preds, _runs(spark)).filter("run_id = 2").collect()}
    assert got == {"critical": 1, "high": 0, "medium": 0, "low": 0}


def test_find_run_by_id_and_status(spark):
    runs = _runs(spark)
    up = runs.first()["upload_id"]
    ids = sorted(r["run_id"] for r in runs.filter(f"upload_id = {up}").collect())
    uploads = spark.createDataFrame([(up,), (777,)], "upload_id long")
    asked = [(up, i) for i in ids] + [(up, None), (up, 999), (777, None), (888, None), (888, ids[0])]
    got = [(r["upload_id"], r["run_id"], r["status"]) for r in
           R.find_run(uploads, runs, spark.createDataFrame(asked, "upload_id long, run_id long")).collect()]
    assert {(up, i, "ok") for i in ids} | {(up, None, "no_run"), (777, None, "no_run"), (888, None, "no_upload")} == set(got)
    assert len(got) == len(asked) and sum(s == "ok" for *_, s in got) == len(ids) + 1


def test_commit_keeps_the_old_version_until_the_switch(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(S.StoreError):
        S.read_committed(spark, root)
    S.commit_tables({"rows": spark.range(5).toDF("upload_id")}, root)
    rows = S.read_committed(spark, root)["rows"]
    S.commit_tables({"rows": rows.filter("upload_id > 2")}, root)  # reads what it replaces
    assert S.read_committed(spark, root)["rows"].count() == 2
    bad = rows.selectExpr("raise_error('stop') AS upload_id")
    with pytest.raises(Exception, match="stop"):
        S.commit_tables({"rows": bad}, root)
    assert S.read_committed(spark, root)["rows"].count() == 2


PREDS = "run_id long, upload_id long, row_index long, reconstruction_error double, prediction int"
RUN = "run_id long, upload_id long, total_flows long"


def _run(spark, run_id, n=2):
    rows = spark.createDataFrame([(10, i, "{}") for i in range(n)], "upload_id long, row_index long, payload string")
    preds = spark.createDataFrame([(run_id, 10, i, 0.1 * i, i % 2) for i in range(n)], PREDS)
    return preds, spark.createDataFrame([(run_id, 10, n)], RUN), rows


def _saved(spark, root):
    t = S.read_committed(spark, root)
    return t["predictions"].count(), t["runs"].count()


def test_saving_a_run_twice_keeps_it_once(spark, tmp_path):
    root = str(tmp_path / "store")
    preds, run, rows = _run(spark, 7)
    for _ in range(3):
        S.save_run(preds, run, rows, root)
    assert _saved(spark, root) == (2, 1)
    with pytest.raises(S.StoreError, match="saved already"):
        S.save_run(preds, run, rows, root, txn="another attempt")
    S.save_run(*_run(spark, 8, 3), root)
    assert _saved(spark, root) == (5, 2)


def test_a_save_that_fails_half_way_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    S.save_run(*_run(spark, 1), root)
    preds, run, rows = _run(spark, 7)
    write = S.CommitLog._write

    def dies(self, table, df):
        if table == "runs":
            raise OSError("executor lost")
        return write(self, table, df)

    monkeypatch.setattr(S.CommitLog, "_write", dies)
    with pytest.raises(OSError):
        S.save_run(preds, run, rows, root)
    assert _saved(spark, root) == (2, 1)
    monkeypatch.undo()
    S.save_run(preds, run, rows, root)
    assert _saved(spark, root) == (4, 2)


def test_two_writers_of_one_version(spark, tmp_path):
    from flowlens.sources.commits import CommitConflict, CommitLog

    root = str(tmp_path / "store")
    S.save_run(*_run(spark, 1), root)
    base = CommitLog(spark, root).snapshot()
    S.save_run(*_run(spark, 2), root, base=base)
    with pytest.raises(CommitConflict):
        S.save_run(*_run(spark, 3), root, base=base)
    assert _saved(spark, root) == (4, 2)
    S.save_run(*_run(spark, 3), root)  # from the newest version it goes through
    assert _saved(spark, root) == (6, 3)
    assert [r["seq"] for r in CommitLog(spark, root).history().orderBy("seq").collect()] == [1, 2, 3]
    assert not [p for p in (tmp_path / "store" / "_commits").iterdir() if p.name.startswith(".draft")]


def test_threads_race_for_one_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from flowlens.sources.commits import CommitConflict, CommitLog

    root = str(tmp_path / "store")
    log = CommitLog(spark, root)
    base = log.commit("first", append={"t": spark.range(1)})

    def write(k):
        try:
            return log.commit(f"w{k}", append={"t": spark.range(1)}, base=base).seq
        except CommitConflict:
            return None

    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(write, range(6)))
    assert sorted(got, key=str) == [2] + [None] * 5
    assert log.read()["t"].count() == 2


def test_old_versions_stay_readable_and_keys_leave(spark, tmp_path):
    from flowlens.sources.commits import CommitLog

    log = CommitLog(spark, str(tmp_path / "store"))
    log.commit("a", append={"rows": spark.range(4).toDF("upload_id")})
    log.commit("b", append={"rows": spark.createDataFrame([(2,)], "upload_id long")}, drop_keys={"rows": [2, 3]})
    log.commit("b", append={"rows": spark.range(9).toDF("upload_id")})  # the same transaction again
    assert sorted(r[0] for r in log.read()["rows"].collect()) == [0, 1, 2]
    assert log.read(log.snapshot(1))["rows"].count() == 4


def test_an_upload_is_counted_in_one_pass(spark, tmp_path, monkeypatch):
    """The metadata's row counts come from the pass that indexes the rows, its columns from one reading of the headers."""
    from flowlens.sources import flow_files as FF

    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text(" x \n5\n")
    calls = []
    for name in ("read_headers", "row_blocks"):
        monkeypatch.setattr(FF, name, lambda *a, f=getattr(FF, name), n=name: calls.append(n) or f(*a))
    up = S.register_uploads(spark, {str(tmp_path / "a.csv"): 1, str(tmp_path / "b.csv"): 2}, str(tmp_path / "store"))
    assert sorted((r.upload_id, r.row_count, r.columns) for r in up.collect()) == [(1, 2, ["x", "y"]), (2, 1, ["x"])]
    assert calls == ["read_headers", "row_blocks"]
