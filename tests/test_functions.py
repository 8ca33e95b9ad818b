"""Column expressions on the edge cases of FIXTURES.md section 2."""

import pytest
from pyspark.sql import functions as F

from flowlens.functions.cleaning import canonical_label, coerce_numeric, json_safe_payload
from flowlens.functions.labels import binary_label, compare_cell, normalise_truth, severity, truth_value


def _one(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {dtype}")
    return [r[0] for r in df.select(expr(F.col("v"))).collect()]


def test_coerce_numeric_cells(spark):
    cells = ["", "abc", " 12 ", "1e3", "1d", "Infinity", "-inf", "NaN", "+inf", None, "2.5f", "-7"]
    got = _one(spark, coerce_numeric, cells)
    assert got == [None, None, 12.0, 1000.0, None, None, None, None, None, None, None, -7.0]


def test_normalise_truth(spark):
    vals = ["BENIGN", "benign", "normal", "Bình Thường", " 0 ", "1", "0.0", "2", "DDoS", "PortScan", None, "  ", "true", "false"]
    got = _one(spark, normalise_truth, vals)
    assert got == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1, None, None, 1, 0]


def test_binary_label_null_is_attack(spark):
    assert _one(spark, binary_label, ["BENIGN", "benign", None, "DDoS"]) == [0, 1, 1, 1]


def test_severity_boundaries(spark):
    theta = 1.5
    vals = [1.5, 1.6, 2.25, 2.3, 3.0, 3.1, 0.1]
    got = _one(spark, lambda c: severity(c, theta), vals, "double")
    assert got == ["low", "medium", "medium", "high", "high", "critical", "low"]


def test_truth_json_number_versus_text(spark):
    from flowlens.functions.labels import truth_is_text

    payloads = ['{"Label": 0.0}', '{"Label": "0.0"}', '{"Label": 2}', '{"Label": true}', '{"Label": 1.0}', '{"x": 1}']
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    got = [r[0] for r in df.select(normalise_truth(truth_value("payload"), truth_is_text("payload"))).collect()]
    assert got == [0, 1, 1, 1, 1, None]


def test_compare_cell(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, None)], "p int, t int")
    got = [r[0] for r in df.select(compare_cell("p", "t")).collect()]
    assert got == ["TP", "FP", "TN", "FN", "N/A"]


def test_truth_key_resolution(spark):
    payloads = ['{" Label ": "DDoS", "x": 1}', '{"binary_label": null, "Label": "BENIGN"}', '{"Flow Duration": 3, "value": 1}',
                '{"x": 1, "label": "normal"}']
    df = spark.createDataFrame([(p,) for p in payloads], "payload string")
    got = [tuple(r) for r in df.select(truth_value("payload"), normalise_truth(truth_value("payload"))).collect()]
    # the first matching key in stored order wins, even when its value is null
    assert got == [("DDoS", 1), (None, None), (None, None), ("normal", 0)]


@pytest.mark.parametrize(
    "raw,expected",
    [
        ("BENIGN", "BENIGN"), ("DoS Hulk", "DoS Hulk"), ("DoS Slowhttptest", "DoS Slowhttptest"),
        ("DoS slowloris", "DoS slowloris"), ("DDoS", "DDoS"), ("Bot", "Bot"), ("bot net", "Bot"), ("robot", None),
        ("PortScan", "PortScan"), ("FTP-Patator", "FTP-Patator"), ("ssh patator", "SSH-Patator"),
        ("Web Attack \ufffd Brute Force", "Web Attack - Brute Force"), ("Web Attack \u2013 XSS", "Web Attack - XSS"),
        ("Web Attack - Sql Injection", "Web Attack - Sql Injection"), ("\ufeffHeartbleed", "Heartbleed"),
        ("Infiltration", "Infiltration"), ("something else", None),
        ("\uff24\uff24\uff4f\uff33", "DDoS"), ("Web\u00a0Attack \u2212 XSS", "Web Attack - XSS"), (None, None),
    ],
)
def test_canonical_label(spark, raw, expected):
    assert _one(spark, canonical_label, [raw]) == [expected]


def test_json_safe_payload_tokens_and_non_finite(spark):
    df = spark.createDataFrame(
        [(1.0, "Infinity", "x"), (float("nan"), " nan ", "y"), (float("inf"), "-Infinity", "ok"), (2.0, "abc", None)],
        "value double, text_inf string, s string",
    )
    got = [r[0] for r in df.select(json_safe_payload([("value", "double"), ("text_inf", "string"), ("s", "string")])).collect()]
    assert got[0] == '{"value":1.0,"text_inf":null,"s":"x"}'
    assert got[1] == '{"value":null,"text_inf":null,"s":"y"}'
    assert got[2] == '{"value":null,"text_inf":null,"s":"ok"}'
    assert got[3] == '{"value":2.0,"text_inf":"abc","s":null}'
