"""Label, severity and truth expressions (pure column expressions, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: payload keys that carry the ground truth, in priority order
TRUTH_KEYS = ["label", "actual_label", "true_label", "binary_label"]
# fixed values: folded texts that mean "normal"
NORMAL_TEXTS = ["0", "benign", "normal", "binh thuong"]
SEVERITIES = ["critical", "high", "medium", "low"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def binary_label(label: Column | str) -> Column:
    """0 iff the label is exactly BENIGN; anything else (NULL included) is 1."""
    return F.when(_c(label).eqNullSafe(F.lit("BENIGN")), F.lit(0)).otherwise(F.lit(1))


def severity(score: Column | str, theta: Column | float) -> Column:
    """critical > 2 theta, high > 1.5 theta, medium > theta, else low (all strict)."""
    s = _c(score)
    t = theta if isinstance(theta, Column) else F.lit(float(theta))
    return (
        F.when(s > t * 2.0, F.lit("critical"))
        .when(s > t * 1.5, F.lit("high"))
        .when(s > t, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def fold_text(x: Column) -> Column:
    """trim + casefold, compared accent-insensitively (ICU collation UNICODE_CI_AI)."""
    return F.collate(F.lower(F.trim(x)), "UNICODE_CI_AI")


def normalise_truth(value: Column | str, is_text: Column | None = None) -> Column:
    """Ground-truth value -> 0/1/NULL.

    NULL or blank -> NULL; booleans -> 0/1; a JSON number equal to 0 or 1 -> 0 / 1
    (so 0.0 -> 0); otherwise the folded text: one of NORMAL_TEXTS -> 0, anything
    else -> 1 (so the text "0.0" -> 1 and the number 2 -> 1).  ``is_text`` tells
    whether the raw JSON token was a quoted string (None: treat as text).
    """
    v = _c(value).cast("string")
    folded = fold_text(v)
    num = F.when(~is_text, v.try_cast("double")) if is_text is not None else F.lit(None).cast("double")
    return (
        F.when(v.isNull() | (F.trim(v) == ""), F.lit(None).cast("int"))
        .when(folded == "false", F.lit(0))
        .when(folded == "true", F.lit(1))
        .when(num == 0.0, F.lit(0))
        .when(num == 1.0, F.lit(1))
        .when(folded.isin(*NORMAL_TEXTS), F.lit(0))
        .otherwise(F.lit(1))
    )


def compare_cell(pred: Column | str, truth: Column | str) -> Column:
    p, t = _c(pred), _c(truth)
    return (
        F.when(t.isNull(), F.lit("N/A"))
        .when((p == 1) & (t == 1), F.lit("TP"))
        .when((p == 1) & (t == 0), F.lit("FP"))
        .when((p == 0) & (t == 0), F.lit("TN"))
        .when((p == 0) & (t == 1), F.lit("FN"))
        .otherwise(F.lit("N/A"))
    )


def truth_key(payload_json: Column | str) -> Column:
    """First payload key (stored order) whose trimmed casefold is a truth key; NULL if none."""
    keys = F.json_object_keys(_c(payload_json))
    return F.try_element_at(F.filter(keys, lambda k: F.lower(F.trim(k)).isin(*TRUTH_KEYS)), F.lit(1))


def truth_value(payload_json: Column | str) -> Column:
    """Raw value text under the resolved truth key (NULL when absent or JSON null)."""
    p = _c(payload_json)
    entries = F.from_json(p, "map<string,string>")
    key = truth_key(p)
    return F.when(key.isNotNull(), F.try_element_at(entries, key))


def truth_is_text(payload_json: Column | str) -> Column:
    """Whether the value under the resolved truth key is a quoted JSON string."""
    p = _c(payload_json)
    key = truth_key(p)
    pattern = F.concat(F.lit('"\\Q'), key, F.lit('\\E"\\s*:\\s*("?)'))
    # the pattern depends on the row's key, so call the SQL function (column-valued regex)
    return F.when(key.isNotNull(), F.call_function("regexp_extract", p, pattern, F.lit(1)) == F.lit('"'))
