"""Cleaning expressions: numeric coercion, JSON-safe payloads, canonical labels.

All are column expressions and never shuffle; all but the compatibility folding
of labels (Spark has no built-in for it; callers apply it to the distinct
labels) fuse into the scan's whole-stage codegen.
"""

from __future__ import annotations

import unicodedata
from typing import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: text cells that mean "missing" in a stored payload (trimmed, case-insensitive)
MISSING_TOKENS = ["nan", "nat", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity"]

# fixed values: ordered canonical-label rules (first match wins); each rule is
# (canonical name, substrings that must all occur, alternatives of which one must occur);
# a required entry starting with "^" must be the whole text or its first word
CANONICAL_RULES = [
    ("Heartbleed", ["heartbleed"], []),
    ("DoS Hulk", ["hulk"], []),
    ("DoS Slowhttptest", ["slowhttptest"], []),
    ("DoS slowloris", ["slowloris"], []),
    ("DoS GoldenEye", ["goldeneye"], []),
    ("DDoS", ["ddos"], []),
    ("Infiltration", ["infiltration"], []),
    ("Bot", ["^bot"], []),
    ("PortScan", ["portscan"], []),
    ("FTP-Patator", [], ["ftp-patator", "ftp patator"]),
    ("SSH-Patator", [], ["ssh-patator", "ssh patator"]),
    ("Web Attack - Brute Force", ["web attack", "brute"], []),
    ("Web Attack - XSS", ["web attack", "xss"], []),
    ("Web Attack - Sql Injection", ["web attack"], ["sql", "injection"]),
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coerce_numeric(x: Column | str) -> Column:
    """Text -> finite double or NULL (pandas ``to_numeric(errors='coerce')`` then +/-Inf, NaN -> missing).

    Spark would accept a trailing d/f type suffix ("1d"); pandas does not, so
    such cells are rejected unless they spell inf/infinity.
    """
    t = F.trim(_c(x).cast("string"))
    suffixed = t.rlike("[dDfF]$") & ~F.lower(t).rlike("^[+-]?(inf|infinity)$")
    v = F.when(~suffixed, t.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def raw_numeric(x: Column | str) -> Column:
    """Text -> double keeping +/-Inf and NaN (for the Inf profile before cleaning)."""
    t = F.trim(_c(x).cast("string"))
    suffixed = t.rlike("[dDfF]$") & ~F.lower(t).rlike("^[+-]?(inf|infinity)$")
    return F.when(~suffixed, t.try_cast("double"))


def finite_or_null(x: Column | str) -> Column:
    v = _c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def json_safe_value(x: Column, dtype: str) -> Column:
    """One cell made JSON-safe: non-finite numbers and missing tokens -> NULL."""
    if dtype in ("double", "float"):
        return finite_or_null(x)
    if dtype.startswith("decimal"):
        return x.cast("string")
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss") if dtype != "date" else F.date_format(x, "yyyy-MM-dd")
    if dtype == "binary":
        return F.decode(x, "UTF-8")
    if dtype == "string":
        return F.when(~F.lower(F.trim(x)).isin(*MISSING_TOKENS), x)
    return x


def json_safe_payload(columns: Sequence[tuple[str, str]] | Sequence[str], dtypes: dict | None = None) -> Column:
    """Row -> JSON object text in column order; NULLs are written as null."""
    fields = []
    for c in columns:
        name, dtype = (c if isinstance(c, tuple) else (c, (dtypes or {}).get(c, "string")))
        fields.append(json_safe_value(F.col(f"`{name}`"), dtype).alias(name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def _compatibility_fold(x: Column) -> Column:
    """Unicode NFKD (full-width letters, ligatures, no-break spaces become plain ones)."""

    @F.pandas_udf("string")
    def nfkd(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v))

    return nfkd(x)


def normalise_label_text(x: Column | str) -> Column:
    """NFKD, drop BOM, U+FFFD -> space, en/em dash and minus -> '-', squeeze spaces, trim, lower."""
    t = F.regexp_replace(_compatibility_fold(_c(x).cast("string")), "\ufeff", "")
    t = F.regexp_replace(t, "\ufffd", " ")
    t = F.regexp_replace(t, "[\u2013\u2014\u2212]", "-")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.lower(F.trim(t))


def canonical_label(x: Column | str) -> Column:
    """Raw attack label -> canonical name by the ordered rules, else NULL."""
    t = normalise_label_text(x)
    out = F.when(t == "benign", F.lit("BENIGN"))
    for name, required, alternatives in CANONICAL_RULES:
        cond = F.lit(True)
        for s in required:
            if s.startswith("^"):
                cond = cond & ((t == s[1:]) | t.startswith(s[1:] + " "))
            else:
                cond = cond & t.contains(s)
        if alternatives:
            any_alt = F.lit(False)
            for s in alternatives:
                any_alt = any_alt | t.contains(s)
            cond = cond & any_alt
        out = out.when(cond, F.lit(name))
    return out
