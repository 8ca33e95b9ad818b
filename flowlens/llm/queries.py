"""The registered queries of this subpackage: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.llm import (
    cgk_decontam,
    crf_rules,
    lexicon_toxicity,
    line_windows,
    minmax_dedup,
    mix_budget,
    periodic_runs,
    ppm_langid,
    quality_ftrl,
    run_index,
    secret_dfa,
    spelling_grams,
    winnowing,
)
from flowlens.llm.common import documents


def op1_run_index(spark, sf_dir):
    """Bytes of every document in repeated 200-byte strings, by run-length indexes."""
    return run_index.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op2_quality_ftrl(spark, sf_dir):
    """Quality score of every document by the FTRL-trained hashed n-gram classifier."""
    return quality_ftrl.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op3_mix_budget(spark, sf_dir):
    """Words taken of every document so that the sources meet their targets."""
    return mix_budget.mix(documents(spark, sf_dir))


def op4_line_windows(spark, sf_dir):
    """Every document without later occurrences of repeated three-line windows."""
    out = line_windows.drop_repeated_windows(documents(spark, sf_dir))
    return out.select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed")


def op5_ppm(spark, sf_dir):
    """Language of every document by the shortest PPM code."""
    return ppm_langid.identify(documents(spark, sf_dir))


def op6_minmax(spark, sf_dir):
    """Near-duplicate group of every document by min-max hashing."""
    return minmax_dedup.near_duplicates(documents(spark, sf_dir))


def op7_cgk(spark, sf_dir):
    """Documents that hold a benchmark item, with the best match of each."""
    return cgk_decontam.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op8_lexicon(spark, sf_dir):
    """Toxicity score of every document by the weighted lexicon."""
    return lexicon_toxicity.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op9_crf_rules(spark, sf_dir):
    """Quality rules of every document with line labels of the CRF, fitted to lines of labelled documents."""
    return crf_rules.judge(documents(spark, sf_dir), labels=documents(spark, sf_dir, "labels"))


def op10_secret_dfa(spark, sf_dir):
    """Secrets in every document, found by the combined automaton."""
    return secret_dfa.find_secrets(documents(spark, sf_dir))


def op11_periodic_runs(spark, sf_dir):
    """Periodic runs of words of every document, some of them altered to hold long ones."""
    altered = periodic_runs.with_periods(documents(spark, sf_dir))
    return periodic_runs.digests(periodic_runs.periodic_runs(altered))


def op12_winnowing(spark, sf_dir):
    """Winnowed fingerprint of every document and of its edited text, and how alike they are."""
    return winnowing.compared(documents(spark, sf_dir))


def op13_spelling_grams(spark, sf_dir):
    """Every frequent word with its usual spelling, by variable-length grams."""
    return spelling_grams.spelling_groups(documents(spark, sf_dir))


_BLANK = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
OP4_SQL = f"""
WITH rows AS (
  SELECT doc_id, text, md5(coalesce('i' || doc_id::VARCHAR, 'n') || chr(1) || coalesce('t' || text, 'n')) AS key
  FROM documents
), docs AS (
  SELECT DISTINCT doc_id, text, key FROM rows
), split AS (
  SELECT doc_id, key, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS idx
  FROM docs
), lines AS (
  SELECT doc_id, key, line, idx, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS pos
  FROM split WHERE trim(line, {_BLANK}) <> ''
), wins AS (
  SELECT doc_id, key, pos, line || chr(10) || lead(line, 1) OVER w || chr(10) || lead(line, 2) OVER w AS body
  FROM lines WINDOW w AS (PARTITION BY key ORDER BY pos)
), later AS (
  SELECT key, pos FROM (
    SELECT key, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST, key, pos) AS k
    FROM wins WHERE body IS NOT NULL)
  WHERE k > 1
), covered AS (
  SELECT DISTINCT key, pos + d AS pos FROM later, (VALUES (0), (1), (2)) AS t(d)
), kept AS (
  SELECT s.key, string_agg(s.line, chr(10) ORDER BY s.idx) AS text
  FROM split s LEFT JOIN lines l ON l.key = s.key AND l.idx = s.idx
  LEFT JOIN covered c ON c.key = l.key AND c.pos = l.pos
  WHERE c.pos IS NULL GROUP BY s.key
), counts AS (
  SELECT l.key, count(*) AS n_lines, count(c.pos) AS n_removed
  FROM lines l LEFT JOIN covered c ON c.key = l.key AND c.pos = l.pos GROUP BY l.key
)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed
FROM rows r LEFT JOIN kept k ON k.key = r.key LEFT JOIN counts c ON c.key = r.key
"""

QUERIES = {
    "op1_run_index": (op1_run_index, None),
    "op2_quality_ftrl": (op2_quality_ftrl, None),
    "op3_mix_budget": (op3_mix_budget, None),
    "op4_line_windows": (op4_line_windows, OP4_SQL),
    "op5_ppm": (op5_ppm, None),
    "op6_minmax": (op6_minmax, None),
    "op7_cgk": (op7_cgk, None),
    "op8_lexicon": (op8_lexicon, None),
    "op9_crf_rules": (op9_crf_rules, None),
    "op10_secret_dfa": (op10_secret_dfa, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_winnowing": (op12_winnowing, None),
    "op13_spelling_grams": (op13_spelling_grams, None),
}
