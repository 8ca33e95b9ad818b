"""Query registry: name -> (spark callable(spark, sf_dir), oracle SQL or None)."""

from __future__ import annotations

import importlib

MODULES = [
    "flowlens.plans.q_eval",
    "flowlens.plans.q_store",
    "flowlens.plans.q_profile",
    "flowlens.plans.q_prep",
    "flowlens.plans.q_score",
    "flowlens.plans.q_fit",
    "flowlens.plans.q_ingest",
    "flowlens.plans.q_stream",
]


def registry() -> dict[str, tuple]:
    out: dict[str, tuple] = {}
    for name in MODULES:
        mod = importlib.import_module(name)
        for key, val in mod.QUERIES.items():
            if key in out:
                raise KeyError(f"duplicate query {key}")
            out[key] = val
    return out
