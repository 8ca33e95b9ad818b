"""flowlens: flow-anomaly analytics as Spark DataFrame programs.

Sub-packages
------------
sources    readers/writers: CSV flow files, the result store, exports, artifacts
functions  column expressions (no shuffles): cleaning, labels, metrics, vectors
operators  table-level jobs: profiling, prep, scoring, fitting, evaluation, store queries
plans      bindings of the operators to the driver tables and the query registry
streaming  incremental scoring of newly arriving files
"""

from flowlens.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
