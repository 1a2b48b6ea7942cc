"""waitwise — Spark-native statistics for database and host performance telemetry.

Sub-packages:
  sources    readers for text/parquet inputs, table bindings, sinks
  functions  Column-level helpers (bands, t-distribution p-value, memory maths)
  operators  DataFrame -> DataFrame operators (time series, statistics, reports,
             logs, diagnostics, Markov forecast)
  plans      the query catalogue used by ``__spark_entry__`` and its DuckDB oracles
  streaming  Structured Streaming versions of the per-minute collection jobs
"""

from waitwise.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
