"""cdcmart: change-data-capture to star schema analytics on Spark.

Sub-packages:
  sources    driver tables, the source-table adapter, readers and sinks
  functions  column helpers (JSON truthiness, typed extraction, keys)
  operators  df -> df operators (CDC, merge, silver, gold, quality, rules, ...)
  plans      named queries (BI), the medallion build, DuckDB twins
  streaming  Structured Streaming pipelines (Bronze ingest, merge, state)
"""

from cdcmart.session import get_spark, work_dir

__all__ = ["get_spark", "work_dir"]
