"""The size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Documents of one batch between the JVM and Python: enough to vectorise, few enough for long texts.
ROWS = 64


def bounded() -> None:
    """Lower the active session's batch size to ROWS; a smaller setting stays."""
    spark = SparkSession.getActiveSession()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and not 0 < int(spark.conf.get(key, "10000")) <= ROWS:
        spark.conf.set(key, str(ROWS))
