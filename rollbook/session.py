"""Session settings that registers need."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A register has far more columns than usual tables. One generated method per stage then outgrows
# the JVM's limit for compiling it to machine code (8000 bytes) and runs interpreted. Below this
# limit Spark generates one method per stage; above it, it splits the work into small ones.
WIDE_ROWS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune_for_wide_rows(spark: SparkSession) -> SparkSession:
    """Apply the settings for wide rows to a session; all of them can change at run time."""
    for key, value in WIDE_ROWS.items():
        spark.conf.set(key, value)
    return spark
