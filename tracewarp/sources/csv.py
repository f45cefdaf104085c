"""CSV traces: ``Timestamp (s)`` or ``Timestamp (ns)``, ``Event Type``, ``Name``, ``Process`` and any other columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import normalise

NAMES = {"Timestamp (ns)": "ts_ns", "Event Type": "event_type", "Name": "name", "Process": "process", "Thread": "thread", "Attributes": "attributes"}


def seconds_to_ns(seconds: Column) -> Column:
    return F.round(seconds.cast("double") * F.lit(1e9)).cast("bigint")


def read_rows(spark: SparkSession, filename: str) -> DataFrame:
    """The file's columns, typed by a pass over the file, and ``source_seq``, which orders rows as the source does."""
    rows = spark.read.csv(filename, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=True)
    return rows.withColumn("source_seq", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, filename: str) -> DataFrame:
    """Canonical events, ordered by time and then by their place in the file."""
    rows = read_rows(spark, filename)
    if "Timestamp (s)" in rows.columns:
        rows = rows.withColumn("Timestamp (s)", seconds_to_ns(F.col("`Timestamp (s)`"))).withColumnRenamed("Timestamp (s)", "ts_ns")
    for old, new in NAMES.items():
        if old in rows.columns:
            rows = rows.withColumnRenamed(old, new)
    return normalise(rows.drop("source_seq"))
