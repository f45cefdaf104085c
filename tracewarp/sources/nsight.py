"""CSV traces of GPU activity: one interval a row, with process and thread ids of the system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.samples import interval_events
from ..schema import normalise
from .csv import read_rows


def _numbers(rows: DataFrame, columns: list[str], number: str, within: list[str]) -> DataFrame:
    """Places of the distinct values of ``columns``, counted from 0 within each of ``within``."""
    from pyspark.sql import Window

    own = rows.select(*columns).distinct()
    order = Window.partitionBy(*[F.col(c) for c in within]).orderBy(*columns) if within else Window.orderBy(*columns)
    return own.withColumn(number, (F.row_number().over(order) - 1).cast("int"))


def read_nsight(spark: SparkSession, filename: str) -> DataFrame:
    """Canonical events. Processes are numbered by PID and threads by TID within their process.

    ``process`` and ``thread`` are always there, 0 where the file has one PID or
    only main threads. The distinct (PID, TID) pairs, one a thread, are numbered;
    the rows are not.
    """
    rows = read_rows(spark, filename)
    missing = [c for c in ("Start (ns)", "End (ns)", "Name", "PID", "TID") if c not in rows.columns]
    if missing:
        raise ValueError(f"an interval file needs {', '.join(missing)}")
    processes = _numbers(rows, ["PID"], "process", [])
    threads = _numbers(rows, ["PID", "TID"], "thread", ["PID"])
    numbered = rows.join(processes, "PID", "left").join(threads, ["PID", "TID"], "left")
    own_thread = rows.agg(F.coalesce(F.max((F.col("PID") != F.col("TID")).cast("int")), F.lit(0)).alias("__threads"))
    numbered = numbered.crossJoin(F.broadcast(own_thread)).withColumn("thread", F.when(F.col("__threads") == 1, F.col("thread")).otherwise(0)).drop("__threads")
    events = interval_events(numbered.withColumnRenamed("Name", "name"), "Start (ns)", "End (ns)")
    # At one time, Leaves of earlier rows come before Enters, and an empty interval's Enter before its Leave.
    events = events.withColumn("__half", F.when(F.col("event_type") == "Enter", 0).otherwise(1))
    return normalise(events, "ts_ns", "source_seq", "__half").drop("source_seq", "__half")
