"""Traces made from the ``events`` table of the test data, in Spark and in SQL.

Event ids are order keys made by arithmetic (time, then Leaves before Enters,
then depth or source order, then process), so no rows are numbered globally. Events
of one process at the same microsecond share an id: the earlier of the source has no
duration, so its Leave comes before its Enter and both stay unmatched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Microseconds of 2020-01-01.
EPOCH = 1_577_836_800_000_000


def base(spark: SparkSession, sf_dir: str, processes: int = 8) -> DataFrame:
    ship(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id", us.alias("us"), (F.col("user_id") % processes).cast("int").alias("process"), "event_type",
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def nested(spark: SparkSession, sf_dir: str, processes: int = 8) -> DataFrame:
    """Well-nested calls: main, a phase for each day, and the events one after another."""
    rows = base(spark, sf_dir, processes).withColumn("day", F.expr("us div 86400000000"))
    by_day = Window.partitionBy("process", "day").orderBy("us", "event_id")  # the source's order at equal times
    leaf = rows.select("process", F.lit(2).alias("d"), F.col("event_type").alias("name"), F.col("us").alias("a"), F.coalesce(F.lead("us").over(by_day), F.col("us") + 1).alias("b"))
    phase = rows.groupBy("process", "day").agg(F.min("us").alias("a"), (F.max("us") + 1).alias("b"))
    phase = phase.select("process", F.lit(1).alias("d"), F.concat(F.lit("phase_"), (F.col("day") % 7).cast("string")).alias("name"), "a", "b")
    main = rows.groupBy("process").agg(F.min("us").alias("a"), (F.max("us") + 1).alias("b"))
    main = main.select("process", F.lit(0).alias("d"), F.lit("main").alias("name"), "a", "b")
    calls = leaf.unionByName(phase).unionByName(main)
    ends = F.array(
        F.struct(F.lit("Enter").alias("event_type"), F.col("a").alias("us"), F.lit(1).alias("e"), F.col("d").alias("o")),
        F.struct(F.lit("Leave").alias("event_type"), F.col("b").alias("us"), F.lit(0).alias("e"), (2 - F.col("d")).alias("o")),
    )
    both = calls.select("process", "name", F.explode(ends).alias("x")).select("process", "name", "x.*")
    key = (((F.col("us") - EPOCH) * 2 + F.col("e")) * 4 + F.col("o")) * 8 + F.col("process")
    return both.select(key.alias("event_id"), ((F.col("us") - EPOCH) * 1000).alias("ts_ns"), "event_type", "name", "process")


NESTED_SQL = """
b{s} AS (SELECT event_id, epoch_us(ts) AS us, (user_id % {p})::INT AS process, event_type, epoch_us(ts) // 86400000000 AS day FROM events),
calls{s} AS (
  SELECT process, 2 AS d, event_type AS name, us AS a, coalesce(lead(us) OVER (PARTITION BY process, day ORDER BY us), us + 1) AS b FROM b{s}
  UNION ALL SELECT process, 1, 'phase_' || (day % 7)::VARCHAR, min(us), max(us) + 1 FROM b{s} GROUP BY process, day
  UNION ALL SELECT process, 0, 'main', min(us), max(us) + 1 FROM b{s} GROUP BY process),
ev{s} AS (
  SELECT (((a - 1577836800000000) * 2 + 1) * 4 + d) * 8 + process AS event_id, (a - 1577836800000000) * 1000 AS ts_ns, 'Enter' AS event_type, name, process FROM calls{s}
  UNION ALL SELECT (((b - 1577836800000000) * 2) * 4 + 2 - d) * 8 + process, (b - 1577836800000000) * 1000, 'Leave', name, process FROM calls{s})"""


def dirty(spark: SparkSession, sf_dir: str, partial: bool = False) -> DataFrame:
    """Interleaved calls; ``partial`` leaves out some Enters and some Leaves."""
    rows = base(spark, sf_dir)
    ends = F.array(
        F.struct(F.lit("Enter").alias("event_type"), F.col("us").alias("us"), F.lit(1).alias("e")),
        F.struct(F.lit("Leave").alias("event_type"), (F.col("us") + F.col("cents") * 600_000).alias("us"), F.lit(0).alias("e")),
    )
    both = rows.select("event_id", "process", F.col("event_type").alias("name"), F.explode(ends).alias("x")).select("event_id", "process", "name", "x.*")
    if partial:
        both = both.filter(~(((F.col("event_id") % 7 == 0) & (F.col("e") == 1)) | ((F.col("event_id") % 11 == 0) & (F.col("e") == 0))))
    key = ((F.col("us") - EPOCH) * 2 + F.col("e")) * 16384 + F.col("event_id") % 16384
    return both.select(key.alias("event_id"), ((F.col("us") - EPOCH) * 1000).alias("ts_ns"), "event_type", "name", "process")


_DIRTY = """
b AS (SELECT event_id, epoch_us(ts) AS us, (user_id % 8)::INT AS process, event_type AS name, round(value * 100)::BIGINT AS cents FROM events),
x AS (SELECT event_id, process, name, us, 1 AS e, 'Enter' AS event_type FROM b
  UNION ALL SELECT event_id, process, name, us + cents * 600000, 0, 'Leave' FROM b),
ev AS (SELECT ((us - 1577836800000000) * 2 + e) * 16384 + event_id % 16384 AS event_id, (us - 1577836800000000) * 1000 AS ts_ns, event_type, name, process FROM x {where})"""
DIRTY_SQL = _DIRTY.format(where="")
PARTIAL_SQL = _DIRTY.format(where="WHERE NOT (event_id % 7 = 0 AND e = 1 OR event_id % 11 = 0 AND e = 0)")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sends and receives with their attributes as JSON."""
    rows = base(spark, sf_dir)
    name = F.when(F.col("event_id") % 2 == 0, "MpiSend").otherwise("MpiRecv")
    attributes = F.to_json(F.struct((F.col("k") % 8).alias("receiver"), F.col("cents").alias("msg_length")))
    return rows.select("event_id", ((F.col("us") - EPOCH) * 1000).alias("ts_ns"), F.lit("Instant").alias("event_type"), name.alias("name"), "process", attributes.alias("attributes"))


MESSAGES_SQL = """
ev AS (SELECT event_id, (epoch_us(ts) - 1577836800000000) * 1000 AS ts_ns, CASE WHEN event_id % 2 = 0 THEN 'MpiSend' ELSE 'MpiRecv' END AS name,
  (user_id % 8)::INT AS process, json_extract(props, '$.k')::BIGINT % 8 AS receiver, round(value * 100)::BIGINT AS msg_length FROM events)"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested trace with a counter that runs along each process, and the number of rows that bear each id.

    Rows of one id have the counter after all of them.
    """
    rows = nested(spark, sf_dir)
    order = Window.partitionBy("process").orderBy("event_id")
    so_far, same = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, 0)
    return rows.withColumns({"cycles": F.sum(F.col("event_id") % 97 + 1).over(so_far), "bearers": F.count(F.lit(1)).over(same)})
