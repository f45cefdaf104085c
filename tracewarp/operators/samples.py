"""Events from call-path samples.

Between two samples of one profile, calls end from the old leaf up to the lowest
common ancestor and begin from there down to the new leaf.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ENTER, LEAVE
from .cct import common_prefix


def sample_moves(samples: DataFrame) -> DataFrame:
    """(profile, seq, place, ts_ns, event_type, element, level) from (profile, seq, ts_ns, path).

    A path is an array of anything comparable, root first; an empty or null one is
    idle. Unchanged samples make no events; all that is open closes at the latest
    time of the whole trace.
    """
    kind = dict(samples.dtypes)["path"]
    nothing = F.array().cast(kind)
    rows = samples.select("profile", "seq", "ts_ns", F.coalesce("path", nothing).alias("path"))
    last = rows.agg(F.max("ts_ns").alias("ts_ns"))
    close = rows.groupBy("profile").agg((F.max("seq") + 1).alias("seq")).crossJoin(F.broadcast(last)).select("profile", "seq", "ts_ns", nothing.alias("path"))
    order = Window.partitionBy("profile").orderBy("seq")
    both = rows.unionByName(close).withColumn("__old", F.coalesce(F.lag("path").over(order), nothing))
    both = both.filter("path <> __old").withColumn("__keep", F.greatest(F.lit(0), F.coalesce(F.size(common_prefix(F.col("__old"), F.col("path"))), F.lit(0))))
    part = lambda c, event: F.transform(
        F.slice(c, F.col("__keep") + 1, F.greatest(F.lit(0), F.size(c) - F.col("__keep"))),
        lambda x, i: F.struct(F.lit(event).alias("event_type"), x.alias("element"), (i + F.col("__keep")).alias("level")),
    )
    moves = F.concat(F.reverse(part(F.col("__old"), LEAVE)), part(F.col("path"), ENTER))
    return both.select("profile", "seq", "ts_ns", F.posexplode(moves).alias("place", "e")).select("profile", "seq", "place", "ts_ns", "e.*")


def sample_events(samples: DataFrame) -> DataFrame:
    """:func:`sample_moves` for paths of names."""
    return sample_moves(samples).withColumnRenamed("element", "name")


def interval_events(intervals: DataFrame, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """An Enter and a Leave row for each interval; other columns stay."""
    both = F.array(
        F.struct(F.lit(ENTER).alias("event_type"), F.col(f"`{start}`").cast("bigint").alias("ts_ns")),
        F.struct(F.lit(LEAVE).alias("event_type"), F.col(f"`{end}`").cast("bigint").alias("ts_ns")),
    )
    rest = [f"`{c}`" for c in intervals.columns if c not in (start, end)]
    return intervals.withColumn("__e", F.explode(both)).select("__e.*", *rest)
