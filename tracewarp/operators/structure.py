"""Event pairing and call structure by window expressions.

Matching deletes the nearest open Enter of the same name, so it is independent
bracket matching for each (process, thread, name): a running sum gives a level at
which Enters and Leaves alternate, and the neighbour at that level is the match.
Callers follow a stack that pops its top: a running sum over matched rows gives
the depth, and the caller is the latest Enter one level up. Rows are dealt by
location once; all windows partition by (process, thread) and more, so matching,
callers and exclusive metrics move no row again. One location's events are one
task's, as a call stack is sequential.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ENTER, LEAVE, LOCATION, is_bracket


def match_events(events: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Adds ``matching_event``, ``matching_ts_ns``, ``time_inc`` and ``<metric>_inc``.

    Both ends of a pair point at each other; inclusive values are on Enter rows.
    They come from the level window itself, without a join.
    """
    metrics = metrics or []
    named = F.when(is_bracket(), F.col("name"))
    rows = events.repartition(*LOCATION).withColumn("__n", named)
    step = F.when(F.col("__n").isNull(), 0).when(F.col("event_type") == ENTER, 1).otherwise(-1)
    by_name = Window.partitionBy(*LOCATION, "__n").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.sum(step).over(by_name))
    rows = rows.withColumn("__level", F.when(F.col("event_type") == LEAVE, F.col("__s") + 1).otherwise(F.col("__s")))
    by_level = Window.partitionBy(*LOCATION, "__n", "__level").orderBy("event_id")
    value = F.struct("event_id", "ts_ns", *metrics)
    other = F.when(F.col("event_type") == ENTER, F.lead(value).over(by_level)).otherwise(F.lag(value).over(by_level))
    rows = rows.withColumn("__m", F.when(F.col("__n").isNotNull(), other))
    enter = F.col("event_type") == ENTER
    out = rows.withColumns(
        {
            "matching_event": F.col("__m.event_id"),
            "matching_ts_ns": F.col("__m.ts_ns"),
            "time_inc": F.when(enter, F.col("__m.ts_ns") - F.col("ts_ns")),
            **{f"{m}_inc": F.when(enter, F.col(f"__m.`{m}`") - F.col(f"`{m}`")) for m in metrics},
        }
    )
    return out.drop("__n", "__s", "__level", "__m")


def match_callers(matched: DataFrame) -> DataFrame:
    """Adds ``depth`` and ``parent`` to matched Enter rows; null elsewhere."""
    pair = F.col("matching_event").isNotNull()
    by_location = Window.partitionBy(*LOCATION, "__p").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == ENTER, 1).otherwise(-1)
    rows = matched.withColumn("__p", pair)
    rows = rows.withColumn("depth", F.when(F.col("__p") & (F.col("event_type") == ENTER), (F.sum(step).over(by_location) - 1).cast("int")))
    # An Enter stands once at its own depth, asking, and once below it, answering.
    both = F.when(F.col("depth").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__below", F.explode(both))
    key = F.when(F.col("depth").isNotNull(), F.col("depth") + F.col("__below"))
    earlier = Window.partitionBy(*LOCATION, "__k").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("__below") == 1, F.col("event_id")), ignorenulls=True).over(earlier)
    rows = rows.withColumn("__k", key).withColumn("parent", F.when(F.col("depth") > 0, answer))
    return rows.filter("__below = 0").drop("__p", "__below", "__k")


def children(called: DataFrame) -> DataFrame:
    """(event_id, children): the ordered ids of the calls that an Enter made itself."""
    found = called.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("event_id"))
    return found.agg(F.array_sort(F.collect_list("event_id")).alias("children"))


def unmatched(matched: DataFrame) -> DataFrame:
    """Enter and Leave rows without a partner."""
    return matched.filter(F.col("event_type").isin(ENTER, LEAVE) & F.col("matching_event").isNull())


def exclusive(called: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Adds ``time_exc`` and ``<metric>_exc``: inclusive less the sum of the calls made.

    A call stands once under its own id and once under its caller's, which is in the
    same location; a window by that id sums the calls, without a join or a list of
    children.
    """
    names = ["time", *(metrics or [])]
    under = F.when(F.col("parent").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = called.withColumn("__side", F.explode(under)).withColumn("__of", F.when(F.col("__side") == 1, F.col("parent")).otherwise(F.col("event_id")))
    own = Window.partitionBy(*LOCATION, "__of")
    made = {m: F.coalesce(F.sum(F.when(F.col("__side") == 1, F.col(f"{m}_inc"))).over(own), F.lit(0)) for m in names}
    out = rows.withColumns({f"{m}_exc": F.col(f"{m}_inc") - made[m] for m in names})
    return out.filter("__side = 0").drop("__side", "__of")
