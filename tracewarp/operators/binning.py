"""Equal-width bins: histograms and the time profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ENTER


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Uniform edges; the last is ``high`` itself. A single point gets half a unit on either side."""
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def edges_of(values: DataFrame, column: str, bins, span=None) -> list[float]:
    """Edges given as a list, or made for ``span`` or the column's range (none: 0 to 1)."""
    if not isinstance(bins, int):
        return [float(e) for e in bins]
    if span is None:
        low, high = values.agg(F.min(column), F.max(column)).first()
        span = (0.0, 1.0) if low is None else (low, high)
    return bin_edges(float(span[0]), float(span[1]), bins)


def bin_column(value: Column, edges: list[float]) -> Column:
    """The bin of a value: half-open but for the last, null outside.

    Uniform edges start from arithmetic and are put right against the edges
    themselves, so rounding never moves a value across one.
    """
    n = len(edges) - 1
    own = F.array(*[F.lit(float(e)) for e in edges])
    width = (edges[-1] - edges[0]) / n
    x = value.cast("double")
    guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((x - F.lit(edges[0])) / F.lit(width)).cast("int")))
    uniform = all(abs(e - (edges[0] + i * width)) <= 1e-9 * max(1.0, abs(e)) for i, e in enumerate(edges))
    if uniform:
        index = F.when(x < F.get(own, guess), guess - 1).when((guess < n - 1) & (x >= F.get(own, guess + 1)), guess + 1).otherwise(guess)
    else:
        index = F.least(F.lit(n - 1), F.size(F.filter(own, lambda e: e <= x)) - 1)
    return F.when((x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), index)


def histogram(values: DataFrame, column: str, bins=20, span=None, weight: str | None = None, density: bool = False) -> DataFrame:
    """(bin, bin_start, bin_end, value): counts, or sums of ``weight``; densities integrate to 1."""
    edges = edges_of(values, column, bins, span)
    spark = values.sparkSession
    axis = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)], "bin int, bin_start double, bin_end double")
    amount = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    found = values.select(bin_column(F.col(column), edges).alias("bin"), *([weight] if weight else [])).filter("bin IS NOT NULL").groupBy("bin").agg(amount.alias("value"))
    out = axis.join(found, "bin", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if density:
        total = out.agg(F.sum("value").alias("total"))
        out = out.crossJoin(F.broadcast(total)).withColumn("value", F.try_divide("value", F.col("total") * (F.col("bin_end") - F.col("bin_start")))).drop("total")
    return out


IDLE_COLUMN = "idle_time"


def time_profile(called: DataFrame, num_bins: int = 50, normalized: bool = False, events: DataFrame | None = None) -> DataFrame:
    """(bin, bin_start, bin_end, name, value): exclusive time of each name in each bin, and the idle rest.

    A call overlaps the bins it is unrolled to, and no others, so the work is the
    overlaps' and not bins times events. Its overlap counts for its own name and
    against its caller's, where the caller overlaps the bin too. Values under 0.01
    become 0; capacity counts processes. The span and the processes are read at once,
    from ``events`` where the table before matching is at hand.
    """
    ends = (called if events is None else events).agg(F.min("ts_ns").alias("lo"), F.max("ts_ns").alias("hi"), F.count_distinct("process").alias("p")).first()
    if ends["lo"] is None:
        return called.sparkSession.createDataFrame([], "bin int, bin_start double, bin_end double, name string, value double")
    edges = bin_edges(float(ends["lo"]), float(ends["hi"]), num_bins)
    own = F.array(*[F.lit(e) for e in edges])
    calls = called.filter((F.col("event_type") == ENTER) & F.col("matching_event").isNotNull())
    calls = calls.select("event_id", "name", "ts_ns", "matching_ts_ns", "parent")
    callers = calls.select(F.col("event_id").alias("parent"), F.col("name").alias("__pn"), F.col("ts_ns").alias("__ps"), F.col("matching_ts_ns").alias("__pe"))
    calls = calls.join(callers, "parent", "left")
    first, last = bin_column(F.col("ts_ns"), edges), bin_column(F.col("matching_ts_ns"), edges)
    spread = calls.withColumn("bin", F.explode(F.sequence(first, F.least(last, F.lit(num_bins - 1)))))
    start, end = F.get(own, F.col("bin")), F.get(own, F.col("bin") + 1)
    overlap = F.least(F.col("matching_ts_ns").cast("double"), end) - F.greatest(F.col("ts_ns").cast("double"), start)
    spread = spread.withColumn("__o", overlap).filter("__o > 0")
    under = (F.col("__pe") > start) & (F.col("__ps") < end)
    signed = F.array(F.struct(F.col("name"), F.col("__o").alias("x")), F.struct(F.when(under, F.col("__pn")).alias("name"), (-F.col("__o")).alias("x")))
    parts = spread.select("bin", F.explode(signed).alias("s")).select("bin", "s.name", "s.x").filter("name IS NOT NULL")
    used = parts.groupBy("bin", "name").agg(F.sum("x").alias("value"))
    axis = called.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(num_bins)], "bin int, bin_start double, bin_end double")
    capacity = (F.col("bin_end") - F.col("bin_start")) * F.lit(float(ends["p"]))
    rest = axis.join(used.groupBy("bin").agg(F.sum("value").alias("used")), "bin", "left")
    idle = rest.select("bin", "bin_start", "bin_end", F.lit(IDLE_COLUMN).alias("name"), (capacity - F.coalesce("used", F.lit(0.0))).alias("value"))
    out = idle.unionByName(used.join(axis, "bin").select("bin", "bin_start", "bin_end", "name", "value"))
    out = out.withColumn("value", F.when(F.col("value") < 0.01, 0.0).otherwise(F.col("value")))
    return out.withColumn("value", F.try_divide(F.col("value"), capacity)) if normalized else out


def time_profile_wide(called: DataFrame, num_bins: int = 50, normalized: bool = False, names: list[str] | None = None, events: DataFrame | None = None) -> DataFrame:
    """The time profile with a column for each name, idle time first, after the bin's edges."""
    long = time_profile(called, num_bins, normalized, events)
    if names is None:
        names = names_of(called)
    wide = long.groupBy("bin", "bin_start", "bin_end").pivot("name", [IDLE_COLUMN, *names]).agg(F.first("value"))
    return wide.na.fill(0.0).orderBy("bin")


def names_of(called: DataFrame) -> list[str]:
    """Names of matched calls in the order of their first; columns of a wide table must be known to the plan."""
    seen = called.filter((F.col("event_type") == ENTER) & F.col("matching_event").isNotNull()).groupBy("name").agg(F.min("event_id").alias("first"))
    return [r["name"] for r in seen.orderBy("first").collect()]
