"""Profiles over names and processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENTER, metric_name

IDLE = ("Idle",)
MPI_WAITS = ("MPI_Wait", "MPI_Waitall", "MPI_Recv")


def flat_profile(events: DataFrame, metrics="time.exc", groupby_column="name", per_process: bool = False) -> DataFrame:
    """Sums of metrics by group and process, or their mean over the processes where the group occurs.

    A group without any value counts as 0.
    """
    names = [metric_name(m) for m in ([metrics] if isinstance(metrics, str) else metrics)]
    groups = [groupby_column] if isinstance(groupby_column, str) else list(groupby_column)
    enters = events.filter(F.col("event_type") == ENTER)
    sums = enters.groupBy(*groups, "process").agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in names])
    return sums if per_process else sums.groupBy(*groups).agg(*[F.avg(m).alias(m) for m in names])


def load_imbalance(events: DataFrame, metric: str = "time.exc", num_processes: int = 1) -> DataFrame:
    """(name, mean, imbalance, top_processes) by falling mean: the largest process over the mean, and who leads.

    ``top_processes`` has at most as many entries as there are processes.
    """
    column = metric_name(metric)
    sums = flat_profile(events, metric, "name", per_process=True)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col(column)).alias("__v"), "process")))
    whole = sums.groupBy("name").agg(F.avg(column).alias("mean"), F.max(column).alias("__max"), F.slice(ranked, 1, num_processes).alias("__top"))
    ratio = F.try_divide(F.col("__max"), F.nullif(F.col("mean"), F.lit(0)))
    out = whole.select("name", "mean", ratio.alias("imbalance"), F.transform("__top", lambda x: x["process"]).alias("top_processes"))
    return out.orderBy(F.desc("mean"), "name")


def idle_time(events: DataFrame, idle_functions=IDLE, mpi_events: bool = False) -> DataFrame:
    """(process, idle_time): inclusive time in idle functions; every process is there."""
    names = [*idle_functions, *(MPI_WAITS if mpi_events else ())]
    idle = F.when((F.col("event_type") == ENTER) & F.col("name").isin(names), F.col("time_inc"))
    return events.groupBy("process").agg(F.coalesce(F.sum(idle), F.lit(0)).alias("idle_time"))


def multirun_analysis(runs: dict[str, DataFrame], metric: str = "time.exc", groupby_column: str = "name") -> DataFrame:
    """(run, <group>, value): the flat profile of each run, zero where a group is absent in it."""
    column, parts = metric_name(metric), None
    for run, events in runs.items():
        one = flat_profile(events, metric, groupby_column).select(F.lit(run).alias("run"), groupby_column, F.col(column).cast("double").alias("value"))
        parts = one if parts is None else parts.unionByName(one)
    # One row a group holds its value in each run; runs are the report's axis.
    by_group = parts.groupBy(groupby_column).agg(F.map_from_entries(F.collect_list(F.struct("run", "value"))).alias("__v"))
    grid = by_group.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))
    return grid.select("run", groupby_column, F.coalesce(F.try_element_at("__v", F.col("run")), F.lit(0.0)).alias("value"))


def multirun_table(runs: dict[str, DataFrame], metric: str = "time.exc", groupby_column: str = "name") -> DataFrame:
    """One row for each run and one column for each group, by falling total."""
    long = multirun_analysis(runs, metric, groupby_column)
    totals = long.groupBy(groupby_column).agg(F.sum("value").alias("total")).orderBy(F.desc("total"), groupby_column)
    columns = [r[0] for r in totals.select(groupby_column).collect()]  # names of columns must be known to the plan
    return long.groupBy("run").pivot(groupby_column, columns).agg(F.first("value")).orderBy("run")
