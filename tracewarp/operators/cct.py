"""The calling context tree as tables.

A node is a call path shared by all processes; its id is the first event that
reached it, so ids are unique and stable without numbering all nodes in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ENTER, LEAVE

SEPARATOR = "->"


def call_paths(events: DataFrame) -> DataFrame:
    """(event_id, path): the open calls at each Enter, itself last.

    A Leave closes the nearest open call of its name, wherever in the stack, so
    calls that never end stay in the paths below them. Each location's events
    stream in order past one stack; memory holds the stack alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, stack = None, []
        for batch in batches:
            ids, paths = [], []
            for event_id, process, thread, kind, name in zip(*(batch.column(c).to_pylist() for c in ("event_id", "process", "thread", "event_type", "name"))):
                if (process, thread) != here:
                    here, stack = (process, thread), []
                if kind == ENTER:
                    stack.append(name)
                    ids.append(event_id)
                    paths.append(list(stack))
                else:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k] == name:
                            del stack[k]
                            break
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.string()))], names=["event_id", "path"])

    rows = events.filter(F.col("event_type").isin(ENTER, LEAVE) & F.col("name").isNotNull())
    rows = rows.select(F.col("event_id").cast("bigint").alias("event_id"), "process", "thread", "event_type", "name")
    ordered = rows.repartition("process", "thread").sortWithinPartitions("process", "thread", "event_id")
    return ordered.mapInArrow(run, "event_id long, path array<string>")


def caller_paths(matched: DataFrame) -> DataFrame:
    """(event_id, path): the callers of each matched Enter as ``match_callers`` finds them, itself last.

    Unmatched calls are in no path. A location's rows stream past the paths of its
    latest Enters at each depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, latest, depth = None, [], 0
        for batch in batches:
            ids, paths = [], []
            for event_id, process, thread, kind, name in zip(*(batch.column(c).to_pylist() for c in ("event_id", "process", "thread", "event_type", "name"))):
                if (process, thread) != here:
                    here, latest, depth = (process, thread), [], 0
                if kind == ENTER:
                    del latest[depth:]
                    latest.append([*latest[-1], name] if latest else [name])
                    ids.append(event_id)
                    paths.append(latest[-1])
                    depth += 1
                else:
                    depth -= 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.list_(pa.string()))], names=["event_id", "path"])

    rows = matched.filter(F.col("matching_event").isNotNull()).select(F.col("event_id").cast("bigint").alias("event_id"), "process", "thread", "event_type", "name")
    # Matching has dealt the rows by location already.
    return rows.sortWithinPartitions("process", "thread", "event_id").mapInArrow(run, "event_id long, path array<string>")


def nodes(paths: DataFrame) -> DataFrame:
    """(node_id, parent_id, level, name, path, calls) of every distinct call path."""
    own = paths.groupBy("path").agg(F.min("event_id").alias("node_id"), F.count(F.lit(1)).alias("calls"))
    above = own.select(F.col("path").alias("__above"), F.col("node_id").alias("parent_id"))
    up = F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1))
    joined = own.withColumn("__up", up).join(above, F.col("__up") == F.col("__above"), "left")
    return joined.select("node_id", "parent_id", (F.size("path") - 1).alias("level"), F.element_at("path", -1).alias("name"), "path", "calls")


def roots(tree: DataFrame) -> DataFrame:
    return tree.filter("parent_id IS NULL")


def event_links(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """(event_id, node_id) of every Enter."""
    return paths.join(tree.select("path", "node_id"), "path").select("event_id", "node_id")


def common_prefix(a: Column, b: Column) -> Column:
    """The longest path that both paths start with: the lowest common ancestor's. Null if there is none."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(same, False)
    size = F.when(first_off > 0, first_off - 1).otherwise(F.least(F.size(a), F.size(b)).cast("bigint"))
    return F.when(size > 0, F.slice(a, F.lit(1), size.cast("int")))


def intersections(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, node_id): the lowest common ancestor of pairs of node ids; null for disjoint roots."""
    one = tree.select(F.col("node_id").alias("a"), F.col("path").alias("__pa"))
    two = tree.select(F.col("node_id").alias("b"), F.col("path").alias("__pb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("__lca", common_prefix(F.col("__pa"), F.col("__pb")))
    named = tree.select(F.col("path").alias("__path"), "node_id")
    return met.join(named, F.col("__lca") == F.col("__path"), "left").select("a", "b", "node_id")


def ancestors(tree: DataFrame, min_level: int = -1) -> DataFrame:
    """(node_id, names): a node and those above it, leaf first, down to levels over ``min_level``."""
    from_ = min_level + 2
    names = F.reverse(F.when(F.size("path") >= from_, F.slice("path", F.lit(from_), F.greatest(F.lit(0), F.size("path") - from_ + 1))).otherwise(F.array().cast("array<string>")))
    return tree.select("node_id", names.alias("names"))
