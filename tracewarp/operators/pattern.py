"""Repeating patterns of one process by the matrix profile.

The series is the metric of the calls between the first Enter and the last Leave
of a start event. The matrix profile holds, for every window, the z-normalised
Euclidean distance to its nearest neighbour outside an exclusion zone (Yeh et al.,
"Matrix Profile I", 2016). The window with the least distance and its nearest
matches are the pattern.

Of the profile only its least entry is needed. The series is cut into blocks, and
each pair of blocks is one row of a table: a matrix product of normalised windows
gives their likenesses, ``SIDE`` windows a side at a time, so all pairs of windows
are compared, spread over tasks, and a task holds two blocks. The distance follows
from the likeness: d² = 2 (window - likeness). Windows that are alike up to
rounding (``EQUAL``) have distance 0, and the first of equal pairs is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENTER, LEAVE, metric_name
from ..session import stored

OUT = "occurrence int, start_place int, distance double, event_id long"
#: Windows a block at least, blocks at most (blocks get longer above), and windows a side of one product.
BLOCK, BLOCKS, SIDE = 4096, 64, 512
EQUAL = 1e-12


def normalised(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows with mean 0 and deviation 1, which of them are flat, and which hold no number."""
    views = np.lib.stride_tricks.sliding_window_view(values, window)
    mean, std = views.mean(axis=1), views.std(axis=1)
    flat, none = std < 1e-12, ~np.isfinite(std)
    rows = (views - mean[:, None]) / np.where(flat, 1.0, std)[:, None]
    rows[flat | none] = 0.0
    return rows, flat, none


def likeness(one: tuple, two: tuple, window: int) -> np.ndarray:
    """Products of normalised windows; flat windows are like flat ones only."""
    out = one[0] @ two[0].T
    if one[1].any() or two[1].any():
        out[one[1]] = out[:, two[1]] = window / 2
        out[np.ix_(one[1], two[1])] = window
    if one[2].any() or two[2].any():
        out[one[2]] = out[:, two[2]] = -np.inf
    return out


def nearest_pair(one: np.ndarray, two: np.ndarray, first: int, second: int, window: int, zone: int) -> tuple[float, int]:
    """(likeness, place of the earlier window) of the most alike windows of two blocks that start at ``first`` <= ``second``."""
    side = max(16, min(SIDE, (1 << 22) // window))
    best, place = -np.inf, -1
    for a in range(0, len(one) - window + 1, side):
        rows = normalised(one[a : a + side + window - 1], window)
        i, n = first + a, len(rows[0])
        for b in range(0, len(two) - window + 1, side):
            j, m = second + b, min(side, len(two) - window + 1 - b)
            if j + m - 1 - i <= zone:
                continue
            like = likeness(rows, normalised(two[b : b + side + window - 1], window), window)
            if j - (i + n - 1) <= zone:  # pairs in the exclusion zone, and each pair once
                like[np.arange(j, j + m)[None, :] - np.arange(i, i + n)[:, None] <= zone] = -np.inf
            most = like.max(axis=1)
            most[most > window * (1 - EQUAL)] = window
            k = int(most.argmax())
            if (most[k], -(i + k)) > (best, -place):
                best, place = float(most[k]), i + k
    return best, place


def _values(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _closest(blocks: DataFrame, count: int, size: int, window: int, zone: int) -> DataFrame:
    """(place): the earlier window of the most alike two, 0 if there are no two; one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("block").to_pylist(), batch.column("other").to_pylist()
            found = [nearest_pair(_values(batch.column("values"), k), _values(batch.column("others"), k), i * size, j * size, window, zone) for k, (i, j) in enumerate(zip(a, b))]
            found = [x for x in found if np.isfinite(x[0])]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())], names=["like", "place"])

    others = blocks.select(F.col("block").alias("other"), F.col("values").alias("others"))
    pairs = blocks.withColumn("other", F.explode(F.sequence("block", F.lit(count - 1)))).join(others, "other")
    pairs = pairs.select("block", "other", "values", "others").repartition(min(512, count * (count + 1) // 2), "block", "other")
    best = pairs.mapInArrow(run, "like double, place long").agg(F.max_by("place", F.struct("like", -F.col("place"))).alias("place"))
    return best.select(F.coalesce("place", F.lit(0)).alias("place"))


def _matches(blocks: DataFrame, closest: DataFrame, size: int, window: int, zone: int, most: int) -> DataFrame:
    """(occurrence, start_place, distance): the window of ``closest`` and its nearest ones, none overlapping."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = max(16, (1 << 22) // window)
        for batch in batches:
            for k, (block, place) in enumerate(zip(batch.column("block").to_pylist(), batch.column("place").to_pylist())):
                own, values = normalised(_values(batch.column("own"), k), window), _values(batch.column("values"), k)
                like = np.concatenate([likeness(normalised(values[a : a + side + window - 1], window), own, window)[:, 0] for a in range(0, len(values) - window + 1, side)] or [np.empty(0)])
                like[like > window * (1 - EQUAL)] = window
                distance = np.sqrt(np.clip(2 * (window - like), 0, None))
                at = np.arange(len(like)) + block * size
                distance[at == place] = 0.0
                # A match rules out 2 * zone + 1 places, so no later one is chosen.
                kept = np.argsort(distance, kind="stable")[: most * (2 * zone + 1)]
                kept = kept[np.isfinite(distance[kept])]
                yield pa.RecordBatch.from_arrays([pa.array(distance[kept]), pa.array(at[kept], pa.int64())], names=["distance", "place"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, list[int]] = {}
        rows: list[tuple] = []
        for batch in batches:
            for distance, place in zip(batch.column("distance").to_pylist(), batch.column("place").to_pylist()):
                if len(rows) == most:
                    break
                cell = place // (zone + 1)
                if all(abs(place - x) > zone for c in (cell - 1, cell, cell + 1) for x in taken.get(c, ())):
                    taken.setdefault(cell, []).append(place)
                    rows.append((len(rows), place, distance))
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], names=["occurrence", "start_place", "distance"])

    holds = F.col("block") == (F.col("place") / size).cast("bigint")
    own = blocks.join(F.broadcast(closest), holds).select("place", F.slice("values", (F.col("place") % size + 1).cast("int"), window).alias("own"))
    candidates = blocks.crossJoin(F.broadcast(own)).mapInArrow(near, "distance double, place long")
    return candidates.repartition(1).sortWithinPartitions("distance", "place").mapInArrow(choose, "occurrence int, start_place int, distance double")


def detect_pattern(events: DataFrame, start_event: str, iterations: int | None = None, window_size: int | None = None, process: int = 0, metric: str = "time.exc") -> DataFrame:
    """(occurrence, start_place, distance, event_id): the calls of each occurrence of the pattern.

    ``iterations`` defaults to the number of times the start event is entered, and
    ``window_size`` to the number of calls over ``iterations``. The chosen process's
    calls are put in order and written once to the shared folder; the search reads
    them there when its result is asked for.
    """
    column = metric_name(metric)
    own = events.filter(F.col("process") == process)
    named = F.col("name") == start_event
    first, last, times = own.agg(
        F.min(F.when(named & (F.col("event_type") == ENTER), F.col("event_id"))),
        F.max(F.when(named & (F.col("event_type") == LEAVE), F.col("event_id"))),
        F.count(F.when(named & (F.col("event_type") == ENTER), 1)),
    ).first()
    calls = own.filter((F.col("event_type") == ENTER) & F.col(column).isNotNull() & (F.col("event_id") > F.lit(first)) & (F.col("event_id") < F.lit(last)))
    ordered = calls.select(F.col("event_id").cast("bigint").alias("event_id"), F.col(column).cast("double").alias("value")).repartition(1).sortWithinPartitions("event_id")
    series = stored(ordered.withColumn("at", F.monotonically_increasing_id()))  # of one partition: 0, 1, 2 and on
    n = series.count()
    most = iterations or max(1, times)
    window = window_size or max(1, n // most)
    if n < window or window < 1:
        return series.sparkSession.createDataFrame([], OUT)
    zone = max(1, -(-window // 4))
    size = max(BLOCK, -(-n // BLOCKS), window)
    count = -(-(n - window + 1) // size)
    # A block has its windows' values, so it ends with the first ones of the next.
    spread = series.select("at", "value", F.explode(F.array_distinct(F.array(F.expr(f"at div {size}"), F.expr(f"(at - {window - 1}) div {size}")))).alias("block")).filter(f"block < {count} AND at - block * {size} < {size + window - 1}")
    blocks = spread.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("rows")).select("block", F.col("rows.value").alias("values"))
    found = _matches(blocks, _closest(blocks, count, size, window, zone), size, window, zone, most)
    places = found.withColumn("at", F.explode(F.sequence(F.col("start_place").cast("bigint"), F.col("start_place").cast("bigint") + window - 1)))
    return places.join(series, "at").select("occurrence", "start_place", "distance", "event_id")
