"""The canonical event table.

``event_id`` orders the events: it is unique and grows with time and, at equal
times, with the order of the source. It need not be dense, so it is made from an
order key or from partition offsets and never by a global window. Offsets differ
from one evaluation of a plan to the next, so a table that gets them is written
once to the session's shared folder and read from there ever after.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stored

ENTER, LEAVE, INSTANT = "Enter", "Leave", "Instant"
REQUIRED = {"ts_ns": "bigint", "event_type": "string", "name": "string"}
OPTIONAL = {"process": "int", "thread": "int"}
LOCATION = ["process", "thread"]
#: Columns that never count as metrics.
STRUCTURAL = {
    "event_id", "ts_ns", "event_type", "name", "process", "thread", "attributes", "matching_event", "matching_ts_ns", "depth", "parent",
    "receiver", "msg_length", "node_id", "source_seq", "core", "calling_context_id", "source_line",
}


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``event_id`` in the order of ``order`` and then of the source, written once and read back.

    A row's place in the source (file, block, row of the partition) is taken before
    anything moves. Rows are then dealt by range and sorted in place; ids are the
    partition's number in the high bits and the row's place in the low ones.
    """
    place = {"__file": F.input_file_name(), "__block": F.input_file_block_start(), "__row": F.monotonically_increasing_id()}
    try:
        placed = df.withColumns(place)
    except AnalysisException:  # Spark names no file where a plan has more than one source
        place = {"__row": F.monotonically_increasing_id()}
        placed = df.withColumns(place)
    keys = [*order, *place]
    dealt = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return stored(dealt.withColumn("event_id", F.monotonically_increasing_id()).drop(*place))


def normalise(df: DataFrame, *order: str) -> DataFrame:
    """Types as above, missing optional columns added, and ``event_id`` if the source has none."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"an event table needs {', '.join(missing)}")
    for name, kind in REQUIRED.items():
        df = df.withColumn(name, F.col(name).cast(kind))
    for name, kind in OPTIONAL.items():
        df = df.withColumn(name, F.col(name).cast(kind) if name in df.columns else F.lit(0).cast(kind))
    if "event_id" not in df.columns:
        df = numbered(df, *(order or ("ts_ns",)))
    return df


def is_bracket() -> Column:
    """Enter and Leave rows that can match; other event types, loops too, and unnamed calls never do."""
    return F.col("event_type").isin(ENTER, LEAVE) & F.col("name").isNotNull()


def metric_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not part of the structure."""
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "decimal")
    return [n for n, t in df.dtypes if t.startswith(numeric) and n not in STRUCTURAL and not n.endswith(("_inc", "_exc"))]


def metric_name(metric: str) -> str:
    """``time.exc`` and ``PAPI.inc`` as the columns ``time_exc`` and ``PAPI_inc``."""
    head, dot, tail = metric.rpartition(".")
    return f"{head}_{tail}" if dot and tail in ("inc", "exc") else metric
