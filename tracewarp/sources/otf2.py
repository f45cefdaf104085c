"""OTF2 archives, by the optional ``otf2`` package.

Definitions are read on the driver; events by a data source with one partition
for each block of locations. Every worker needs the package and the archive.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import normalise


def _otf2():
    try:
        import otf2
    except ImportError as e:
        raise ImportError("reading OTF2 archives needs the otf2 package on the driver and the workers") from e
    return otf2


def plain(value, is_definition=lambda v: False):
    """Lists, sets, tuples and dicts with every definition as ``"Kind ref"`` and other objects as text."""
    if isinstance(value, dict):
        return {str(plain(k, is_definition)): plain(v, is_definition) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v, is_definition) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v, is_definition) for v in value), key=str)
    if is_definition(value):
        return f"{type(value).__name__} {value._ref}"
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def fields(definition, is_definition=lambda v: False):
    """A definition's fields by name; a single one stands alone."""
    own = {str(f.name): plain(getattr(definition, f.name), is_definition) for f in definition._fields}
    return next(iter(own.values())) if len(own) == 1 else own


def blocks(n: int, parts: int) -> list[tuple[int, int]]:
    """``n`` places in ``parts`` runs whose sizes differ by one at most."""
    parts = max(1, min(parts, n))
    return [(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


def to_ns(ticks, offset, resolution):
    """Nanoseconds since the trace's start."""
    return ((ticks - offset) * F.lit(1e9) / resolution).cast("bigint")


def is_definition(value) -> bool:
    return hasattr(value, "_ref") and hasattr(value, "_fields")


def event_rows(events, first: dict[int, int]) -> Iterator[tuple]:
    """Raw rows of (location, event) pairs; ``first`` is the least location of each process.

    A metric event has no row of its own: it gives its values, by the names of its own
    metric class, to the event of its location at its time.
    """
    held: dict[int, tuple[int, dict]] = {}
    for seq, (loc, event) in enumerate(events):
        kind = type(event).__name__
        if kind == "Metric":
            held[loc._ref] = (event.time, dict(zip([m.name for m in event.metric.members], event.values)))
            continue
        call = kind in ("Enter", "Leave")
        attributes = None
        if kind != "Leave":
            own = {k: plain(v, is_definition) for k, v in vars(event).items() if k not in ("time", "region") and not k.startswith("_")}
            attributes = json.dumps(own) if own else None
        time, values = held.get(loc._ref, (None, None))
        process = loc.group._ref
        yield process, loc._ref - first[process], seq, int(event.time), kind if call else "Instant", event.region.name if call else kind, attributes, json.dumps(values) if time == event.time else None


def counter_names(definitions) -> list[str]:
    """Names of the members of all metric classes, each once."""
    return list(dict.fromkeys(m.name for c in definitions.metric_classes for m in getattr(c, "members", [])))


class _Block(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class EventReader(DataSourceReader):
    def __init__(self, path: str, parts: int, every_kind: bool):
        self.path, self.parts, self.every_kind = path, parts, every_kind

    def _open(self):
        return _otf2().reader.open(self.path)

    def partitions(self) -> list[InputPartition]:
        with self._open() as trace:
            return [_Block(a, b) for a, b in blocks(len(list(trace.definitions.locations)), self.parts)]

    def read(self, part: _Block) -> Iterator[tuple]:
        otf2 = _otf2()
        with self._open() as trace:
            everything = list(trace.definitions.locations)
            wanted = lambda loc: self.every_kind or loc.type == otf2.LocationType.CPU_THREAD
            first: dict[int, int] = {}
            for loc in filter(wanted, everything):
                first[loc.group._ref] = min(first.get(loc.group._ref, loc._ref), loc._ref)
            yield from event_rows(trace.events([loc for loc in everything[part.first : part.last] if wanted(loc)]), first)


class EventSource(DataSource):
    """Raw events with their clock's ticks and their counters as JSON."""

    @classmethod
    def name(cls) -> str:
        return "otf2_events"

    def schema(self) -> str:
        return "process int, thread int, seq bigint, ticks bigint, event_type string, name string, attributes string, counters string"

    def reader(self, schema) -> DataSourceReader:
        return EventReader(self.options["path"], int(self.options.get("numPartitions", "8")), self.options.get("everyKind", "false") == "true")


def read_definitions(spark: SparkSession, trace) -> DataFrame:
    """(definition_type, id, attributes as JSON) of every definition."""
    rows = []
    for name in dir(trace.definitions):
        registry = getattr(trace.definitions, name)
        if name.startswith("_") or isinstance(registry, (str, bytes)):
            continue
        for item in registry if hasattr(registry, "__iter__") else [registry]:
            if hasattr(item, "_fields"):
                rows.append((type(item).__name__, getattr(item, "_ref", None), json.dumps(fields(item, is_definition))))
    return spark.createDataFrame(rows, "definition_type string, id bigint, attributes string")


def read_otf2(spark: SparkSession, dirname: str, num_processes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Definitions, and canonical events with a column for each counter."""
    otf2 = _otf2()
    path = f"{dirname}/traces.otf2"
    with otf2.reader.open(path) as trace:
        definitions = read_definitions(spark, trace)
        clock = trace.definitions.clock_properties
        offset, resolution = int(clock.global_offset), float(clock.timer_resolution)
        counters = counter_names(trace.definitions)
    spark.dataSource.register(EventSource)
    parts = num_processes or spark.sparkContext.defaultParallelism
    raw = spark.read.format("otf2_events").option("numPartitions", str(parts)).load(path)
    events = raw.withColumn("ts_ns", to_ns(F.col("ticks"), F.lit(offset), F.lit(resolution)))
    events = events.withColumns({c: F.get_json_object("counters", f"$['{c}']").cast("double") for c in counters}).drop("counters", "ticks")
    return definitions, normalise(events, "ts_ns", "process", "thread", "seq").drop("seq")
