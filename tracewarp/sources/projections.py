"""Projections traces: an ``.sts`` file of definitions and a gzipped text log for each processing element.

The definitions are parsed on the driver and joined to the logs; a log is one
task, as gzip can't be split. Lines keep their order by their place in the file.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import normalise

#: Record codes with a fixed name: (name, event type, field of the time).
FIXED = {
    14: ("Idle", "Enter", 1), 15: ("Idle", "Leave", 1), 16: ("Pack", "Enter", 1), 17: ("Pack", "Leave", 1),
    18: ("Unpack", "Enter", 1), 19: ("Unpack", "Leave", 1), 11: ("Trace", "Enter", 1), 12: ("Trace", "Leave", 1),
    6: ("Computation", "Enter", 1), 7: ("Computation", "Leave", 1), 10: ("Message Receive", "Instant", 2),
    4: ("Enque", "Instant", 2), 5: ("Deque", "Instant", 2), 8: ("Interrupt", "Enter", 1), 9: ("Interrupt", "Leave", 1),
    26: ("User Supplied", "Instant", None), 28: ("User Supplied Note", "Instant", 1), 27: ("Memory Usage", "Instant", 2),
    98: ("User Event Pair", "Enter", 2), 99: ("User Event Pair", "Leave", 2), 29: ("User Supplied Bracketed Note", "Enter", 1),
}
#: Codes named by an entry, a user event or a user statistic: (table, field of the key, event type, field of the time).
NAMED = {
    1: ("entry", 2, "Instant", 3), 21: ("entry", 2, "Instant", 3), 20: ("entry", 2, "Instant", 3), 2: ("entry", 2, "Enter", 3), 3: ("entry", 2, "Leave", 3),
    13: ("event", 1, "Instant", 2), 100: ("event", 1, "Instant", 2), 32: ("stat", 5, "Instant", 1),
}
_PE = {"From PE": 2}
_PAIR = {"From PE": 4, "Event ID": 3, "Nested ID": 5}
#: Codes with a name of their own whose attributes name a user event: (field of the key, attribute).
LABELLED = {98: (1, "User Event Name"), 99: (1, "User Event Name"), 29: (3, "Event Name")}
#: Fields of each code by place, for the attributes.
FIELDS = {
    **{c: _PE for c in (14, 15, 16, 17, 18, 19)}, 26: {"User Supplied": 1}, 27: {"Memory Usage": 1},
    1: {"From PE": 5, "MType": 1, "Message Length": 6, "Event ID": 4, "Send Time": 7},
    **{c: {"From PE": 5, "Message Type": 1, "Message Length": 6, "Event ID": 4, "Send Time": 7, "Num Procs": 8} for c in (20, 21)},
    2: {"From PE": 5, "Message Type": 1, "Event ID": 4, "Message Length": 6, "Receive Time": 7},
    10: {"From PE": 4, "Message Type": 1, "Event ID": 3, "Message Length": 5},
    4: {"From PE": 4, "Message Type": 1, "Event ID": 3}, 5: {"From PE": 4, "Message Type": 1, "Event ID": 3},
    8: {"From PE": 3, "Event ID": 2}, 9: {"From PE": 3, "Event ID": 2},
    13: {"From PE": 4, "Event ID": 3}, 100: _PAIR, 98: _PAIR, 99: _PAIR, 29: {"Event ID": 3}, 32: {"From PE": 4, "User Time": 2},
}
#: Attributes in microseconds that become nanoseconds.
TIMES = {"Send Time", "User Time"}
#: What kind of record an event is, where its name does not tell.
KINDS = {
    1: ("Entry Type", "Create"), 20: ("Entry Type", "Broadcast"), 21: ("Entry Type", "Multicast"), 2: ("Entry Type", "Processing"),
    13: ("Event Type", "User Event"), 100: ("Event Type", "User Event Pair"), 32: ("Event Type", "User Stat"),
}


class Definitions:
    """The keywords of an ``.sts`` file."""

    def __init__(self, text: str):
        self.totals: dict[str, str] = {}
        self.chares: dict[int, tuple[str, int]] = {}
        self.entries: dict[int, tuple[str, int]] = {}
        self.messages: dict[int, int] = {}
        self.events: dict[int, str] = {}
        self.stats: dict[int, str] = {}
        self.papi: dict[int, str] = {}
        for line in text.splitlines():
            words = line.split()
            if not words:
                continue
            key = words[0]
            quoted = re.search(r'"(.*)"', line)
            if key == "CHARE":
                self.chares[int(words[1])] = (quoted[1] if quoted else words[2], int(words[-1]) if words[-1].isdigit() and len(words) > 3 else 0)
            elif key == "ENTRY":
                rest = line[quoted.end() :].split() if quoted else words[4:]
                self.entries[int(words[2])] = (quoted[1] if quoted else words[3], int(rest[0]) if rest else -1)
            elif key == "MESSAGE":
                self.messages[int(words[1])] = int(words[2])
            elif key in ("EVENT", "STAT", "PAPI_EVENT"):
                own = {"EVENT": self.events, "STAT": self.stats, "PAPI_EVENT": self.papi}[key]
                own[int(words[1])] = " ".join(words[2:]).strip('"').strip()
            elif len(words) > 1:
                self.totals[key] = words[1]

    @property
    def processors(self) -> int:
        return int(self.totals.get("PROCESSORS", 0))

    def rows(self) -> list[tuple[str, int, str, int]]:
        """(kind, key, label, dimension); an entry has its chare's dimension."""
        out = [("entry", k, n, self.chares.get(chare, ("", 0))[1]) for k, (n, chare) in self.entries.items()]
        return out + [("event", k, n, 0) for k, n in self.events.items()] + [("stat", k, n, 0) for k, n in self.stats.items()]


def locate(dirname: str) -> tuple[str, Definitions]:
    """The executable's name and its definitions; every processing element must have a log."""
    found = [f for f in os.listdir(dirname) if f.endswith(".sts")]
    if len(found) != 1:
        raise ValueError(f"{dirname} needs one .sts file; it has {len(found)}")
    with open(os.path.join(dirname, found[0]), encoding="utf-8") as f:
        definitions = Definitions(f.read())
    name = found[0][: -len(".sts")]
    missing = [i for i in range(definitions.processors) if not os.path.exists(os.path.join(dirname, f"{name}.{i}.log.gz"))]
    if missing:
        raise ValueError(f"no log of processing elements {missing}")
    return name, definitions


def _field(k: int) -> Column:
    return F.get(F.col("f"), F.lit(k))


def _number(k: int) -> Column:
    return F.expr(f"try_cast(get(f, {k}) AS bigint)")


def _numbers(start: Column, count: Column) -> Column:
    return F.transform(F.slice("f", start, F.greatest(F.lit(0), count)), lambda x: x.try_cast("bigint"))


def _attributes(code: Column, perf_counts: int) -> Column:
    """JSON of the attributes of each code; ``label`` and ``dimension`` are of the record's definition."""
    out = F.lit(None).cast("string")
    for c, fields in FIELDS.items():
        own = [(_number(k) * 1000 if n in TIMES else _number(k)).alias(n) for n, k in fields.items()]
        if c in KINDS:
            own.append(F.lit(KINDS[c][1]).alias(KINDS[c][0]))
        if c in LABELLED:
            own.append(F.col("label").alias(LABELLED[c][1]))
        if c == 21:
            own.append(_numbers(F.lit(10), _number(8).cast("int")).alias("Destination PEs"))
        if c == 2:
            # The element's index has as many fields as its chare has dimensions; the CPU time and the counters follow.
            size = F.coalesce("dimension", F.lit(0))
            own += [_numbers(F.lit(9), size).alias("ID List"), F.get("f", size + 8).try_cast("bigint").alias("CPU Start Time")]
            own.append(_numbers(size + 10, F.lit(perf_counts)).alias("perf counts list"))
        if c == 29:
            own.append(F.array_join(F.slice("f", 5, 1_000_000), " ").alias("Note"))
        if c == 32:
            own.append(F.expr("try_cast(get(f, 3) AS double)").alias("Stat"))
        out = F.when(code == c, F.to_json(F.struct(*own))).otherwise(out)
    return F.when(code == 28, F.to_json(F.struct(F.array_join(F.slice("f", 3, 1_000_000), " ").alias("Note")))).otherwise(out)


def _codes(spark: SparkSession) -> DataFrame:
    """A row for each code: its name or the table and place of its key, its event type, and the place of its time."""
    rows = [(c, label, event, at, "event" if c in LABELLED else None, LABELLED.get(c, (None,))[0]) for c, (label, event, at) in FIXED.items()]
    rows += [(c, None, event, at, table, k) for c, (table, k, event, at) in NAMED.items()]
    return spark.createDataFrame(rows, "code bigint, name string, event_type string, time_at int, kind string, key_at int").coalesce(1)


def decode(lines: DataFrame, definitions: DataFrame, perf_counts: int = 0) -> DataFrame:
    """Events of tokenised lines ``(process, seq, f)``; ``definitions`` is (kind, key, label, dimension)."""
    rows = lines.withColumn("code", _number(0)).join(F.broadcast(_codes(lines.sparkSession)), "code")  # one row a code
    time = F.when(F.col("time_at").isNull(), F.lit(-1).cast("bigint")).otherwise(F.expr("try_cast(get(f, time_at) AS bigint)") * 1000)
    rows = rows.withColumns({"ts_ns": time, "key": F.expr("try_cast(get(f, key_at) AS bigint)")})
    named = rows.join(definitions, ["kind", "key"], "left")
    named = named.withColumn("name", F.coalesce("name", "label", F.concat_ws(" ", "kind", "key"))).withColumn("attributes", _attributes(F.col("code"), perf_counts))
    # A bracketed note is a call of its own; its end is the second field.
    end = F.when(F.col("code") == 29, F.array(F.struct(F.col("event_type"), F.col("ts_ns"), F.lit(0).alias("half")), F.struct(F.lit("Leave").alias("event_type"), (_number(2) * 1000).alias("ts_ns"), F.lit(1).alias("half"))))
    both = named.withColumn("e", F.explode(F.coalesce(end, F.array(F.struct("event_type", "ts_ns", F.lit(0).alias("half"))))))
    return both.select("process", "seq", "e.half", "e.ts_ns", "e.event_type", "name", "attributes")


def close_computation(events: DataFrame) -> DataFrame:
    """A Leave of ``Computation`` at the last time of each log that does not end with one."""
    last = events.groupBy("process").agg(F.max_by(F.struct("name", "event_type", "ts_ns", "seq"), F.struct("seq", "half")).alias("x"), F.max("ts_ns").alias("end"))
    late = last.filter(~((F.col("x.name") == "Computation") & (F.col("x.event_type") == "Leave")))
    return events.unionByName(late.select("process", (F.col("x.seq") + 1).alias("seq"), F.lit(0).alias("half"), F.col("end").alias("ts_ns"), F.lit("Leave").alias("event_type"), F.lit("Computation").alias("name"), F.lit(None).cast("string").alias("attributes")))


def read_projections(spark: SparkSession, dirname: str, num_processes: int | None = None) -> DataFrame:
    """Canonical events of all logs. ``num_processes`` is not needed: each log is a task."""
    name, found = locate(dirname)
    definitions = spark.createDataFrame(found.rows() or [("none", -1, "none", 0)], "kind string, key bigint, label string, dimension int")
    paths = [os.path.join(dirname, f"{name}.{i}.log.gz") for i in range(found.processors)]
    lines = spark.read.text(paths).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"\.(\d+)\.log\.gz$", 1).cast("int").alias("process"),
        F.monotonically_increasing_id().alias("seq"),
        F.split(F.trim("value"), " +").alias("f"),
    )
    events = close_computation(decode(lines, definitions, len(found.papi)))
    return normalise(events, "ts_ns", "process", "seq", "half").drop("seq", "half")
