"""Export to the Chrome trace event format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PHASES = {"Enter": "B", "Leave": "E", "Instant": "i"}


def chrome_records(events: DataFrame, thread: bool = False) -> DataFrame:
    """name, ph, ts (whole microseconds), pid, and tid and args where the trace has them, in event order."""
    phase = F.col("event_type")
    for kind, letter in PHASES.items():
        phase = F.when(F.col("event_type") == kind, letter).otherwise(phase)
    columns = [F.col("name"), phase.alias("ph"), F.expr("ts_ns div 1000").alias("ts"), F.col("process").alias("pid")]
    if thread:
        columns.append(F.col("thread").alias("tid"))
    if "attributes" in events.columns:
        columns.append(F.col("attributes").alias("args"))
    return events.select("event_id", *columns)


def _json(events: DataFrame, thread: bool) -> DataFrame:
    rows = chrome_records(events, thread)
    if "args" not in rows.columns:
        return rows.select("event_id", F.to_json(F.struct(*[c for c in rows.columns if c != "event_id"])).alias("value"))
    # Attributes are JSON already and go in as they are.
    head = F.to_json(F.struct(*[c for c in rows.columns if c not in ("event_id", "args")]))
    whole = F.when(F.col("args").isNull(), head).otherwise(F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(',"args":'), F.col("args"), F.lit("}")))
    return rows.withColumn("h", head).select("event_id", whole.alias("value"))


def to_chrome(events: DataFrame, filename: str | None = None, thread: bool = False) -> str | None:
    """Write one JSON array, streamed in event order; without a filename, return it."""
    ordered = _json(events, thread).orderBy("event_id").select("value")
    if filename is None:
        return "[" + ",".join(r["value"] for r in ordered.toLocalIterator()) + "]"
    with open(filename, "w", encoding="utf-8") as f:
        f.write("[")
        for k, r in enumerate(ordered.toLocalIterator()):
            f.write(("," if k else "") + r["value"])
        f.write("]")
    return None


def write_chrome_lines(events: DataFrame, folder: str, thread: bool = False) -> None:
    """The same records as JSON lines in many files, for traces too large for one."""
    _json(events, thread).select("value").write.text(folder)
