"""HPCToolkit databases, version 4: ``meta.db``, ``profile.db`` and ``trace.db``.

Contexts and profiles, which do not grow with the trace, are parsed on the driver.
Samples are read by a data source with one partition for each trace line, or
several for a long one, and turned into events by comparing call paths.
"""

from __future__ import annotations

import mmap
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.samples import sample_moves
from ..schema import normalise

UNKNOWN_FUNCTION = "<unkown function>"
#: Samples of one partition.
SLICE = 1 << 20
FUNCTION, LOOP, LINE, INSTRUCTION = 0, 1, 2, 3


class Binary:
    """Little-endian fields of a file by offset, and its sections."""

    def __init__(self, path: str, form: bytes):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)  # pages are read where they are touched
        if self.data[:10] != b"HPCTOOLKIT" or self.data[10:14] != form:
            raise ValueError(f"{path} is no {form.decode()} database")
        if self.data[14] != 4:
            raise ValueError(f"{path} has version {self.data[14]}; version 4 is known")

    def u8(self, at: int) -> int:
        return self.data[at]

    def u16(self, at: int) -> int:
        return struct.unpack_from("<H", self.data, at)[0]

    def u32(self, at: int) -> int:
        return struct.unpack_from("<I", self.data, at)[0]

    def u64(self, at: int) -> int:
        return struct.unpack_from("<Q", self.data, at)[0]

    def text(self, at: int) -> str | None:
        return self.data[at : self.data.find(b"\0", at)].decode("utf-8", "replace") if at else None

    def section(self, at: int) -> int:
        """Where the section starts whose size and pointer stand at ``at``."""
        return self.u64(at + 8)


class Meta(Binary):
    """Call paths of every context: a list of (node, name, is_loop, file, line), root first."""

    def __init__(self, path: str):
        super().__init__(path, b"meta")
        general = self.section(0x10)
        self.title, self.description = self.text(self.u64(general)), self.text(self.u64(general + 8))
        names = self.section(0x20)
        self.kinds = [self.text(self.u64(self.u64(names) + 8 * i)) for i in range(self.u8(names + 8))]
        self.paths: dict[int, list[tuple]] = {}
        context = self.section(0x40)
        first, count, size = self.u64(context), self.u16(context + 8), self.u8(context + 0xA)
        for i in range(count):
            at = first + i * size
            node = (self.u32(at + 0x10), self.text(self.u64(at + 0x18)) or "unknown entry", False, None, None)
            self.paths[node[0]] = [node]
            self._children(at, [node], None)

    def _children(self, at: int, path: list[tuple], place: tuple | None) -> None:
        stack = [(self.u64(at + 8), self.u64(at), path, place)]
        while stack:
            start, size, above, inherited = stack.pop()
            here, end = start, start + size
            while start and here < end:
                words = self.u8(here + 0x17)
                own, where = self._context(here, inherited)
                # Lines and instructions belong to the function or loop around them.
                path = above if own is None else [*above, own]
                self.paths[self.u32(here + 0x10)] = path
                if self.u64(here + 8):
                    stack.append((self.u64(here + 8), self.u64(here), path, where))
                here += 0x20 + 8 * words

    def _context(self, at: int, inherited: tuple | None) -> tuple[tuple | None, tuple | None]:
        ctx, flags, kind = self.u32(at + 0x10), self.u8(at + 0x14), self.u8(at + 0x16)
        flex, function, file, line = at + 0x20, None, None, None
        if flags & 1:
            function = self.u64(flex)
            flex += 8
        if flags & 2:
            file = self.text(self.u64(self.u64(flex) + 8))
            line = self.u32(flex + 8)
        name = None
        if function:
            name = self.text(self.u64(function))
            if file is None and self.u64(function + 0x18):
                file, line = self.text(self.u64(self.u64(function + 0x18) + 8)), self.u32(function + 0x20)
        if file is None and inherited:
            file, line = inherited
        where = (file, line) if file else inherited
        if kind == FUNCTION:
            return (ctx, name or UNKNOWN_FUNCTION, False, file, line), where
        if kind == LOOP:
            return (ctx, "loop", True, file, line), where
        return None, where


class Profiles(Binary):
    """Identifiers of each profile by kind: (process, thread, core, host)."""

    def __init__(self, path: str, kinds: list[str]):
        super().__init__(path, b"prof")
        info = self.section(0x10)
        first, count, size = self.u64(info), self.u32(info + 8), self.u8(info + 0xC)
        self.rows: list[tuple] = []
        for i in range(count):
            at = self.u64(first + i * size + 0x20)
            ids: dict[str, int] = {}
            for k in range(self.u16(at) if at else 0):
                own = at + 8 + 16 * k
                physical = self.u16(own + 2) & 1
                kind = kinds[self.u8(own)] if self.u8(own) < len(kinds) else ""
                ids[kind] = self.u64(own + 8) if physical else self.u32(own + 4)
            host = ids.get("NODE")
            self.rows.append((i, ids.get("RANK", 0), ids.get("THREAD", 0), ids.get("CORE"), None if host is None else f"{host:x}"))


class _Slice(InputPartition):
    def __init__(self, profile: int, start: int, count: int, seq: int):
        self.profile, self.start, self.count, self.seq = profile, start, count, seq


class SampleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        b = Binary(self.path, b"trce")
        head, out = b.section(0x10), []
        first, count, size = b.u64(head), b.u32(head + 8), b.u8(head + 0xC)
        for i in range(count):
            at = first + i * size
            start, total = b.u64(at + 8), (b.u64(at + 0x10) - b.u64(at + 8)) // 12
            out += [_Slice(b.u32(at), start + 12 * k, min(SLICE, total - k), k) for k in range(0, total, SLICE)]
        return out or [_Slice(0, 0, 0, 0)]

    def read(self, part: _Slice) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            f.seek(part.start)
            data = f.read(12 * part.count)
        rows = np.frombuffer(data, np.dtype([("ts", "<u8"), ("ctx", "<u4")]))
        for at in range(0, len(rows), 1 << 16):
            own = rows[at : at + (1 << 16)]
            columns = [np.full(len(own), part.profile, np.int32), part.seq + at + np.arange(len(own)), own["ts"].astype(np.int64), own["ctx"].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["profile", "seq", "ts_ns", "ctx_id"])


class SampleSource(DataSource):
    """``spark.read.format("hpctoolkit_samples").load(trace.db)``: (profile, seq, ts_ns, ctx_id)."""

    @classmethod
    def name(cls) -> str:
        return "hpctoolkit_samples"

    def schema(self) -> str:
        return "profile int, seq bigint, ts_ns bigint, ctx_id bigint"

    def reader(self, schema) -> DataSourceReader:
        return SampleReader(self.options["path"])


_ELEMENT = "array<struct<node_id: bigint, name: string, loop: boolean, file: string, line: bigint>>"


def read_hpctoolkit(spark: SparkSession, dirname: str) -> tuple[DataFrame, DataFrame]:
    """Canonical events, and the calling context tree as its table."""
    meta = Meta(os.path.join(dirname, "meta.db"))
    profiles = Profiles(os.path.join(dirname, "profile.db"), meta.kinds)
    contexts = spark.createDataFrame(list(meta.paths.items()) or [(-1, [])], f"ctx_id bigint, path {_ELEMENT}")
    owners = spark.createDataFrame(profiles.rows or [(-1, 0, 0, None, None)], "profile int, process bigint, thread bigint, core bigint, host string")
    spark.dataSource.register(SampleSource)
    samples = spark.read.format("hpctoolkit_samples").load(os.path.join(dirname, "trace.db"))
    moves = sample_moves(samples.join(contexts, "ctx_id", "left").select("profile", "seq", "ts_ns", "path"))
    start = samples.agg(F.min("ts_ns").alias("__start"))
    loop = F.when(F.col("element.loop"), F.concat(F.lit("Loop "), F.col("event_type"))).otherwise(F.col("event_type"))
    events = moves.join(owners, "profile", "left").crossJoin(F.broadcast(start)).select(
        (F.col("ts_ns") - F.col("__start")).alias("ts_ns"), loop.alias("event_type"), F.col("element.name").alias("name"), "process", "thread", "core", "host",
        F.col("element.node_id").alias("node_id"), F.col("element.file").alias("source_file"), F.col("element.line").alias("source_line"),
        F.col("element.node_id").alias("calling_context_id"), "profile", "seq", "place",
    )
    events = normalise(events, "ts_ns", "profile", "seq", "place").drop("profile", "seq", "place")
    nodes = {p[-1][0]: p for p in meta.paths.values() if p}
    rows = [(n, p[-2][0] if len(p) > 1 else None, len(p) - 1, p[-1][1], [x[1] for x in p]) for n, p in nodes.items()]
    tree = spark.createDataFrame(rows, "node_id bigint, parent_id bigint, level int, name string, path array<string>")
    return events, tree
