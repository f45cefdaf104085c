"""Substring deduplication: windows of ``WINDOW`` words that an earlier document has too.

1. Sketch. A window is counted under its key, the least hash of its runs of ``GRAM``
   words: equal windows have equal keys, and neighbours mostly share theirs, so a
   document has few. Every partition counts its documents' keys in a count-min sketch
   of ``ROWS`` rows of ``CELLS`` cells (counts stop at 2); the partitions' sketches are
   merged cell range by cell range. A key's least cell never undercounts the documents
   that hold a window of that key, and so overestimates every window's count.
2. Exact pass. Only windows that may be in two documents go on: they are grouped by
   two independent hashes, 96 bits in all, from the words' own up; the least
   ``doc_id`` of each group is kept where there are two, and joined back to its
   windows. Grouping aggregates before it shuffles. The groups are checkpointed, so
   the join stands alone and Spark splits the tasks of a hot window.
3. Removal. Texts without such a window are finished where they are read; the
   others meet the places of their windows and lose the words these cover.

The merged sketch is ``ROWS * CELLS`` bits, 32 MB, whatever the input; where an
input fills it, more windows reach the exact pass and the result is the same.

Edge cases: a null or empty text has no words and its kept text is empty; texts
under ``WINDOW`` words lose nothing; texts of any length are read whole; rows without ``doc_id`` are neither earlier
nor later than others and lose nothing; repeated rows (equal ids) do not remove
each other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, release
from .shingles import chunks, inside, mix, run_hashes, sliding_min, word_hashes

WINDOW = 50
GRAM = 16
ROWS = 2
CELL_BITS = 27
#: Cells of one range of the sketch.
RANGE_BITS = 20
#: Seed of the second hash of words and windows.
SECOND = 2
U = np.uint64


def window_keys(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The key of every window: the least hash of its runs of ``gram`` words."""
    return sliding_min(run_hashes(words, gram), window - gram + 1)


def cells(keys: np.ndarray) -> list[np.ndarray]:
    """A key's cell in each row of the sketch."""
    h = mix(keys + U(0x632BE59BD9B4E019))
    return [((h >> U(32 * r)) & U((1 << CELL_BITS) - 1)).astype(np.int64) for r in range(ROWS)]


def _document_keys(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place of the first text, word hashes, text offsets, key of every window) chunk by chunk."""
    for first, own in chunks(texts):
        words, offsets = word_hashes(own)
        yield first, words, offsets, window_keys(words)


def partition_sketch(docs: DataFrame) -> DataFrame:
    """(row, range, cells, often): each partition's sketch, sparse, by ranges of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        gathered, size = [], 0

        def emit() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(gathered) if gathered else np.zeros(0, np.uint64)
            for r, own in enumerate(cells(keys)):
                unique, times = np.unique(own, return_counts=True)
                edges = np.flatnonzero(np.diff(unique >> RANGE_BITS)) + 1
                parts = list(zip(np.split(unique, edges), np.split(times, edges))) if len(unique) else []
                for at in range(0, len(parts), 16):
                    some = parts[at : at + 16]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r] * len(some), pa.int32()),
                            pa.array([int(u[0] >> RANGE_BITS) for u, _ in some], pa.int32()),
                            pa.array([(u & ((1 << RANGE_BITS) - 1)).astype(np.uint32).tobytes() for u, _ in some], pa.binary()),
                            pa.array([np.packbits(t > 1).tobytes() for _, t in some], pa.binary()),
                        ],
                        names=["row", "range", "cells", "often"],
                    )

        for batch in batches:
            for _, words, offsets, keys in _document_keys(batch.column("text").to_pylist()):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    if b - a >= WINDOW:
                        gathered.append(np.unique(keys[a : b - WINDOW + 1]))
                        size += len(gathered[-1])
            if size > 1_000_000:
                yield from emit()
                gathered, size = [], 0
        yield from emit()

    return docs.select("text").mapInArrow(run, "row int, range int, cells binary, often binary")


def merge_sketches(parts: DataFrame) -> DataFrame:
    """(row, range, bits): the cells that count two or more over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            values = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(values, names=["row", "range", "bits"])

        for batch in batches:
            for row, range_, own, often in zip(*(batch.column(c).to_pylist() for c in ("row", "range", "cells", "often"))):
                if (row, range_) != key:
                    if key is not None:
                        yield done()
                    key, once, twice = (row, range_), np.zeros(1 << RANGE_BITS, bool), np.zeros(1 << RANGE_BITS, bool)
                at = np.frombuffer(own, np.uint32)
                twice[at] |= once[at] | np.unpackbits(np.frombuffer(often, np.uint8), count=len(at)).astype(bool)
                once[at] = True
        if key is not None:
            yield done()

    ordered = parts.repartition("row", "range").sortWithinPartitions("row", "range")
    return ordered.mapInArrow(run, "row int, range int, bits binary")


class Sketch:
    """The merged sketch: whether a key may be in two documents."""

    def __init__(self, packed: bytes):
        self.bits = np.frombuffer(packed, np.uint8).reshape(ROWS, -1)  # a view: workers hold the bits once

    @staticmethod
    def pack(rows) -> bytes:
        """All ranges of all rows, one after another; a range that is not there is empty."""
        size = 1 << (RANGE_BITS - 3)
        bits = np.zeros((ROWS, size << (CELL_BITS - RANGE_BITS)), np.uint8)
        for row, range_, own in rows:
            bits[row, range_ * size : (range_ + 1) * size] = np.frombuffer(own, np.uint8)
        return bits.tobytes()

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        # Neighbouring windows mostly share a key, so each run of equal keys is looked up once.
        if not len(keys):
            return np.zeros(0, bool)
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        own, ok = keys[new], np.ones(int(new.sum()), bool)
        for bits, cell in zip(self.bits, cells(own)):
            ok &= (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return ok[np.cumsum(new) - 1]


def _suspects(sketch: Sketch, words: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the windows, each in one text, that may be in two documents."""
    if not len(keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(sketch.repeated(keys) & inside(offsets, WINDOW, len(keys)))


def suspect_windows(docs: DataFrame, shared) -> DataFrame:
    """(h1, h2, doc_id, place) of every window that the sketch can't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(shared.value)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for first, words, offsets, keys in _document_keys(texts):
                at = _suspects(sketch, words, offsets, keys)
                if len(at):
                    again = word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts[first : first + len(offsets) - 1]], SECOND)[0]
                    one, two = run_hashes(words, WINDOW)[at], run_hashes(again, WINDOW, SECOND)[at]
                    doc = np.searchsorted(offsets, at, "right") - 1
                    columns = [one.view(np.int64), (two & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32), ids[first + doc].astype(np.int64), (at - offsets[doc]).astype(np.int32)]
                    for a in range(0, len(at), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], names=["h1", "h2", "doc_id", "place"])

    return docs.filter("doc_id IS NOT NULL").mapInArrow(run, "h1 long, h2 int, doc_id long, place int")


def covered(places: list[int], n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which words the windows at ``places`` cover."""
    edges = np.zeros(n_words + 1, np.int64)
    at = np.array(places, np.int64)
    edges[at] += 1
    np.subtract.at(edges, np.minimum(at + window, n_words), 1)
    return np.cumsum(edges[:-1]) > 0


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    merged = merge_sketches(partition_sketch(rows)).collect()  # ROWS * CELLS bits at most
    shared = spark.sparkContext.broadcast(Sketch.pack((r["row"], r["range"], r["bits"]) for r in merged))
    windows = suspect_windows(rows, shared)
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    least = checkpoint(least.filter(F.col("first") < F.col("last")).select("h1", "h2", "first"))
    later = windows.join(least.hint("merge"), ["h1", "h2"]).filter(F.col("first") < F.col("doc_id"))
    removed = later.groupBy("doc_id").agg(F.collect_set("place").alias("places")).withColumnRenamed("doc_id", "__id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            suspect = np.zeros(len(texts), bool)
            for first, words, offsets, keys in _document_keys(texts):
                at = _suspects(sketch, words, offsets, keys)
                suspect[first + np.unique(np.searchsorted(offsets, at, "right") - 1)] = True
            n, digests = [], []
            for text, maybe in zip(texts, suspect.tolist()):
                words = WORD.findall(text or "")
                n.append(len(words))
                digests.append(None if maybe else _digest(words))
                if not maybe and not with_text:
                    texts[len(n) - 1] = None
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "sha", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, digests, kept = [], [], []
            for n, sha, text, places in zip(*(batch.column(c).to_pylist() for c in ("n_words", "sha", "text", "places"))):
                words = WORD.findall(text or "") if sha is None or with_text else []
                out = covered(places, n) if places and sha is None else None
                if out is not None:
                    words = [w for w, x in zip(words, out.tolist()) if not x]
                gone.append(0 if out is None else int(out.sum()))
                digests.append(sha or _digest(words))
                kept.append(" ".join(words))
            columns = [batch.column("doc_id"), batch.column("n_words"), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    scanned = rows.mapInArrow(read, "doc_id long, n_words long, sha string, text string")
    met = scanned.join(removed.hint("merge"), F.col("doc_id") == F.col("__id"), "left").select("doc_id", "n_words", "sha", "text", "places")
    return met.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`remove_repeats`, over the windows' own words."""
    n = WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, unnest(range(1, len(w) - {n} + 2)) AS i, w FROM d WHERE len(w) >= {n} AND doc_id IS NOT NULL),
h AS (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i + {n - 1}], ' ')) AS win FROM g),
m AS (SELECT win, min(doc_id) AS first FROM h GROUP BY win HAVING min(doc_id) < max(doc_id)),
p AS (SELECT DISTINCT rid, i + k AS i FROM h JOIN m USING (win), range({n}) t(k) WHERE first < doc_id),
c AS (SELECT rid, list(i) AS gone, count(*) AS n FROM p GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (rid)"""
