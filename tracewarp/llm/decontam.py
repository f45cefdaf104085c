"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are lower-cased, white space made single, and cut into segments
of ``SEGMENT`` characters or so. A segment of ``m`` characters with at most ``k``
edits shares at least ``m - q + 1 - k q`` q-grams with its copy, all within a
diagonal range of ``k``; so shared q-grams are counted in diagonal bands of width
``2 (k + 1)`` that overlap by half, and only bands that reach the bound are
aligned, by a banded edit distance with free ends in the document. A document is
contaminated if a segment aligns within its budget. Documents never move: there
is no shuffle, and the items are broadcast in blocks of about ``BLOCK_CHARS``
characters, ``CHAIN`` blocks a pass over the documents; between passes what was
found is written to the shared folder and the blocks are let go.

Edge cases: null or empty texts match nothing; items shorter than ``MIN_ITEM``
characters after normalising are too common inside texts to mean anything, so only
documents that say nothing else match them; null and empty items are skipped;
repeated items report each id; repeated rows are judged alike; an empty benchmark
flags nothing; long texts are scanned whole; other columns are not read (the filter
form keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

Q = 8
EDIT_RATE = 0.1
SEGMENT = 120
MIN_ITEM = 24
BLOCK_CHARS = 4_000_000
#: Blocks whose broadcasts and Python stages are alive at once.
CHAIN = 4
_BASE = 0x9E3779B1
_TABLE_BITS = 20
_BANDS = 1 << 36
_PLACES = 1 << 20
#: Characters of documents that are hashed at once: their hashes fit in a core's cache.
_CHUNK = 1 << 16


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(x: np.ndarray) -> np.ndarray:
    """32-bit hash of every run of ``Q`` = 8 characters."""
    h, base = x, _BASE
    for step in (1, 2, 4):
        if len(h) <= step:
            return np.zeros(0, np.uint32)
        h = h[:-step] * np.uint32(base) + h[step:]
        base = base * base & 0xFFFFFFFF
    return h


def banded_distance(segment: np.ndarray, window: np.ndarray, low: int, width: int, most: int) -> int:
    """Least edits of ``segment`` against any part of ``window`` on diagonals ``low .. low + width``; ``most + 1`` if more."""
    far = most + 1
    lanes = np.arange(width + 1)
    row = np.zeros(width + 1, np.int64)  # free start in the window
    for i, c in enumerate(segment.tolist()):
        at = lanes + (low + i)
        inside = (at >= 0) & (at < len(window))
        same = np.zeros(width + 1, bool)
        same[inside] = window[at[inside]] == c
        step = row + np.where(same, 0, 1)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - lanes) + lanes
        if row.min() > most:
            return far
    return int(min(far, row.min()))


class SegmentIndex:
    """q-grams of a block of benchmark segments."""

    def __init__(self, items: list[tuple[int, str]]):
        self.segments: list[tuple[int, str, np.ndarray, int, int]] = []
        self.short: dict[str, list[int]] = {}
        grams, owners, places = [], [], []
        with np.errstate(over="ignore"):
            for item_id, text in items:
                text = normalise(text)
                if len(text) < MIN_ITEM:
                    if text:
                        self.short.setdefault(text, []).append(item_id)
                    continue
                parts = max(1, round(len(text) / SEGMENT))
                for p in range(parts):
                    own = text[len(text) * p // parts : len(text) * (p + 1) // parts]
                    m = len(own)
                    k = max(0, min(int(EDIT_RATE * m), (m - Q) // Q))
                    h = gram_hashes(x := codes(own))
                    grams.append(h)
                    owners.append(np.full(len(h), len(self.segments)))
                    places.append(np.arange(len(h)))
                    self.segments.append((item_id, own, x, k, m - Q + 1 - k * Q))
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        order = np.argsort(h, kind="stable")
        self.owner = (np.concatenate(owners) if grams else np.zeros(0, np.int64))[order]
        self.place = (np.concatenate(places) if grams else np.zeros(0, np.int64))[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self._cell(self.keys)] = True
        self.width = np.array([s[3] + 1 for s in self.segments] or [1], np.int64)
        self.bound = np.array([s[4] for s in self.segments] or [1], np.int64)

    @staticmethod
    def _cell(h: np.ndarray) -> np.ndarray:
        return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - _TABLE_BITS)

    def candidates(self, x: np.ndarray) -> list[tuple[int, int]]:
        """(segment, first diagonal) of the bands that reach the bound."""
        if not len(self.keys):
            return []
        with np.errstate(over="ignore"):
            h = gram_hashes(x)
            at = np.flatnonzero(np.take(self.table, self._cell(h)))
        found = np.searchsorted(self.keys, h[at])
        found[found == len(self.keys)] = 0
        real = self.keys[found] == h[at]
        at, found = at[real], found[real]
        if not len(at):
            return []
        times = self.count[found]
        rows = np.repeat(self.first[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner, diagonal = self.owner[rows], np.repeat(at, times) - self.place[rows]
        band = np.floor_divide(diagonal, self.width[owner])
        # One number for a segment and a band; bands start below 0 where a copy is cut off at the front.
        key = owner * _BANDS + band + _BANDS // 2
        key, place = np.concatenate([key, key - 1]), np.tile(self.place[rows], 2)
        keys, hits = np.unique(key, return_counts=True)
        keys = keys[hits >= self.bound[keys // _BANDS]]
        if not len(keys):
            return []
        # Text that repeats itself meets one gram of a segment again and again; each counts once.
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        real = keys[at] == key
        hits = np.bincount(np.unique(at[real] * _PLACES + place[real]) // _PLACES, minlength=len(keys))
        owner, band = keys // _BANDS, keys % _BANDS - _BANDS // 2
        keep = hits >= self.bound[owner]
        return [(int(s), int(b * self.width[s])) for s, b in zip(owner[keep], band[keep])]

    def matches(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(item id, edits) of the segments found in each normalised text."""
        joined = "\n".join(texts)  # normalised texts have no newline, nor have segments
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        x = codes(joined)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        for s, low in self.candidates(x):
            item_id, own, chars, k, _ = self.segments[s]
            width = 2 * int(self.width[s])
            middle = max(0, min(len(x) - 1, low + width // 2 + len(own) // 2))
            d = int(np.searchsorted(starts, middle, "right")) - 1
            if s in out[d]:
                continue
            begin, end = int(starts[d]), int(starts[d]) + len(texts[d])
            first, last = max(begin, low - k), min(end, low + width + len(own) + k)
            if own in joined[first:last]:
                edits = 0
            else:
                edits = banded_distance(chars, x[first:last], low - k - first, width + 2 * k, k)
            if edits <= k:
                out[d][s] = (item_id, edits)
        return [list(found.values()) + [(i, 0) for i in self.short.get(t, ())] for t, found in zip(texts, out)]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, collected in blocks of a bounded number of characters."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // BLOCK_CHARS))
    for b in range(n):
        yield [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()]


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``_CHUNK`` characters, each with its first place."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= _CHUNK:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def _find(shared, batch: pa.RecordBatch, made: dict) -> list[list[tuple[int, int]]]:
    if "index" not in made:
        made["index"] = SegmentIndex(shared.value)
    texts = [normalise(t) for t in batch.column("text").to_pylist()]
    out: list[list[tuple[int, int]]] = []
    for _, own in _chunks(texts):
        out += made["index"].matches(own)
    return out


def _passes(docs: DataFrame, benchmark: DataFrame, step) -> DataFrame:
    """``docs`` after ``step(batch, index)`` of every block of items, in passes of ``CHAIN`` blocks."""
    alive: list = []
    for items in _blocks(benchmark):
        if len(alive) == CHAIN:
            docs = stored(docs)
            for b in alive:
                b.unpersist()
            alive = []
        shared = docs.sparkSession.sparkContext.broadcast(items)  # about BLOCK_CHARS characters
        alive.append(shared)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            made: dict = {}
            for batch in batches:
                yield step(batch, _find(shared, batch, made))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, the item ids found, the segments found and the fewest edits, one row for each document."""

    def step(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        ids, n, least = (batch.column(c).to_pylist() for c in ("item_ids", "n_segments", "min_edits"))
        for k, own in enumerate(rows):
            if own:
                ids[k] = sorted(set(ids[k]) | {i for i, _ in own if i is not None})
                n[k] += len(own)
                least[k] = min([e for _, e in own] + ([least[k]] if least[k] is not None else []))
        columns = [batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(least, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "item_ids", "n_segments", "min_edits"])

    out = docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text", "cast(array() as array<bigint>) AS item_ids", "0L AS n_segments", "cast(null as bigint) AS min_edits")
    return _passes(out, benchmark, step).select("doc_id", (F.col("n_segments") > 0).alias("contaminated"), "item_ids", "n_segments", "min_edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without benchmark text, with the columns of ``docs``."""
    return _passes(docs.withColumn("text", F.col("text").cast("string")), benchmark, lambda batch, rows: batch.filter(pa.array([not own for own in rows], pa.bool_())))
