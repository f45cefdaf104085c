"""Harmonic packing of documents into sequences of a fixed capacity.

Each worker packs its own partition, so there is no shuffle and a lost task can
be run again with the same result. A document of ``n`` ids up to the capacity
belongs to the reciprocal class ``k = capacity // n``, and each bin of class ``k``
takes exactly ``k`` documents, whole. A bin with its ``k`` documents has less than
one ``(k + 1)``-th of the capacity left; rooms under ``SLACK`` ids are padded, the
others wait for a document that is cut to fill them: one longer than the capacity,
or the next one once ``WAITING`` bins or ``ROOMS`` capacities of room wait. Longer
documents fill waiting rooms, then whole sequences; their rest is a piece of its
own class. Bins that are not full when a worker ends are pooled, filled in order
and cut at the capacity; what is then left over is cut at powers of two, which
need no padding.

Edge cases: a null or empty text is one piece of its end id; repeated rows and
ties are packed as they come; a null ``doc_id`` stays null; texts of any length
are cut as above; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import give_back, vocabulary_path
from .word_ids import WordIds, slices

CAPACITY = 4096
#: Rooms of fewer ids are padded.
SLACK = 8
#: Bins that wait for a filling document, and their room in capacities, before the next one has to fill them.
WAITING, ROOMS = 64, 8
END_ID = 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
_FIELDS = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])
#: Rows of one Arrow batch that leaves a worker.
BATCH_ROWS = 20_000


class HarmonicPacker:
    """Bins of one worker: at most one open for each class, and those that wait for a filling document."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.next_id, self.open, self.rows = capacity, first_id, {}, []
        self.waiting: deque[tuple[list[tuple], int]] = deque()
        self.room = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """One document, its end id included."""
        total = len(ids) // 4
        at = 0
        if total > self.capacity or len(self.waiting) >= WAITING or self.room >= ROOMS * self.capacity:
            while self.waiting and at < total:
                pieces, room = self.waiting.popleft()
                n = min(room, total - at)
                pieces.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
                at, self.room = at + n, self.room - room
                self._close_or_wait(pieces, room - n)
            while total - at >= self.capacity:
                self._close([(doc_id, at, ids[4 * at : 4 * (at + self.capacity)], total)])
                at += self.capacity
        if at == total:
            return
        k = self.capacity // (total - at)
        own = self.open.setdefault(k, [])
        own.append((doc_id, at, ids[4 * at :], total))
        if len(own) == k:
            self._close_or_wait(self.open.pop(k), self.capacity - sum(len(p[2]) for p in own) // 4)

    def _close_or_wait(self, pieces: list[tuple], room: int) -> None:
        if room < SLACK:
            self._close(pieces)
        else:
            self.waiting.append((pieces, room))
            self.room += room

    def _close(self, pieces: list[tuple]) -> None:
        length, at = sum(len(p[2]) for p in pieces) // 4, 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, self.next_id, at, length))
            at += n
        self.next_id += 1

    def finish(self) -> None:
        """Pool the bins that are not full, fill sequences in order, and cut the rest at powers of two."""
        pool = [p for own, _ in self.waiting for p in own] + [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear(), self.waiting.clear()
        self.room = 0
        left = sum(len(p[2]) for p in pool) // 4
        own: list[tuple] = []
        room = min(self.capacity, left and 1 << (left.bit_length() - 1))
        for doc_id, start, ids, doc_tokens in pool:
            while ids:
                now = ids[: 4 * room]
                own.append((doc_id, start, now, doc_tokens))
                n = len(now) // 4
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    self._close(own)
                    own, room = [], min(self.capacity, left and 1 << (left.bit_length() - 1))


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece; ``vocabulary`` is the path of the tokenizer file, read on the driver."""
    with open(vocabulary or vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(text)  # a file of fixed size, about 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(shared.value)
        packer = HarmonicPacker(TaskContext.get().partitionId() << 40, capacity)
        end = END_ID.to_bytes(4, "little")

        def rows() -> pa.RecordBatch:
            done, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done)], schema=_FIELDS)

        for batch in batches:
            for first, texts in slices(batch.column("text")):
                flat, offsets = words.encode(texts)
                whole, offsets = flat.astype("<u4").tobytes(), (4 * offsets).tolist()
                for doc_id, a, b in zip(batch.column("doc_id").slice(first, len(texts)).to_pylist(), offsets[:-1], offsets[1:]):
                    packer.add(doc_id, whole[a:b] + end)
                del flat, whole, offsets, texts
                give_back()  # a slice takes several times its bytes while it is encoded
                if len(packer.rows) >= BATCH_ROWS:
                    yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", "cast(text as string) AS text").mapInArrow(run, SCHEMA)
