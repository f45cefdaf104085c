"""Ids of the lower-cased word vocabulary, cached by white-space chunk.

The vocabulary's pattern never crosses white space and its merges never cross a
word, so a text's ids are its chunks' ids in order. A batch is split and its
chunks are numbered in Arrow; each different chunk is looked up once, in a cache
of bounded size. Texts with characters outside plain Latin, or with what may be
one of the vocabulary's special strings, go to the tokenizer whole, as it may
treat those differently.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: What may normalise otherwise than character by character, or start a special string.
_UNSAFE = "<\\||[^\t\n\r\x20-\x7e\xa1-įı-ŷŹ-ž–-—…]"
_MARK = "\x01"
#: Chunks kept by one worker process at most, but for those of one slice of texts.
CACHE_CHUNKS = 800_000
#: Bytes of text that are encoded at once, unless one text is longer.
SLICE = 4 << 20
#: Chunks whose ids are gathered at once.
GATHERED = 1 << 16


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a string column of about ``most`` bytes, each with its first place."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, column.slice(at, stop - at)
        at = stop


class WordIds:
    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.used = 0

    @classmethod
    def of(cls, vocabulary: str) -> "WordIds":
        """The process's tokenizer for this vocabulary, with its cache."""
        return held(("words", hash(vocabulary)), lambda: cls(vocabulary))

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        for at in range(0, len(chunks), 20_000):
            some = chunks[at : at + 20_000]
            # Many chunks in one string, between marks that no chunk has, cost less than a string each.
            ids = self._encoded([f" {_MARK} ".join(some[i : i + 1000]) + f" {_MARK}" for i in range(0, len(some), 1000)])
            flat = np.fromiter(chain.from_iterable(ids), np.uint32)
            marks = np.flatnonzero(flat == self.mark)
            sizes = np.diff(marks, prepend=-1) - 1
            flat = np.delete(flat, marks)
            first, total = len(self.place), len(flat)
            while first + len(some) > len(self.starts):
                self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
            while self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * len(self.flat))
            self.flat[self.used : self.used + total] = flat
            self.sizes[first : first + len(some)] = sizes
            self.starts[first : first + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.used += total
            self.place.update(zip(some, range(first, first + len(some))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column in order, and where each text's start (one more at the end); null is empty."""
        column = pc.fill_null(column, "")
        odd = pc.match_substring_regex(column, _UNSAFE)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", column)))
        bounds = lists.offsets.to_numpy()
        chunks = lists.flatten().dictionary_encode()
        del lists  # each of these is as large as the texts, so none outlives its use
        # One string for all different chunks is cheaper to take over than a string each.
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(chunks.dictionary)], pa.int32()), chunks.dictionary), "\n")
        known = whole[0].as_py().split("\n") if len(chunks.dictionary) else []
        del whole
        if len(self.place) + len(known) > CACHE_CHUNKS:
            self._forget()
        self._learn([c for c in known if c not in self.place])
        slots = np.fromiter(map(self.place.__getitem__, known), np.int32, len(known))[chunks.indices.to_numpy()]
        del chunks, known
        ends = np.cumsum(self.sizes[slots], dtype=np.int64)
        flat = np.empty(ends[-1] if len(ends) else 0, self.flat.dtype)
        for at in range(0, len(slots), GATHERED):
            own = slots[at : at + GATHERED]
            first, sizes = int(ends[at - 1]) if at else 0, self.sizes[own]
            stop = int(ends[at + len(own) - 1])
            flat[first:stop] = self.flat[np.repeat(self.starts[own] - (ends[at : at + len(own)] - sizes), sizes) + np.arange(first, stop)]
        del slots
        offsets = np.concatenate([[0], ends])[bounds - bounds[0]]
        where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(where):
            own = [np.array(x, np.uint32) for x in self._encoded(column.take(pa.array(where)).to_pylist())]
            parts = np.split(flat, offsets[where])
            flat = np.concatenate([x for pair in zip(parts, own) for x in pair] + [parts[-1]])
            more = np.zeros(len(offsets), np.int64)
            more[where + 1] = [len(x) for x in own]
            offsets = offsets + np.cumsum(more)
        return flat, offsets
