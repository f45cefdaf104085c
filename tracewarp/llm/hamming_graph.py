"""Navigable small-world graph over binary codes, grown and searched for many codes at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

NONE = np.int16(32000)
#: A rank is a distance above the ``DIST``-th bit, then an id, then whether it is open; ``EMPTY`` is farther than all and open.
DIST, ID = 33, (1 << 32) - 1
EMPTY = np.int64(int(NONE) << DIST | ID << 1 | 1)


def exact(queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """All Hamming distances, a query a row, in blocks that stay in the cache."""
    out, rows, columns = np.empty((len(queries), len(codes)), np.int16), 32, 1024
    mine, theirs = np.ascontiguousarray(queries.T), np.ascontiguousarray(codes.T)
    for a in range(0, len(queries), rows):
        for b in range(0, len(codes), columns):
            q, c = mine[:, a : a + rows, None], theirs[:, None, b : b + columns]
            total = 0
            for w in range(0, len(q), 3):  # the bits of three words fit in a byte
                some = np.bitwise_count(q[w] ^ c[w])
                for k in range(w + 1, min(w + 3, len(q))):
                    some += np.bitwise_count(q[k] ^ c[k])
                total = some.astype(np.int16) if w == 0 else total + some
            out[a : a + rows, b : b + columns] = total
    return out


def _nearest(ids: np.ndarray, dist: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` nearest columns of each row, in no order."""
    if dist.shape[1] <= k:
        return ids, dist, *more
    best = np.argpartition(dist, k - 1, axis=1)[:, :k]
    return tuple(np.take_along_axis(x, best, axis=1) for x in (ids, dist, *more))


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, id) of each row's different ids, row by row; -1 is none."""
    ids = np.sort(ids, axis=1)
    own = ids >= 0
    own[:, 1:] &= ids[:, 1:] != ids[:, :-1]
    at = np.flatnonzero(own)
    return at // ids.shape[1], ids.ravel().take(at)


def _places(r: np.ndarray, m: int) -> tuple[np.ndarray, int]:
    """Each one's place among those of its row, for rows in order, and the most of a row."""
    times = np.bincount(r, minlength=m)
    return np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times), int(times.max())


class HammingGraph:
    """Codes linked to the nearest that were there when they came, and these back to them.

    ``links`` links at insertion and up to ``2 * links`` in all, the farthest giving
    way; early codes keep the long ones. A search starts from a spread of codes and
    from the latest codes of the query's own buckets, by ``TABLES`` keys of some of
    its bits; it keeps a beam of the nearest seen and opens the nearest unopened ones
    until all of the beam is open. Queries that are done leave the batch.
    """

    TABLES, SLOTS, SPREAD, OPENED = 6, 6, 16, 3
    #: One in so many codes is audited.
    AUDITED = 8

    def __init__(self, codes: np.ndarray, links: int = 8, beam: int = 16, seed: int = 11):
        self.codes, self.links, self.beam, self.size, self.audit = codes, links, beam, 0, (0, 0)
        self.seen = np.zeros(0, bool)
        n, bits = len(codes), 64 * codes.shape[1]
        self.to, self.far = np.full((n, 2 * links), -1, np.int32), np.full((n, 2 * links), NONE, np.int16)
        wide = max(1, min(14, n.bit_length() - 3))
        order = np.random.default_rng(seed).permutation(bits)
        self.bits = [order[t * wide % (bits - wide) :][:wide] for t in range(self.TABLES)]
        self.slots = np.full((self.TABLES, 1 << wide, self.SLOTS), -1, np.int32)
        self.filled = np.zeros((self.TABLES, 1 << wide), np.int64)

    def _keys(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((self.TABLES, len(codes)), np.int64)
        for t, own in enumerate(self.bits):
            for k, bit in enumerate(own.tolist()):
                out[t] |= ((codes[:, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)).astype(np.int64) << k
        return out

    def _ranks(self, queries: np.ndarray, r: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Distance, code and an open mark in one number for each pair of a query's and a code's place; the least is the nearest."""
        bits = np.bitwise_count(queries.take(r, axis=0) ^ self.codes.take(v, axis=0))
        dist = bits[:, 0].astype(np.int64)
        for w in range(1, bits.shape[1]):
            dist += bits[:, w]
        return dist << DIST | v.astype(np.int64) << 1

    def _entries(self, queries: np.ndarray, beam: int) -> np.ndarray:
        m = len(queries)
        spread = np.unique(np.linspace(0, self.size - 1, min(self.size, self.SPREAD)).astype(np.int32))
        ids = np.concatenate([np.broadcast_to(spread, (m, len(spread))), *(self.slots[t].take(key, axis=0) for t, key in enumerate(self._keys(queries)))], axis=1)
        r, v = _distinct(ids)
        ranks = np.full((m, max(beam, ids.shape[1])), EMPTY)
        ranks[r, _places(r, m)[0]] = self._ranks(queries, r, v)
        ranks.sort(axis=1)
        return ranks[:, :beam]

    def search(self, queries: np.ndarray, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam of each query; -1 where there is none."""
        beam, n, m = beam or self.beam, len(self.codes), len(queries)
        ranks, first = self._entries(queries, beam), np.arange(m) * n
        if len(self.seen) < m * n:
            self.seen = np.zeros(m * n, bool)
        seen, marked = self.seen, [(first[:, None] + (ranks >> 1 & ID))[ranks != EMPTY]]
        seen[marked[0]] = True
        active, out = np.arange(m), np.full((m, beam), EMPTY)
        opened = min(self.OPENED, beam)
        while len(active):
            rows = np.arange(len(active))[:, None]
            waiting = np.where(ranks & 1, EMPTY, ranks)
            pick = np.argpartition(waiting, opened - 1, axis=1)[:, :opened]
            picked = waiting[rows, pick].ravel()
            ranks[rows, pick] |= 1
            near = self.to.take(np.where(picked == EMPTY, 0, picked >> 1 & ID), axis=0)
            near[picked == EMPTY] = -1
            r, v = _distinct(near.reshape(len(active), -1))
            at = first.take(r) + v
            fresh = np.flatnonzero(~seen.take(at))
            r, v = r.take(fresh), v.take(fresh)
            marked.append(at.take(fresh))
            seen[marked[-1]] = True
            new = self._ranks(queries, r, v)
            better = np.flatnonzero(new >> DIST < (ranks[:, -1] >> DIST).take(r))
            if len(better):
                r = r.take(better)
                place, most = _places(r, len(active))
                more = np.full((len(active), most), EMPTY)
                more[r, place] = new.take(better)
                ranks = np.concatenate([ranks, more], axis=1)
                ranks.sort(axis=1)
                ranks = ranks[:, :beam]
            over = (ranks & 1).all(axis=1)
            if over.any():
                out[active[over]] = ranks[over]
                active, ranks, first, queries = active[~over], ranks[~over], first[~over], queries[~over]
        for at in marked:  # clean for the next search: new memory costs more than these places
            seen[at] = False
        return np.where(out == EMPTY, -1, out >> 1 & ID), (out >> DIST).astype(np.int16)

    def _insert(self, own: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Link codes that come next to the nearest of ``ids``."""
        near, far = _nearest(ids.astype(np.int32), dist, self.links)
        k = near.shape[1]
        self.to[own, :k], self.far[own, :k] = np.where(far < NONE, near, -1), far
        self.size = int(own[-1]) + 1
        a, b, d = np.repeat(own, k).astype(np.int32), near.ravel(), far.ravel()
        a, b, d = a[d < NONE], b[d < NONE], d[d < NONE]
        order = np.lexsort((d, b))
        a, b, d = a[order], b[order], d[order]
        ends, first, times = np.unique(b, return_index=True, return_counts=True)
        if len(ends):
            at, row = np.arange(len(b)) - np.repeat(first, times), np.repeat(np.arange(len(ends)), times)
            keep = at < 2 * self.links
            back_ids, back = np.full((len(ends), min(times.max(), 2 * self.links)), -1, np.int32), np.full((len(ends), min(times.max(), 2 * self.links)), NONE, np.int16)
            back_ids[row[keep], at[keep]], back[row[keep], at[keep]] = a[keep], d[keep]
            back[(back_ids[:, :, None] == self.to[ends][:, None, :]).any(axis=2)] = NONE
            self.to[ends], self.far[ends] = _nearest(np.concatenate([self.to[ends], back_ids], 1), np.concatenate([self.far[ends], back], 1), 2 * self.links)
        for t, key in enumerate(self._keys(self.codes[own])):
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            times = np.diff(np.append(first, len(order)))
            at = self.filled[t, sorted_] + np.arange(len(order)) - np.repeat(first, times)
            self.slots[t, sorted_, at % self.SLOTS] = own[order]
            self.filled[t, sorted_[first]] += times

    def grow(self, limit: int, nearest: int, wanted: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Insert all codes; (code, earlier code, distance, whether the code has more) for each one's ``nearest`` earlier ones within ``limit``.

        One in ``AUDITED`` of the codes is also compared with all earlier ones, before
        it has links of its own. Where the share of their exact ``nearest`` within
        ``limit`` that the searches found falls under ``wanted``, by more than chance
        does, the beam doubles and the batch is searched again. ``audit`` is (found, to be found) by the last beam.
        """
        n = len(self.codes)
        while self.size < n:
            own = np.arange(self.size, min(n, self.size + min(512, max(64, self.size))))
            inner = np.full((len(own), len(own)), NONE)
            for a in range(0, len(own), 64):  # only earlier ones count
                some = exact(self.codes[own[a : a + 64]], self.codes[own[: a + 64]])
                some[np.arange(some.shape[1]) >= np.arange(a, a + len(some))[:, None]] = NONE
                inner[a : a + 64, : a + 64] = some
            ids, dist = np.broadcast_to(own, inner.shape), inner
            if self.size:
                found = self._audited(own, limit, nearest, wanted)
                ids, dist = np.concatenate([found[0], ids], axis=1), np.concatenate([found[1], dist], axis=1)
            self._insert(own, ids, dist)
            near, far = _nearest(ids, dist, nearest)
            r, c = np.nonzero(far <= limit)
            if len(r):
                yield own[r], near[r, c], far[r, c], ((dist <= limit).sum(axis=1) > nearest)[r]

    def _audited(self, own: np.ndarray, limit: int, nearest: int, wanted: float) -> tuple[np.ndarray, np.ndarray]:
        some = slice(None, None, self.AUDITED)
        k = min(nearest, self.size)
        truth = np.sort(np.partition(exact(self.codes[own[some]], self.codes[: self.size]), k - 1, axis=1)[:, :k], axis=1)
        close = truth <= limit
        while True:
            found = self.search(self.codes[own])
            near = np.sort(found[1][some], axis=1)[:, :k]
            # The j-th found is one of the nearest if it is no farther than the exact j-th; ties are as good.
            now = int((close[:, : near.shape[1]] & (near <= truth[:, : near.shape[1]])).sum()), int(close.sum())
            hits, total = self.audit[0] + now[0], self.audit[1] + now[1]
            if hits >= wanted * total - 1 - 2 * math.sqrt(total * wanted * (1 - wanted)) or self.beam >= self.size:
                self.audit = hits, total
                return found
            self.beam, self.audit = 2 * self.beam, (0, 0)
