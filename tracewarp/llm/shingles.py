"""Hashes of words and of runs of words, for many texts at once, in numpy.

Words are runs of characters other than space and U+0009-U+000D. A word's hash sums
its UTF-8 bytes times random numbers of their places, so no pattern of letters is
special; a run's hash joins the hashes of its halves and mixes at every step.
Different seeds give independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_FACTORS: dict[int, np.ndarray] = {}
#: Bytes of text that are hashed at once, unless one text is longer.
CHUNK = 1 << 18


def factors(seed: int, n: int) -> np.ndarray:
    """Random odd numbers for at least ``n`` places, the same ones for a seed every time."""
    have = _FACTORS.get(seed)
    if have is None or len(have) < n:
        size = 1 << max(12, n.bit_length())
        have = np.random.default_rng(seed).integers(0, 1 << 64, size, dtype=np.uint64) | U(1)
        if size <= CHUNK:
            _FACTORS[seed] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> U(29))) * U(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> U(32))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes, as UTF-8, each with its first place."""
    first, own, size = 0, [], 0
    for i, t in enumerate(texts):
        own.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(own[-1]) + 1
        if size >= CHUNK:
            yield first, own
            first, own, size = i + 1, [], 0
    if own:
        yield first, own


def word_hashes(texts: list[bytes], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The words' mixed hashes of all texts in order, and where each text's words start (one more at the end)."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sep = _SEPARATOR[b]
    before = np.empty_like(sep)
    before[0], before[1:] = True, sep[:-1]
    starts, ends = np.flatnonzero(~sep & before), np.flatnonzero(sep & ~before)
    offsets = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        letters = (b[~sep].astype(np.uint64) + U(1)) * factors(seed, int(size.max()))[place]
        return mix(np.add.reduceat(letters, first) + size.astype(np.uint64) * U(0x9E3779B97F4A7C15)), offsets


def _joined(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U(0xD6E8FEB86659FD93) + b * U(0xA0761D6478BD642F) + U(seed))


def run_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``length`` words (runs across texts too; callers mask them)."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    have, out = 1, words
    while 2 * have <= length:
        out = _joined(out[:-have], out[have:], seed + have)
        have *= 2
    rest = length - have
    return _joined(out[:-rest], out[rest:], seed + length) if rest else out


def inside(offsets: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` runs lie in one text."""
    ok = np.ones(n, bool)
    for at in offsets[1:-1].tolist():
        ok[max(0, at - length + 1) : at] = False
    return ok


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest and len(out) > rest else out if not rest else out[:0]
