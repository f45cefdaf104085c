"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
score of a word is the sum over all its segmentations into pieces, computed by a
forward pass; a text's score is the product over its words. Piece probabilities
come from expectation-maximisation over word counts of a bounded sample:
about ``TRAIN_DOCS`` documents a language, chosen by a hash of their id, for every language, and the
``TRAIN_WORDS`` most frequent words of each of them. Prediction reads whole texts.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go
to the language first in order; languages with no usable text are not learned; an
empty table gives no rows, and with nothing learned every row is ``und``;
repeated rows get equal answers; other columns are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, held, unit_hash, vocabulary_path
from .word_ids import slices

TRAIN_DOCS = 1500
TRAIN_WORDS = 6000
ROUNDS = 2
#: Probability of one character that no piece covers.
UNKNOWN = 1e-7
#: Bits of the tables that rule out runs of characters.
_BITS = 18
_WORDS = re.compile(r"[^\W\d_]+")


def load_pieces(path: str | None = None) -> list[str]:
    """Pieces of letters, with the word-begin mark, of a public vocabulary, in lower case."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path("piece_bpe_32k.model"))
    kept = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if piece.strip("▁").isalpha() and piece.count("▁") <= 1 and piece == piece.lower() and not sp.is_byte(i):
            kept[piece] = None
    return list(kept)


class Model:
    """Piece probabilities of L languages; words' log scores are cached."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray, priors: np.ndarray):
        self.languages, self.priors = languages, np.log(priors)
        # One row more stands for a character that no piece covers.
        self.table = np.concatenate([np.asarray(probabilities, np.float64).reshape(len(pieces), len(languages)), np.full((1, len(languages)), UNKNOWN)])
        self.longest = max(map(len, pieces), default=1)
        # For each length: the pieces' hashes in order, their places, and a table that rules most others out.
        self.known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == size]
            h = np.array([int(self._hashes("".join(pieces[i]), size)[-1][0]) for i in own], np.uint64)
            order, maybe = np.argsort(h), np.zeros(1 << _BITS, bool)
            maybe[self._cells(h)] = True
            self.known.append((h[order], np.array(own, np.int64)[order], maybe))
        self.rows, self.cache = np.zeros((1 << 16, len(languages)), np.float64), {}

    @staticmethod
    def _hashes(text: str, longest: int) -> list[np.ndarray]:
        """Hashes of all runs of 1 to ``longest`` characters."""
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        out = [x]
        with np.errstate(over="ignore"):
            for size in range(2, min(longest, len(x)) + 1):
                out.append(out[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + x[size - 1 :])
        return out

    @staticmethod
    def _cells(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _BITS)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log of the sum over all segmentations, a word a row and a language a column.

        The forward pass goes from end to end for all words at once; the pieces of one
        length that stop at one end are an arc a word at most.
        """
        n, count, sizes = len(words), len(self.languages), np.array([len(w) + 1 for w in words], np.int64)
        out, shift = np.zeros((n, count)), np.zeros(n)
        if not n:
            return out
        word = np.repeat(np.arange(n), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.repeat(sizes, sizes) - place
        ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # for each length: words and pieces by end, and where each end starts
        longest = int(sizes.max())
        for size, h in enumerate(self._hashes("".join("▁" + w for w in words), self.longest), 1):
            keys, places, maybe = self.known[size - 1]
            inside = left[: len(h)] >= size
            at = np.flatnonzero(maybe[self._cells(h)] & inside) if size > 1 else np.arange(len(h))
            found = np.minimum(np.searchsorted(keys, h[at]), max(0, len(keys) - 1))
            hit = keys[found] == h[at] if len(keys) else np.zeros(len(at), bool)
            piece = np.where(hit, places[found], len(self.table) - 1) if len(keys) else np.full(len(at), len(self.table) - 1)
            if size > 1:
                at, piece = at[hit], piece[hit]
            end = place[at] + size
            order = np.argsort(end.astype(np.int16) if longest < 1 << 15 else end, kind="stable")
            ends.append((word[at][order], piece[order], np.searchsorted(end[order], np.arange(longest + 2))))
        # The last ends are kept, as far back as a piece reaches; a shift of a word's logarithm keeps long words in range.
        alpha = np.zeros((self.longest + 1, n, count))
        alpha[0] = 1.0
        for end in range(1, longest + 1):
            now = alpha[end % len(alpha)]
            now[:] = 0.0
            for size, (w, piece, starts) in enumerate(ends[:end], 1):
                a, b = starts[end], starts[end + 1]
                if b > a:
                    now[w[a:b]] += alpha[(end - size) % len(alpha), w[a:b]] * self.table[piece[a:b]]
            done = np.flatnonzero(sizes == end)
            out[done] = np.log(np.maximum(now[done], 1e-320)) + shift[done, None]
            low = np.flatnonzero((now.max(axis=1) < 1e-200) & (sizes > end))
            if len(low):
                alpha[:, low] *= 1e200
                shift[low] -= 200 * math.log(10)
        return out

    def learn(self, words: list[str]) -> None:
        """Put the scores of new words in the cache; words of like length go together."""
        new = sorted({w for w in words if w not in self.cache}, key=len)
        at = 0
        while at < len(new):
            step = max(1, min(8192, (1 << 18) // (len(new[at]) + 1)))
            while step > 1 and len(new[min(at + step, len(new)) - 1]) > 2 * len(new[at]) + 16:
                step //= 2
            some = new[at : at + step]
            first = len(self.cache)
            while first + len(some) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(some)] = self.score_words(some)
            self.cache.update(zip(some, range(first, first + len(some))))
            at += len(some)

    def predict(self, texts: list[str | None], most: int = 600_000) -> list[tuple[str, float]]:
        """(language, its posterior probability) of each text."""
        words = [_WORDS.findall(t.lower()) if t and self.languages else [] for t in texts]
        if len(self.cache) > most:
            self.cache.clear()
        self.learn([w for own in words for w in own])
        out = []
        for own in words:
            if not any(map(str.isalpha, own)) and not any(c.isalpha() for w in own for c in w):
                out.append(("und", 0.0))
                continue
            scores = self.rows[np.fromiter(map(self.cache.__getitem__, own), np.int64, len(own))].sum(axis=0) + self.priors
            best = int(scores.argmax())
            out.append((self.languages[best], float(1 / np.exp(scores - scores[best]).sum())))
        return out


def _expected(counts: list[tuple[str, int]], p: dict[str, float], longest: int) -> dict[str, float]:
    """Expected piece counts of one language's words under ``p`` (forward-backward)."""
    out: dict[str, float] = {}
    for word, times in counts:
        text, n = "▁" + word, len(word) + 1
        arcs = [(s, e, q) for e in range(1, n + 1) for s in range(max(0, e - longest), e) if (q := p.get(text[s:e], UNKNOWN if e - s == 1 else None)) is not None]
        forward, backward = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for s, e, q in arcs:
            forward[e] += forward[s] * q
        for s, e, q in sorted(arcs, key=lambda a: -a[0]):
            backward[s] += q * backward[e]
        if forward[n] > 0:
            for s, e, q in arcs:
                if text[s:e] in p:
                    out[text[s:e]] = out.get(text[s:e], 0.0) + times * forward[s] * q * backward[e] / forward[n]
    return out


def fit(counts: dict[str, list[tuple[str, int]]], documents: dict[str, int], pieces: list[str], rounds: int = ROUNDS) -> tuple:
    """Languages, pieces in use, probabilities and priors from word counts by language."""
    known, longest = set(pieces), max(map(len, pieces))
    languages = sorted(k for k, v in counts.items() if v)
    learned = {}
    for lang in languages:
        seen: dict[str, float] = {}
        for word, times in counts[lang]:
            text = "▁" + word
            for e in range(1, len(text) + 1):
                for s in range(max(0, e - longest), e):
                    if text[s:e] in known:
                        seen[text[s:e]] = seen.get(text[s:e], 0.0) + times / len(text)
        p = seen
        for k in range(rounds + 1):
            total = sum(p.values()) or 1.0
            p = {w: v / total for w, v in p.items() if v / total > 1e-9}
            if k < rounds:
                p = _expected(counts[lang], p, longest)
        learned[lang] = p
    used = sorted(set().union(*learned.values())) if learned else []
    floor = 1e-7
    table = np.array([[learned[lang].get(w, 0.0) * (1 - len(used) * floor) + floor for lang in languages] for w in used]).reshape(len(used), len(languages))
    total = sum(documents.get(lang, 0) + 1 for lang in languages) or 1
    return languages, used, table, np.array([(documents.get(lang, 0) + 1) / total for lang in languages])


def train(docs: DataFrame, vocabulary: str | None = None, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS) -> tuple:
    """Fit on documents outside the held-out bucket; what reaches the driver has a fixed bound."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_bucket(4) != 2))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not sizes:
        return [], [], np.zeros((0, 0)), np.zeros(0)
    # Maps, as a chain of conditions gets as deep as there are languages.
    of_lang = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), F.col("lang"))
    share = of_lang({lang: min(1.0, train_docs / n) for lang, n in sizes.items()})

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for w in _WORDS.findall(text.lower()):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
        rows = [(k[0], k[1], v) for k, v in seen.items()]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[at : at + 10_000])], names=["lang", "word", "n"])

    sample = usable.filter(unit_hash() < share).select("lang", "text").mapInArrow(words, "lang string, word string, n long")
    rare = sample.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The most frequent words of a language by a threshold on the count, so no language is sorted in one task.
    ranked = rare.groupBy("lang", "n").agg(F.count("*").alias("words")).collect()
    least = {}
    for lang in sizes:
        total = 0
        for r in sorted((r for r in ranked if r["lang"] == lang), key=lambda r: -r["n"]):
            if total + r["words"] > train_words and total:
                break
            total, least[lang] = total + r["words"], r["n"]
    keep = F.col("n") >= of_lang(least) if least else F.lit(False)
    counts: dict[str, list] = {lang: [] for lang in sizes}
    for r in rare.filter(keep).orderBy(F.desc("n"), "word").limit(train_words * max(1, len(least)) * 2).collect():
        counts[r["lang"]].append((r["word"], r["n"]))
    return fit(counts, sizes, load_pieces(vocabulary))


def identify(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and its posterior probability for every document."""
    model = train(docs, vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces, which are bounded, x languages

    key = uuid.uuid4().hex  # names this model in the worker processes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(key, lambda: Model(*shared.value))
        for batch in batches:
            found = [f for _, texts in slices(batch.column("text")) for f in own.predict(texts.to_pylist())]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(doc_bucket(4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
