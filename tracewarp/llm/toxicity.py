"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Training reads a bounded sample: about ``MAX_EXAMPLES`` labelled documents of each
class, chosen by a hash of the id, never from the held-out bucket. From their
words the ``N_TERMS`` terms most associated with toxic ones (chi-squared over
document frequencies, and at least ``LIFT`` times as frequent) become the
vocabulary; TF-IDF is over those terms. The
examples' vectors form an inverted index whose postings are cut into blocks with
the block's largest weight. A query adds up block bounds and opens blocks from
the best bound down until no bound exceeds the worst of the ``K`` best, which
gives the exact ``K`` nearest (ties: the smaller example number). Neighbours vote
with their similarity; a monotone map fitted by leave-one-out on the examples,
weighted to the classes' true shares, makes the vote a probability.

Edge cases: a null or empty text, or one without a known term, has no neighbour
and gets the calibrated share of such examples; without any labelled example
every score is 0; label rows that disagree count as toxic; null labels are
ignored; repeated rows get equal scores; an empty table gives no rows; other
columns are not read.
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

from .common import doc_bucket, held, unit_hash

MAX_EXAMPLES = 2000
N_TERMS = 400
MIN_DOCS = 4
LIFT = 2.0
K = 15
BLOCK = 32
_TOKEN = re.compile(r"[^\W\d_]+")


class BlockMaxIndex:
    """Postings of unit vectors by term, in blocks of ``BLOCK`` examples with their largest weight."""

    def __init__(self, terms: list[str], idf: np.ndarray, vectors: list[dict[int, float]], labels: list[int], ids: list[int], cut_x=None, cut_y=None, none_score: float = 0.0):
        self.terms, self.idf = {t: i for i, t in enumerate(terms)}, idf
        self.labels, self.ids, self.n = np.array(labels, np.float64), ids, len(vectors)
        blocks = -(-self.n // BLOCK) if self.n else 0
        self.bounds = np.zeros((len(terms), max(1, blocks)))
        self.postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [{} for _ in terms]
        lists: list[dict[int, list]] = [{} for _ in terms]
        for d, v in enumerate(vectors):
            for t, x in v.items():
                lists[t].setdefault(d // BLOCK, []).append((d % BLOCK, x))
        for t, own in enumerate(lists):
            for b, entries in own.items():
                weights = np.array([x for _, x in entries])
                self.postings[t][b] = (np.array([d for d, _ in entries]), weights)
                self.bounds[t, b] = weights.max()
        self.cut_x, self.cut_y, self.none_score = cut_x, cut_y, none_score

    def vector(self, text: str | None) -> dict[int, float]:
        """The text's unit TF-IDF vector."""
        counts: dict[int, int] = {}
        get = self.terms.get
        for w in _TOKEN.findall(text.lower()) if text else ():
            if (t := get(w)) is not None:
                counts[t] = counts.get(t, 0) + 1
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: float(x / norm) for t, x in v.items()} if norm else {}

    def nearest(self, v: dict[int, float], k: int = K, skip: int = -1) -> list[tuple[float, int]]:
        """The exact ``k`` nearest with positive similarity, best first; ``skip`` leaves one example out."""
        if not v or not self.n:
            return []
        terms = sorted(v)
        bound = np.array([v[t] for t in terms]) @ self.bounds[terms]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(best) == k and bound[b] + 1e-9 < -best[-1][0]:
                break
            sums = np.zeros(BLOCK)
            for t in terms:
                if (own := self.postings[t].get(b)) is not None:
                    sums[own[0]] += v[t] * own[1]
            least = -best[-1][0] if len(best) == k else 0.0
            places = np.flatnonzero(sums >= max(least, 1e-12))
            if len(places):
                best += [(-float(round(sums[i], 9)), b * BLOCK + i) for i in places.tolist() if b * BLOCK + i != skip]
                best.sort()
                del best[k:]
        return [(-s, d) for s, d in best]

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s * s for s, _ in near)
        return sum(s * s * self.labels[d] for s, d in near) / total if total else 0.0

    def score(self, text: str | None) -> tuple[float, list[tuple[float, int]]]:
        """The calibrated probability and the neighbours it rests on."""
        near = self.nearest(self.vector(text))
        if not near:
            return self.none_score, []
        return float(np.interp(self.vote(near), self.cut_x, self.cut_y)), near


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Pool adjacent violators; points of the monotone map."""
    ties: dict[float, list[float]] = {}
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist()):
        own = ties.setdefault(a, [0.0, 0.0])
        own[0] += b * c
        own[1] += c
    pools: list[list[float]] = []
    for a in sorted(ties):
        pools.append([a, *ties[a], a])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + last[1], pools[-1][2] + last[2], last[3]]
    xs = [z for p in pools for z in (p[0], p[3] + 1e-12)]
    return xs, [p[1] / p[2] for p in pools for _ in range(2)]


def fit(rows: list[tuple[int, int, list[tuple[str, int]]]], shares: tuple[float, float], n_terms: int = N_TERMS) -> tuple:
    """Index parts from (id, label, [(word, count)]) and the true shares of labels 0 and 1."""
    rows = sorted(rows)
    n = [sum(r[1] == k for r in rows) for k in (0, 1)]
    if not n[0] or not n[1]:
        return [], np.zeros(0), [], [], [], [0.0], [0.0], float(bool(n[1]))
    found: dict[str, list[int]] = {}
    for _, label, words in rows:
        for w, _ in words:
            found.setdefault(w, [0, 0])[label] += 1

    def chi(c: list[int]) -> float:
        out = 0.0
        total = n[0] + n[1]
        for k in (0, 1):
            for seen, own in ((c[k], c[0] + c[1]), (n[k] - c[k], total - c[0] - c[1])):
                expected = own * n[k] / total
                out += (seen - expected) ** 2 / expected if expected else 0.0
        return out

    scored = sorted(((-chi(c), w) for w, c in found.items() if c[0] + c[1] >= MIN_DOCS and c[1] * n[0] >= LIFT * (c[0] + 0.5) * n[1]))[:n_terms]
    terms = sorted(w for x, w in scored if -x >= 10.8)  # beyond chance at one in a thousand
    idf = np.array([math.log(1 + len(rows) / sum(found[t])) for t in terms])
    place, vectors = {t: i for i, t in enumerate(terms)}, []
    for _, _, words in rows:
        v = {place[w]: (1 + math.log(c)) * idf[place[w]] for w, c in words if w in place}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: float(x / norm) for t, x in v.items()} if norm else {})
    labels = [r[1] for r in rows]
    index = BlockMaxIndex(terms, idf, vectors, labels, [r[0] for r in rows])
    weight = [shares[k] / n[k] for k in (0, 1)]
    x, y, w, none = [], [], [], [0.0, 0.0]
    for d, v in enumerate(vectors):
        near = index.nearest(v, skip=d)
        if near:
            x.append(round(index.vote(near), 6)), y.append(labels[d]), w.append(weight[labels[d]])
        else:
            none[labels[d]] += weight[labels[d]]
    cut_x, cut_y = _isotonic(np.array(x), np.array(y, float), np.array(w)) if x else ([0.0], [0.0])
    return terms, idf, vectors, labels, [r[0] for r in rows], cut_x, cut_y, none[1] / (sum(none) or 1.0)


def train(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple:
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (doc_bucket(5) != 0))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("__toxic"))
    sizes = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values()) or 1
    take = [min(1.0, max_examples / sizes[k]) if sizes.get(k) else 0.0 for k in (0, 1)]
    # About max_examples ids a class, so this side of the join has a fixed bound.
    sample = known.filter(unit_hash("__id") < F.when(F.col("__toxic") == 1, F.lit(take[1])).otherwise(F.lit(take[0])))
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, lists = [], [], []
            for doc_id, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__toxic", "text"))):
                seen: dict[str, int] = {}
                for w in _TOKEN.findall((text or "").lower()):
                    seen[w] = seen.get(w, 0) + 1
                ids.append(doc_id), marks.append(toxic), lists.append(" ".join(f"{w} {n}" for w, n in seen.items()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int32()), pa.array(lists, pa.string())], names=["doc_id", "toxic", "words"])

    counted = joined.mapInArrow(words, "doc_id long, toxic int, words string")
    # Only words of several examples can become terms; the others stay on the executors.
    pairs = counted.select("doc_id", "toxic", F.explode(F.split("words", "(?<=[0-9]) ")).alias("p")).filter("p <> ''")
    pairs = pairs.select("doc_id", "toxic", F.split("p", " ")[0].alias("w"), F.split("p", " ")[1].cast("int").alias("n"))
    frequent = pairs.groupBy("w").agg(F.count("*").alias("df"), F.sum("toxic").alias("pos")).filter(F.col("df") >= MIN_DOCS)
    expected = F.col("df") * F.lit(take and (sizes.get(1, 0) * take[1]) / max(1.0, sum(sizes.get(k, 0) * take[k] for k in (0, 1))))
    top = frequent.orderBy(F.desc((F.col("pos") - expected) / F.sqrt(expected + 1)), "w").limit(4 * N_TERMS).select("w")
    by_doc = pairs.join(F.broadcast(top), "w").groupBy("doc_id").agg(F.collect_list(F.struct("w", "n")).alias("words"))
    rows = [(r["__id"], r["__toxic"], []) for r in joined.select("__id", "__toxic").distinct().collect()]  # the sample's ids
    lists = {r["doc_id"]: sorted((x["w"], x["n"]) for x in r["words"]) for r in by_doc.collect()}
    merged = []
    for doc_id, toxic, _ in rows:
        counts: dict[str, int] = {}
        for w, c in lists.get(doc_id, []):
            counts[w] = counts.get(w, 0) + c
        merged.append((doc_id, toxic, sorted(counts.items())))
    return fit(merged, (sizes.get(0, 0) / total, sizes.get(1, 0) / total))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the evidence: the nearest examples' ids."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_EXAMPLES and N_TERMS

    key = uuid.uuid4().hex  # names this index in the worker processes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held(key, lambda: BlockMaxIndex(*shared.value))
        for batch in batches:
            scores, evidence = [], []
            for text in batch.column("text"):
                score, near = index.score(text.as_py())
                scores.append(score)
                evidence.append([index.ids[d] for _, d in near])
            marks = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), marks, pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(doc_bucket(5) == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")
