"""SimHash near-duplicates: small-world graphs by shard, verified edges, components.

1. A text's distinct five-word shingles give a SimHash of ``64 * WORDS`` bits. Equal
   texts (by their words) are one *copy class* with the least ``doc_id``; only
   classes go on.
2. Every class is dealt to one shard for each band of its code, of about
   ``SHARD_CODES`` codes; there are so many bands that two texts at the similarity
   limit meet in a search with probability ``BAND_RECALL``. A shard's codes come one
   batch after another: each searches the navigable small-world graph of the earlier
   ones for its ``NEAREST`` within ``radius`` and is then linked into it. Searches are
   audited against exact search as the graph grows, and the beam doubles where they
   find less than ``AUDIT_RECALL`` of the exact nearest. A shard above ``SPLIT`` codes
   is split into parts with a graph each, and its codes are queries to all of them.
3. Each class's nearest candidate is verified by the exact Jaccard similarity of
   the shingle sets, verified edges are united, and then every other candidate
   whose ends are still apart is verified; no pair within a united group is
   made. Components come from alternating stars; nothing is collected.
4. Classes that had more than ``NEAREST`` neighbours in some shard are compared with
   all codes of other components there. Components with such a neighbour within
   ``radius`` are joined exactly on the rarest shingles of their classes' sets (two
   sets at the limit share one of them, early in both), so a large group does not hide
   a link to another.
5. Bits of small sets agree less often than the law of large ones says, so texts of
   up to ``FEW`` shingles are also linked exactly, by a join on their shingles.

Edge cases: texts of one to four words are one shingle; null texts and texts
without words resemble nothing and are classes of their own; a null ``doc_id``
takes the class of its copies, if any; an id names one document, so rows of one
id, repeated or not, share a class and the filter keeps one of them; ties go to
the smaller id; texts of any length are shingled whole; an empty table gives no
rows; other columns are not read (the filter form keeps them).
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, give_back, release
from .components import components
from .hamming_graph import HammingGraph, exact
from .shingles import CHUNK, chunks, mix, run_hashes, word_hashes
from .word_ids import slices

U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
#: 64-bit words of a code.
WORDS = 5
#: Bits of a band at least, and codes of one shard on average beyond which bands take more.
BAND_BITS, SHARD_CODES = 3, 1 << 14
BAND_RECALL = 0.995
#: Share of the exact nearest that the searches of a shard find at least; the number of bands makes up for the rest.
AUDIT_RECALL = 0.8
#: Codes of one graph at most.
SPLIT = 1 << 17
NEAREST = 3
#: Texts of up to so many shingles are linked without codes.
FEW = 32
CODES = [f"c{i}" for i in range(WORDS)]


def agreement(similarity: float = SIMILARITY) -> float:
    """Chance that one bit of two codes agrees at this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius(similarity: float = SIMILARITY) -> int:
    """Distance that all but two in ten thousand pairs at the limit stay within, by the law of large sets; for small ones see :func:`short_links`."""
    p, n = 1 - agreement(similarity), 64 * WORDS
    return int(n * p + 3.8 * math.sqrt(n * p * (1 - p)))


def bands(n_codes: int, similarity: float = SIMILARITY) -> list[np.ndarray]:
    """The bits of each band. Their number grows with the bits, which grow with the codes."""
    bits = max(BAND_BITS, math.ceil(math.log2(max(1, n_codes) / SHARD_CODES)) if n_codes > SHARD_CODES else 0)
    count = math.ceil(math.log(1 - BAND_RECALL) / math.log(1 - AUDIT_RECALL * agreement(similarity) ** bits))
    total, out, rng = 64 * WORDS, [], np.random.default_rng(7)
    while len(out) < count:
        order = rng.permutation(total)
        out += [np.sort(order[a : a + bits]) for a in range(0, total - bits + 1, bits)]
    return out[:count]


def shingle_sets(texts: list[str | None]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(h1, h2, words, distinct shingle hashes) of each text in order."""
    for _, own in chunks(texts):
        words, offsets = word_hashes(own)
        runs = run_hashes(words, SHINGLE)
        for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if b == a:
                yield 0, 0, 0, np.zeros(0, np.uint64)
                continue
            whole = np.frombuffer(hashlib.blake2b(b" ".join(own[k].split()), digest_size=16).digest(), np.uint64)
            yield int(whole[0]), int(whole[1]), b - a, np.unique(runs[a : b - SHINGLE + 1]) if b - a >= SHINGLE else whole[:1]


_SALTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Majority of the shingles' hashed bits."""
    bits = np.unpackbits(mix(shingles[:, None] ^ _SALTS[None, :]).view(np.uint8), axis=1)
    # Counts of up to 255 rows fit in a byte, which sums fastest.
    ones = sum(bits[a : a + 255].sum(axis=0, dtype=np.uint8).astype(np.int64) for a in range(0, len(bits), 255))
    return np.packbits(2 * ones > len(shingles)).view(np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, shingles where they are few, code words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n = batch.num_rows
            h, counts, codes = np.zeros((2, n), np.uint64), np.zeros(n, np.int64), np.zeros((n, WORDS), np.uint64)
            few: list[bytes | None] = [None] * n
            for first, texts in slices(batch.column("text"), CHUNK):
                for k, (h1, h2, _, shingles) in enumerate(shingle_sets(texts.to_pylist()), first):
                    h[0, k], h[1, k], counts[k] = h1, h2, len(shingles)
                    if len(shingles):
                        codes[k] = simhash(shingles)
                    if 0 < len(shingles) <= FEW:
                        few[k] = shingles.tobytes()
            columns = [batch.column("doc_id"), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(counts), pa.array(few, pa.binary())]
            columns += [pa.array(np.ascontiguousarray(codes[:, w]).view(np.int64)) for w in range(WORDS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "n_shingles", "few", *CODES])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, n_shingles long, few binary, " + ", ".join(f"{c} long" for c in CODES))


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in CODES], axis=1)


def deal(classes: DataFrame, chosen: list[np.ndarray]) -> DataFrame:
    """One row for each class and band: (shard, node, code, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                bits = np.unpackbits(np.ascontiguousarray(_codes(part)).view(np.uint8), axis=1)
                for k, own in enumerate(chosen):
                    key = bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(key + (k << 40)), *part.columns], names=["shard", *part.schema.names])

    return classes.mapInArrow(run, "shard long, node long, component long, " + ", ".join(f"{c} long" for c in CODES))


def hot_shards(dealt: DataFrame) -> DataFrame | None:
    """(shard, parts) of the shards above ``SPLIT`` codes, if there are any."""
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT)
    hot = checkpoint(sizes.select("shard", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")))
    return None if hot.isEmpty() else hot


def grouped(dealt: DataFrame, hot: DataFrame | None, queries, shards: int = 0) -> DataFrame:
    """Rows by shard and part in order, in tasks for so many ``shards`` (0: by size); ``held`` where a part indexes the code. Rows for which ``queries`` holds go to every part."""
    if hot is None:
        parted = dealt.withColumns({"part": F.lit(0), "held": F.lit(True)})
    else:
        parts = F.coalesce("parts", F.lit(1))
        own = F.pmod(F.xxhash64("node"), parts).cast("int")
        every = F.when(queries, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
        parted = dealt.join(hot, "shard", "left").withColumn("own", own).withColumn("part", F.explode(every)).withColumn("held", F.col("part") == F.col("own"))
    # Searches cost more than their bytes tell, so they are not left to be coalesced by size. A few shards have two tasks
    # each, so that seldom two meet; of many, a task gets about four, as tasks without one cost time as well.
    tasks = [max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * shards, 512 + shards // 4, 20_000))] if shards else []
    return parted.select("shard", "part", "held", "node", "component", *CODES).repartition(*tasks, "shard", "part").sortWithinPartitions("shard", "part", "node")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, components, codes, held) of each part of a shard; rows come in that order."""
    at, parts = None, []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "part")], axis=1)
        columns = batch.column("node").to_numpy(), batch.column("component").to_numpy(), _codes(batch), batch.column("held").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:]):
            if b == a:
                continue
            if (own := tuple(key[a].tolist())) != at:
                if parts:
                    yield tuple(np.concatenate(x) for x in zip(*parts))
                at, parts = own, []
            parts.append([x[a:b] for x in columns])
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _neighbours(codes: np.ndarray, held: np.ndarray, limit: int, audit: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, candidate places, distances, whether the query has more) of one part of a shard."""
    index, asked = np.flatnonzero(held), np.flatnonzero(~held)
    if not len(index):
        return
    graph = HammingGraph(codes[index])
    for q, c, d, more in graph.grow(limit, NEAREST, AUDIT_RECALL):
        yield index[q], index[c], d, more
    audit.append((len(index), graph.beam, *graph.audit))
    for at in range(0, len(asked), 512):
        own = asked[at : at + 512]
        ids, dist = graph.search(codes[own])
        near = np.argsort(dist, axis=1, kind="stable")[:, :NEAREST]
        r, c = np.nonzero(np.take_along_axis(dist, near, axis=1) <= limit)
        yield own[r], index[ids[r, near[r, c]]], dist[r, near[r, c]], ((dist <= limit).sum(axis=1) > NEAREST)[r]


def candidates(rows: DataFrame, limit: int) -> DataFrame:
    """(u, v, distance, more_u, more_v): each class's nearest in each of its shards, and whether an end has more there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()
        for nodes, _, codes, held in _shards(batches):
            if len(nodes) < 2:
                continue
            parts = []
            for q, c, d, more in _neighbours(codes, held, limit, []):
                a, b = nodes[q], nodes[c]
                up = a > b
                parts.append(np.stack([np.maximum(a, b), np.minimum(a, b), d.astype(np.int64) << 2 | (more & up) << 1 | (more & ~up)], axis=1))
            found = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
            del parts
            found = np.ascontiguousarray(found[found[:, 0] != found[:, 1]])
            # A row's bytes take a third of what its numbers take in a tuple.
            rest = [k for k in dict.fromkeys(found.view("V24").ravel().tolist()) if k not in seen]
            if len(seen) > 100_000:
                seen.clear()
            seen.update(rest)
            if rest:
                u, v, x = np.frombuffer(b"".join(rest), np.int64).reshape(-1, 3).T
                columns = [pa.array(u), pa.array(v), pa.array(x >> 2), pa.array(x & 2 > 0), pa.array(x & 1 > 0)]
                yield pa.RecordBatch.from_arrays(columns, names=["u", "v", "distance", "more_u", "more_v"])
        give_back()

    return rows.mapInArrow(run, "u long, v long, distance long, more_u boolean, more_v boolean")


def graph_audit(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(codes, beam, found, wanted) of every graph: how many of the audited codes' exact nearest its searches found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, _, codes, held in _shards(batches):
            audit: list[tuple] = []
            for _ in _neighbours(codes, held, radius(similarity), audit):
                pass
            if audit:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*audit)], names=["codes", "beam", "found", "wanted"])

    _, codes, chosen = copy_classes(checkpoint(fingerprints(docs)), similarity)
    dealt = deal(codes, chosen)
    return grouped(dealt, hot_shards(dealt), F.lit(True), len(chosen) << len(chosen[0])).mapInArrow(run, "codes long, beam long, found long, wanted long")


def _strange(codes: np.ndarray, comps: np.ndarray, asked: np.ndarray, held: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query places, places, distances) within ``limit`` in other components, a block of queries at a time; a crowd is not compared with itself."""
    order = asked[np.argsort(comps[asked], kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(comps[order]) != 0, [True]]))
    crowds = [order[a:b] for a, b in zip(edges[:-1], edges[1:]) if b - a >= 64]
    rest = [order[a:b] for a, b in zip(edges[:-1], edges[1:]) if b - a < 64]
    groups = [(own, held[comps[held] != comps[own[0]]]) for own in crowds] + ([(np.concatenate(rest), held)] if rest else [])
    for own, others in groups:
        step = max(1, min(256, (1 << 20) // max(1, len(others))))
        for at in range(0, len(own) if len(others) else 0, step):
            some = own[at : at + step]
            dist = exact(codes[some], codes[others])
            q, c = np.nonzero((dist <= limit) & (comps[some][:, None] != comps[others][None, :]))
            if len(q):
                yield some[q], others[c], dist[q, c]


def strangers(rows: DataFrame, limit: int) -> DataFrame:
    """(component) of both ends, once a shard, where a marked class has a code of another component within ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, comps, codes, held in _shards(batches):
            marked = np.flatnonzero(comps < 0)  # a marked class carries its component as -1 - component
            comps = np.where(comps < 0, -1 - comps, comps)
            if len(marked) == 0 or len(np.unique(comps)) < 2:
                continue
            found: set[int] = set()
            for q, c, _ in _strange(codes, comps, marked, np.flatnonzero(held), limit):
                found.update(np.unique(comps[np.concatenate([q, c])]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["component"])

    return rows.mapInArrow(run, "component long").distinct()


_FILTER_BITS = 26


def _filter_cells(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> U(64 - _FILTER_BITS)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A broadcast bit set of 8 MB, whatever the input, that holds every id's cell (and so some other ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        size, bits = 1 << 20, {}
        for batch in batches:
            cell = _filter_cells(batch.column(0).to_numpy())
            for r in np.unique(cell >> 20).tolist():
                bits.setdefault(r, np.zeros(size, bool))[cell[cell >> 20 == r] & (size - 1)] = True
        for r, own in bits.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], names=["range", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            for r, bits in zip(batch.column("range").to_pylist(), batch.column("bits").to_pylist()):
                if r != key:
                    if key is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["range", "bits"])
                    key, own = r, np.zeros(1 << 17, np.uint8)
                own |= np.frombuffer(bits, np.uint8)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["range", "bits"])

    schema = "range int, bits binary"
    parts = ids.mapInArrow(run, schema).repartition("range").sortWithinPartitions("range")
    rows = parts.mapInArrow(merge, schema).collect()  # 64 ranges of 128 kB at most
    return ids.sparkSession.sparkContext.broadcast({r["range"]: bytes(r["bits"]) for r in rows})


def _in_filter(bits: dict[int, bytes], ids: np.ndarray) -> np.ndarray:
    out, cell = np.zeros(len(ids), bool), _filter_cells(ids)
    for r, own in bits.items():
        at = np.flatnonzero(cell >> 20 == r)
        low = cell[at] & ((1 << 20) - 1)
        out[at] = np.frombuffer(own, np.uint8)[low >> 3] >> (7 - (low & 7)).astype(np.uint8) & 1
    return out


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the documents that stand for a class with candidates; 32-bit shingle hashes, sorted."""
    shared = id_filter(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keep = _in_filter(shared.value, batch.column("doc_id").to_numpy())
            part = batch.filter(pa.array(keep))
            for at in range(0, part.num_rows, 200):
                some = part.slice(at, 200)
                sets = [np.unique((s >> U(32)).astype(np.uint32)).tobytes() for *_, s in shingle_sets(some.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    # Rows of one id are one document; the filter lets some others through, which the joins drop.
    return rows.mapInArrow(run, "node long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (u, v) whose shingle sets have at least this Jaccard similarity; a pair may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("su"), batch.column("sv")):
                a, b = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both) - 1e-9 and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.select("u", "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
    return two.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def _prefix(n: int, similarity: float) -> int:
    """Of two sets in one order, one of ``n`` and both at the limit at least, these first elements have one in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def _linked(sets: list[tuple[int, frozenset[int]]], similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs that join the (node, set) of one group as all pairs at the limit would; rare elements are looked up first."""
    times = Counter(x for _, own in sets for x in own)
    up = list(range(len(sets)))
    same: dict[frozenset[int], int] = {}
    index: dict[int, list[int]] = {}

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, (node, own) in enumerate(sets):
        if (j := same.setdefault(own, i)) != i:
            up[i] = top(j)
            yield node, sets[j][0]
            continue
        looked: set[int] = set()
        for x in sorted(own, key=lambda x: (times[x], x))[: _prefix(len(own), similarity)]:
            for j in index.get(x, ()):
                if j in looked or top(i) == top(j):
                    continue
                looked.add(j)
                both = len(own & sets[j][1])
                if both >= similarity * (len(own) + len(sets[j][1]) - both) - 1e-9:
                    up[top(i)] = top(j)
                    yield node, sets[j][0]
            index.setdefault(x, []).append(i)


def short_links(wordy: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(u, v) that join the classes of up to ``FEW`` shingles as all their pairs at the limit would.

    A class goes to the groups of its first shingles in the order of their hashes:
    two classes at the limit meet in one. A group gives one row a class at most.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, few in zip(batch.column("node").to_pylist(), batch.column("few").to_pylist()):
                own = np.frombuffer(few, np.uint64)  # sorted
                out += [(x, node, few) for x in own[: _prefix(len(own), similarity)].view(np.int64).tolist()]
            types = [pa.int64(), pa.int64(), pa.binary()]
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 10_000]), types)], names=["key", "node", "few"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows = ((k, n, f) for b in batches for k, n, f in zip(*(b.column(c).to_pylist() for c in ("key", "node", "few"))))
        for _, own in groupby(rows, key=lambda r: r[0]):
            links = list(_linked([(n, frozenset(np.frombuffer(f, np.uint64).tolist())) for _, n, f in own], similarity))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((max(x), min(x)) for x in links))], names=["u", "v"])

    classes = wordy.filter("few IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("few").alias("few")).select("node", "few")
    dealt = classes.mapInArrow(keys, "key long, node long, few binary").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "u long, v long")


def same_id(wordy: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v) that join the classes of the different texts of one id."""
    several = wordy.groupBy("doc_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("h2").alias("c"), F.max("h2").alias("d")).filter("a <> b OR c <> d").select("doc_id")
    nodes = wordy.select("doc_id", "h1", "h2").join(several, "doc_id").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc_id", "node").distinct()
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("v"))
    return nodes.join(least, "doc_id").filter("node > v").select(F.col("node").alias("u"), "v")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    a = comps.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    b = comps.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    both = pairs.join(a, "u", "left").join(b, "v", "left")
    return both.filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _edges(comps: DataFrame) -> DataFrame:
    return comps.select(F.col("node").alias("u"), F.col("component").alias("v"))


def prefix_pairs(sets: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """(u, v) of different components that share one of their rarest shingles, and so all pairs at the limit.

    A set's elements are ordered by how many sets have them. Of a shingle's rows, those
    outside its largest component meet all others: a crowd is not compared with itself.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [np.frombuffer(x.as_py(), np.uint32) for x in part.column("shingles")]
                size = np.array([len(x) for x in own])
                columns = [np.repeat(part.column("node").to_numpy(), size), np.repeat(size, size), np.concatenate(own).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "n", "s"])

    rows = checkpoint(sets.mapInArrow(spread, "node long, n long, s long"))
    shared = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    # An element that no other set has comes first in order and meets nothing, so only the shared ones are ranked.
    held = rows.join(shared, "s")
    order = Window.partitionBy("node").orderBy("df", "s")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("node"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    keys = held.withColumn("place", alone + F.row_number().over(order)).filter(F.col("place") <= first).select("s", "node", "n", "place")
    keys = checkpoint(keys.join(comps, "node", "left").select("s", "node", "n", "place", F.coalesce("component", "node").alias("c")))
    largest = keys.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("m")).filter("m > 1")
    largest = checkpoint(largest)  # so that the joins below stand alone and their hot shingles can be split
    minor = keys.join(largest.select("s", "most"), "s").filter("c <> most").select("s", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("c").alias("ca"))
    minor = checkpoint(minor)
    # If this is their first shared element, so many are shared at most; a pair at the limit passes at its first one.
    most = F.lit(1) + F.least(F.col("n") - F.col("place"), F.col("na") - F.col("pa"))
    enough = most >= similarity / (1 + similarity) * (F.col("n") + F.col("na")) - 1e-9
    both = minor.join(keys, "s").filter((F.col("ca") != F.col("c")) & enough)
    return both.select(F.greatest("a", "node").alias("u"), F.least("a", "node").alias("v")).distinct()


def link_strangers(docs: DataFrame, live: DataFrame, chosen: list[np.ndarray], hot: DataFrame | None, limit: int, tried: DataFrame, marked: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """The components once every neighbour of a marked class has been verified, ruled out exactly, or is in its component."""
    placed = live.join(comps, "node", "left").join(marked.withColumn("more", F.lit(True)), "node", "left")
    own = F.coalesce("component", "node")
    dealt = placed.select("node", F.when(F.col("more"), F.lit(-1) - own).otherwise(own).alias("component"), *CODES)
    inside = checkpoint(strangers(grouped(deal(dealt, chosen), hot, F.col("component") < 0), limit))
    if inside.isEmpty():
        return comps
    nodes = checkpoint(placed.select("node", own.alias("component")).join(inside, "component", "left_semi").select("node"))
    sets = checkpoint(sets_of(docs, nodes).join(nodes, "node", "left_semi"))
    rest = checkpoint(prefix_pairs(sets, comps, similarity).join(tried, ["u", "v"], "left_anti"))
    late = checkpoint(verified(rest, sets, similarity))
    return comps if late.isEmpty() else components(_edges(comps).unionByName(late))


def copy_classes(prints: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, list[np.ndarray]]:
    """The copy classes (h1, h2, node, code), the rows to deal, and the bands."""
    wordy = prints.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = wordy.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in CODES])
    return classes, classes.select("node", F.lit(0).cast("bigint").alias("component"), *CODES), bands(wordy.count(), similarity)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_shingles, representative) for every document."""
    limit = radius(similarity)
    prints = checkpoint(fingerprints(docs))
    wordy = prints.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes, codes, chosen = copy_classes(prints, similarity)
    dealt = deal(codes, chosen)
    hot = hot_shards(dealt)
    searched = candidates(grouped(dealt, hot, F.lit(True), len(chosen) << len(chosen[0])), limit)
    found = searched.groupBy("u", "v").agg(F.min("distance").alias("distance"), F.max("more_u").alias("more_u"), F.max("more_v").alias("more_v"))
    pairs = checkpoint(found)
    # A class's nearest candidate first, from either end; ties to the smaller id.
    ends = pairs.select(F.explode(F.array(F.struct("u", F.struct("distance", "v").alias("x")), F.struct(F.col("v").alias("u"), F.struct("distance", F.col("u").alias("v")).alias("x")))).alias("e"))
    near = checkpoint(ends.select("e.*").groupBy("u").agg(F.min("x").alias("x")))
    first = near.select(F.greatest("u", "x.v").alias("u"), F.least("u", "x.v").alias("v")).distinct()
    sets = checkpoint(sets_of(docs, near.select("u")))
    edges = checkpoint(verified(first, sets, similarity).unionByName(short_links(wordy, similarity)).unionByName(same_id(wordy, classes)))
    comps = components(edges)
    more = checkpoint(verified(_apart(pairs, comps), sets, similarity))
    if not more.isEmpty():
        comps = components(_edges(comps).unionByName(more))
    marked = pairs.select(F.explode(F.array(F.when(F.col("more_u"), F.col("u")), F.when(F.col("more_v"), F.col("v")))).alias("node")).filter("node IS NOT NULL").distinct()
    if not marked.isEmpty():
        comps = link_strangers(docs, codes.drop("component"), chosen, hot, limit, pairs.select("u", "v"), marked, comps, similarity)
    by_text = classes.select("h1", "h2", "node").join(comps, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("class_id"))
    out = prints.select("doc_id", "h1", "h2", "n_shingles").join(by_text, ["h1", "h2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"), "n_shingles", F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("representative"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, of the least id; rows without an id stay."""
    found = checkpoint(near_duplicates(docs, similarity).filter("doc_id IS NOT NULL"))
    gone = found.filter("NOT representative").select(F.col("doc_id").alias("__gone")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.join(gone, docs["doc_id"].cast("bigint") == F.col("__gone"), "left_anti")
    again = found.filter("representative").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__again"))
    if again.isEmpty():
        return kept.select(*columns)
    # Few rows share an id; of these the one with the least text stays.
    match = kept["doc_id"].cast("bigint") == F.col("__again")
    place = F.row_number().over(Window.partitionBy("__again").orderBy(F.col("text").asc_nulls_last()))
    one = kept.join(again, match).withColumn("__place", place).filter("__place = 1").select(*columns)
    return kept.join(again, match, "left_anti").select(*columns).unionByName(one)
