"""Near-duplicates, substring removal, decontamination and toxicity against brute force."""

import collections
import hashlib
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarp.llm import components, decontam, near_dups, shingles, substring, toxicity
from tracewarp.llm.common import WORD
from tracewarp.llm.hamming_graph import HammingGraph, exact

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng, texts = random.Random(5), []
    for i in range(60):
        texts.append((i, " ".join(words(rng, rng.choice([3, 30, 120, 400])))))
    base = words(rng, 200)
    for i in range(60, 90):  # near copies, some of them nearer than others
        own = list(base)
        for _ in range(rng.choice([1, 2, 4, 9])):
            own[rng.randrange(len(own))] = f"x{i}"
        texts.append((i, " ".join(own)))
    texts += [(100 + k, texts[5][1]) for k in range(12)]  # a group of exact copies
    texts += [(200, None), (201, ""), (202, " \n "), (203, texts[9][1] + "\n"), (204, "one"), (205, "one")]
    passage = " ".join(words(rng, 70))
    texts += [(300 + k, " ".join(words(rng, 20)) + " " + passage + "\t" + " ".join(words(rng, k))) for k in range(8)]
    return texts


def test_near_duplicates(spark, corpus):
    got = {r["doc_id"]: r for r in near_dups.near_duplicates(docs_of(spark, corpus)).collect()}
    sets = {}
    for i, t in corpus:
        w = WORD.findall(t or "")
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert {i: r["class_id"] for i, r in got.items()} == {i: top(i) for i in sets}
    assert all(r["representative"] == (i == r["class_id"]) for i, r in got.items())
    kept = near_dups.drop_near_duplicates(docs_of(spark, corpus))
    assert {r["doc_id"] for r in kept.collect()} == {top(i) for i in sets} and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def test_near_duplicates_of_nothing(spark):
    assert near_dups.near_duplicates(docs_of(spark, [])).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f g", 1), (3, "a b c d e f g", 1), (None, "z", 2)], "doc_id bigint, text string, class_id int")
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0) for r in near_dups.near_duplicates(null).collect()) == [(0, 0), (0, 3), (3, 3)]


def test_near_duplicates_of_two_crowds(spark):
    """One pair alone links two crowds; either end has many nearer codes that fail, so later rounds must find it."""
    rng = random.Random(14)
    one = words(rng, 120, 10**6)
    two = ["x" + w if k in (1, 40, 80) else w for k, w in enumerate(one)]
    texts = [" ".join([*own[:-1], own[-1] if i == 0 else f"{n}{i}"]) for n, own in (("a", one), ("b", two)) for i in range(25)]
    got = near_dups.near_duplicates(docs_of(spark, list(enumerate(texts)))).collect()
    assert {r["class_id"] for r in got} == {0} and len(got) == 50
    apart = [(i, t) for i, t in enumerate(texts) if i != 25]
    assert {(r["doc_id"] > 25, r["class_id"]) for r in near_dups.near_duplicates(docs_of(spark, apart)).collect()} == {(False, 0), (True, 26)}


def test_near_duplicates_of_short_texts(spark):
    """Eight words and the same with one more: Jaccard 4 of 5, where a bit differs more often than in large sets."""
    rng, texts = random.Random(6), []
    for i in range(200):
        own = words(rng, 8, 10**6)
        texts += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, "more"]))]
    texts += [(1000, "so " * 6), (1001, "so " * 9)]  # one shingle each
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == {i: i & ~1 if i < 1000 else 1000 for i, _ in texts}
    assert near_dups.radius() >= 72


def test_short_sets_are_linked_as_all_pairs_would():
    rng = random.Random(7)
    sets = [frozenset(rng.sample(range(14), rng.randrange(1, 12))) for _ in range(300)]
    up = list(range(300))

    def top(x):
        return x if up[x] == x else top(up[x])

    def united(pairs):
        up[:] = range(300)
        for i, j in pairs:
            up[top(i)] = top(j)
        return [{k for k in range(300) if top(k) == top(i)} for i in range(300)]

    want = united((i, j) for i in range(300) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9)
    assert united(list(near_dups._linked(list(enumerate(sets)), 0.8))) == want


def grown(codes, limit, nearest, wanted, **options):
    graph = HammingGraph(codes, **options)
    pairs = {(q, c): (d, m) for part in graph.grow(limit, nearest, wanted) for q, c, d, m in zip(*(x.tolist() for x in part))}
    return graph, pairs


def test_graph_finds_what_exact_search_finds():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, (5000, 5), dtype=np.uint64)
    order = rng.permutation(5000)
    codes[order[1::2]] = codes[order[::2]]
    codes[order[1::2], 0] ^= rng.integers(0, 1 << 30, 2500, dtype=np.uint64)  # a neighbour for each
    graph, pairs = grown(codes, 40, 3, 0.9)
    truth = exact(codes, codes)
    want = {(q, c) for q, c in zip(*np.nonzero(truth <= 40)) if c < q}
    assert len(want & set(pairs)) >= 0.9 * len(want) and set(pairs) <= want and all(truth[p] == d for p, (d, _) in pairs.items())
    assert graph.size == 5000 and graph.audit[1] > 50 and graph.audit[0] >= 0.85 * graph.audit[1]
    ids, dist = graph.search(codes[:200])
    assert (dist.min(axis=1) == 0).all() and all((truth[q, i[i >= 0]] == d[i >= 0]).all() for q, (i, d) in enumerate(zip(ids, dist)))
    assert all(len(set(i[i >= 0].tolist())) == (i >= 0).sum() for i in ids) and ((graph.to >= -1) & (graph.to < 5000)).all()
    linked = [set(x[x >= 0].tolist()) for x in graph.to]
    assert all(len(x) == (row >= 0).sum() for x, row in zip(linked, graph.to)) and all(k not in x for k, x in enumerate(linked))


def test_graph_says_who_has_more():
    codes = np.zeros((150, 1), np.uint64)
    codes[:, 0] = [(1 << (k % 50)) - 1 for k in range(150)]
    _, pairs = grown(codes, 4, 3, 0.8)
    truth = exact(codes, codes)
    for k in range(64):  # the first batch is compared exactly
        near = [c for c in range(k) if truth[k, c] <= 4]
        own = {c: pairs[k, c] for c in range(k) if (k, c) in pairs}
        assert len(own) == min(3, len(near)) and sorted(d for d, _ in own.values()) == sorted(truth[k, near])[:3] and all(m == (len(near) > 3) for _, m in own.values())
    assert grown(codes[:1], 4, 3, 0.8)[1] == {}


def test_beam_grows_until_the_audit_is_met():
    """Codes that only a wide beam finds: searches that miss what exact search finds double the beam."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, (1500, 1), dtype=np.uint64)

    class Blind(HammingGraph):
        def search(self, queries, beam=None):
            ids, dist = super().search(queries, beam)
            return (ids, dist) if (beam or self.beam) >= 64 else (np.full_like(ids, -1), np.full_like(dist, 32000))

    graph = Blind(codes, beam=16)
    list(graph.grow(24, 3, 0.8))
    assert graph.beam >= 64 and graph.audit[0] >= 0.8 * graph.audit[1] - 2 * graph.audit[1] ** 0.5 - 1


def test_exact_distances():
    rng = np.random.default_rng(9)
    for m, n, words_ in ((1, 1, 1), (40, 2500, 5), (33, 7, 4)):
        a, b = (rng.integers(0, 1 << 63, (k, words_), dtype=np.uint64) for k in (m, n))
        b[0] = ~a[0]  # as far as can be
        assert (exact(a, b) == np.bitwise_count(a[:, None] ^ b[None]).sum(axis=2)).all()
    assert exact(a[:0], b).shape == (0, 7) and exact(a, b[:0]).shape == (33, 0)


def test_graph_is_grown_fast():
    """A code's search and links take less time than comparing it plainly with 1900 codes."""
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, (4000, 5), dtype=np.uint64)

    def seconds(work):
        start = time.process_time()
        work()
        return time.process_time() - start

    plain = min(seconds(lambda: np.bitwise_count(codes[:500, None] ^ codes[None, :1000]).sum(axis=2, dtype=np.int16)) for _ in range(3)) / 500 / 1000
    own = min(seconds(lambda: list(HammingGraph(codes).grow(72, 3, 0.8))) for _ in range(3)) / len(codes)
    assert own < 1900 * plain


def test_many_shards_share_tasks(spark):
    codes = spark.range(4).selectExpr("id AS shard", "id AS node", "0L AS component", *[f"0L AS {c}" for c in near_dups.CODES])
    few, many = (near_dups.grouped(codes, None, F.lit(True), n).rdd.getNumPartitions() for n in (160, 22 << 8))
    assert few >= 2 * 160 and many <= (22 << 8) // 2


def test_bands_and_radius():
    assert near_dups.bands(10) and all(len(b) == near_dups.BAND_BITS for b in near_dups.bands(10))
    wide = near_dups.bands(1 << 34)
    assert len(wide[0]) > near_dups.BAND_BITS and len(wide) > len(near_dups.bands(10))
    for n in (10, 1 << 18, 1 << 34):
        own = near_dups.bands(n)
        met = near_dups.AUDIT_RECALL * near_dups.agreement() ** len(own[0])
        assert 1 - (1 - met) ** len(own) >= near_dups.BAND_RECALL and all(len(set(b.tolist())) == len(b) for b in own)


def united(texts):
    """The classes by comparing all pairs."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, WORD.findall(t)) for i, t in texts)}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if top(i) != top(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


def crowd(rng):
    """401 near copies, and 20 texts that are near to just one of them each."""
    base = words(rng, 300, 10**6)
    texts = []
    for i in range(401):
        own = list(base)
        for k in rng.sample(range(300), 5):
            own[k] = f"c{i}x{k}"
        texts.append((i, own))
    for i in range(20):
        own = list(texts[20 * i][1])
        for k in rng.sample(range(300), 5):
            own[k] = f"d{i}x{k}"
        texts.append((1000 + i, own))
    return [(i, " ".join(w)) for i, w in texts]


@pytest.mark.parametrize("split", [1 << 17, 150])
def test_crowds_hide_no_link(spark, monkeypatch, split):
    monkeypatch.setattr(near_dups, "SPLIT", split)  # the smaller one has several graphs for a shard
    texts = crowd(random.Random(21))
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs_of(spark, texts)).collect()}
    assert got == united(texts)


def test_many_near_copies_are_found(spark):
    """Pairs from 0.8 to 1 among unrelated texts; the recall of the whole search, not of one shard."""
    rng, texts = random.Random(22), []
    for i in range(2500):
        own = words(rng, 120, 10**6)
        other = list(own)
        for k in rng.sample(range(120), rng.choice([0, 1, 1, 2])):
            other[k] = "z"
        texts += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(other))]
    got = {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs_of(spark, texts)).collect()}
    near = []
    for (i, a), (_, b) in zip(texts[::2], texts[1::2]):
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
        near.append(len(x & y) >= 0.8 * len(x | y))
        assert near[-1] or got[i] != got[i + 1]
    assert sum(near) > 1500 and sum(got[2 * k] == got[2 * k + 1] for k, ok in enumerate(near) if ok) >= 0.99 * sum(near)
    audit = near_dups.graph_audit(docs_of(spark, texts[:1200])).selectExpr("sum(codes) AS codes", "sum(found) AS found", "sum(wanted) AS wanted").first()
    assert audit["codes"] >= 1200 and audit["found"] >= 0.8 * audit["wanted"] > 0


def test_rows_of_one_id(spark):
    """Repeated rows, and two texts under one id, one of which is another's copy too."""
    rng = random.Random(23)
    a, b, c = (" ".join(words(rng, 40, 10**6)) for _ in range(3))
    rows = [(9, a), (9, a), (3, b), (3, c), (1, b), (5, None), (5, None), (None, a), (None, a)]
    found = near_dups.near_duplicates(docs_of(spark, rows))
    assert sorted((r["doc_id"], r["class_id"]) for r in found.collect() if r["doc_id"]) == [(1, 1), (3, 1), (3, 1), (5, 5), (5, 5), (9, 9), (9, 9)]
    kept = near_dups.drop_near_duplicates(docs_of(spark, rows).withColumn("node", F.lit("clash")))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(1, b), (5, ""), (9, a), (0, a), (0, a)]) and kept.columns[-1] == "node"
    long = [(0, " ".join(words(rng, 60_000))), (1, "x")]
    long.append((2, long[0][1] + " more words at the end"))
    assert {r["doc_id"]: r["class_id"] for r in near_dups.near_duplicates(docs_of(spark, long)).collect()} == {0: 0, 1: 1, 2: 0}


@pytest.mark.parametrize("blocks", [10_000, 7])
def test_components(spark, blocks):
    rng = random.Random(2)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(500, 500 + k) for k in range(1, 40)] + [(900 + k, 901 + k) for k in range(12)]
    edges = components.checkpoint(spark.createDataFrame(pairs, "u bigint, v bigint").repartition(4))
    got = {r["node"]: r["component"] for r in components.components(edges, blocks).collect()}
    up = {x: x for p in pairs for x in p}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    assert {x: got.get(x, x) for x in up} == {x: top(x) for x in up}


def test_word_hashes_tell_words_apart():
    texts = ["a b\tc", "", "ab c  d\n", "\x1c x", "é ü"]
    h, offsets = shingles.word_hashes([t.encode() for t in texts])
    assert np.diff(offsets).tolist() == [len(WORD.findall(t)) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in WORD.findall(t)})
    assert shingles.sliding_min(np.array([5, 3, 9, 1, 4, 7], np.uint64), 3).tolist() == [3, 1, 1, 1]


def thue_morse(n, a, b):
    return [b if bin(k).count("1") % 2 else a for k in range(n)]


def test_hashes_of_patterned_words_and_texts():
    """Sequences that defeat any polynomial modulo a power of two."""
    one, two = "".join(thue_morse(4096, "a", "b")), "".join(thue_morse(4096, "b", "a"))
    for seed in (1, 2):
        h, _ = shingles.word_hashes([one.encode(), two.encode()], seed)
        assert h[0] != h[1]
    h, _ = shingles.word_hashes([" ".join(thue_morse(4096, "x", "y")).encode(), " ".join(thue_morse(4096, "y", "x")).encode()])
    for n in (5, 16, 50, 64, 2048):
        own = shingles.run_hashes(h, n)
        runs = [tuple(h[k : k + n].tolist()) for k in range(len(h) - n + 1)]
        assert len(own) == len(runs) and len(set(zip(runs, own.tolist()))) == len(set(runs)) == len(set(own.tolist()))
    a, b = ([*near_dups.shingle_sets([" ".join(thue_morse(4096, x, y))])][0][:2] for x, y in ("xy", "yx"))
    assert a != b


def test_substring_of_patterned_words(spark):
    one, two = "".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a"))
    rest = [f"w{k}" for k in range(49)]
    texts = [(1, " ".join([one, *rest])), (2, " ".join([two, *rest])), (3, " ".join([one, *rest, "more"])), (4, " ".join(f"v{k % 5000}" for k in range(30_000)))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_removal(texts) and got[2][1] == 0 and got[3][1] == 50


def brute_removal(texts):
    first = {}
    split = {i: WORD.findall(t or "") for i, t in texts}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), i)
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_removal(spark, corpus):
    df = docs_of(spark, corpus).selectExpr("*", "1 AS n_words", "'x' AS places").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(df).collect()}
    assert got == brute_removal(corpus) and any(v[1] for v in got.values())
    text = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(df, with_text=True).collect()}
    assert all(hashlib.sha256(text[i].encode()).hexdigest() == v[2] for i, v in got.items())


def test_substring_sketch_never_undercounts():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    rows = collections.defaultdict(set)
    for r, own in enumerate(substring.cells(keys[:1000])):
        for c in own.tolist():
            rows[r, c >> substring.RANGE_BITS].add(c & ((1 << substring.RANGE_BITS) - 1))
    packed = []
    for (r, range_), own in rows.items():
        bits = np.zeros(1 << substring.RANGE_BITS, bool)
        bits[list(own)] = True
        packed.append((r, range_, np.packbits(bits).tobytes()))
    found = substring.Sketch(substring.Sketch.pack(packed)).repeated(keys)
    assert found[:1000].all() and found[1000:].mean() < 0.01


def test_substring_of_repeated_rows_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring.remove_repeats(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 60)]
    assert substring.remove_repeats(df.limit(0)).count() == 0


def slow_distance(segment, window):
    row = [0] * (len(window) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, d in enumerate(window, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_banded_distance_is_exact_within_budget():
    rng = random.Random(1)
    for _ in range(30):
        a = "".join(rng.choice("abcd") for _ in range(40))
        b = list(a)
        for _ in range(rng.randrange(7)):
            k = rng.randrange(len(b))
            rng.choice([lambda: b.pop(k), lambda: b.insert(k, "z"), lambda: b.__setitem__(k, "y")])()
        window = "q" * rng.randrange(6) + "".join(b) + "q" * 5
        got = decontam.banded_distance(decontam.codes(a), decontam.codes(window), -12, 40, 8)
        assert got == min(9, slow_distance(a, window))


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, 40))) for k in range(12)] + [(90, None), (91, "w1 w2"), (92, "")]
    texts = []
    for k in range(60):
        own = words(rng, 150)
        if k % 5 == 0:
            copy = items[k % 12][1]
            chars = list(copy)
            for _ in range(k % 10 and 3):
                chars[rng.randrange(len(chars))] = "z"
            own[70:70] = ["".join(chars).upper().replace(" ", "\n")]
        texts.append((k, " ".join(own)))
    texts += [(70, None), (71, ""), (72, items[3][1][: len(items[3][1]) // 2])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontam.find_contamination(docs_of(spark, texts), bench).collect()}
    want = set()
    for i, t in texts:
        for _, item in items:
            own = decontam.normalise(item)
            if len(own) < decontam.MIN_ITEM:
                continue
            parts = max(1, round(len(own) / decontam.SEGMENT))
            for p in range(parts):
                s = own[len(own) * p // parts : len(own) * (p + 1) // parts]
                k = max(0, min(int(decontam.EDIT_RATE * len(s)), (len(s) - decontam.Q) // decontam.Q))
                if slow_distance(s, decontam.normalise(t)) <= k:
                    want.add(i)
    assert {i for i, r in got.items() if r["contaminated"]} == want and len(want) >= 12 and 72 in want
    assert got[0]["item_ids"] == [0] and got[70]["item_ids"] == []
    kept = decontam.drop_contaminated(docs_of(spark, texts), bench)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in texts} - want
    assert decontam.find_contamination(docs_of(spark, texts), bench.limit(0)).filter("contaminated").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    monkeypatch.setattr(decontam, "CHAIN", 2)
    items = [(k, f"benchmark item number {k} has some words of its own {k * 7919}") for k in range(12)] + [(50, " Short  ITEM"), (51, "short item"), (None, "an item of no number but with quite some text")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [(k, f"before benchmark item number {k} has some words of its own {k * 7919} after") for k in range(12)]
    texts += [(90, "short\nitem"), (91, "a short item"), (92, "so an item of no number but with quite some text is here"), (93, ""), (94, None), (95, "long " * 100_000 + texts[3][1]), (3, texts[3][1])]
    docs = docs_of(spark, texts).selectExpr("*", "'clash' AS item_ids", "1 AS contaminated")
    got = collections.defaultdict(list)
    for r in decontam.find_contamination(docs, bench).collect():
        got[r["doc_id"]].append(r)
    assert all(r["contaminated"] and k in r["item_ids"] for k in range(12) for r in got[k]) and len(got[3]) == 2
    assert got[90][0]["item_ids"] == [50, 51] and not got[91][0]["contaminated"] and got[92][0]["contaminated"] and got[92][0]["item_ids"] == []
    assert not got[93][0]["contaminated"] and not got[94][0]["contaminated"] and 3 in got[95][0]["item_ids"]
    kept = decontam.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [91, 93, 94] and kept.columns == docs.columns
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0


def test_nearest_is_exact():
    rng = random.Random(9)
    rows = [(i, i % 2, [(f"t{rng.randrange(30)}", rng.randrange(1, 4)) for _ in range(6)]) for i in range(300)]
    rows = [(i, y, sorted(dict(w).items()) + ([("bad", 1)] if y else [])) for i, y, w in rows]
    parts = toxicity.fit(rows, (0.9, 0.1))
    index = toxicity.BlockMaxIndex(*parts)
    assert "bad" in parts[0]
    for text in ("bad t1 t2", "t3 t4 t4", "bad", "nothing known", "t5 bad t6 t7 t8"):
        v = index.vector(text)
        every = sorted(((-round(sum(v.get(t, 0) * x for t, x in own.items()), 9), d) for d, own in enumerate(parts[2])))
        want = [(-s, d) for s, d in every if s < 0][: toxicity.K]
        got = index.nearest(v)
        assert [d for _, d in got] == [d for _, d in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
    assert index.score("bad t1")[0] > index.score("t1 t2")[0] and 0 <= index.score("")[0] <= 1 and index.score(None)[1] == []


def test_toxicity(spark):
    rng, texts, labels = random.Random(8), [], []
    for i in range(600):
        bad = i % 6 == 0
        own = words(rng, 60, 200) + (rng.sample(["scum", "idiot", "trash"], 2) if bad else [])
        rng.shuffle(own)
        texts.append((i, " ".join(own)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    texts += [(700, None), (701, ""), (702, "scum idiot")]
    labels += [(5, 1, None), (None, 1, 1), (9999, 0, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs_of(spark, texts), table).collect()}
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[i]["predicted"] == int(i % 6 == 0) for i in range(600)]) > 0.97 and got[702]["predicted"] == 1 and got[702]["evidence"]
    none = toxicity.score_documents(docs_of(spark, texts[:3]), table.limit(0)).collect()
    assert [r["score"] for r in none] == [0, 0, 0]
    assert toxicity.score_documents(docs_of(spark, []), table).count() == 0


def test_candidates_of_one_task_take_few_bytes():
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    codes = np.random.default_rng(3).integers(0, 1 << 64, (1, near_dups.WORDS), dtype=np.uint64)
    n, shards = 3000, 12
    batches = []
    for shard in range(shards):
        own = np.repeat(codes, n, axis=0)
        own[:, 0] ^= np.uint64(1) << (np.arange(n) % 60).astype(np.uint64)
        columns = [np.full(n, shard), np.zeros(n, np.int64), np.ones(n, bool), np.arange(n) + shard * n, np.zeros(n, np.int64)]
        names = ["shard", "part", "held", "node", "component", *near_dups.CODES]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.array(own[:, w].copy().view(np.int64)) for w in range(near_dups.WORDS)], names=names))
    run = near_dups.candidates(Rows(), near_dups.radius())
    list(run(iter(batches[:1])))
    tracemalloc.start()
    got = sum(len({(u, v) for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist())}) for b in run(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got >= shards * (n - 1)
    assert most < 24e6  # 28 MB with tuples, of which a task keeps many
