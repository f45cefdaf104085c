import time

import numpy as np
import pytest

from tracewarp.operators import pattern


def _series(spark, values):
    rows = [(0, 0, "Enter", "loop", 0, None), *((k + 1, k + 1, "Enter", "x", 0, float(v)) for k, v in enumerate(values)), (len(values) + 1, len(values) + 1, "Leave", "loop", 0, None)]
    return spark.createDataFrame(rows, "event_id bigint, ts_ns bigint, event_type string, name string, process int, time_exc double")


def _plain(values, window, most):
    """Top motif and its nearest matches, by all distances."""
    n, zone = len(values) - window + 1, max(1, -(-window // 4))
    views = np.lib.stride_tricks.sliding_window_view(values, window)
    std, flat = views.std(axis=1), views.std(axis=1) < 1e-12
    z = np.where(flat[:, None], 0, (views - views.mean(axis=1)[:, None]) / np.where(flat, 1, std)[:, None])
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2))
    d[flat[:, None] ^ flat[None, :]] = np.sqrt(window)
    d[d < 1e-5] = 0
    far = np.where(np.abs(np.arange(n)[:, None] - np.arange(n)) <= zone, np.inf, d)
    place = int(far.min(axis=1).argmin()) if np.isfinite(far).any() else 0
    own, out = d[place].copy(), []
    while len(out) < most and np.isfinite(own).any():
        i = int(own.argmin())
        out.append((len(out), i, round(float(own[i]), 6)))
        own[max(0, i - zone) : i + zone + 1] = np.inf
    return out


@pytest.mark.parametrize("kind", ["noise", "flats", "repeats", "short"])
def test_blocks_find_what_all_pairs_find(spark, monkeypatch, kind):
    monkeypatch.setattr(pattern, "BLOCK", 64)
    monkeypatch.setattr(pattern, "SIDE", 20)
    rng = np.random.default_rng(3)
    values = {"noise": rng.exponential(size=450), "flats": np.repeat(rng.integers(0, 3, 60), 7), "repeats": np.tile(rng.random(50), 8), "short": rng.random(9)}[kind].astype(float)
    got = pattern.detect_pattern(_series(spark, values), "loop", 5, 8).collect()
    want = _plain(values, 8, 5)
    assert sorted({(r["occurrence"], r["start_place"], round(r["distance"], 6)) for r in got}) == want
    assert sorted((r["occurrence"], r["event_id"]) for r in got) == sorted((k, i + 1 + x) for k, i, _ in want for x in range(8))


def test_a_long_series_ends_soon(spark):
    values = np.random.default_rng(5).exponential(size=40_000)
    values[31_000:31_012] = values[7_000:7_012] * 3 + 1
    frame = _series(spark, values)
    start = time.time()
    got = pattern.detect_pattern(frame, "loop", 2, 12).collect()
    assert {(r["occurrence"], r["start_place"]) for r in got} == {(0, 7_000), (1, 31_000)}
    assert time.time() - start < 60
    assert pattern.detect_pattern(frame.filter("event_type = 'Leave'"), "loop", 2, 12).collect() == []
