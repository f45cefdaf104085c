import json

import pytest
from traces import S, two

from tracewarp import Trace, get_option, reset_option, set_option


@pytest.fixture(scope="module")
def trace(spark):
    return Trace.from_dataframe(two(spark))


def test_flat_profile(trace):
    got = {r["name"]: r["time_exc"] / S for r in trace.flat_profile().collect()}
    assert got == {"main()": 50, "foo()": 12, "bar()": 26, "Idle": 26, "MPI_Send": 2, "baz()": 10, "MPI_Recv": 4, "grault()": 20}
    per = {(r["name"], r["process"]): r["time_exc"] / S for r in trace.flat_profile(per_process=True).collect()}
    assert per["main()", 0] == 76 and per["main()", 1] == 24
    assert {r["depth"] for r in trace.flat_profile("time.inc", ["depth", "name"]).collect()} == {0, 1, 2}


def test_load_imbalance(trace):
    rows = trace.load_imbalance(num_processes=5).collect()
    assert rows[0]["name"] == "main()" and rows[0]["mean"] / S == 50 and rows[0]["imbalance"] == 1.52 and rows[0]["top_processes"] == [0, 1]
    assert all(r["imbalance"] == 1 for r in rows[1:])


def test_idle_time(trace):
    assert {r["process"]: r["idle_time"] // S for r in trace.idle_time().collect()} == {0: 0, 1: 26}
    assert {r["process"]: r["idle_time"] // S for r in trace.idle_time(mpi_events=True).collect()} == {0: 0, 1: 30}


def test_time_profile(trace):
    rows = trace.time_profile_wide(4).collect()
    names = ["main()", "foo()", "bar()", "Idle", "MPI_Send", "MPI_Recv", "baz()", "grault()"]
    want = [[2, 12, 12, 8, 2, 4, 10, 0], [25, 0, 14, 11, 0, 0, 0, 0], [25, 0, 0, 7, 0, 0, 0, 18], [48, 0, 0, 0, 0, 0, 0, 2]]
    assert [[r[n] / S for n in names] for r in rows] == want and all(r["idle_time"] == 0 for r in rows)
    assert all(abs(sum(x["value"] for x in trace.time_profile(4, True).collect() if x["bin"] == b) - 1) < 1e-9 for b in range(4))


def test_time_profile_bins_add_up(trace):
    whole = {r["name"]: r["time_exc"] for r in trace.flat_profile(per_process=True).groupBy("name").sum("time_exc").withColumnRenamed("sum(time_exc)", "time_exc").collect()}
    got = {}
    for r in trace.time_profile(37).collect():
        got[r["name"]] = got.get(r["name"], 0) + r["value"]
    assert all(abs(got[n] - v) < 100 for n, v in whole.items())


def test_messages(spark):
    rows = []
    for k in range(8):
        for p in (0, 1):
            rows.append((2 * k + p, 1000 + 10 * k + p, "Instant", "MpiSend", p, json.dumps({"receiver": 1 - p, "msg_length": 8 * 2 ** (11 + k)})))
    rows += [(100, 0, "Enter", "main", 0, None), (101, 1100, "Leave", "main", 0, None), (102, 1050, "Instant", "MpiRecv", 1, None)]
    trace = Trace.from_dataframe(spark.createDataFrame(rows, "event_id bigint, ts_ns bigint, event_type string, name string, process int, attributes string"))
    total = sum(8 * 2 ** (11 + k) for k in range(8))
    assert {(r["sender"], r["receiver"]): r["volume"] for r in trace.comm_matrix().collect()} == {(0, 0): 0, (1, 1): 0, (0, 1): total, (1, 0): total}
    assert {(r["sender"], r["receiver"]): r["volume"] for r in trace.comm_matrix("count").collect()}[0, 1] == 8
    assert {(r["process"], r["sent"], r["received"]) for r in trace.comm_by_process("count").collect()} == {(0, 8, 8), (1, 8, 8)}
    over = [r["value"] for r in trace.comm_over_time(bins=5).orderBy("bin").collect()]
    assert over == [0, 0, 0, 0, 2 * total]
    assert sum(r["value"] for r in trace.comm_over_time("count", "receive", 5).collect()) == 1
    sizes = [r["value"] for r in trace.message_histogram(4).orderBy("bin").collect()]
    assert sum(sizes) == 16 and sizes[-1] == 2
    assert abs(sum(r["value"] * (r["bin_end"] - r["bin_start"]) for r in trace.message_histogram(4, density=True).collect()) - 1) < 1e-9
    with pytest.raises(ValueError):
        trace.comm_matrix("bytes")
    with pytest.raises(ValueError):
        Trace.from_dataframe(two(spark)).comm_matrix()


def test_histogram_matches_numpy(spark):
    import numpy as np

    from tracewarp.operators.binning import histogram

    rng = np.random.default_rng(1)
    for values in (rng.integers(0, 50, 200).tolist(), [3, 3, 3], (np.arange(31) / 10).tolist()):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for bins in (1, 7, 10, [0, 1, 2.5, 9]):
            want, edges = np.histogram(values, bins)
            got = histogram(df, "x", bins).orderBy("bin").collect()
            assert [r["value"] for r in got] == want.tolist() and np.allclose([r["bin_start"] for r in got], edges[:-1])
    assert [r["value"] for r in histogram(df.filter("x > 1e9"), "x", 2).collect()] == [0, 0]


def test_multirun(spark, trace):
    other = Trace.from_dataframe(two(spark).filter("process = 0"))
    rows = Trace.multirun_analysis([trace, other]).collect()
    assert [r["run"] for r in rows] == ["1", "2"] and rows[0].asDict()["main()"] / S == 76 and rows[0]["bar()"] == 0


def test_detect_pattern(spark):
    rows, t, i = [], 0, 0
    for _ in range(6):
        for name, d in (("loop", 0), ("a", 3), ("b", 9), ("c", 5)):
            if name == "loop":
                rows.append((i, t, "Enter", "loop", 0))
                i += 1
                continue
            rows += [(i, t, "Enter", name, 0), (i + 1, t + d, "Leave", name, 0)]
            i, t = i + 2, t + d
        rows.append((i, t, "Leave", "loop", 0))
        i += 1
    trace = Trace.from_dataframe(spark.createDataFrame(rows, "event_id bigint, ts_ns bigint, event_type string, name string, process int"))
    got = trace.detect_pattern("loop").collect()
    assert len({r["occurrence"] for r in got}) >= 4 and max(r["distance"] for r in got if r["occurrence"] < 3) < 1e-3


def test_chrome(trace, tmp_path):
    records = json.loads(trace.to_chrome())
    assert records[0] == {"name": "main()", "ph": "B", "ts": 0, "pid": 0, "tid": 0} and len(records) == 20 and records[2]["ts"] == 1_000_000
    trace.to_chrome(str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text()) == records


def test_options():
    assert get_option("log_level") == "INFO"
    set_option("log_level", "DEBUG")
    set_option("notebook_url", "https://example.com/x")
    assert get_option("log_level") == "DEBUG"
    reset_option("all")
    assert get_option("log_level") == "INFO"
    for call in (lambda: set_option("log_level", 3), lambda: set_option("notebook_url", 5), lambda: get_option("x"), lambda: reset_option("")):
        with pytest.raises(ValueError):
            call()
