import pytest
from traces import SCHEMA, S, dirty, stack_callers, stack_match, stack_paths, two

from tracewarp import Trace


def test_two_processes(spark):
    rows = {r["event_id"]: r for r in Trace.from_dataframe(two(spark)).profiled.collect()}
    want = {
        0: (18, 0, None, 100, 76), 1: (19, 0, None, 100, 24), 2: (12, 1, 0, 24, 12), 3: (13, 1, 1, 38, 26), 4: (8, 2, 3, 8, 8),
        5: (6, 2, 2, 2, 2), 7: (11, 2, 2, 10, 10), 9: (10, 2, 3, 4, 4), 14: (15, 1, 1, 18, 18), 16: (17, 1, 1, 20, 20),
    }
    got = {i: (r["matching_event"], r["depth"], r["parent"], r["time_inc"] // S, r["time_exc"] // S) for i, r in rows.items() if r["depth"] is not None}
    assert got == want
    assert rows[18]["matching_event"] == 0 and rows[18]["time_inc"] is None


@pytest.mark.parametrize("seed", range(3))
def test_dirty_traces(spark, seed):
    rows = dirty(seed)
    trace = Trace.from_dataframe(spark.createDataFrame(rows, SCHEMA))
    match = stack_match(rows)
    got = {r["event_id"]: r for r in trace.matched.collect()}
    assert len(got) == len(rows)
    assert {i: r["matching_event"] for i, r in got.items() if r["matching_event"] is not None} == match
    assert {i: (r["depth"], r["parent"]) for i, r in got.items() if r["depth"] is not None} == stack_callers(rows, match)
    assert {r["event_id"]: r["path"] for r in trace.paths.collect()} == stack_paths(rows)


def test_children(spark):
    kids = {r["event_id"]: r["children"] for r in Trace.from_dataframe(two(spark)).children().collect()}
    assert kids == {0: [2], 1: [3, 14, 16], 2: [5, 7], 3: [4, 9]}


def test_empty_and_single(spark):
    empty = Trace.from_dataframe(spark.createDataFrame([], SCHEMA))
    assert empty.profiled.count() == 0 and empty.cct.count() == 0
    one = Trace.from_dataframe(spark.createDataFrame([(0, 5, "Enter", "x", 0, 0)], SCHEMA))
    assert [r["time_inc"] for r in one.profiled.collect()] == [None]
    assert [r["time_exc"] for r in one.flat_profile().collect()] == [0.0]


def test_exclusive_sums_to_roots(spark):
    rows = Trace.from_dataframe(two(spark)).profiled.collect()
    assert sum(r["time_exc"] or 0 for r in rows) == sum(r["time_inc"] for r in rows if r["depth"] == 0)


def test_metric_columns(spark):
    df = two(spark).selectExpr("*", "event_id * event_id AS cycles")
    got = {r["event_id"]: r for r in Trace.from_dataframe(df).profiled.collect()}
    assert got[2]["cycles_inc"] == 144 - 4 and got[2]["cycles_exc"] == 140 - (36 - 25) - (121 - 49)


def test_cct(spark):
    trace = Trace.from_dataframe(two(spark))
    nodes = {"->".join(r["path"]): r for r in trace.cct.collect()}
    assert len(nodes) == 9 and nodes["main()"]["calls"] == 2 and nodes["main()"]["parent_id"] is None
    assert nodes["main()->foo()->baz()"]["parent_id"] == nodes["main()->foo()"]["node_id"]
    assert trace.event_nodes().count() == 10


def test_cct_nodes_meet(spark):
    from tracewarp.operators import cct

    trace = Trace.from_dataframe(two(spark))
    ids = {"->".join(r["path"]): r["node_id"] for r in trace.cct.collect()}
    pairs = spark.createDataFrame([(ids["main()->foo()->baz()"], ids["main()->foo()->MPI_Send"]), (ids["main()->foo()"], ids["main()->bar()"])], "a bigint, b bigint")
    assert {(r["a"], r["b"]): r["node_id"] for r in cct.intersections(trace.cct, pairs).collect()} == {
        (ids["main()->foo()->baz()"], ids["main()->foo()->MPI_Send"]): ids["main()->foo()"], (ids["main()->foo()"], ids["main()->bar()"]): ids["main()"],
    }
    above = {r["node_id"]: r["names"] for r in cct.ancestors(trace.cct, 0).collect()}
    assert above[ids["main()->foo()->baz()"]] == ["baz()", "foo()"] and above[ids["main()"]] == []


def test_ids_of_a_source_are_stable(spark, tmp_path):
    """Back-to-back calls with ties in several files: ids equal whatever is read with them, and no call inside another."""
    n = 300_000
    calls = [(k // 2 + k % 2, "Enter" if k % 2 == 0 else "Leave", f"f{k // 2 % 3}", "x" * (k % 50)) for k in range(n)]
    for part in range(4):
        own = calls[part * n // 4 : (part + 1) * n // 4]
        spark.createDataFrame(own, "ts_ns bigint, event_type string, name string, attributes string").coalesce(1).write.parquet(str(tmp_path / f"p{part}"))
    trace = Trace.from_dataframe(spark.read.parquet(*[str(tmp_path / f"p{part}") for part in range(4)]))
    narrow = trace.events.select("ts_ns", "name", "event_type", "event_id").orderBy("event_id").toPandas()
    wide = trace.events.orderBy("event_id").toPandas()
    assert (narrow["event_id"].to_numpy() == wide["event_id"].to_numpy()).all() and (narrow["ts_ns"].to_numpy() == wide["ts_ns"].to_numpy()).all() and narrow["event_id"].is_unique
    assert trace.matched.filter("event_type = 'Enter'").selectExpr("max(depth) AS d", "count(parent) AS p", "count(matching_event) AS m").first() == (0, 0, n // 2)
