"""Two events of one process at the same microsecond: queries and their SQL agree where ids are shared."""

from datetime import datetime, timedelta

import pytest

QUERIES = [
    "match_events_nested", "inc_metrics_counter", "exc_metrics_counter", "cct_nodes", "cct_event_links", "cct_roots", "cct_ancestors", "cct_lca", "caller_callee_nested", "exc_metrics_time",
]


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """Process 1 has a view and a click at once, on its first day."""
    path, start = tmp_path_factory.mktemp("tied"), datetime(2024, 1, 1, 1)
    kinds = ["error", "signup", "purchase", "view", "click", "signup", "view", "error", "view", "click"]
    minutes = [0, 1, 2, 3, 3, 4, 5, 1440, 1441, 1442]
    rows = [(8 * i + p, start + timedelta(minutes=m, microseconds=7 * p), 8 * i + p, k, 1.0 + i, '{"k": 3}') for p in (0, 1) for i, (m, k) in enumerate(zip(minutes, kinds)) if p or i != 4]
    frame = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    frame.coalesce(1).write.parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize("name", QUERIES)
def test_shared_ids(spark, tied, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE TABLE events AS SELECT * FROM '{tied}/events.parquet/*.parquet' ORDER BY event_id")
    df = e.queries()[name](spark, tied)
    cols = sorted(df.columns)
    want = con.sql(e.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in cols)).fetchall()
    key = lambda r: repr([float(x) if isinstance(x, (int, float)) else x for x in r])
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want))
