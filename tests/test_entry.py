"""The registry, without the training-data subpackage too."""

import os
import subprocess
import sys

from conftest import ROOT


def test_every_query_but_one_has_sql():
    import __spark_entry__ as e

    plain = {n for n in e.queries() if not n.startswith("op") and n != "pipeline"}
    assert plain - set(e.oracle_sql()) == {"detect_pattern"} and len(plain) > 40
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_imports_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name in ("tracewarp", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", os.path.join(ROOT, name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "tracewarp" / "llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[1] == "False", out.stderr


def test_sql_and_spark_agree_on_the_smallest_tables(spark):
    import duckdb

    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    for name in ("flat_profile", "match_events_partial", "sample_diff_events", "time_profile_long", "comm_matrix_size"):
        df = e.queries()[name](spark, sf)
        cols = sorted(df.columns)
        want = con.sql(e.oracle_sql()[name])
        assert cols == sorted(want.columns)
        key = lambda r: repr([float(x) if isinstance(x, (int, float)) else x for x in r])
        assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want.project(", ".join(f'"{c}"' for c in cols)).fetchall())), name
