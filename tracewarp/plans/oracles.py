"""DuckDB SQL for the queries, in other formulations where there is one.

Matching is an as-of join of Enters to Leaves at equal levels, callers are an as-of
join to the latest Enter one level up, time profiles are a theta join of bins and
calls, and call paths are a recursive query.
"""

from __future__ import annotations

from .queries import PHASES, TYPES
from .testdata import DIRTY_SQL, MESSAGES_SQL, NESTED_SQL, PARTIAL_SQL

NESTED = NESTED_SQL.format(s="", p=8)

MATCH = """
lv{s} AS (SELECT *, sum(CASE event_type WHEN 'Enter' THEN 1 ELSE -1 END) OVER (PARTITION BY process, name ORDER BY event_id)
    + CASE event_type WHEN 'Leave' THEN 1 ELSE 0 END AS lvl FROM ev{s}),
pr{s} AS (SELECT e.event_id AS a, l.event_id AS b, e.process, e.name, e.ts_ns AS ta, l.ts_ns AS tb
  FROM (SELECT * FROM lv{s} WHERE event_type = 'Enter') e ASOF JOIN (SELECT * FROM lv{s} WHERE event_type = 'Leave') l
  ON e.process = l.process AND e.name = l.name AND e.lvl = l.lvl AND e.event_id <= l.event_id)"""
CALLS = """
mk{s} AS (SELECT a AS id, 1 AS w, process FROM pr{s} UNION ALL SELECT b, -1, process FROM pr{s}),
dp{s} AS (SELECT id, (sum(w) OVER (PARTITION BY process ORDER BY id) - 1)::INT AS depth, w FROM mk{s}),
en{s} AS (SELECT pr{s}.*, depth FROM pr{s} JOIN dp{s} ON id = a WHERE w = 1),
ca{s} AS (SELECT c.*, p.a AS parent FROM en{s} c ASOF LEFT JOIN en{s} p ON c.process = p.process AND c.depth - 1 = p.depth AND c.a >= p.a),
ex{s} AS (SELECT c.*, tb - ta AS inc, tb - ta - coalesce(k.t, 0) AS exc FROM ca{s} c
  LEFT JOIN (SELECT parent, sum(tb - ta)::BIGINT AS t FROM ca{s} WHERE parent IS NOT NULL GROUP BY 1) k ON k.parent = c.a)"""
FULL = NESTED + "," + MATCH.format(s="") + "," + CALLS.format(s="")


def _with(*parts: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",".join(parts[:-1]) + " " + parts[-1]


def _pairs(source: str) -> str:
    return _with(
        source, MATCH.format(s=""),
        """SELECT event_id, ev.process, ev.name, event_type, coalesce(x.b, y.a) AS matching_event, coalesce(x.tb, y.ta) AS matching_ts_ns
        FROM ev LEFT JOIN pr x ON x.a = event_id LEFT JOIN pr y ON y.b = event_id""",
    )


def _callers(source: str) -> str:
    return _with(source, MATCH.format(s=""), CALLS.format(s=""), "SELECT a AS event_id, process, name, depth, parent FROM ca")


_COUNTED = "cy AS (SELECT event_id, sum(event_id % 97 + 1) OVER (PARTITION BY process ORDER BY event_id)::BIGINT AS cycles FROM ev)"
_CYCLES = "ci AS (SELECT c.a, c.name, c.parent, (y.cycles - x.cycles)::BIGINT AS inc FROM ca c JOIN cy x ON x.event_id = c.a JOIN cy y ON y.event_id = c.b)"
_SUMS = "su AS (SELECT name, process, sum(exc)::BIGINT AS v FROM ex GROUP BY 1, 2)"


def _imbalance(n: int) -> str:
    return _with(
        FULL, _SUMS, "rk AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v DESC, process) AS r FROM su)",
        f"""SELECT name, round(avg(v) / 1e9, 3) AS mean_s, round(max(v) / nullif(avg(v), 0), 6) AS imbalance,
        string_agg(process::VARCHAR, ',' ORDER BY r) FILTER (WHERE r <= {n}) AS top FROM rk GROUP BY name""",
    )


def _time_profile(n: int) -> str:
    return f"""
lim AS (SELECT min(ts_ns)::DOUBLE AS lo, max(ts_ns)::DOUBLE AS hi, count(DISTINCT process) AS p FROM ev),
bins AS (SELECT i::INT AS bin, lo + i * ((hi - lo) / {n}) AS s, CASE WHEN i = {n - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {n}) END AS e, p FROM lim, range({n}) r(i)),
part AS (SELECT bin, c.name, least(c.tb::DOUBLE, e) - greatest(c.ta::DOUBLE, s) AS o, CASE WHEN q.tb > s AND q.ta < e THEN q.name END AS up
  FROM bins JOIN ca c ON c.tb > s AND c.ta < e LEFT JOIN ca q ON q.a = c.parent),
used AS (SELECT bin, name, sum(x) AS v FROM (SELECT bin, name, o AS x FROM part UNION ALL SELECT bin, up, -o FROM part WHERE up IS NOT NULL) GROUP BY 1, 2),
allv AS (SELECT bin, name, v FROM used UNION ALL
  SELECT b.bin, 'idle_time', any_value((e - s) * p) - coalesce(sum(v), 0) FROM bins b LEFT JOIN used USING (bin) GROUP BY b.bin),
tp AS (SELECT bin, name, CASE WHEN v < 0.01 THEN 0.0 ELSE v END AS v, (e - s) * p AS cap FROM allv JOIN bins USING (bin))"""


_GRID = "rk AS (SELECT DISTINCT process FROM ev), se AS (SELECT * FROM ev WHERE name = 'MpiSend')"


def _matrix(amount: str) -> str:
    return _with(
        MESSAGES_SQL, _GRID,
        f"""SELECT a.process AS sender, b.process::BIGINT AS receiver, coalesce({amount}, 0)::DOUBLE AS volume
        FROM rk a CROSS JOIN rk b LEFT JOIN se ON se.process = a.process AND se.receiver = b.process GROUP BY 1, 2""",
    )


def _by_process(amount: str) -> str:
    return _with(
        MESSAGES_SQL, _GRID,
        f"""SELECT rk.process::BIGINT AS process, coalesce((SELECT {amount} FROM se WHERE se.process = rk.process), 0)::DOUBLE AS sent,
        coalesce((SELECT {amount} FROM se WHERE se.receiver = rk.process), 0)::DOUBLE AS received FROM rk""",
    )


def _bins(values: str, n: int, low: str, high: str, amount: str) -> str:
    return f"""lim AS (SELECT {low} AS lo, {high} AS hi), bins AS (SELECT i::INT AS bin, lo + i * ((hi - lo) / {n}) AS s,
        CASE WHEN i = {n - 1} THEN hi ELSE lo + (i + 1) * ((hi - lo) / {n}) END AS e FROM lim, range({n}) r(i))
        SELECT bin, coalesce({amount}, 0)::DOUBLE AS value FROM bins LEFT JOIN ({values}) v ON v.x >= s AND (v.x < e OR bin = {n - 1} AND v.x <= e) GROUP BY bin"""


_PATHS = """
pt AS (SELECT a AS id, [name] AS path FROM ca WHERE parent IS NULL UNION ALL SELECT c.a, list_append(pt.path, c.name) FROM pt JOIN ca c ON c.parent = pt.id),
nd AS (SELECT path, min(id) AS node_id, count(*) AS calls FROM pt GROUP BY path)"""


def _multirun() -> str:
    parts = []
    for p in (2, 4, 8):
        parts += [NESTED_SQL.format(s=p, p=p), MATCH.format(s=p), CALLS.format(s=p)]
        parts.append(f"fp{p} AS (SELECT '{p}' AS run, name, avg(v) AS value FROM (SELECT name, process, sum(exc) AS v FROM ex{p} GROUP BY 1, 2) GROUP BY name)")
    parts.append("fp AS (SELECT * FROM fp2 UNION ALL SELECT * FROM fp4 UNION ALL SELECT * FROM fp8)")
    parts.append("SELECT run, name, round(coalesce(value, 0) / 1e9, 3) AS value_s FROM (SELECT DISTINCT run FROM fp) CROSS JOIN (SELECT DISTINCT name FROM fp) LEFT JOIN fp USING (run, name)")
    return _with(*parts)


def oracle_sql() -> dict[str, str]:
    match = MATCH.format(s="")
    wide = ", ".join(f"round(coalesce(max(v) FILTER (WHERE name = '{c}'), 0) / 1e9, 0) AS {c}" for c in ("idle_time", "main", *PHASES, *TYPES))
    return {
        "match_events_nested": _pairs(NESTED),
        "match_events_dirty": _pairs(DIRTY_SQL),
        "match_events_partial": _pairs(PARTIAL_SQL),
        "unmatched_events": _with(PARTIAL_SQL, match, "SELECT event_id, process, name, event_type FROM ev WHERE event_id NOT IN (SELECT a FROM pr) AND event_id NOT IN (SELECT b FROM pr)"),
        "caller_callee_nested": _callers(NESTED),
        "caller_callee_dirty": _callers(PARTIAL_SQL),
        "children_lists": _with(FULL, "SELECT parent AS event_id, count(*)::INT AS n, string_agg(a::VARCHAR, ',' ORDER BY a) AS children FROM ca WHERE parent IS NOT NULL GROUP BY parent"),
        "inc_metrics_time": _with(DIRTY_SQL, match, "SELECT a AS event_id, name, tb - ta AS time_inc FROM pr"),
        "inc_metrics_counter": _with(FULL, _COUNTED, _CYCLES, "SELECT a AS event_id, name, inc AS cycles_inc FROM ci"),
        "exc_metrics_time": _with(FULL, "SELECT a AS event_id, name, exc AS time_exc FROM ex"),
        "exc_metrics_counter": _with(FULL, _COUNTED, _CYCLES, "SELECT a AS event_id, name, (inc - coalesce((SELECT sum(inc) FROM ci k WHERE k.parent = ci.a), 0))::BIGINT AS cycles_exc FROM ci"),
        "flat_profile": _with(FULL, _SUMS, "SELECT name, round(avg(v) / 1e9, 3) AS time_exc_s FROM su GROUP BY name"),
        "flat_profile_per_process": _with(FULL, _SUMS, "SELECT name, process, v AS time_exc FROM su"),
        "flat_profile_inc": _with(
            PARTIAL_SQL, match,
            """SELECT name, round(avg(v) / 1e9, 3) AS time_inc_s FROM (SELECT ev.name, ev.process, coalesce(sum(tb - ta), 0) AS v
            FROM ev LEFT JOIN pr ON a = event_id WHERE event_type = 'Enter' GROUP BY 1, 2) GROUP BY name""",
        ),
        "flat_profile_by_depth": _with(FULL, "SELECT depth, name, round(avg(v) / 1e9, 3) AS time_exc_s FROM (SELECT depth, name, process, sum(exc) AS v FROM ex GROUP BY 1, 2, 3) GROUP BY 1, 2"),
        "load_imbalance_top1": _imbalance(1),
        "load_imbalance_top3": _imbalance(3),
        "idle_time": _with(NESTED, match, "SELECT process, coalesce(sum(tb - ta) FILTER (WHERE name IN ('view', 'signup')), 0)::BIGINT AS idle_time FROM pr GROUP BY process"),
        "idle_time_mpi": _with(NESTED, match, "SELECT process, coalesce(sum(tb - ta) FILTER (WHERE name IN ('click', 'error')), 0)::BIGINT AS idle_time FROM pr GROUP BY process"),
        "time_profile_long": _with(FULL, _time_profile(20), "SELECT bin, name, round(v / 1e9, 0) AS value_s FROM tp"),
        "time_profile_wide": _with(FULL, _time_profile(16), f"SELECT bin, {wide} FROM tp GROUP BY bin"),
        "time_profile_normalized": _with(FULL, _time_profile(20), "SELECT bin, name, round(v / cap, 6) AS share FROM tp"),
        "comm_matrix_size": _matrix("sum(msg_length)"),
        "comm_matrix_count": _matrix("count(se.event_id)"),
        "comm_by_process_size": _by_process("sum(msg_length)"),
        "comm_by_process_count": _by_process("count(*)"),
        "message_histogram": _with(MESSAGES_SQL, _GRID, _bins("SELECT msg_length::DOUBLE AS x FROM se", 20, "(SELECT min(msg_length)::DOUBLE FROM se)", "(SELECT max(msg_length)::DOUBLE FROM se)", "count(v.x)")).replace(") lim AS", "), lim AS"),
        "message_histogram_edges": _with(
            MESSAGES_SQL, _GRID,
            """SELECT bin, s AS bin_start, e AS bin_end, count(m.msg_length)::DOUBLE AS value FROM (VALUES (0, 0.0::DOUBLE, 10.0::DOUBLE), (1, 10, 100), (2, 100, 1000), (3, 1000, 5000), (4, 5000, 10000), (5, 10000, 1000000)) b(bin, s, e)
            LEFT JOIN se m ON m.msg_length >= s AND (m.msg_length < e OR bin = 5 AND m.msg_length <= e) GROUP BY 1, 2, 3""",
        ),
        "comm_over_time_send_size": _with(MESSAGES_SQL, _GRID, _bins("SELECT ts_ns::DOUBLE AS x, msg_length AS y FROM se", 25, "(SELECT min(ts_ns)::DOUBLE FROM ev)", "(SELECT max(ts_ns)::DOUBLE FROM ev)", "sum(v.y)")).replace(") lim AS", "), lim AS"),
        "comm_over_time_recv_count": _with(MESSAGES_SQL, _GRID, _bins("SELECT ts_ns::DOUBLE AS x FROM ev WHERE name = 'MpiRecv'", 25, "(SELECT min(ts_ns)::DOUBLE FROM ev)", "(SELECT max(ts_ns)::DOUBLE FROM ev)", "count(v.x)")).replace(") lim AS", "), lim AS"),
        "multirun_analysis": _multirun(),
        "cct_nodes": _with(
            FULL, _PATHS,
            """SELECT n.node_id, u.node_id AS parent_id, (len(n.path) - 1)::INT AS level, n.path[-1] AS name, array_to_string(n.path, '->') AS path, n.calls
            FROM nd n LEFT JOIN nd u ON u.path = n.path[:-2] AND len(n.path) > 1""", recursive=True,
        ),
        "cct_event_links": _with(FULL, _PATHS, "SELECT id AS event_id, node_id FROM pt JOIN nd USING (path)", recursive=True),
        "cct_roots": _with(FULL, _PATHS, "SELECT node_id, path[1] AS name FROM nd WHERE len(path) = 1", recursive=True),
        "cct_lca": _with(
            FULL, _PATHS,
            """SELECT x.node_id AS a, y.node_id AS b, z.node_id FROM nd x, nd y, nd z WHERE len(x.path) = 3 AND len(y.path) = 3 AND y.path[3] = 'view'
            AND z.path = x.path[:CASE WHEN x.path[1] <> y.path[1] THEN 0 WHEN x.path[2] <> y.path[2] THEN 1 WHEN x.path[3] <> y.path[3] THEN 2 ELSE 3 END]""", recursive=True,
        ),
        "cct_ancestors": _with(FULL, _PATHS, "SELECT node_id, array_to_string(list_reverse(path[2:]), '<') AS names FROM nd", recursive=True),
        "chrome_export": _with(NESTED, "SELECT event_id, name, CASE event_type WHEN 'Enter' THEN 'B' ELSE 'E' END AS ph, ts_ns // 1000 AS ts, process AS pid FROM ev"),
        "interval_to_events": """SELECT event_id, event_type AS name, 'Enter' AS event_type, epoch_us(ts) * 1000 AS ts_ns FROM events
            UNION ALL SELECT event_id, event_type, 'Leave', (epoch_us(ts) + round(value * 100)::BIGINT) * 1000 FROM events""",
        "sample_diff_events": """
WITH r AS (SELECT (user_id % 8)::INT AS profile, event_id AS seq, epoch_us(ts) - 1577836800000000 AS ts_ns,
    CASE WHEN event_id % 50 <> 0 THEN ['main', 'phase_' || (epoch_us(ts) // 86400000000 % 7)::VARCHAR, event_type] ELSE [] END AS path FROM events),
b AS (SELECT * FROM r UNION ALL SELECT profile, max(seq) + 1, (SELECT max(ts_ns) FROM r), [] FROM r GROUP BY profile),
o AS (SELECT *, coalesce(lag(path) OVER (PARTITION BY profile ORDER BY seq), []) AS old FROM b),
k AS (SELECT *, CASE WHEN len(path) = 0 OR len(old) = 0 OR path[1] <> old[1] THEN 0 WHEN path[2] <> old[2] THEN 1 WHEN path[3] <> old[3] THEN 2 ELSE 3 END AS keep FROM o WHERE path <> old)
SELECT profile, seq, (len(old) - 1 - level)::INT AS place, ts_ns, 'Leave' AS event_type, old[level + 1] AS name, level::INT AS level FROM k, range(3) t(level) WHERE level >= keep AND level < len(old)
UNION ALL SELECT profile, seq, (greatest(len(old) - keep, 0) + level - keep)::INT, ts_ns, 'Enter', path[level + 1], level::INT FROM k, range(3) t(level) WHERE level >= keep AND level < len(path)""",
        "csv_seconds_to_ns": "SELECT event_id, round(((epoch_us(ts) - 1577836800000000) / 1e6) * 1e9)::BIGINT AS ts_ns FROM events",
        "match_events_without_ids": _with(
            """ev AS (SELECT event_id, (epoch_us(ts) - 1577836800000000) * 1000 AS ts_ns, CASE WHEN event_id % 3 = 1 THEN 'Leave' ELSE 'Enter' END AS event_type,
            event_type AS name, (user_id % 8)::INT AS process FROM events)""",
            match, CALLS.format(s=""),
            """SELECT ts_ns, ev.process, ev.name, event_type, coalesce(x.tb, y.ta) AS matching_ts_ns, x.depth
            FROM ev LEFT JOIN ca x ON x.a = event_id LEFT JOIN pr y ON y.b = event_id""",
        ),
        "projections_decode": """
WITH r AS (SELECT (user_id % 8)::INT AS process, event_id AS seq, (epoch_us(ts) - 1577836800000000) * 1000 AS ts_ns, json_extract(props, '$.k')::BIGINT AS k FROM events),
e AS (SELECT process, seq, 0 AS half, ts_ns, 'Enter' AS event_type, 'entry ' || k AS name, '[5,6]' AS id_list, '8' AS cpu, '[11]' AS perf, NULL AS event_name, NULL AS user_time, NULL AS stat FROM r WHERE k % 5 = 0
  UNION ALL SELECT process, seq, 0, ts_ns, 'Leave', 'entry ' || k, NULL, NULL, NULL, NULL, NULL, NULL FROM r WHERE k % 5 = 1
  UNION ALL SELECT process, seq, h, ts_ns, ['Enter', 'Leave'][h + 1], 'User Supplied Bracketed Note', NULL, NULL, NULL, 'event ' || k, NULL, NULL FROM r, range(2) t(h) WHERE k % 5 = 2
  UNION ALL SELECT process, seq, 0, ts_ns, 'Instant', 'stat ' || k, NULL, NULL, NULL, NULL, (k * 1000)::VARCHAR, '2.5' FROM r WHERE k % 5 = 3)
SELECT process, ts_ns, event_type, name, id_list, cpu, perf, event_name, user_time, stat FROM e
UNION ALL SELECT process, max(ts_ns), 'Leave', 'Computation', NULL, NULL, NULL, NULL, NULL, NULL FROM e GROUP BY process""",
        "filter_process": _with(FULL, _SUMS, "SELECT name, process, v AS time_exc FROM su WHERE process IN (1, 3)"),
    }
