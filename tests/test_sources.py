import gzip
import json
import struct
import sys

import pytest
from pyspark.sql import functions as F
from traces import TWO, S

from tracewarp import Trace


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Timestamp (s), Event Type, Name, Process\n" + "".join(f"{t}, {k}, {n}, {p}\n" for t, k, n, p in TWO))
    trace = Trace.from_csv(spark, str(path))
    rows = trace.events.orderBy("event_id").collect()
    assert [(r["ts_ns"] // S, r["event_type"], r["name"], r["process"]) for r in rows] == TWO
    assert {r["name"]: r["time_exc"] / S for r in trace.flat_profile().collect()}["main()"] == 50


def _interval_file(tmp_path, rows):
    path = tmp_path / "n.csv"
    path.write_text("Start (ns),End (ns),Name,PID,TID,Extra\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return str(path)


def test_intervals_one_thread(spark, tmp_path):
    trace = Trace.from_nsight(spark, _interval_file(tmp_path, [(10, 20, "k1", 7, 7, "x"), (12, 15, "k2", 7, 7, "y")]))
    assert [(r["ts_ns"], r["event_type"], r["name"], r["process"], r["thread"], r["Extra"]) for r in trace.events.orderBy("event_id").collect()] == [
        (10, "Enter", "k1", 0, 0, "x"), (12, "Enter", "k2", 0, 0, "y"), (15, "Leave", "k2", 0, 0, "y"), (20, "Leave", "k1", 0, 0, "x"),
    ]


def test_intervals_of_threads_and_processes(spark, tmp_path):
    rows = [(10, 20, "a", 7, 8, ""), (12, 15, "b", 7, 7, ""), (1, 2, "c", 9, 11, "")]
    got = Trace.from_nsight(spark, _interval_file(tmp_path, rows)).events.filter("event_type = 'Enter'").collect()
    assert {(r["name"], r["process"], r["thread"]) for r in got} == {("a", 0, 1), ("b", 0, 0), ("c", 1, 0)}


STS = """PROJECTIONS_ID
VERSION 7.0
PROCESSORS 2
TOTAL_CHARES 1
TOTAL_EPS 2
CHARE 0 "Main" 1
ENTRY CHARE 0 "Main(CkArgMsg*)" 0 0
ENTRY CHARE 1 "ping()" 0 0
MESSAGE 0 8
EVENT 5 user thing
STAT 2 my stat
TOTAL_PAPI_EVENTS 2
PAPI_EVENT 0 PAPI_A
PAPI_EVENT 1 PAPI_B
END
"""
LOG0 = """PROJECTIONS-RECORD 0
6 0
2 0 1 5 3 1 64 2 77 11 22 33
1 0 1 6 4 1 64 7
21 0 1 6 9 0 64 7 2 0 1
3 0 1 9 3 1 64 8
14 10 0
15 12 0
16 12 0
17 13 0
18 13 0
19 14 0
26 42
28 15 hello there
29 15 18 5 a note
27 1000 18
10 0 19 3 1 64
4 0 20 3 1
5 0 21 3 1
8 22 1 0
9 23 1 0
13 5 24 1 0
100 5 24 1 0 0
98 5 24 1 0 0
99 5 25 1 0 0
32 26 27 3.5 0 2
11 26
12 27
7 30
"""
LOG1 = "6 0\n14 1 1\n15 4 1\n"


@pytest.fixture()
def projections(tmp_path):
    (tmp_path / "app.prj.sts").write_text(STS)
    for i, text in enumerate((LOG0, LOG1)):
        with gzip.open(tmp_path / f"app.prj.{i}.log.gz", "wt") as f:
            f.write(text)
    return tmp_path


def test_projections(spark, projections):
    trace = Trace.from_projections(spark, str(projections))
    rows = trace.events.collect()
    own = [(r["ts_ns"], r["event_type"], r["name"]) for r in sorted(rows, key=lambda r: r["event_id"]) if r["process"] == 0]
    assert (5000, "Enter", "ping()") in own and (9000, "Leave", "ping()") in own and (6000, "Instant", "ping()") in own
    assert (15000, "Enter", "User Supplied Bracketed Note") in own and (18000, "Leave", "User Supplied Bracketed Note") in own and (26000, "Instant", "my stat") in own
    assert (-1, "Instant", "User Supplied") in own and (18000, "Instant", "Memory Usage") in own and own[-1] == (30000, "Leave", "Computation")
    assert own.count((24000, "Instant", "user thing")) == 2 and (24000, "Enter", "User Event Pair") in own
    late = [r for r in rows if r["process"] == 1 and r["name"] == "Computation" and r["event_type"] == "Leave"]
    assert [r["ts_ns"] for r in late] == [4000]
    sent = next(r for r in rows if r["name"] == "ping()" and r["event_type"] == "Instant" and "Destination" in (r["attributes"] or ""))
    assert '"Destination PEs":[0,1]' in sent["attributes"] and '"Send Time":7000' in sent["attributes"]
    assert '"Note":"hello there"' in next(r["attributes"] for r in rows if r["name"] == "User Supplied Note")


def test_projections_attributes(spark, projections):
    """Every field of every code that has attributes."""
    want = {
        ("ping()", "Enter"): {"From PE": 1, "Message Type": 0, "Event ID": 3, "Message Length": 64, "Receive Time": 2, "Entry Type": "Processing", "ID List": [77], "CPU Start Time": 11, "perf counts list": [22, 33]},
        ("Idle", "Enter"): {"From PE": 0}, ("Idle", "Leave"): {"From PE": 0}, ("Pack", "Enter"): {"From PE": 0}, ("Unpack", "Leave"): {"From PE": 0},
        ("User Supplied", "Instant"): {"User Supplied": 42}, ("User Supplied Note", "Instant"): {"Note": "hello there"}, ("Memory Usage", "Instant"): {"Memory Usage": 1000},
        ("User Supplied Bracketed Note", "Enter"): {"Event ID": 5, "Event Name": "user thing", "Note": "a note"},
        ("User Supplied Bracketed Note", "Leave"): {"Event ID": 5, "Event Name": "user thing", "Note": "a note"},
        ("Message Receive", "Instant"): {"From PE": 1, "Message Type": 0, "Event ID": 3, "Message Length": 64},
        ("Enque", "Instant"): {"From PE": 1, "Message Type": 0, "Event ID": 3}, ("Deque", "Instant"): {"From PE": 1, "Message Type": 0, "Event ID": 3},
        ("Interrupt", "Enter"): {"From PE": 0, "Event ID": 1}, ("Interrupt", "Leave"): {"From PE": 0, "Event ID": 1},
        ("User Event Pair", "Enter"): {"From PE": 0, "Event ID": 1, "Nested ID": 0, "User Event Name": "user thing"},
        ("User Event Pair", "Leave"): {"From PE": 0, "Event ID": 1, "Nested ID": 0, "User Event Name": "user thing"},
        ("my stat", "Instant"): {"From PE": 0, "User Time": 27000, "Stat": 3.5, "Event Type": "User Stat"},
        ("ping()", "Leave"): None, ("Trace", "Enter"): None, ("Computation", "Leave"): None,
    }
    rows = [r for r in Trace.from_projections(spark, str(projections)).events.collect() if r["process"] == 0]
    for (name, kind), fields in want.items():
        own = [r["attributes"] for r in rows if (r["name"], r["event_type"]) == (name, kind)]
        assert len(own) == 1 and (own[0] is None if fields is None else json.loads(own[0]) == fields), (name, kind, own)
    sent = [json.loads(r["attributes"]) for r in rows if (r["name"], r["event_type"]) == ("ping()", "Instant")]
    assert {"From PE": 1, "MType": 0, "Message Length": 64, "Event ID": 4, "Send Time": 7000, "Entry Type": "Create"} not in sent[1:] and sent[0]["Entry Type"] == "Create" and sent[1]["Entry Type"] == "Multicast"
    events = [json.loads(r["attributes"]) for r in rows if r["name"] == "user thing"]
    assert events == [{"From PE": 0, "Event ID": 1, "Event Type": "User Event"}, {"From PE": 0, "Event ID": 1, "Nested ID": 0, "Event Type": "User Event Pair"}]


def test_projections_needs_every_log(spark, projections):
    (projections / "app.prj.1.log.gz").unlink()
    with pytest.raises(ValueError):
        Trace.from_projections(spark, str(projections))


class _File:
    """A little-endian file under construction, with strings and patches."""

    def __init__(self, form):
        self.b = bytearray(b"HPCTOOLKIT" + form + bytes([4, 0]))

    def put(self, data):
        while len(self.b) % 8:
            self.b.append(0)
        at = len(self.b)
        self.b += data
        return at

    def text(self, s):
        return self.put(s.encode() + b"\0")


def _databases(folder):
    m = _File(b"meta")
    m.b += bytes(0x80)
    title = m.text("run")
    general = m.put(struct.pack("<QQ", title, title))
    names = [m.text(k) for k in ("SUMMARY", "NODE", "RANK", "THREAD", "CORE")]
    kinds = m.put(struct.pack("<5Q", *names))
    idnames = m.put(struct.pack("<QB", kinds, 5))
    file = m.put(struct.pack("<IIQ", 0, 0, m.text("a.c")))
    foo = m.put(struct.pack("<QQQQII", m.text("foo"), 0, 0, file, 3, 0))
    bar = m.put(struct.pack("<QQQQII", m.text("bar"), 0, 0, 0, 0, 0))

    def ctx(children, size, ctx_id, flags, kind, flex):
        return struct.pack("<QQIBBBBHHI", size, children, ctx_id, flags, 1, kind, len(flex), 0, 0, 0) + struct.pack(f"<{len(flex)}Q", *flex)

    line = ctx(0, 0, 5, 2, 2, [file, 9])
    at_line = m.put(line)
    bar_ctx = ctx(at_line, len(line), 4, 1, 0, [bar])
    at_bar = m.put(bar_ctx)
    loop = ctx(at_bar, len(bar_ctx), 3, 2, 1, [file, 7])
    at_loop = m.put(loop)
    foo_ctx = ctx(at_loop, len(loop), 2, 1, 0, [foo])
    at_foo = m.put(foo_ctx)
    entries = m.put(struct.pack("<QQIHHQ", len(foo_ctx), at_foo, 1, 1, 0, m.text("main thread")) + struct.pack("<QQIHHQ", 0, 0, 6, 2, 0, m.text("application thread")))
    tree = m.put(struct.pack("<QHB", entries, 2, 32))
    for slot, at in ((0x10, general), (0x20, idnames), (0x40, tree)):
        struct.pack_into("<QQ", m.b, slot, 64, at)
    (folder / "meta.db").write_bytes(m.b)
    p = _File(b"prof")
    p.b += bytes(0x20)
    tuples = [p.put(struct.pack("<HHI", 3, 0, 0) + b"".join(struct.pack("<BBHIQ", k, 0, f, v, v) for k, f, v in ((1, 1, 0xAB), (2, 0, r), (3, 0, 0)))) for r in (0, 1)]
    infos = p.put(b"".join(bytes(0x20) + struct.pack("<QII", t, 0, 0) for t in (0, *tuples)))
    head = p.put(struct.pack("<QIB", infos, 3, 0x30))
    struct.pack_into("<QQ", p.b, 0x10, 64, head)
    (folder / "profile.db").write_bytes(p.b)
    t = _File(b"trce")
    t.b += bytes(0x10)
    lines = [[(100, 2), (110, 5), (120, 5), (130, 4), (140, 0), (150, 6)], [(100, 3), (160, 1)]]
    places = [t.put(b"".join(struct.pack("<QI", *x) for x in own)) for own in lines]
    heads = t.put(b"".join(struct.pack("<IIQQ", i + 1, 0, at, at + 12 * len(own)) for i, (at, own) in enumerate(zip(places, lines))))
    head = t.put(struct.pack("<QIBBHQQ", heads, 2, 24, 0, 0, 100, 160))
    struct.pack_into("<QQ", t.b, 0x10, 64, head)
    (folder / "trace.db").write_bytes(t.b)


def test_hpctoolkit(spark, tmp_path):
    _databases(tmp_path)
    trace = Trace.from_hpctoolkit(spark, str(tmp_path))
    rows = trace.events.orderBy("event_id").collect()
    own = [(r["ts_ns"], r["event_type"], r["name"]) for r in rows if r["process"] == 0]
    assert own == [
        (0, "Enter", "main thread"), (0, "Enter", "foo"), (10, "Loop Enter", "loop"), (10, "Enter", "bar"),
        (40, "Leave", "bar"), (40, "Loop Leave", "loop"), (40, "Leave", "foo"), (40, "Leave", "main thread"), (50, "Enter", "application thread"), (60, "Leave", "application thread"),
    ]
    other = [(r["ts_ns"], r["event_type"], r["name"]) for r in rows if r["process"] == 1]
    assert other == [(0, "Enter", "main thread"), (0, "Enter", "foo"), (0, "Loop Enter", "loop"), (60, "Loop Leave", "loop"), (60, "Leave", "foo"), (60, "Leave", "main thread")]
    first = next(r for r in rows if r["name"] == "loop")
    assert (first["source_file"], first["source_line"], first["host"], first["thread"]) == ("a.c", 7, "ab", 0)
    assert {(r["node_id"], r["parent_id"], r["name"]) for r in trace.cct.collect()} == {(1, None, "main thread"), (2, 1, "foo"), (3, 2, "loop"), (4, 3, "bar"), (6, None, "application thread")}


def test_otf2_parts(monkeypatch):
    from tracewarp.sources import otf2

    class Region:
        _ref = 19

        class _Field:
            name = "name"

        _fields = [_Field]
        name = "main"

    known = lambda v: isinstance(v, Region)
    assert otf2.plain({"a": [Region(), {1, 2}], "b": (None, 2.5)}, known) == {"a": ["Region 19", [1, 2]], "b": [None, 2.5]}
    assert otf2.fields(Region(), known) == "main"
    assert otf2.blocks(5, 2) == [(0, 2), (2, 5)] and otf2.blocks(2, 8) == [(0, 1), (1, 2)]
    monkeypatch.setitem(sys.modules, "otf2", None)
    with pytest.raises(ImportError):
        otf2._otf2()


@pytest.mark.parametrize("processes", [1, 3])
def test_otf2(spark, tmp_path, processes):
    """The whole reader over a stand-in for the package."""
    trace = Trace.from_otf2(spark, str(tmp_path), processes)
    rows = trace.events.orderBy("event_id").collect()
    got = [(r["process"], r["thread"], r["ts_ns"], r["event_type"], r["name"], r["CYC"], r["MISS"], r["attributes"]) for r in rows if r["event_type"] != "Instant"]
    assert sorted(got, key=str) == sorted([
        (0, 0, 0, "Enter", "main", 5.0, 6.0, None), (0, 0, 10, "Enter", "MPI_Send", None, 7.0, None), (0, 0, 20, "Leave", "MPI_Send", None, None, None), (0, 0, 100, "Leave", "main", None, None, None),
        (0, 1, 5, "Enter", "main", None, None, None), (0, 1, 6, "Leave", "main", None, None, None), (1, 0, 0, "Enter", "main", None, None, None), (1, 0, 50, "Leave", "main", None, None, None),
    ], key=str)
    sent = [r for r in rows if r["event_type"] == "Instant"]
    assert [(r["name"], r["ts_ns"], json.loads(r["attributes"])) for r in sent] == [("MpiSend", 15, {"receiver": 1, "msg_length": 64})]
    assert [r["ts_ns"] for r in rows] == sorted(r["ts_ns"] for r in rows)
    kinds = {r["definition_type"]: r["n"] for r in trace.definitions.groupBy("definition_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"Region": 2, "Location": 4, "LocationGroup": 2, "MetricMember": 2, "MetricClass": 2, "ClockProperties": 1}
    classes = {r["id"]: json.loads(r["attributes"]) for r in trace.definitions.filter("definition_type = 'MetricClass'").collect()}
    assert classes == {0: ["MetricMember 0", "MetricMember 1"], 1: ["MetricMember 1"]}
    assert {r["name"]: r["time_exc"] for r in trace.flat_profile().collect()} == {"main": (90 + 1 + 50) / 2, "MPI_Send": 10}
