"""Traces that tests share, and a plain stack to hold windows against."""

from __future__ import annotations

import random

SCHEMA = "event_id bigint, ts_ns bigint, event_type string, name string, process int, thread int"
#: (second, type, name, process): two processes, ties in time.
TWO = [
    (0, "Enter", "main()", 0), (0, "Enter", "main()", 1), (1, "Enter", "foo()", 0), (1, "Enter", "bar()", 1), (2, "Enter", "Idle", 1),
    (3, "Enter", "MPI_Send", 0), (5, "Leave", "MPI_Send", 0), (8, "Enter", "baz()", 0), (10, "Leave", "Idle", 1), (10, "Enter", "MPI_Recv", 1),
    (14, "Leave", "MPI_Recv", 1), (18, "Leave", "baz()", 0), (25, "Leave", "foo()", 0), (39, "Leave", "bar()", 1), (39, "Enter", "Idle", 1),
    (57, "Leave", "Idle", 1), (57, "Enter", "grault()", 1), (77, "Leave", "grault()", 1), (100, "Leave", "main()", 0), (100, "Leave", "main()", 1),
]
S = 1_000_000_000


def two(spark):
    return spark.createDataFrame([(i, t * S, k, n, p, 0) for i, (t, k, n, p) in enumerate(TWO)], SCHEMA)


def dirty(seed: int, n: int = 300) -> list[tuple]:
    """Unmatched and interleaved calls, ties, unnamed and other events, two processes of two threads."""
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 5])
        kind = rng.choices(["Enter", "Leave", "Instant"], [10, 9, 1])[0]
        out.append((i, t, kind, rng.choice(["a", "b", "c", None] if rng.random() < 0.1 else ["a", "b", "c"]), rng.randrange(2), rng.randrange(2)))
    return out


def stack_match(rows: list[tuple]) -> dict[int, int]:
    open_: dict[tuple, list] = {}
    found: dict[int, int] = {}
    for event_id, _, kind, name, process, thread in rows:
        own = open_.setdefault((process, thread), [])
        if kind == "Enter" and name is not None:
            own.append((event_id, name))
        elif kind == "Leave" and name is not None:
            for k in range(len(own) - 1, -1, -1):
                if own[k][1] == name:
                    found[event_id], found[own[k][0]] = own[k][0], event_id
                    del own[k]
                    break
    return found


def stack_callers(rows: list[tuple], match: dict[int, int]) -> dict[int, tuple]:
    open_: dict[tuple, list] = {}
    out = {}
    for event_id, _, kind, _, process, thread in rows:
        if event_id not in match:
            continue
        own = open_.setdefault((process, thread), [])
        if kind == "Enter":
            out[event_id] = (len(own), own[-1] if own else None)
            own.append(event_id)
        else:
            own.pop()
    return out


def stack_paths(rows: list[tuple]) -> dict[int, list[str]]:
    open_: dict[tuple, list] = {}
    out = {}
    for event_id, _, kind, name, process, thread in rows:
        own = open_.setdefault((process, thread), [])
        if kind == "Enter" and name is not None:
            own.append(name)
            out[event_id] = list(own)
        elif kind == "Leave" and name in own:
            del own[len(own) - 1 - own[::-1].index(name)]
    return out
