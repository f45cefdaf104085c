"""Matching calls of a stream of events.

An extension for live traces: each (process, thread) keeps the calls that are open,
and a Leave closes the nearest of its name. A location's events must arrive in
order; the state is the open calls alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "process int, thread int, name string, enter_event long, leave_event long, time_inc long"
STATE = "ids array<bigint>, times array<bigint>, names array<string>"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ids, times, names = (list(x) for x in state.get) if state.exists else ([], [], [])
    out = []
    for pdf in batches:
        for e in pdf.sort_values("event_id").itertuples():
            if e.event_type == "Enter":
                ids.append(e.event_id), times.append(e.ts_ns), names.append(e.name)
            elif e.name in names:
                k = len(names) - 1 - names[::-1].index(e.name)
                out.append((*key, e.name, ids[k], e.event_id, e.ts_ns - times[k]))
                del ids[k], times[k], names[k]
    state.update((ids, times, names))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def match_stream(events: DataFrame) -> DataFrame:
    """A row for each call that ended, from a streaming event table."""
    calls = events.filter("event_type IN ('Enter', 'Leave') AND name IS NOT NULL")
    return calls.groupBy("process", "thread").applyInPandasWithState(_step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
