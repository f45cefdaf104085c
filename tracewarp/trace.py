"""The trace: an event table, its definitions, and the questions one can ask."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .operators import binning, cct, comm, pattern, profile, structure
from .schema import metric_columns, normalise
from .sinks.chrome import to_chrome


class Trace:
    """Wraps immutable DataFrames; derived tables are lazy and made once.

    ``events`` is public: filter it, join it or register it as a view. ``persist()``
    keeps the matched table where several questions follow.
    """

    def __init__(self, definitions: DataFrame | None, events: DataFrame, cct: DataFrame | None = None):
        self.definitions, self._cct, self._has_thread = definitions, cct, "thread" in events.columns
        self.events = normalise(events)
        self.numeric_cols = metric_columns(self.events)

    # -- sources -----------------------------------------------------------

    @staticmethod
    def from_dataframe(events: DataFrame, definitions: DataFrame | None = None) -> Trace:
        return Trace(definitions, events)

    @staticmethod
    def from_csv(spark: SparkSession, filename: str) -> Trace:
        from .sources.csv import read_csv

        return Trace(None, read_csv(spark, filename))

    @staticmethod
    def from_nsight(spark: SparkSession, filename: str, create_cct: bool = False) -> Trace:
        from .sources.nsight import read_nsight

        return Trace(None, read_nsight(spark, filename))._with_cct(create_cct)

    @staticmethod
    def from_projections(spark: SparkSession, dirname: str, num_processes: int | None = None, create_cct: bool = False) -> Trace:
        from .sources.projections import read_projections

        return Trace(None, read_projections(spark, dirname, num_processes))._with_cct(create_cct)

    @staticmethod
    def from_hpctoolkit(spark: SparkSession, dirname: str) -> Trace:
        from .sources.hpctoolkit import read_hpctoolkit

        events, tree = read_hpctoolkit(spark, dirname)
        return Trace(None, events, tree)

    @staticmethod
    def from_otf2(spark: SparkSession, dirname: str, num_processes: int | None = None, create_cct: bool = False) -> Trace:
        from .sources.otf2 import read_otf2

        definitions, events = read_otf2(spark, dirname, num_processes)
        return Trace(definitions, events)._with_cct(create_cct)

    # -- structure ---------------------------------------------------------

    @cached_property
    def matched(self) -> DataFrame:
        """Events with partners, inclusive metrics, depth and caller."""
        return structure.match_callers(structure.match_events(self.events, self.numeric_cols))

    @cached_property
    def profiled(self) -> DataFrame:
        """``matched`` with exclusive metrics."""
        return structure.exclusive(self.matched, self.numeric_cols)

    def persist(self) -> Trace:
        self.matched.persist()
        return self

    def unpersist(self) -> Trace:
        self.matched.unpersist()
        return self

    def match_events(self) -> DataFrame:
        return structure.match_events(self.events, self.numeric_cols)

    def match_caller_callee(self) -> DataFrame:
        return self.matched

    def children(self) -> DataFrame:
        return structure.children(self.matched)

    def calc_inc_metrics(self, columns: list[str] | None = None) -> DataFrame:
        return structure.match_events(self.events, self.numeric_cols if columns is None else [c for c in columns if c in self.numeric_cols])

    def calc_exc_metrics(self, columns: list[str] | None = None) -> DataFrame:
        return self.profiled if columns is None else structure.exclusive(self.matched, [c for c in columns if c in self.numeric_cols])

    @cached_property
    def paths(self) -> DataFrame:
        return cct.call_paths(self.events)

    @property
    def cct(self) -> DataFrame:
        if self._cct is None:
            self._cct = cct.nodes(self.paths)
        return self._cct

    def event_nodes(self) -> DataFrame:
        """(event_id, node_id) of every Enter."""
        return cct.event_links(self.paths, self.cct)

    def _with_cct(self, create: bool) -> Trace:
        if create:
            self._cct = cct.nodes(self.paths)
        return self

    # -- questions ---------------------------------------------------------

    def flat_profile(self, metrics="time.exc", groupby_column="name", per_process: bool = False) -> DataFrame:
        return profile.flat_profile(self.profiled, metrics, groupby_column, per_process)

    def load_imbalance(self, metric: str = "time.exc", num_processes: int = 1) -> DataFrame:
        return profile.load_imbalance(self.profiled, metric, num_processes)

    def idle_time(self, idle_functions=profile.IDLE, mpi_events: bool = False) -> DataFrame:
        return profile.idle_time(structure.match_events(self.events), idle_functions, mpi_events)

    def time_profile(self, num_bins: int = 50, normalized: bool = False) -> DataFrame:
        return binning.time_profile(self.matched, num_bins, normalized, self.events)

    def time_profile_wide(self, num_bins: int = 50, normalized: bool = False) -> DataFrame:
        return binning.time_profile_wide(self.matched, num_bins, normalized, events=self.events)

    def comm_matrix(self, output: str = "size", dense: bool = True) -> DataFrame:
        return comm.comm_matrix(self.events, output, dense)

    def comm_by_process(self, output: str = "size") -> DataFrame:
        return comm.comm_by_process(self.events, output)

    def message_histogram(self, bins=20, **options) -> DataFrame:
        return comm.message_histogram(self.events, bins, **options)

    def comm_over_time(self, output: str = "size", message_type: str = "send", bins=50, **options) -> DataFrame:
        return comm.comm_over_time(self.events, output, message_type, bins, **options)

    def detect_pattern(self, start_event: str, iterations: int | None = None, window_size: int | None = None, process: int = 0, metric: str = "time.exc") -> DataFrame:
        return pattern.detect_pattern(self.profiled, start_event, iterations, window_size, process, metric)

    @staticmethod
    def multirun_analysis(traces: dict[str, Trace] | list[Trace], metric: str = "time.exc", groupby_column: str = "name") -> DataFrame:
        """One row a run, named by its number of processes where the traces come in a list."""
        if not isinstance(traces, dict):
            traces = {str(t.events.select("process").distinct().count()): t for t in traces}
        return profile.multirun_table({k: t.profiled for k, t in traces.items()}, metric, groupby_column)

    # -- sinks -------------------------------------------------------------

    def to_chrome(self, filename: str | None = None) -> str | None:
        return to_chrome(self.events, filename, self._has_thread)
