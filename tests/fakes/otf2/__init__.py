"""A stand-in for the archive package: one small trace, whatever the path."""

import enum
from contextlib import contextmanager


class LocationType(enum.Enum):
    CPU_THREAD = 1
    GPU = 2


class _Field:
    def __init__(self, name):
        self.name = name


class _Definition:
    def __init__(self, ref, **values):
        self._ref, self._fields = ref, [_Field(n) for n in values]
        vars(self).update(values)


Region, Location, LocationGroup, MetricMember, MetricClass, ClockProperties = (type(n, (_Definition,), {}) for n in ("Region", "Location", "LocationGroup", "MetricMember", "MetricClass", "ClockProperties"))


class _Event:
    def __init__(self, time, **values):
        self.time = time
        vars(self).update(values)


Enter, Leave, Metric, MpiSend = (type(n, (_Event,), {}) for n in ("Enter", "Leave", "Metric", "MpiSend"))


class _Trace:
    def __init__(self):
        groups = [LocationGroup(r, name=f"rank {r}") for r in (0, 1)]
        locations = [Location(i, name=f"thread {i}", group=groups[g], type=kind) for i, g, kind in ((10, 0, LocationType.CPU_THREAD), (11, 0, LocationType.CPU_THREAD), (12, 0, LocationType.GPU), (20, 1, LocationType.CPU_THREAD))]
        main, send = Region(0, name="main"), Region(1, name="MPI_Send")
        cycles, misses = MetricMember(0, name="CYC"), MetricMember(1, name="MISS")
        one, two = MetricClass(0, members=[cycles, misses]), MetricClass(1, members=[misses])

        class Definitions:
            pass

        d = self.definitions = Definitions()
        d.locations, d.regions, d.location_groups = locations, [main, send], groups
        d.metric_classes, d.metric_members = [one, two], [cycles, misses]
        d.clock_properties = ClockProperties(0, timer_resolution=1_000_000_000, global_offset=100)
        self._of = {
            10: [Metric(100, metric=one, values=[5, 6]), Enter(100, region=main), Metric(110, metric=two, values=[7]), Enter(110, region=send), MpiSend(115, receiver=1, msg_length=64), Leave(120, region=send), Leave(200, region=main)],
            11: [Enter(105, region=main), Leave(106, region=main)],
            12: [Enter(101, region=main)],
            20: [Enter(100, region=main), Leave(150, region=main)],
        }

    def events(self, locations):
        own = [(loc, e) for loc in locations for e in self._of[loc._ref]]
        return iter(sorted(own, key=lambda x: x[1].time))


class reader:  # noqa: N801
    @staticmethod
    @contextmanager
    def open(path):
        yield _Trace()
