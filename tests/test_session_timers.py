"""A key of many sessions has one timer at a time, and tells them as they end."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Row

from newsloom.streaming import state


class Listed:
    def __init__(self):
        self.held = []

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def clear(self):
        self.held = []


class Handle:
    def __init__(self):
        self.open, self.timers = Listed(), set()
        self.calls = 0

    def getListState(self, name, schema):  # noqa: N802
        return self.open

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)
        self.calls += 1


def expire(sessions, handle, passed):
    """What Spark does at a watermark, in milliseconds: all timers that it has passed run, also those set meanwhile."""
    told, clock = [], SimpleNamespace(getCurrentWatermarkInMs=lambda: passed)
    while due := [t for t in handle.timers if t <= passed]:
        handle.timers.remove(min(due))
        told += sessions.handleExpiredTimer(("a",), clock, None)
    return [(r["cluster_start"], r["members"]) for r in told]


def test_one_timer_for_many_sessions():
    gap, sessions, handle = 1_000_000, state.EventSessions(["k"], 1_000_000), Handle()
    sessions.init(handle)
    starts = [n * 10 * gap for n in range(50)]
    rows = [Row(_at=s + d, _id=i, _source="x") for i, s in enumerate(starts) for d in (0, 5)]
    assert list(sessions.handleInputRows(("a",), iter(rows), None)) == []
    assert handle.calls == 1
    # The first session grows after its timer is set; that timer then finds none over and sets the next.
    list(sessions.handleInputRows(("a",), iter([Row(_at=gap, _id=99, _source="x")]), None))
    assert expire(sessions, handle, 1001) == [] and len(handle.timers) == 1
    assert expire(sessions, handle, 2000) == [(0, 3)] and len(handle.timers) == 1
    assert expire(sessions, handle, starts[20] // 1000 + 2000) == [(s, 2) for s in starts[1:21]]
    assert expire(sessions, handle, 10**9) == [(s, 2) for s in starts[21:]]
    assert not handle.timers and not handle.open.held
