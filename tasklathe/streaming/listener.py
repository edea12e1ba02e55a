"""Progress of streaming queries as metrics, and their states as a subscription's."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener

from tasklathe.config import Properties
from tasklathe.operators.metrics import SECTIONS

INITIALIZING, RUNNING, REBALANCING, SHUTTING_DOWN, TERMINATED = "INITIALIZING", "RUNNING", "REBALANCING", "SHUTTING_DOWN", "TERMINATED"

# The states that may follow each state of a subscription.
FOLLOWS = {
    None: (INITIALIZING,),
    INITIALIZING: (RUNNING, SHUTTING_DOWN, TERMINATED),
    RUNNING: (REBALANCING, SHUTTING_DOWN, TERMINATED),
    REBALANCING: (RUNNING, SHUTTING_DOWN, TERMINATED),
    SHUTTING_DOWN: (TERMINATED,),
    TERMINATED: (),
}


class States:
    """The state of a subscription; tells ``on_state`` of each change. A change that can't follow is left out."""

    def __init__(self, on_state: Callable[[str], None] | None = None):
        self.now: str | None = None
        self.on_state = on_state or (lambda s: None)

    def to(self, state: str) -> bool:
        if state not in FOLLOWS[self.now]:
            return False
        self.now = state
        self.on_state(state)
        return True


class Progress(StreamingQueryListener):
    """Sums durations per section and rows per query; tells ``on_state`` of state changes.

    The section ``pause`` is the time between micro-batches in which a query
    neither polled nor worked.  With the property
    ``client.metrics.micrometer.bound`` the metrics that the sources report
    (and their rows and rates) are kept as ``client``: the latest per query,
    source and name.
    """

    def __init__(self, on_state: Callable[[str, str], None] | None = None, properties: Properties | None = None, clock: Callable[[], float] = time.monotonic):
        self.durations: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.rows: dict[str, int] = defaultdict(int)
        self.client: dict[tuple[str, str, str], str] = {}
        self.on_state = on_state or (lambda q, s: None)
        self.properties, self.clock = properties, clock
        self._running: set[str] = set()
        self._last: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        self.on_state(str(event.id), INITIALIZING)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        q = str(p.id)
        if q not in self._running:
            self._running.add(q)
            self.on_state(q, RUNNING)
        now, spent = self.clock(), 0
        for section, parts in SECTIONS.items():
            ms = sum(p.durationMs.get(x, 0) for x in parts)
            spent += ms
            self.durations[q][section] += ms
        if q in self._last:
            self.durations[q]["pause"] += max(0, int((now - self._last[q]) * 1000) - spent)
        self._last[q] = now
        self.rows[q] += p.numInputRows
        if self.properties is not None and self.properties["client.metrics.micrometer.bound"]:
            for s in p.sources:
                own = dict(s.metrics or {}) | {"numInputRows": str(s.numInputRows), "processedRowsPerSecond": str(s.processedRowsPerSecond)}
                self.client.update({(q, s.description, name): v for name, v in own.items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.on_state(str(event.id), TERMINATED)
