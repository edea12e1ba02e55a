"""Keeping a query in step with its settings: re-reads them, and restarts the query when they ask for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from tasklathe.config import Properties
from tasklathe.settings_file import SettingsFile
from tasklathe.streaming.listener import INITIALIZING, REBALANCING, RUNNING, SHUTTING_DOWN, TERMINATED, States


class Supervisor:
    """Runs ``start(properties)`` and, on every ``tick``, applies changes of the settings.

    A changed rate, key list or other setting is seen by the next micro-batch
    through ``properties``.  A change of concurrency or of the pending limit
    drains the query (it stops after the micro-batch it is in) and starts it
    anew from its checkpoint.  A rate of 0 stops fetching: the query rests
    until the rate changes.
    """

    def __init__(self, start: Callable[[Properties], StreamingQuery], properties: Properties, settings: SettingsFile | None = None, on_state: Callable[[str], None] | None = None):
        self.start, self.properties, self.settings = start, properties, settings
        self.states = States(on_state)
        self.states.to(INITIALIZING)
        self.restarts = 0
        self.query: StreamingQuery | None = None

    @property
    def resting(self) -> bool:
        return self.properties["processing.rate.per.partition"] == 0

    def _drain(self) -> None:
        if self.query is not None:
            if self.query.isActive:
                self.query.processAllAvailable()
                self.query.stop()
            self.query = None

    def tick(self) -> None:
        if self.settings is not None:
            self.settings.poll()
        if self.resting:
            self._drain()
            return
        if self.properties.reload_requested:
            self.properties.reload_requested = False
            if self.query is not None:
                self.states.to(REBALANCING)
                self._drain()
                self.restarts += 1
        if self.query is None:
            self.query = self.start(self.properties)
            self.states.to(RUNNING)

    def close(self) -> None:
        self.states.to(SHUTTING_DOWN)
        self._drain()
        self.states.to(TERMINATED)
