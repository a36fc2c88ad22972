"""The cache of contacts as keyed state: what was found stays, what was not found is not sought again for a while."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COOLDOWN = 14 * 24 * 3_600_000
_OUT = "domain string, source string, at timestamp, decision string, email string"


def _ms(at: datetime) -> int:
    return round(at.timestamp() * 1000)


class ContactCache(StatefulProcessor):
    """State of a domain: the mailbox found, and for each source when it last had none.

    Rows are taken as they come.  A miss is forgotten by a timer once the watermark is past
    its cool-down; until then a question about its source waits, unless it asks for a retry.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.found = handle.getValueState("found", "email string")
        self.missed = handle.getMapState("missed", "source string", "at long")

    def _learn(self, outcome: str, source: str, email: str | None, at: int) -> None:
        if outcome == "found":
            self.found.update((email,))
            if self.missed.exists():
                self.missed.clear()
        elif outcome == "missed" and not self.found.exists():
            if not self.missed.containsKey((source,)) or self.missed.getValue((source,))[0] < at:
                self.missed.updateValue((source,), (at,))
            self.handle.registerTimer(at + COOLDOWN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            if r.kind != "ask":
                self._learn(r.kind, r.source or "", r.email, _ms(r.at))
                continue
            email, decision = None, "fetch"
            if self.found.exists():
                email, decision = self.found.get()[0], "found"
            elif not r.retry and self.missed.containsKey((r.source or "",)) and _ms(r.at) < self.missed.getValue((r.source or "",))[0] + COOLDOWN:
                decision = "cooldown"
            yield Row(domain=key[0], source=r.source, at=r.at, decision=decision, email=email)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for (source,), (at,) in list(self.missed.iterator()):
            if at + COOLDOWN <= now:
                self.missed.removeKey((source,))
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._learn(initialState.kind, initialState.source or "", initialState.email, _ms(initialState.at))

    def close(self) -> None:
        pass


def decisions(stream: DataFrame, before: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """domain, source, at, decision (found, cooldown, fetch), email for every question of the stream.

    stream has domain, source, kind (found, missed, ask), email, retry and at; before, a
    batch table of domain, source, kind, email and at, is the state to begin with, read by
    the first run alone.  A null source is the domain's own; a null kind teaches nothing.
    Needs the RocksDB state store.
    """
    rows = stream.select("domain", "source", "kind", "email", "retry", "at").withWatermark("at", late)
    initial = before.select("domain", "source", "kind", "email", "at").groupBy("domain") if before is not None else None
    return rows.groupBy("domain").transformWithState(ContactCache(), _OUT, "Append", "EventTime", initialState=initial)
