"""What a sink is, and sending one batch to several."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from tidemark.control.retry import GaveUp

log = logging.getLogger("tidemark.sinks")


class Sink(Protocol):
    """A destination. apply must give the same result if a batch comes again with the same batch_id."""

    name: str

    def apply(self, batch: DataFrame, batch_id: int) -> None: ...

    def probe(self) -> None: ...

    def close(self) -> None: ...


@dataclass
class Progress:
    """Per sink: active, and the greatest position it has reached. A smaller one never replaces a greater one."""

    reached: dict[str, int] = field(default_factory=dict)
    active: dict[str, bool] = field(default_factory=dict)

    def add(self, name: str, lsn: int | None = None) -> None:
        self.active[name] = True
        if lsn is not None:
            self.reached[name] = lsn

    def advance(self, name: str, lsn: int | None) -> bool:
        """Whether lsn was accepted."""
        if lsn is None or not self.active.get(name) or lsn <= self.reached.get(name, -1):
            return False
        self.reached[name] = lsn
        return True

    def fail(self, name: str) -> None:
        """An inactive sink no longer holds the others back."""
        self.active[name] = False
        self.reached.pop(name, None)

    def ack(self) -> int:
        """The position that the source may drop: the least of the active sinks, 0 while one of them has none."""
        live = [n for n, on in self.active.items() if on]
        return min((self.reached.get(n, 0) for n in live), default=0)

    def any_active(self) -> bool:
        return any(self.active.values())


class FanOut:
    """One batch to every active sink, read once. A sink that gives up is dropped, the others go on."""

    def __init__(self, sinks: list[Sink], progress: Progress, attempt: Callable[[Callable[[], None]], None]):
        self.sinks, self.progress, self.attempt = sinks, progress, attempt
        for s in sinks:
            progress.add(s.name, progress.reached.get(s.name))

    def apply(self, batch: DataFrame, batch_id: int, lsn: int | None = None) -> list[str]:
        """The names of the sinks that have the batch. Without any active sink it is dropped."""
        live = [s for s in self.sinks if self.progress.active[s.name]]
        if not live:
            return []
        shared = batch.persist() if len(live) > 1 else batch
        done = []
        try:
            for s in live:
                try:
                    self.attempt(lambda s=s: s.apply(shared, batch_id))
                    self.progress.advance(s.name, lsn)
                    done.append(s.name)
                except GaveUp as e:
                    log.error("sink %s is dropped: %s", s.name, e.__cause__)
                    self.progress.fail(s.name)
        finally:
            if len(live) > 1:
                shared.unpersist()
        return done

    def close(self) -> None:
        for s in self.sinks:
            s.close()
