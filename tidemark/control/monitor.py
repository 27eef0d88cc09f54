"""What happens while running: counters, rates, and lines for the log, taken from streaming progress."""

from __future__ import annotations

import logging
import threading
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.model import ROW_ACTIONS

log = logging.getLogger("tidemark.monitor")
LOG_FORMAT = "%(asctime)s.%(msecs)03d %(levelname)s %(name)s %(message)s"


def configure_log(level: str = "INFO") -> None:
    logging.basicConfig(level=level, format=LOG_FORMAT, datefmt="%Y-%m-%dT%H:%M:%S")


def observed(changes: DataFrame, name: str) -> DataFrame:
    """changes with counters by action that Spark reports with each batch's progress."""
    return changes.observe(name, *[F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ROW_ACTIONS], F.count(F.lit(1)).alias("total"))


@dataclass
class Counters:
    """Totals by name, and the rate since the last look."""

    clock: Callable[[], float] = time.monotonic
    totals: Counter = field(default_factory=Counter)

    def __post_init__(self):
        self._lock, self._seen, self._at = threading.Lock(), Counter(), self.clock()
        self.began = self._at

    def add(self, counts: dict[str, int]) -> None:
        with self._lock:
            self.totals.update({k: int(v or 0) for k, v in counts.items()})

    def look(self) -> dict:
        """The totals, seconds since the start, and events a second since the last look."""
        with self._lock:
            now = self.clock()
            took = now - self._at
            delta = self.totals["total"] - self._seen["total"]
            out = {**self.totals, "seconds": now - self.began, "eps": delta / took if took > 0 else 0.0}
            self._seen, self._at = Counter(self.totals), now
            return out


class ProgressListener(StreamingQueryListener):
    """Adds what each batch observed to the counters."""

    def __init__(self, counters: Counters):
        self.counters = counters

    def onQueryStarted(self, event) -> None:
        log.info("started %s", event.name or event.id)

    def onQueryProgress(self, event) -> None:
        for row in (event.progress.observedMetrics or {}).values():
            self.counters.add(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("ended %s %s", event.id, event.exception or "")


class Ticker:
    """Writes a line of the counters every few seconds, with the memory in use."""

    def __init__(self, counters: Counters, interval_s: float, write: Callable[[str], None] = log.info):
        self.counters, self.interval_s, self.write, self._stop = counters, interval_s, write, threading.Event()

    def line(self) -> str:
        c = self.counters.look()
        try:
            import psutil

            used = f" memory={psutil.virtual_memory().percent:.0f}%"
        except Exception:
            used = ""
        return f"eps={c['eps']:.0f} total={c.get('total', 0)} " + " ".join(f"{a.lower()}={c.get(a, 0)}" for a in ROW_ACTIONS) + f" seconds={c['seconds']:.0f}{used}"

    def start(self) -> None:
        def run() -> None:
            while not self._stop.wait(self.interval_s):
                self.write(self.line())

        threading.Thread(target=run, name="monitor", daemon=True).start()

    def stop(self) -> None:
        self._stop.set()
