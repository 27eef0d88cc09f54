"""Tuning while running: a guard on memory, the number of workers, the batch timeout. Automatic mode only."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from tidemark.control import probe as probes
from tidemark.control.config import Config

log = logging.getLogger("tidemark.tuner")

# fixed values of the tuner
MEMORY_HIGH, MEMORY_LOW = 95.0, 85.0
BACKLOG_HIGH_S, BACKLOG_LOW_S = 1.5, 0.1
TIMEOUT_LOW_MS, TIMEOUT_HIGH_MS, TIMEOUT_ROOM = 20, 5000, 1.3
IDLE_TICKS = 2


@dataclass(frozen=True)
class Tuning:
    """What the tuner decides: batch size and its probe, workers, timeout; throttled while memory is short."""

    probe: probes.Probe
    workers: int
    timeout_ms: int
    throttled: bool = False


def memory_percent() -> float:
    import psutil

    return psutil.virtual_memory().percent


def halved(t: Tuning) -> Tuning:
    size = max(t.probe.size // 2, probes.EMERGENCY_LOW)
    return replace(t, probe=probes.forced(t.probe, size))


def guarded(t: Tuning, used_percent: float) -> Tuning:
    """Above the high mark the batch is halved, once a tick, and probing is held until memory falls below the low mark."""
    if not t.throttled and used_percent >= MEMORY_HIGH:
        return halved(replace(t, throttled=True, probe=probes.held(t.probe, True)))
    if t.throttled and used_percent < MEMORY_LOW:
        return replace(t, throttled=False, probe=probes.held(t.probe, False))
    return halved(t) if t.throttled and used_percent >= MEMORY_HIGH else t


def staffed(t: Tuning, pending: int, cpus: int) -> Tuning:
    backlog = pending / max(t.probe.eps, 1.0)
    if backlog > BACKLOG_HIGH_S and t.workers < cpus:
        return replace(t, workers=t.workers + 1)
    return replace(t, workers=t.workers - 1) if backlog < BACKLOG_LOW_S and t.workers > 1 else t


def timed(t: Tuning, idle_s: float, tick_s: float) -> Tuning:
    """The time in which a stable batch fills, with room; held when there was no flush for some ticks."""
    stable = t.probe.stable()
    if idle_s > IDLE_TICKS * tick_s or stable is None or t.probe.eps <= 0:
        return t
    millis = int(stable / t.probe.eps * 1000.0 * TIMEOUT_ROOM)
    return replace(t, timeout_ms=max(TIMEOUT_LOW_MS, min(TIMEOUT_HIGH_MS, millis)))


def tick_seconds(config: Config) -> float:
    return 2.0 * config.monitor.interval_s if config.monitor.interval_s > 0 else 10.0


def tick(t: Tuning, config: Config, used_percent: float, pending: int, idle_s: float, cpus: int) -> Tuning:
    """One round, in this order: memory, workers, timeout. In manual mode nothing changes."""
    if not config.tuning.automatic:
        return t
    return timed(staffed(guarded(t, used_percent), pending, cpus), idle_s, tick_seconds(config))


class Tuner:
    """Ticks on a thread of its own; the engine reads state, which is replaced as a whole."""

    def __init__(self, config: Config, pending: Callable[[], int], cpus: int, memory: Callable[[], float] = memory_percent):
        batch = config.performance.batch_size
        self.config, self.pending, self.cpus, self.memory = config, pending, cpus, memory
        self.state = Tuning(probes.probe(batch), config.performance.workers, config.performance.batch_timeout_ms)
        self._stop = threading.Event()
        self._lock = threading.Lock()

    def flushed(self, at: float, n: int, full: bool) -> None:
        with self._lock:
            step = probes.full_flush if full else probes.timeout_flush
            self.state = replace(self.state, probe=step(self.state.probe, at, n))

    def tick(self, now: float | None = None) -> Tuning:
        with self._lock:
            last = self.state.probe.flushes[-1].at if self.state.probe.flushes else float("-inf")
            idle = (time.time() if now is None else now) - last
            try:
                used = self.memory()
            except Exception as e:  # memory cannot be read here: no guard in this round
                log.warning("memory is not known: %s", e)
                used = 0.0
            self.state = tick(self.state, self.config, used, self.pending(), idle, self.cpus)
            return self.state

    def start(self) -> threading.Thread:
        def run() -> None:
            while not self._stop.wait(tick_seconds(self.config)):
                self.tick()

        thread = threading.Thread(target=run, name="tuner", daemon=True)
        thread.start()
        return thread

    def stop(self) -> None:
        self._stop.set()
