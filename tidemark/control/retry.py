"""Trying again with growing waits, within a deadline."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

T = TypeVar("T")
log = logging.getLogger("tidemark.retry")


class GaveUp(Exception):
    """All attempts failed; the last error is the cause."""


def waits(retries: int, base_s: float, cap_s: float) -> Iterator[float]:
    """Seconds before each retry: doubling, at most cap_s."""
    for i in range(retries):
        yield min(base_s * 2**i, cap_s)


def retried(
    work: Callable[[], T], retries: int = 3, base_s: float = 2.0, cap_s: float = 30.0, deadline_s: float | None = 120.0,
    sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, stopped: Callable[[], bool] = lambda: False,
) -> T:
    """The result of work, tried once and then retries times more. The deadline spans all attempts.

    A stop asked for while waiting, and a wait that would pass the deadline, end it with GaveUp.
    """
    began, pauses, attempt = clock(), waits(retries, base_s, cap_s), 0
    while True:
        attempt += 1
        try:
            return work()
        except Exception as e:
            pause = next(pauses, None)
            late = deadline_s is not None and pause is not None and clock() - began + pause > deadline_s
            if pause is None or late or stopped():
                raise GaveUp(f"gave up after {attempt} attempts" + ", no time left" * late) from e
            log.warning("attempt %d failed, next in %.1f s: %s", attempt, pause, e)
            sleep(pause)
            if stopped():
                raise GaveUp(f"stopped after {attempt} attempts") from e
