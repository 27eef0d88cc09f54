"""Checks of sources and sinks without side effects, each within a deadline."""

from __future__ import annotations

import concurrent.futures
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Health:
    name: str
    ok: bool
    error: str = ""


def check(name: str, probe: Callable[[], None], deadline_s: float = 8.0) -> Health:
    """probe returns if all is well and raises if not; one that takes longer than the deadline is not well."""
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        pool.submit(probe).result(timeout=deadline_s)
        return Health(name, True)
    except concurrent.futures.TimeoutError:
        return Health(name, False, f"no answer within {deadline_s:g} s")
    except Exception as e:
        return Health(name, False, f"{type(e).__name__}: {e}"[:300])
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def check_all(probes: dict[str, Callable[[], None]], deadline_s: float = 8.0) -> list[Health]:
    """All at once, in the order of their names."""
    with concurrent.futures.ThreadPoolExecutor(max(1, len(probes))) as pool:
        return list(pool.map(lambda n: check(n, probes[n], deadline_s), sorted(probes)))
