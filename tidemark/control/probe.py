"""Finding a good batch size while running: a pure state and what each flush makes of it.

The size is moved in steps and the smoothed rate watched: better, and the steps grow in the same direction; worse, and
the size jumps to the peak of a parabola through the recent flushes if they show one, or turns back; no
difference, and after a while a small step is tried again. Batches that time out nearly empty shrink it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

# fixed values of the controller
KEPT = 16
FIRST_STEP, LEAST_STEP = 500, 100
GROW, SHRINK = 1.5, 0.5
BAND = 0.02
QUIET_FLUSHES = 10
EPS_ALPHA, BATCH_ALPHA = 0.2, 0.3
FILL_LOW, DECAY, UNDERFILLS = 0.2, 0.10, 5
SAFE_LOW, SAFE_HIGH = 200, 200_000
EMERGENCY_LOW = 2000
FIT_POINTS, FIT_SPREAD, FIT_DETERMINANT = 5, 100, 1e-9


@dataclass(frozen=True)
class Flush:
    at: float
    size: int
    total: int


@dataclass(frozen=True)
class Probe:
    """What is known after some flushes. size is the batch size to use next."""

    low: int = SAFE_LOW
    high: int = SAFE_HIGH
    size: int = 5000
    step: int = FIRST_STEP
    direction: int = 1
    flushes: tuple[Flush, ...] = ()
    raw_eps: float = 0.0
    eps: float = 0.0
    seen_eps: float | None = None
    best: tuple[float, int] = (0.0, 0)
    steady: float | None = None
    quiet: int = 0
    underfilled: int = 0
    held: bool = field(default=False)

    def stable(self) -> int | None:
        """The smoothed batch size; before any move the best one, if there was a rate at all."""
        if self.steady is not None:
            return int(self.steady)
        return self.best[1] if self.best[0] > 0 else None


def probe(size: int, low: int = SAFE_LOW, high: int = SAFE_HIGH) -> Probe:
    size = max(low, min(high, size))
    return Probe(low=low, high=high, size=size, best=(0.0, size))


def _sized(p: Probe, size: int, **more) -> Probe:
    size = max(p.low, min(p.high, size))
    steady = float(size) if p.steady is None else p.steady * (1 - BATCH_ALPHA) + size * BATCH_ALPHA
    return replace(p, size=size, steady=steady, **more)


def forced(p: Probe, size: int) -> Probe:
    """A size set from outside; probing goes on from there in small steps."""
    return _sized(p, size, step=LEAST_STEP, underfilled=0)


def held(p: Probe, on: bool) -> Probe:
    """While held, flushes are counted but the size stays."""
    return replace(p, held=on)


def _counted(p: Probe, at: float, n: int) -> Probe:
    last = p.flushes[-1] if p.flushes else None
    now = Flush(at, n, (last.total if last else 0) + n)
    p = replace(p, flushes=(*p.flushes, now)[-KEPT:])
    if last is None or at <= last.at:
        return p
    raw = n / (at - last.at)
    eps = raw if p.eps == 0 else p.eps * (1 - EPS_ALPHA) + raw * EPS_ALPHA
    return replace(p, raw_eps=raw, eps=eps, best=(eps, n) if eps > p.best[0] else p.best)


def peak(points: Sequence[tuple[float, float]]) -> float | None:
    """The vertex of the least-squares parabola through (x, y), if it is a maximum within the range of x."""
    xs = [x for x, _ in points]
    if len(points) < FIT_POINTS or max(xs) - min(xs) < FIT_SPREAD:
        return None
    m = [sum(x**k for x in xs) for k in range(5)]
    v = [sum(y * x**k for x, y in points) for k in (2, 1, 0)]
    rows = [[m[4], m[3], m[2]], [m[3], m[2], m[1]], [m[2], m[1], m[0]]]

    def det(a):
        return sum(a[0][i] * (a[1][(i + 1) % 3] * a[2][(i + 2) % 3] - a[1][(i + 2) % 3] * a[2][(i + 1) % 3]) for i in range(3))

    whole = det(rows)
    if abs(whole) < FIT_DETERMINANT:
        return None
    a, b = (det([[v[r] if c == k else rows[r][c] for c in range(3)] for r in range(3)]) / whole for k in (0, 1))
    if a >= 0:
        return None
    vertex = -b / (2 * a)
    return vertex if min(xs) <= vertex <= max(xs) else None


def _recent(p: Probe) -> list[tuple[float, float]]:
    pairs = zip(p.flushes, p.flushes[1:])
    return [(float(b.size), (b.total - a.total) / (b.at - a.at)) for a, b in pairs if b.at > a.at]


def _observed(p: Probe) -> Probe:
    if p.seen_eps is None:
        return _sized(replace(p, seen_eps=p.eps, quiet=0), p.size + p.direction * p.step)
    change = (p.eps - p.seen_eps) / max(p.seen_eps, 1.0)
    p = replace(p, seen_eps=p.eps)
    if change > BAND:
        step = min(int(p.step * GROW), (p.high - p.low) // 4)
        return _sized(p, p.size + p.direction * step, step=step, quiet=0)
    if change < -BAND:
        top = peak(_recent(p))
        if top is not None:
            return _sized(p, int(top), direction=1, step=LEAST_STEP, quiet=0)
        step = max(int(p.step * SHRINK), LEAST_STEP)
        return _sized(p, p.size - p.direction * step, direction=-p.direction, step=step, quiet=0)
    if p.quiet + 1 >= QUIET_FLUSHES:
        return _sized(p, p.size + p.direction * LEAST_STEP, step=LEAST_STEP, quiet=0)
    return replace(p, quiet=p.quiet + 1)


def full_flush(p: Probe, at: float, n: int) -> Probe:
    """A batch of n that was full."""
    p = replace(_counted(p, at, n), underfilled=0)
    return p if p.held or p.eps <= 0 else _observed(p)


def timeout_flush(p: Probe, at: float, n: int) -> Probe:
    """A batch of n that the timer took before it was full."""
    p = _counted(p, at, n)
    if p.held:
        return p
    if n / p.size >= FILL_LOW:
        return replace(p, underfilled=0)
    if p.underfilled + 1 < UNDERFILLS:
        return replace(p, underfilled=p.underfilled + 1)
    return _sized(p, int(p.size * (1 - DECAY)), step=LEAST_STEP, underfilled=0)


def trace(flushes: Iterable[tuple[float, int, str]], start: Probe) -> list[Probe]:
    """The states after each flush (at, n, reason), reason being size or timeout."""
    out, p = [], start
    for at, n, reason in flushes:
        p = full_flush(p, at, n) if reason == "size" else timeout_flush(p, at, n)
        out.append(p)
    return out
