"""What a sink's history of flushes tells: rolling rates, smoothed rates, best batch, least-squares peak, under-filled runs.

A history has (sink, at double seconds, batch_size long, reason). It has one row per flush, not per event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = 16
EPS_ALPHA, BATCH_ALPHA = 0.2, 0.3
#: Fewest points, least spread of batch sizes, and least determinant for a fit.
FIT_POINTS, FIT_SPREAD, FIT_DETERMINANT = 5, 100, 1e-9


def deltas(history: DataFrame) -> DataFrame:
    """history with cumulative, dt, eps (null for the first flush and for dt <= 0) and the rate over the last RING flushes."""
    w = Window.partitionBy("sink").orderBy("at", "flush_no")
    ring = w.rowsBetween(1 - RING, 0)
    h = history.withColumn("cumulative", F.sum("batch_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h = h.withColumn("dt", F.col("at") - F.lag("at").over(w))
    h = h.withColumn("eps", F.when(F.col("dt") > 0, F.col("batch_size") / F.col("dt")))
    first_at, first_n = F.first("at").over(ring), F.first("cumulative").over(ring)
    span = F.col("at") - first_at
    return h.withColumn("ring_eps", F.when(span > 0, (F.col("cumulative") - first_n) / span)).withColumn("ring_n", F.count(F.lit(1)).over(ring))


def smoothed(values: Column, alpha: float) -> Column:
    """The last value of an exponential average of an array of numbers, seeded by its first; null for none."""
    seed = F.struct(F.lit(None).cast("double").alias("v"))
    step = lambda acc, x: F.struct(F.when(acc["v"].isNull(), x).otherwise(x * alpha + acc["v"] * (1 - alpha)).alias("v"))
    return F.aggregate(values, seed, step, lambda acc: acc["v"])


def ewma(history: DataFrame) -> DataFrame:
    """(sink, eps_ewma, batch_ewma): one row per sink; its flushes are one array, as long as the history kept for it."""
    d = deltas(history)
    of = d.groupBy("sink").agg(F.sort_array(F.collect_list(F.struct("at", "flush_no", "eps", F.col("batch_size").cast("double").alias("b")))).alias("h"))
    rates = F.transform(F.filter("h", lambda x: x["eps"].isNotNull()), lambda x: x["eps"])
    return of.select("sink", smoothed(rates, EPS_ALPHA).alias("eps_ewma"), smoothed(F.transform("h", lambda x: x["b"]), BATCH_ALPHA).alias("batch_ewma"))


def best_batch(history: DataFrame) -> DataFrame:
    """(sink, eps, batch_size): the flush with the highest rate; the earliest of equal ones."""
    rated = deltas(history).filter(F.col("eps").isNotNull())
    top = F.max(F.struct("eps", (-F.col("at")).alias("a"), (-F.col("flush_no")).alias("f"), "batch_size"))
    return rated.groupBy("sink").agg(top.alias("m")).select("sink", "m.eps", "m.batch_size")


def _det(a: list[Column]) -> Column:
    return a[0] * (a[4] * a[8] - a[5] * a[7]) - a[1] * (a[3] * a[8] - a[5] * a[6]) + a[2] * (a[3] * a[7] - a[4] * a[6])


def quadratic_fit(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, peak): the vertex of the least-squares parabola of y over x, null where there is no peak within the data.

    Sums of powers are combined map-side. x is scaled by the group's largest value first, so that powers stay exact enough.
    """
    valid = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    scale = valid.groupBy(*by).agg(F.max("x").alias("top"))
    u = valid.join(scale, by).withColumn("u", F.col("x") / F.nullif(F.col("top"), F.lit(0.0)))
    s = {f"s{p}": F.sum(F.pow("u", F.lit(p))) for p in range(1, 5)}
    s |= {"t0": F.sum("y"), "t1": F.sum(F.col("u") * F.col("y")), "t2": F.sum(F.col("u") * F.col("u") * F.col("y"))}
    g = u.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), *[c.alias(n) for n, c in s.items()])
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    whole = _det([s4, s3, s2, s3, s2, s1, s2, s1, n])
    a = _det([t2, s3, s2, t1, s2, s1, t0, s1, n]) / whole
    b = _det([s4, t2, s2, s3, t1, s1, s2, t0, n]) / whole
    vertex = -b / (2 * a) * F.col("high")
    fits = (n >= FIT_POINTS) & (F.col("high") - F.col("low") >= FIT_SPREAD) & (F.abs(whole) >= FIT_DETERMINANT)
    return g.select(*by, "n", F.when(fits & (a < 0) & vertex.between(F.col("low"), F.col("high")), vertex).alias("peak"))


def underfilled(history: DataFrame, batch: int, fill: float = 0.2) -> DataFrame:
    """history with run: how many timeouts in a row, up to this one, were filled to less than fill; 0 for other flushes."""
    low = (F.col("reason") == "timeout") & (F.col("batch_size") < F.lit(fill) * batch)
    w = Window.partitionBy("sink").orderBy("at", "flush_no")
    island = F.sum(F.when(low, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    h = history.withColumn("__low", low).withColumn("__island", island)
    of = Window.partitionBy("sink", "__island").orderBy("at", "flush_no").rowsBetween(Window.unboundedPreceding, 0)
    return h.withColumn("run", F.sum(F.col("__low").cast("int")).over(of)).drop("__low", "__island")
