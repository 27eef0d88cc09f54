"""Cutting a feed into bags and batches, and the checkpoint that each cut may publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import numbered, running

#: Events of one transaction after which a bag is sent although the transaction goes on.
BAG_LIMIT = 50_000


def bags(events: DataFrame, txn: list[str], order: list[str], limit: int = BAG_LIMIT) -> DataFrame:
    """events with bag, the number of its bag within its transaction, from 0: full every limit events."""
    return numbered(events, txn, order, "bag").withColumn("bag", F.floor(F.col("bag") / limit).cast("long"))


def bag_sizes(events: DataFrame, txn: list[str], order: list[str], limit: int = BAG_LIMIT) -> DataFrame:
    """(txn, bag, n, closed): closed is true for the bag in which the transaction ends."""
    n = events.groupBy(*txn).agg(F.count(F.lit(1)).alias("__n"))
    bag = F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / limit).cast("long")))
    one = n.withColumn("bag", bag)
    return one.select(*txn, "bag", F.least(F.lit(limit), F.col("__n") - F.col("bag") * limit).alias("n"), ((F.col("bag") + 1) * limit >= F.col("__n")).alias("closed"))


def size_cuts(events: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """events with batch_no: each group's events in order, size to a batch, the rest in the last one."""
    return numbered(events, by, order, "batch_no").withColumn("batch_no", F.floor(F.col("batch_no") / size).cast("long"))


def chunked(events: DataFrame, by: list[str], order: list[str], workers: int) -> DataFrame:
    """events with chunk: contiguous chunks of ceil(n / workers) events of each group; the last ones may be short or missing."""
    n = events.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    placed = numbered(events, by, order, "__pos")
    return placed.join(n, by).withColumn("chunk", F.floor(F.col("__pos") / F.ceil(F.col("__n") / workers)).cast("long")).drop("__pos", "__n")


def batch_checkpoints(events: DataFrame, by: list[str], order: list[str], size: int, bag: list[str]) -> DataFrame:
    """(by, batch_no, n, reason, ckpt): the batches of a collector that takes bag after bag.

    After each bag as many full batches as there are are cut (reason size); what is left waits for the next bag, and at
    the end the timer takes it (reason timeout). A batch may publish a checkpoint, the greatest last lsn of the bags seen
    so far, only if its cut leaves nothing waiting: a batch ends a bag's last row exactly, or is the last one.
    """
    placed = numbered(events, by, order, "pos")
    ends = placed.groupBy(*by, *bag).agg(F.max("pos").alias("pos"), F.max_by("lsn", "pos").alias("last_lsn"))
    reached = running(ends, by, ["pos"], {"ckpt": ("max", F.col("last_lsn"))})
    n = events.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    batches = placed.withColumn("batch_no", F.floor(F.col("pos") / size).cast("long")).groupBy(*by, "batch_no").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos"))
    full = F.col("n") == size
    out = batches.join(reached.select(*by, "pos", "ckpt"), [*by, "pos"], "left").join(n, by)
    drained = (F.col("pos") + 1 == F.col("__n")) | F.col("ckpt").isNotNull()
    return out.select(*by, "batch_no", "n", F.when(full, "size").otherwise("timeout").alias("reason"), F.when(drained, F.col("ckpt")).alias("ckpt"))
