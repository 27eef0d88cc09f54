"""Progress of destinations and of the feed: counters, rates, checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import ROW_ACTIONS
from tidemark.operators.ordering import running


def action_counts(changes: DataFrame) -> DataFrame:
    """(action, n): events by action; null actions are a group."""
    return changes.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def action_totals(changes: DataFrame) -> DataFrame:
    """One row: inserts, updates, deletes, total of the three; zeros for an empty feed."""
    one = [F.count(F.when(F.col("action") == a, 1)).alias(f"{a.lower()}s") for a in ROW_ACTIONS]
    return changes.agg(*one, F.count(F.when(F.col("action").isin(*ROW_ACTIONS), 1)).alias("total"))


def rates(changes: DataFrame, at: str, seconds: int, by: list[str]) -> DataFrame:
    """(by, slot, n, eps): events in each interval of seconds, slot being its first Unix second. Null times are left out."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    slot = (F.floor(micros / (1_000_000 * seconds)) * seconds).cast("long").alias("slot")
    counted = changes.filter(F.col(at).isNotNull()).groupBy(*by, slot).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("eps", F.col("n") / F.lit(float(seconds)))


def sink_summary(progress: DataFrame) -> DataFrame:
    """One row: min_ckpt over all sinks and max_pending over the active ones (0 without any), any_active."""
    return progress.agg(
        F.coalesce(F.min("ckpt"), F.lit(0)).cast("long").alias("min_ckpt"),
        F.coalesce(F.max(F.when(F.col("active"), F.col("pending"))), F.lit(0)).cast("long").alias("max_pending"),
        F.coalesce(F.bool_or("active"), F.lit(False)).alias("any_active"),
    )


def acknowledged(progress: DataFrame) -> DataFrame:
    """(instance_name, ack): what a source may drop: the least checkpoint of its active sinks, 0 while one has none."""
    return progress.filter(F.coalesce("active", F.lit(False))).groupBy("instance_name").agg(F.min(F.coalesce("ckpt", F.lit(0))).cast("long").alias("ack"))


def monotone(updates: DataFrame, by: list[str], order: list[str], value: str = "lsn") -> DataFrame:
    """updates with accepted, whether it is greater than all before it, and reached, the greatest so far. Nulls never are."""
    so_far = running(updates, by, order, {"reached": ("max", F.col(value)), "__prior": ("max_before", F.col(value))})
    accepted = F.col(value).isNotNull() & (F.coalesce("__prior", F.lit(-1)) < F.col(value))
    return so_far.withColumn("accepted", accepted).drop("__prior")


def fanned_out(changes: DataFrame, progress: DataFrame) -> DataFrame:
    """(sink, n, last_lsn): what each active sink of an instance receives. Counted before it is multiplied."""
    per = changes.groupBy("instance_name").agg(F.count(F.lit(1)).alias("n"), F.max("lsn").alias("last_lsn"))
    return progress.filter(F.coalesce("active", F.lit(False))).join(per, "instance_name").select("sink", "n", "last_lsn")


def pending(changes: DataFrame, progress: DataFrame) -> DataFrame:
    """(sink, behind): row events of its instance beyond a sink's checkpoint: arrivals less what it has consumed.

    Each sink is a threshold in its instance's log. Events are counted once per interval between thresholds.
    """
    cuts = progress.filter(F.col("ckpt").isNotNull()).groupBy("instance_name").agg(F.sort_array(F.collect_set("ckpt")).alias("cuts"))
    rows = changes.filter((F.coalesce("table_name", F.lit("")) != "") & F.col("lsn").isNotNull()).join(cuts, "instance_name")
    rank = F.size(F.filter("cuts", lambda c: c < F.col("lsn"))).alias("rank")
    counted = rows.groupBy("instance_name", rank).agg(F.count(F.lit(1)).alias("n"))
    placed = progress.filter(F.col("ckpt").isNotNull()).join(cuts, "instance_name")
    mine = placed.select("sink", "instance_name", F.array_position("cuts", F.col("ckpt")).alias("place"))
    after = mine.join(counted, "instance_name", "left").groupBy("sink").agg(F.coalesce(F.sum(F.when(F.col("rank") >= F.col("place"), F.col("n"))), F.lit(0)).alias("behind"))
    return after


def table_filter(changes: DataFrame, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Events of the included tables (all, if none is named) without the excluded ones; exclusion wins. Markers stay."""
    name = F.concat_ws(".", F.coalesce("schema_name", F.lit("")), F.coalesce("table_name", F.lit("")))
    marker = F.coalesce("table_name", F.lit("")) == ""
    keep = name.isin(*include) if include else F.lit(True)
    return changes.filter(marker | (keep & ~name.isin(*exclude) if exclude else marker | keep))
