"""Results per row key when a few keys hold most of the rows.

Rows are range-partitioned on the composite key and a secondary order by sampled quantiles, so a heavy key is
split over as many partitions as its share asks for. Each partition folds its rows into one partial state per key; then
only states are exchanged and stitched: one for a key inside a partition, one more for each border that cuts a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import ACTIONS, ROW_ACTIONS, action_code, row_key
from tidemark.session import written

KEY = ["schema_name", "table_name", "row_key"]
INSTANCE_KEY = ["instance_name", *KEY]


def keyed_rows(changes: DataFrame) -> DataFrame:
    """The INSERT, UPDATE and DELETE rows with key names: their row key, position, action. Copies included."""
    c = changes
    return c.filter(F.col("action").isin(*ROW_ACTIONS) & (F.size("key_names") > 0)).select(
        "instance_name", "schema_name", "table_name", row_key(c).alias("row_key"), F.coalesce("lsn", F.lit(-1)).alias("lsn"), "seq", action_code(F.col("action")).alias("code")
    )


def ranged(df: DataFrame, keys: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df in partitions of near-equal size, split on quantiles of (keys, order) that Spark samples."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order)


def key_stats(changes: DataFrame, partitions: int | None = None) -> DataFrame:
    """(instance_name, schema_name, table_name, row_key, n, last_lsn, last_action): one row per key of an instance.

    Each instance counts its positions for itself, so a last position has a meaning only within one. The last row of a
    key is the one with the greatest lsn, then the greatest seq; null lsn sorts first. Null names are a key of their own.
    An empty feed gives no rows.
    """
    last = F.struct("lsn", "seq", "code")
    stats = ranged(keyed_rows(changes), INSTANCE_KEY, ["lsn", "seq"], partitions).groupBy(*INSTANCE_KEY).agg(F.count(F.lit(1)).alias("n"), F.max(last).alias("last"))
    names = F.array(*map(F.lit, ACTIONS))
    return stats.select(*INSTANCE_KEY, "n", F.col("last.lsn").alias("last_lsn"), F.get(names, F.col("last.code")).alias("last_action"))


def heavy_keys(changes: DataFrame, share: float = 0.02, partitions: int | None = None) -> DataFrame:
    """(schema_name, table_name, row_key) with at least share of the rows that key_stats counts, all instances together."""
    per_key = key_stats(changes, partitions).groupBy(*KEY).agg(F.sum("n").alias("n"))
    per_key = written(per_key, "key-counts")
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return per_key.filter(F.col("n") >= F.lit(share) * F.lit(total)).select(*KEY)
