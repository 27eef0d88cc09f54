"""Net state and net changes per key of a feed with one known set of columns, by aggregation.

The fold is not last-write-wins: with died the newest DELETE and born the first INSERT after it, a key is live if it was
born, and each column has its newest value at or after the birth among the events that list it. An UPDATE of an absent
key changes nothing. apply.py holds the general form, with moved keys and columns found in the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lives(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, born) of the live keys. Two aggregations, both combined map-side."""
    died = events.filter("action = 'DELETE'").groupBy(*keys).agg(F.max(order).alias("__died"))
    starts = events.filter("action = 'INSERT'").select(*keys, order).join(died, keys, "left")
    starts = starts.filter(F.col("__died").isNull() | (F.col(order) > F.col("__died")))
    return starts.groupBy(*keys).agg(F.min(order).alias("__born"))


def fold(events: DataFrame, keys: list[str], order: str, columns: list[str], image: str = "after_image") -> DataFrame:
    """(keys, columns): the live rows. events has action, order (unique within a key) and image, a map of text.

    A present null overwrites, an absent column does not. Events with a null key or other actions have no effect.
    """
    valid = events.filter(F.col("action").isin("INSERT", "UPDATE", "DELETE"))
    for k in keys:
        valid = valid.filter(F.col(k).isNotNull())
    after = valid.filter(F.col("action") != "DELETE").join(_lives(valid, keys, order), keys).filter(F.col(order) >= F.col("__born"))
    newest = [F.max(F.when(F.map_contains_key(image, F.lit(c)), F.struct(F.col(order), F.try_element_at(image, F.lit(c)).alias("v")))).alias(f"__{c}") for c in columns]
    return after.groupBy(*keys).agg(*newest).select(*keys, *[F.col(f"__{c}.v").alias(c) for c in columns])


def seeds(target: DataFrame, keys: list[str], order: str, columns: list[str], below: int = -1, image: str = "after_image") -> DataFrame:
    """The rows of a destination as INSERT events below every event of the feed."""
    entries = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("string") for c in columns]))
    return target.select(*keys, F.lit("INSERT").alias("action"), F.lit(below).cast("long").alias(order), entries.alias(image))


def merged(target: DataFrame, events: DataFrame, keys: list[str], order: str, columns: list[str], image: str = "after_image") -> DataFrame:
    """The destination after the events: target has keys and columns; orders of events are 0 or more."""
    all_events = events.select(*keys, "action", order, image).unionByName(seeds(target, keys, order, columns, image=image))
    return fold(all_events, keys, order, columns, image)


def net_changes(target: DataFrame, events: DataFrame, keys: list[str], order: str, columns: list[str], image: str = "after_image") -> DataFrame:
    """(keys, net): what one write to the destination has to do for each key that the events name: upsert, delete or none."""
    after = merged(target, events, keys, order, columns, image).select(*keys, F.lit(True).alias("__after"))
    before = target.select(*keys, F.lit(True).alias("__before"))
    named = events.filter(F.col("action").isin("INSERT", "UPDATE", "DELETE")).select(*keys).distinct()
    net = F.when(F.col("__after"), "upsert").when(F.col("__before"), "delete").otherwise("none")
    return named.join(after, keys, "left").join(before, keys, "left").select(*keys, net.alias("net"))


def last_write_wins(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The keys that keeping each key's newest event would leave live; for comparison with fold."""
    newest = events.groupBy(*keys).agg(F.max_by("action", order).alias("action"))
    return newest.filter("action <> 'DELETE'").select(*keys)
