"""From decoded messages to change events: images, key names, relations as of each change, positions, commit markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import action_code
from tidemark.operators.ordering import as_of


def key_names(columns: Column) -> Column:
    """The names of the columns whose flag is 1, in the relation's order."""
    return F.transform(F.filter(columns, lambda c: c["flags"] == 1), lambda c: c["name"])


def image(columns: Column, cells: Column) -> Column:
    """A tuple as a map: cells is array<struct<code string, text string>>, by place in columns.

    n is a null, u an unchanged value, which stays out of the map; t and b have text. Where the widths differ the shorter
    one counts. A null tuple is a null map.
    """
    width = F.least(F.size(columns), F.size(cells))
    pairs = F.arrays_zip(F.slice(F.transform(columns, lambda c: c["name"]), 1, F.greatest(width, F.lit(0))).alias("name"), F.slice(cells, 1, F.greatest(width, F.lit(0))).alias("cell"))
    held = F.filter(pairs, lambda p: p["cell"]["code"].isin("n", "t", "b"))
    entries = F.transform(held, lambda p: F.struct(p["name"].alias("key"), F.when(p["cell"]["code"] != "n", p["cell"]["text"]).alias("value")))
    return F.when(cells.isNotNull(), F.map_from_entries(entries))


def event_lsn(wal_start: Column, payload: Column) -> Column:
    """The position right after a message."""
    return wal_start + F.octet_length(payload)


def encoded(events: DataFrame, keep: list[str] = ()) -> DataFrame:
    """events as the envelope goes out: the action's code, images as JSON objects (nulls kept), the position as JSON.

    An absent image is null. keep names columns of events to keep beside the envelope's.
    """
    return events.select(
        *keep, "source_type", action_code(F.col("action")).alias("action_code"), "schema_name", "table_name", "key_names",
        F.to_json("before_image").alias("before_json"), F.to_json("after_image").alias("after_json"),
        F.to_json(F.struct(F.col("lsn").cast("string").alias("lsn"))).alias("checkpoint_json"),
    )


def decoded(encoded_events: DataFrame) -> DataFrame:
    """The inverse of encoded for its images and position: before_image, after_image and lsn."""
    image = lambda c: F.from_json(c, "map<string,string>")
    lsn = F.get_json_object("checkpoint_json", "$.lsn").try_cast("long")
    return encoded_events.withColumns({"before_image": image("before_json"), "after_image": image("after_json"), "lsn": lsn}).drop("before_json", "after_json", "checkpoint_json")


def current_relations(relations: DataFrame) -> DataFrame:
    """The newest message of each relation id of an instance: a later one replaces an earlier one."""
    newest = relations.groupBy("instance_name", "relation_id").agg(F.max_by(F.struct("namespace", "name", "columns"), "seq").alias("r"))
    return newest.select("instance_name", "relation_id", "r.namespace", "r.name", key_names(F.col("r.columns")).alias("key_names"), F.size("r.columns").alias("width"))


def resolved(changes: DataFrame, relations: DataFrame, order: str = "seq") -> DataFrame:
    """changes with namespace, name and columns of the newest relation of their id before them; unknown ones are dropped."""
    return as_of(changes, relations, ["relation_id"], order, ["namespace", "name", "columns"], "known").filter("known").drop("known")


def commit_markers(changes: DataFrame) -> DataFrame:
    """(instance_name, txn_id, lsn): one marker for each transaction that has a commit position and no row event.

    Row events are those with a table name.
    """
    rows = F.count(F.when(F.coalesce("table_name", F.lit("")) != "", 1))
    of = changes.groupBy("instance_name", "txn_id").agg(F.max("commit_lsn").alias("lsn"), rows.alias("rows"))
    return of.filter((F.col("rows") == 0) & F.col("lsn").isNotNull()).select("instance_name", "txn_id", "lsn")


def commit_stamped(changes: DataFrame) -> DataFrame:
    """(instance_name, txn_id, seq, lsn): row events, the last one of each transaction with the commit position.

    Last is by lsn, then seq. The winner is found by aggregation, so a large transaction costs each task one row.
    """
    rows = changes.filter(F.coalesce("table_name", F.lit("")) != "").select("instance_name", "txn_id", "seq", "lsn", "commit_lsn")
    last = rows.groupBy("instance_name", "txn_id").agg(F.max(F.struct(F.coalesce("lsn", F.lit(-1)).alias("l"), "seq")).alias("m"), F.max("commit_lsn").alias("end"))
    last = last.select("instance_name", "txn_id", F.col("m.seq").alias("seq"), "end")
    joined = rows.drop("commit_lsn").join(last, ["instance_name", "txn_id", "seq"], "left")
    return joined.select("instance_name", "txn_id", "seq", F.coalesce("end", "lsn").alias("lsn"))


def presence(changes: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, present, nulls, absent): how often the after images of INSERT and UPDATE hold each column."""
    rows = changes.filter(F.col("action").isin("INSERT", "UPDATE") & F.col("after_image").isNotNull())
    one = lambda n: F.struct(F.lit(n).alias("column_name"), F.map_contains_key("after_image", F.lit(n)).alias("has"), F.try_element_at("after_image", F.lit(n)).isNull().alias("no"))
    cells = rows.select(F.explode(F.array(*map(one, columns))).alias("c")).select("c.*")
    return cells.groupBy("column_name").agg(
        F.count(F.when(F.col("has") & ~F.col("no"), 1)).alias("present"), F.count(F.when(F.col("has") & F.col("no"), 1)).alias("nulls"), F.count(F.when(~F.col("has"), 1)).alias("absent")
    )


