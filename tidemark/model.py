"""The change envelope: schemas, row keys, message identity and log positions.

Column names differ from the envelope's field names only where SQL keywords would clash: ``schema_name``,
``table_name``, ``before_image``, ``after_image`` and ``lsn``. Images are ``map<string,string>``: a present
key with a null value is SQL NULL, an absent key is an unchanged column. The two are never merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIONS = ("UNKNOWN", "INSERT", "UPDATE", "DELETE", "COMMIT")
ROW_ACTIONS = ("INSERT", "UPDATE", "DELETE")
#: A null key value in a row key's text; such keys match no row.
NULL_KEY = "\\N"
#: A log position is commit_lsn * 2^63 + lsn, exact in 38 digits as both parts are below 2^63.
POSITION_BASE = 1 << 63
POSITION_TYPE = T.DecimalType(38, 0)

IMAGE = T.MapType(T.StringType(), T.StringType(), True)

CHANGE_EVENT = T.StructType(
    [
        T.StructField("source_type", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("key_names", T.ArrayType(T.StringType())),
        T.StructField("before_image", IMAGE),
        T.StructField("after_image", IMAGE),
        T.StructField("lsn", T.LongType()),
    ]
)

FEED = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("txn_id", T.LongType()),
        T.StructField("commit_lsn", T.LongType()),
        *CHANGE_EVENT.fields,
    ]
)


def action_code(action: Column) -> Column:
    """The envelope's integer code of an action name; unknown names are 0."""
    return F.coalesce(*[F.when(action == a, F.lit(i)) for i, a in enumerate(ACTIONS)], F.lit(0))


def key_values(names: Column, first: Column, second: Column | None = None) -> Column:
    """The key values in the order of names: from first where it has the key, even with null, else from second.

    Presence decides, not nullness: a present null never falls back. Without second a missing key is null.
    """

    def one(k: Column) -> Column:
        found = F.try_element_at(first, k)
        if second is None:
            return found
        return F.when(F.coalesce(F.map_contains_key(first, k), F.lit(False)), found).otherwise(F.try_element_at(second, k))

    return F.transform(names, one)


def key_text(values: Column) -> Column:
    """Key values joined with ``|``; null for null names, empty for a table without key."""
    return F.array_join(values, "|", NULL_KEY)


def row_key(df: DataFrame) -> Column:
    return key_text(key_values(df["key_names"], df["before_image"], df["after_image"]))


def message_columns(df: DataFrame) -> dict[str, Column]:
    """What makes two rows copies of one message. Null names count as empty; COMMIT has no row key."""
    return {
        "instance_name": F.coalesce(df["instance_name"], F.lit("")),
        "lsn": df["lsn"],
        "schema_name": F.coalesce(df["schema_name"], F.lit("")),
        "table_name": F.coalesce(df["table_name"], F.lit("")),
        "row_key": F.when(df["action"] == "COMMIT", F.lit("")).otherwise(F.coalesce(row_key(df), F.lit(""))),
    }


def transactions(changes: DataFrame) -> DataFrame:
    """(instance_name, txn_id, commit_lsn): one row per transaction, null while no row of it knows its end."""
    return changes.groupBy("instance_name", "txn_id").agg(F.max("commit_lsn").alias("commit_lsn"))


def with_commit(changes: DataFrame, txns: DataFrame | None = None) -> DataFrame:
    """changes with commit_lsn filled on the rows sent before their transaction's end.

    Only the rows without one are joined; the others keep theirs and are not shuffled. A transaction whose end
    is not in the feed keeps null. Null instance or transaction ids never match.
    """
    known = changes.filter(F.col("commit_lsn").isNotNull())
    pending = changes.filter(F.col("commit_lsn").isNull()).drop("commit_lsn")
    txns = transactions(changes.filter(F.col("commit_lsn").isNotNull())) if txns is None else txns
    found = pending.join(txns, ["instance_name", "txn_id"], "left").select(changes.columns)
    return known.unionByName(found)


def _base() -> Column:
    """POSITION_BASE as a column; one beyond a long, so it is passed as text."""
    return F.lit(str(POSITION_BASE)).cast("decimal(19,0)")


def position(commit_lsn: Column, lsn: Column) -> Column:
    """Place in an instance's log order (commit_lsn, then lsn) as one exact number.

    A transaction whose end is unknown has not committed yet, so it is placed after every known position.
    """
    commit = F.coalesce(commit_lsn, F.lit(POSITION_BASE - 1)).cast("decimal(19,0)")
    return (commit * _base() + F.coalesce(lsn, F.lit(0)).cast("decimal(19,0)")).cast(POSITION_TYPE)


def position_lsn(pos: Column) -> Column:
    return (pos % _base()).cast("long")
