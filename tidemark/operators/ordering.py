"""Positions in an order, running values and cuts, without one task that sees every row.

Rows are range-partitioned by (group, order); a partition numbers its own rows, and what comes before each partition is
the sum of the partitions before it, a table of one row per group and partition. A group with most of the rows is
spread over many partitions like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import small, written

#: Bytes a row of the table of partition totals is taken to have, names of groups included.
_TOTALS_ROW = 256


def ranged(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """df with __part, written: near-equal ranges of (by, order), split on quantiles that Spark samples.

    Without a number Spark takes the session's and joins neighbouring ranges that are small.
    """
    cut = df.repartitionByRange(partitions, *by, *order) if partitions else df.repartitionByRange(*by, *order)
    return written(cut.withColumn("__part", F.spark_partition_id()), "ranged")


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> Column:
    cond = left["__part"] == right["__p"]
    for c in by:
        cond = cond & left[c].eqNullSafe(right[f"__b_{c}"])
    return cond


def running(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], partitions: int | None = None) -> DataFrame:
    """df with one more column for each of values, name: (kind, column), taken over the rows of its group up to it.

    kind: sum, max, max_before (the row itself left out), min, last (the newest that is not null). Null groups are a group. Rows of equal order get one of the
    possible results; give an order that tells rows apart.
    """
    spread = ranged(df.withColumns({f"__v_{n}": c for n, (_, c) in values.items()}), by, order, partitions)
    upto = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*[f"__b_{c}" for c in by]).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max, "max_before": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    last_of = F.struct(*order)

    def total(name: str, kind: str) -> Column:
        v = F.col(f"__v_{name}")
        return F.max_by(v, F.when(v.isNotNull(), last_of)) if kind == "last" else fold[kind](v)

    totals = spread.groupBy(*[F.col(c).alias(f"__b_{c}") for c in by], F.col("__part").alias("__p")).agg(*[total(n, k).alias(f"__t_{n}") for n, (k, _) in values.items()])
    carried = totals.withColumns({f"__c_{n}": fold[k](F.col(f"__t_{n}")).over(before) for n, (k, _) in values.items()})
    carried = written(carried.drop(*[f"__t_{n}" for n in values]), "carried")
    joined = spread.join(small(carried, carried.count(), _TOTALS_ROW), _same(spread, carried, by), "left")

    def whole(name: str, kind: str) -> Column:
        own, held = fold[kind](F.col(f"__v_{name}")).over(ahead if kind == "max_before" else upto), F.col(f"__c_{name}")
        if kind == "sum":
            return F.when(own.isNull() & held.isNull(), F.lit(None)).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(held, F.lit(0)))
        return {"max": F.greatest(own, held), "max_before": F.greatest(own, held), "min": F.least(own, held), "last": F.coalesce(own, held)}[kind]

    return joined.select(*df.columns, *[whole(n, k).alias(n) for n, (k, _) in values.items()])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """df with the row's place in its group, from 0."""
    counted = running(df, by, order, {name: ("sum", F.lit(1).cast("long"))}, partitions)
    return counted.withColumn(name, F.col(name) - 1)


def as_of(rows: DataFrame, facts: DataFrame, by: list[str], at: str, values: list[str], found: str | None = None) -> DataFrame:
    """rows with values of the newest fact of the same group whose at is less than the row's; null where there is none.

    found names a boolean column that tells whether there was one. Of facts with an equal at, one is taken.
    """
    fact = F.struct(F.col(at), *[F.col(v) for v in values])
    cols = [c for c in rows.columns if c not in values]
    left = rows.select(*cols, F.lit(0).alias("__kind"), F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("__fact"))
    right = facts.select(*[(F.col(c) if c in [*by, at] else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in cols], F.lit(1).alias("__kind"), fact.alias("__fact"))
    both = running(left.unionByName(right), by, [at, "__kind"], {"__found": ("last", F.col("__fact"))})
    out = both.filter(F.col("__kind") == 0).select(*cols, *[F.col(f"__found.{v}").alias(v) for v in values], F.col("__found").isNotNull().alias("__has"))
    return out.withColumnRenamed("__has", found) if found else out.drop("__has")
