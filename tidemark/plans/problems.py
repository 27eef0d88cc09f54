"""Queries of the general data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import apply, dedup, incremental, schema_drift, skew
from tidemark.session import shared_path, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = apply.apply_changes(table(spark, sf_dir, "changes"))
    return state.withColumn("row_key", apply.key_shown(F.col("row_key")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run into an empty sink: plan, read, merge, commit, retire."""
    sink = incremental.IncrementalSink(spark, shared_path(spark, "sink"))
    sink.run(table(spark, sf_dir, "changes"), table(spark, sf_dir, "checkpoint_files"))
    return sink.records().select("seq")


class _Stop(Exception):
    pass


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that runs leave in a sink: one stopped before its commit, its replay, and one with nothing new."""
    changes, files = table(spark, sf_dir, "changes"), table(spark, sf_dir, "checkpoint_files")
    sink = incremental.IncrementalSink(spark, shared_path(spark, "sink"), ["action", "after_image"])

    def stop(step: str) -> None:
        if step == "commit":
            raise _Stop

    try:
        sink.run(changes, files, stop)
    except _Stop:
        pass
    sink.run(changes, files)
    sink.run(changes, files)
    return sink.records().select("seq", "instance_name", "lsn", "schema_name", "table_name", "row_key", "action", "after_image")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf_dir, "changes"))


def p3_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_stats(table(spark, sf_dir, "changes"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.surplus(table(spark, sf_dir, "changes"))


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(table(spark, sf_dir, "changes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes with an empty old_name, not null, where nothing was renamed."""
    changes = schema_drift.schema_changes(written(schema_drift.cells(table(spark, sf_dir, "raw_feed")), "cells"))
    return changes.withColumn("old_name", F.coalesce("old_name", F.lit("")))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = written(schema_drift.cells(table(spark, sf_dir, "raw_feed")), "cells")
    return schema_drift.consistent_table(cells, schema_drift.schema_changes(cells))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_runs": p2_runs,
    "p3_found": p3_found,
    "p3_key_stats": p3_key_stats,
    "p4_found": p4_found,
    "p4_kept": p4_kept,
    "p5_found": p5_found,
    "p5_table": p5_table,
}

_ROW_KEY = """coalesce(array_to_string(list_transform(key_names, lambda k:
    coalesce(case when map_contains(before_image, k) then before_image[k] else after_image[k] end, '\\N')), '|'), '')"""

_MESSAGES = f"""messages as (
    select *, coalesce(schema_name, '') as s_name, coalesce(table_name, '') as t_name,
        case when action = 'COMMIT' then '' else {_ROW_KEY} end as row_key
    from changes)"""

_NEW = f"""usable as (
    select source_type, instance_name, try_cast(json_extract_string(checkpoint_data, '$.lsn') as bigint) as lsn,
        case when updated_at < 100000000000 then updated_at * 1000000 when updated_at < 100000000000000 then updated_at * 1000 else updated_at end as moment
    from checkpoint_files
    where not ends_with(file_name, '.tmp') and updated_at > 0 and json_valid(checkpoint_data)
        and json_type(checkpoint_data) = 'OBJECT' and regexp_full_match(json_extract_string(checkpoint_data, '$.lsn'), '[0-9]+')),
force as (select source_type, instance_name, max_by(lsn, row(moment, lsn)) as reached from usable where lsn > 0 group by all),
txns as (select instance_name, txn_id, max(commit_lsn) as ended from changes group by all),
{_MESSAGES},
fresh as (select min(m.seq) as seq, m.instance_name, m.lsn, m.s_name, m.t_name, m.row_key from messages m join txns t on m.instance_name = t.instance_name and m.txn_id = t.txn_id
    left join force f on f.source_type = m.source_type and f.instance_name = m.instance_name
where m.t_name <> '' and (f.reached is null or t.ended is null or t.ended > f.reached)
group by m.instance_name, m.lsn, m.s_name, m.t_name, m.row_key)"""

SQL: dict[str, str] = {
    "p2_found": f"with {_NEW} select seq from fresh",
    "p2_runs": f"""with {_NEW}
select f.seq, f.instance_name, f.lsn, f.s_name as schema_name, f.t_name as table_name, f.row_key, c.action, c.after_image from fresh f join changes c using (seq)""",
    "p3_found": f"""
with keyed as (select schema_name, table_name, {_ROW_KEY} as row_key from changes
    where action in ('INSERT', 'UPDATE', 'DELETE') and len(key_names) > 0)
select schema_name, table_name, row_key from keyed group by all having count(*) >= 0.02 * (select count(*) from keyed)""",
    "p3_key_stats": f"""
with keyed as (select instance_name, schema_name, table_name, {_ROW_KEY} as row_key, coalesce(lsn, -1) as lsn, seq, action from changes
    where action in ('INSERT', 'UPDATE', 'DELETE') and len(key_names) > 0)
select instance_name, schema_name, table_name, row_key, count(*) as n, max(lsn) as last_lsn, max_by(action, row(lsn, seq)) as last_action
from keyed group by all""",
    "p4_found": f"""
with {_MESSAGES}
select seq from (select seq, row_number() over (partition by instance_name, lsn, s_name, t_name, row_key order by seq) as n from messages) where n > 1""",
    "p4_kept": f"""
with {_MESSAGES}, kept as (select min(seq) as seq from messages group by instance_name, lsn, s_name, t_name, row_key)
select c.* from changes c join kept using (seq)""",
}
