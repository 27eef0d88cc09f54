"""Processing only new or changed records.

A run reads, for each partition of the log (source type and instance), the messages after the position that is
safely reached and up to the log's end when the run was planned. The plan is written before any record is read and is
replayed, not planned anew, when the run failed. The sink keeps one copy per key and offset, so that neither a
replay nor a repeated delivery adds a record. Only when the sink has the records are the positions advanced; then the plan is
retired. A failure at any point leaves a state from which the next run goes on.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import message_columns, transactions, with_commit
from tidemark.session import delete_path, path_exists, rename_path, shared_path, small, written
from tidemark.sources.checkpoint_files import in_force

PARTITION = ["source_type", "instance_name"]
IDENTITY = ["instance_name", "lsn", "schema_name", "table_name", "row_key"]
PLAN = T.StructType([*[T.StructField(c, T.StringType()) for c in PARTITION], T.StructField("from_lsn", T.LongType()), T.StructField("to_lsn", T.LongType())])
POSITIONS = T.StructType([*[T.StructField(c, T.StringType()) for c in PARTITION], T.StructField("lsn", T.LongType())])
#: Partitions of the log up to which their offsets are also pushed to the scan as conditions, only to skip row groups.
PUSHED = 256


@dataclass
class BatchPlan:
    """The offsets of one run, as written: (source_type, instance_name, from_lsn exclusive, to_lsn inclusive).

    to_lsn is null where no transaction of the instance has ended.
    """

    spark: SparkSession
    path: str

    def offsets(self) -> DataFrame:
        return self.spark.read.schema(PLAN).parquet(self.path)


def write_plan(changes: DataFrame, txns: DataFrame, reached: DataFrame, path: str | None = None) -> BatchPlan:
    """Write the plan of the next run, or take the one at path if a failed run left it there whole.

    txns are the transactions of changes; reached has (source_type, instance_name, lsn). Partitions without a position
    start below every record. An instance counts its positions for all its source types, so they share the log's end.
    The plan's folder gets its name only when it is whole, so a half-written plan counts as none.
    """
    spark = changes.sparkSession
    path = path or shared_path(spark, "batch-plan")
    if path_exists(spark, path):
        return BatchPlan(spark, path)
    ends = txns.groupBy(F.col("instance_name").alias("e_instance")).agg(F.max("commit_lsn").alias("to_lsn"))
    parts = changes.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("n")).drop("n")
    start = reached.select(*[F.col(c).alias(f"r_{c}") for c in PARTITION], F.col("lsn").alias("from_lsn"))
    same = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in PARTITION]
    plan = parts.join(start, same[0] & same[1], "left").join(ends, F.col("instance_name").eqNullSafe(F.col("e_instance")), "left")
    plan = plan.select(*PARTITION, F.coalesce("from_lsn", F.lit(-1)).alias("from_lsn"), "to_lsn")
    plan.coalesce(1).write.mode("overwrite").parquet(f"{path}.tmp")
    rename_path(spark, f"{path}.tmp", path)
    return BatchPlan(spark, path)


def planned(changes: DataFrame, txns: DataFrame, plan: BatchPlan, columns: list[str]) -> DataFrame:
    """The rows of the plan's ranges, copies included, with the given columns of changes.

    A transaction belongs to a run by its commit position as a whole. One whose end is not known yet lies after
    every position reached, so its rows are in each run until it ends; the sink keeps one copy. The plan is read back,
    one row for each partition of the log, so that the scan can skip what lies before the positions.
    """
    need = list(dict.fromkeys([*columns, "instance_name", "source_type", "txn_id", "commit_lsn"]))
    offsets = plan.offsets()
    n = offsets.count()
    scan = changes.select(*need)
    if 0 < n <= PUSHED:
        after = [F.col("instance_name").eqNullSafe(F.lit(o.instance_name)) & (F.col("commit_lsn") > o.from_lsn) for o in offsets.groupBy("instance_name").agg(F.min("from_lsn").alias("from_lsn")).collect()]
        scan = scan.filter(F.col("commit_lsn").isNull() | reduce(lambda a, b: a | b, after))
    rows = with_commit(scan, txns.filter(F.col("commit_lsn").isNotNull()))
    offsets = offsets.select(*[F.col(c).alias(f"p_{c}") for c in PARTITION], "from_lsn", "to_lsn")
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in PARTITION]
    within = F.col("commit_lsn").isNull() | ((F.col("commit_lsn") > F.col("from_lsn")) & (F.col("commit_lsn") <= F.col("to_lsn")))
    return rows.join(small(offsets, n, 256), same[0] & same[1]).filter(within).select(*columns)


MESSAGE_COLUMNS = ["instance_name", "lsn", "schema_name", "table_name", "action", "key_names", "before_image", "after_image"]


def _log_ends(changes: DataFrame) -> DataFrame:
    """Transactions with their ends, from every row: often only the commit marker, which has no table, knows the end."""
    return written(transactions(changes), "transactions")


def new_messages(changes: DataFrame, files: DataFrame, plan_path: str | None = None, keep: list[str] = ()) -> DataFrame:
    """(instance_name, lsn, schema_name, table_name, row_key, seq, keep): each row message after the checkpoint in force, once.

    Of its copies the one with the smallest seq stays, with the columns keep of it. Events with an empty or null table are
    not row messages. Missing or unusable checkpoints: every message of the partition. Empty tables give an empty result.
    The plan is written before this returns.
    """
    return _messages(changes, in_force(files), plan_path, keep)


def _messages(changes: DataFrame, reached: DataFrame, plan_path: str | None, keep: list[str]) -> DataFrame:
    txns = _log_ends(changes)
    plan = write_plan(changes, txns, reached, plan_path)
    rows = planned(changes, txns, plan, list(dict.fromkeys([*MESSAGE_COLUMNS, "seq", *keep])))
    rows = rows.filter(F.coalesce("table_name", F.lit("")) != "")
    more = [c for c in keep if c not in (*IDENTITY, "seq")]
    slim = rows.select(*[c.alias(n) for n, c in message_columns(rows).items()], "seq", *more)
    if not more:
        return slim.groupBy(*IDENTITY).agg(F.min("seq").alias("seq"))
    first = F.min_by(F.struct("seq", *more), "seq").alias("m")
    return slim.groupBy(*IDENTITY).agg(first).select(*IDENTITY, "m.*")


def merge_into_sink(sink: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that the sink lacks, by key and offset: replaying a batch adds nothing."""
    held = sink.select(*[F.col(c).alias(f"h_{c}") for c in IDENTITY])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in IDENTITY])
    return rows.join(held, same, "left_anti")


class IncrementalSink:
    """A folder of records, fed by runs: parts/ (one folder a run), plan/ (of the run under way), positions/.

    Records have the identity columns, seq and keep.
    """

    def __init__(self, spark: SparkSession, path: str, keep: list[str] = ()):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), list(keep)

    def _run_no(self) -> int:
        """The number of the run to do: positions are committed as one folder per finished run."""
        n = 0
        while path_exists(self.spark, f"{self.path}/positions/{n}"):
            n += 1
        return n

    def positions(self) -> DataFrame | None:
        n = self._run_no()
        return self.spark.read.schema(POSITIONS).parquet(f"{self.path}/positions/{n - 1}") if n else None

    def records(self) -> DataFrame | None:
        """The records of every finished or failed run; a failed run's part is written over by its replay."""
        parts = [p for n in range(self._run_no() + 1) if path_exists(self.spark, p := f"{self.path}/parts/{n}")]
        return self.spark.read.parquet(*parts) if parts else None

    def run(self, changes: DataFrame, files: DataFrame, fail: Callable[[str], None] = lambda step: None) -> int:
        """Process what is new since the last finished run; returns the run's number.

        The first run starts from the checkpoints in force. fail is called before each step, for tests of failures.
        """
        spark, n = self.spark, self._run_no()
        plan_path = f"{self.path}/plan/{n}"
        reached = self.positions() if n else in_force(files)
        fail("plan")
        rows = _messages(changes, reached, plan_path, self.keep)
        earlier = [p for k in range(n) if path_exists(spark, p := f"{self.path}/parts/{k}")]
        if earlier:
            rows = merge_into_sink(spark.read.parquet(*earlier), rows)
        fail("write")
        rows.write.mode("overwrite").parquet(f"{self.path}/parts/{n}")
        fail("commit")
        done = BatchPlan(spark, plan_path).offsets()
        moved = done.select(*PARTITION, F.greatest("from_lsn", "to_lsn").alias("lsn")).filter("lsn >= 0")
        if n:  # a partition that has no record left in the log keeps its position
            moved = moved.unionByName(reached).groupBy(*PARTITION).agg(F.max("lsn").alias("lsn"))
        moved.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/positions.tmp")
        _mkdir(spark, f"{self.path}/positions")
        rename_path(spark, f"{self.path}/positions.tmp", f"{self.path}/positions/{n}")
        fail("retire")
        delete_path(spark, plan_path)
        return n

    def state(self) -> str:
        """What the next run does, as JSON: its number and whether it replays a plan."""
        n = self._run_no()
        return json.dumps({"run": n, "replays": path_exists(self.spark, f"{self.path}/plan/{n}")})


def _mkdir(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
