"""Session helpers: the shared folder, written intermediates and their removal, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of bytes that this library broadcasts; larger sides are shuffled.
BROADCAST_BYTES = 64 << 20

_SETTING = "spark.checkpoint.dir"
_made: list[str] = []
_shipped: set[str] = set()


def local_session(cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.files.openCostInBytes", "524288")  # small tables too are read by several tasks
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once in an application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    own = tempfile.mkdtemp(prefix="tidemark-code-")
    atexit.register(shutil.rmtree, own, True)
    with zipfile.ZipFile(f"{own}/{root.name}.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(f"{own}/{root.name}.zip")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the setting spark.checkpoint.dir names it.

    Where it is unset, a local master gets a temporary folder of its own; on a cluster that is an error, as no other
    machine could read it.
    """
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.conf.set(_SETTING, found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, to be removed by clean()."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder of any file system that Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def rename_path(spark: SparkSession, old: str, new: str) -> bool:
    """Move a file or folder within one file system; false if new is there already."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(b) and bool(fs.rename(a, b))


def clean(spark: SparkSession) -> int:
    """Remove the intermediates that this process has written; to be called when the results that read them are stored."""
    removed = sum(delete_path(spark, p) for p in _made)
    _made.clear()
    return removed


def written(df: DataFrame, name: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back. This runs a job at once.

    It cuts the lineage with a durable copy: a lost executor costs a re-read, not a recomputation, and the reader knows
    the exact size on disk, which is what lets Spark choose a join strategy by size.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    out = df.write.option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if ``rows * row_bytes`` is within BROADCAST_BYTES; unchanged, so joined by shuffle, beyond."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
