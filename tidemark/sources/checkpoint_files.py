"""Checkpoint files: which writes are usable and which position is safely reached."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unix_micros(at: Column) -> Column:
    """A Unix time in seconds, milliseconds, microseconds or nanoseconds, told apart by its size, in microseconds."""
    return (
        F.when(at < 100_000_000_000, at * 1_000_000)
        .when(at < 100_000_000_000_000, at * 1000)
        .when(at < 100_000_000_000_000_000, at)
        .otherwise((at / 1000).cast("long"))
    )


def checkpoint_lsn(text: Column) -> Column:
    """The positive whole ``lsn`` of a JSON object, quoted or not; null for anything else, damaged text included."""
    whole = F.trim(text)
    object_text = F.when(whole.startswith("{") & whole.endswith("}"), whole)
    strict = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowComments": "false"}
    found = F.try_element_at(F.from_json(object_text, "map<string,string>", strict), F.lit("lsn"))
    lsn = F.when(found.rlike("^[0-9]{1,19}$"), found.try_cast("long"))
    return F.when(lsn > 0, lsn)


def usable(files: DataFrame) -> DataFrame:
    """The usable writes with lsn and at (microseconds): not .tmp, a time above 0, a readable position."""
    return (
        files.filter(~F.coalesce(F.col("file_name"), F.lit("")).endswith(".tmp") & (F.col("updated_at") > 0))
        .withColumn("lsn", checkpoint_lsn(F.col("checkpoint_data")))
        .filter(F.col("lsn").isNotNull())
        .withColumn("at", unix_micros(F.col("updated_at")))
    )


def in_force(files: DataFrame) -> DataFrame:
    """(source_type, instance_name, lsn): the usable write latest in time; of equal times the greatest lsn."""
    latest = F.max(F.struct("at", "lsn"))
    return usable(files).groupBy("source_type", "instance_name").agg(latest.alias("m")).select("source_type", "instance_name", F.col("m.lsn").alias("lsn"))


def file_name(source_type: str, instance_name: str) -> str:
    return f"{source_type}_{instance_name}_ckpt.json"


def save(folder: str, source_type: str, instance_name: str, lsn: int, at: int) -> str:
    """Write a checkpoint file as a whole, under another name first, and return its path. at is a Unix time in seconds."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, file_name(source_type, instance_name))
    body = {"instance_name": instance_name, "source_type": source_type, "checkpoint_data": {"lsn": str(lsn)}, "updated_at": at}
    with open(f"{path}.tmp", "w") as f:
        json.dump(body, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
    return path


def load(folder: str, source_type: str, instance_name: str) -> int | None:
    """The position in a checkpoint file: None if there is no file or no usable position in it; a broken file is an error.

    Fields that are not known are passed over.
    """
    path = os.path.join(folder, file_name(source_type, instance_name))
    if not os.path.exists(path):
        return None
    with open(path) as f:
        body = json.load(f)
    data = body.get("checkpoint_data") if isinstance(body, dict) else None
    text = str(data.get("lsn", "")) if isinstance(data, dict) else ""
    return int(text) if text.isascii() and text.isdigit() and int(text) > 0 else None


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """The checkpoint files of a folder as a table of writes: file_name, instance_name, source_type, checkpoint_data, updated_at."""
    body = F.col("value")
    text = spark.read.option("wholetext", True).option("pathGlobFilter", "*_ckpt.json*").text(folder)
    get = lambda k: F.get_json_object(body, f"$.{k}")
    return text.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), get("instance_name").alias("instance_name"),
        get("source_type").alias("source_type"), get("checkpoint_data").alias("checkpoint_data"), get("updated_at").try_cast("long").alias("updated_at"),
    )
