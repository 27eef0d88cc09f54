"""Scalar functions on columns: positions, hashes, names, times, series, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import key_values

_LOW = (1 << 32) - 1


def lsn_text(lsn: Column) -> Column:
    """A position as two hexadecimal halves, HI/LO."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(_LOW))))


def lsn_number(text: Column) -> Column:
    """The inverse of lsn_text; null for other texts."""
    half = lambda i: F.conv(F.split_part(text, F.lit("/"), F.lit(i)), 16, 10).cast("long")
    return F.when(text.rlike("^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"), half(1) * F.lit(1 << 32) + half(2))


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def url_safe(data: Column) -> Column:
    """Binary as base64 for URLs."""
    return F.translate(F.base64(data), "+/", "-_")


def text_of(data: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def checkpoint_name(source_type: Column, instance_name: Column) -> Column:
    return F.format_string("%s_%s_ckpt.json", source_type, instance_name)


def time_text(unix_seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(unix_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_of(text: Column) -> Column:
    return F.unix_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def whole_number(text: Column) -> Column:
    """A positive whole number as entered; null for anything else."""
    n = F.when(F.trim(text).rlike("^[0-9]{1,19}$"), F.trim(text).try_cast("long"))
    return F.when(n > 0, n)


def backoff(base: float, cap: float, retries: Column) -> Column:
    """The waits before each retry, an array of seconds: doubling from base, at most cap."""
    n = F.greatest(retries.cast("int"), F.lit(0))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), i)))


def clamp(value: Column, low: float | int, high: float | int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def timeout_hint(stable_batch: Column, eps: Column) -> Column:
    """Milliseconds in which a stable batch fills at a rate, with 30 % room, within 20 to 5000; null without a rate."""
    return F.when((eps > 0) & (stable_batch > 0), clamp((stable_batch / eps * 1000.0 * 1.3).cast("long"), 20, 5000))


def worker_hint(pending: Column, eps: Column, workers: Column, cpus: int) -> Column:
    """One worker more where the backlog takes over 1.5 s at the rate, one less where under 0.1 s, within 1 and cpus."""
    backlog = pending / F.greatest(eps, F.lit(1.0))
    moved = F.when(backlog > 1.5, workers + 1).when(backlog < 0.1, workers - 1).otherwise(workers)
    return F.when((backlog > 1.5) | (backlog < 0.1), clamp(moved, 1, cpus)).otherwise(workers).cast("long")


def over_percent(used: Column, total: Column, percent: float) -> Column:
    return used * 100.0 / F.nullif(total, F.lit(0)) >= percent


def option(url: Column, name: str) -> Column:
    """A query option of a connection string; null if missing or empty."""
    return F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(""))


def without_options(url: Column, names: list[str]) -> Column:
    """A connection string without the named query options."""
    out = url
    for n in names:
        out = F.regexp_replace(out, rf"(?<=[?&]){n}=[^&]*&?", "")
    return F.regexp_replace(out, r"[?&]+$", "")


def row_key_text(names: Column, before: Column, after: Column) -> Column:
    """Key values, before first, joined with |; null values as \\N."""
    return F.array_join(key_values(names, before, after), "|", "\\N")
