"""Tagged-union schema inference over tenants' files: what a table's columns are, and every change between files.

Each value is tagged by its content, quoted or not, and converted to one canonical text. Only one small record per
file and column, and the values of columns that go or come in one file, are brought together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ship, small, written

TABLE = ["schema_name", "table_name"]
CHANGES = "schema_name string, table_name string, file_no long, kind string, column_name string, old_name string"
_CELLS = "schema_name string, table_name string, file_no long, line_no int, action string, row_key string, column_name string, tag string, value string"
_WHOLE = re.compile(r"[+-]?\d+\Z", re.A)
_DECIMAL = re.compile(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?\Z", re.A)
_AT = re.compile(r"\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?)?\Z", re.A)
_FLAGS = {"true": "true", "t": "true", "false": "false", "f": "false"}


def tagged(v) -> tuple[str | None, str | None]:
    """(tag, canonical text) of a JSON value; (None, None) for null."""
    if v is None:
        return None, None
    if isinstance(v, bool):
        return "flag", str(v).lower()
    if isinstance(v, list):
        return "list", json.dumps([tagged(x)[1] for x in v], ensure_ascii=False)
    if isinstance(v, dict):
        return "text", json.dumps(v, ensure_ascii=False, sort_keys=True, default=str)
    s = str(v)
    t = s.strip()
    if isinstance(v, int) or _WHOLE.match(t):
        return "whole", str(Decimal(t))
    if isinstance(v, Decimal) or _DECIMAL.match(t):
        try:
            return "decimal", str(Decimal(t).normalize())
        except InvalidOperation:
            return "text", s
    if t.lower() in _FLAGS:
        return "flag", _FLAGS[t.lower()]
    if _AT.match(t):
        return "at", t.replace("T", " ")
    if t[:1] == "{" and t[-1:] == "}":
        return "list", json.dumps([tagged(x.strip().strip('"'))[1] for x in t[1:-1].split(",")] if t[1:-1].strip() else [], ensure_ascii=False)
    if t[:1] == "[" and t[-1:] == "]":
        try:
            return "list", json.dumps([tagged(x)[1] for x in json.loads(t, parse_float=Decimal)], ensure_ascii=False)
        except ValueError:
            pass
    return "text", s


def _bad(name):
    raise ValueError(name)


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _CELLS.split(", ")]
    for frame in frames:
        out = []
        for s, t, file_no, line_no, action, keys, text in frame.itertuples(index=False, name=None):
            try:
                image = json.loads(text, parse_float=Decimal, parse_constant=_bad) if text else None
            except (ValueError, RecursionError):
                continue
            if not isinstance(image, dict):
                continue
            cells = {c: tagged(v) for c, v in image.items()}
            key = [cells.get(k, (None, None))[1] for k in keys] if keys is not None else []
            key = None if not len(key) or None in key else "|".join(key)
            out.extend((s, t, file_no, line_no, action, key, c, *v) for c, v in cells.items())
            if not cells:  # the file is one of the table's all the same
                out.append((s, t, file_no, line_no, action, None, None, None, None))
        yield pd.DataFrame(out, columns=names)


def cells(feed: DataFrame) -> DataFrame:
    """One row for each column of each readable line, tagged; lines with unreadable or no JSON are left out.

    A line without columns has one row without column_name. Null schema or table names count as empty.
    """
    ship(feed.sparkSession)
    f = feed.select(
        F.coalesce("schema_name", F.lit("")).alias("schema_name"), F.coalesce("table_name", F.lit("")).alias("table_name"),
        "file_no", "line_no", "action", "key_names", "after_image",
    ).filter(F.col("after_image").isNotNull())
    return f.mapInPandas(_parse, _CELLS)


def _file_type(tags: set) -> str | None:
    tags = tags - {None}
    if tags == {"whole", "decimal"}:
        return "decimal"
    return next(iter(tags)) if len(tags) == 1 else "text" if tags else None


def _settled(seq: list[tuple[int, set]]) -> list[tuple[int, str]]:
    """(file, type) of the files in which a column has values.

    A column that mixes a type with another in some files has files with values of the one only by chance: between files of
    the wider type these are of the wider type too.
    """
    kinds = [(f, k) for f, tags in seq if (k := _file_type(tags))]
    mixed = {(narrow, _file_type(tags)) for _, tags in seq for narrow in tags - {None} if len(tags - {None}) > 1}
    out = []
    for i, (f, k) in enumerate(kinds):
        wider = [w for n, w in mixed if n == k != w and any(x == w for _, x in kinds[:i]) and any(x == w for _, x in kinds[i + 1 :])]
        out.append((f, wider[0] if wider else k))
    return out


def _lives(per_file: DataFrame) -> DataFrame:
    """(TABLE, column_name, came, gone): the file with which a column comes or goes, null if it was there from the first or to the last.

    A table's list of files is put in order once; columns meet it by joins.
    """
    in_order = Window.partitionBy(*TABLE).orderBy("file_no")
    files = per_file.select(*TABLE, "file_no").distinct().withColumn("__next", F.lead("file_no").over(in_order))
    starts = files.groupBy(*TABLE).agg(F.min("file_no").alias("__start"))
    spans = per_file.filter(F.col("column_name").isNotNull()).groupBy(*TABLE, "column_name").agg(F.min("file_no").alias("__first"), F.max("file_no").alias("file_no"))
    met = spans.join(files, [*TABLE, "file_no"]).join(starts, TABLE)
    return met.select(*TABLE, "column_name", F.when(F.col("__first") != F.col("__start"), F.col("__first")).alias("came"), F.col("__next").alias("gone"))


def _runs(per_file: DataFrame) -> DataFrame:
    """(TABLE, column_name, runs): the files with which a column's tags change, with the tags; files without values left out."""
    tags = F.sort_array(F.col("tags"))
    seen = per_file.filter(F.col("column_name").isNotNull() & (F.size("tags") > 0)).select(*TABLE, "column_name", "file_no", tags.alias("tags"))
    before = F.lag("tags").over(Window.partitionBy(*TABLE, "column_name").orderBy("file_no"))
    changed = seen.withColumn("__before", before).filter(F.col("__before").isNull() | (F.col("__before") != F.col("tags")))
    return changed.groupBy(*TABLE, "column_name").agg(F.sort_array(F.collect_list(F.struct("file_no", "tags"))).alias("runs"))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(TABLE, column_name, until, since) of each retyped column: the files before until are of its first type, those from since on of its last."""
    for batch in batches:
        out = []
        for s, t, column, runs in zip(*(c.to_pylist() for c in batch.columns)):
            seq = _settled([(r["file_no"], set(r["tags"])) for r in runs])
            turns = [f for (_, a), (f, b) in zip(seq, seq[1:]) if a != b]
            if turns:
                out.append({"schema_name": s, "table_name": t, "column_name": column, "until": turns[0], "since": turns[-1]})
        yield pa.RecordBatch.from_pylist(out, _TURNS_ARROW)


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the candidates of one file of a table the best first, each column once."""
    for batch in batches:
        out = []
        for s, t, f, candidates in zip(*(c.to_pylist() for c in batch.columns)):
            news, olds = set(), set()
            for c in sorted(candidates, key=lambda c: (-c["share"], -c["kept"], c["new_name"], c["old_name"])):
                if c["new_name"] not in news and c["old_name"] not in olds:
                    news.add(c["new_name"])
                    olds.add(c["old_name"])
                    out.append((s, t, f, c["new_name"], c["old_name"]))
        yield pa.RecordBatch.from_pylist([dict(zip(_PAIR_NAMES, r)) for r in out], _PAIR_ARROW)


def _retyped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(TABLE, file_no, column_name) for each change of a column's type; a renamed column goes on from its old type."""
    for batch in batches:
        out = []
        for s, t, column, runs, old in zip(*(c.to_pylist() for c in batch.columns)):
            seq = _settled([(r["file_no"], set(r["tags"])) for r in runs])
            was = _settled([(r["file_no"], set(r["tags"])) for r in old or []])
            seq = [*was[-1:], *seq]
            out += [{"schema_name": s, "table_name": t, "file_no": f, "column_name": column} for (_, a), (f, b) in zip(seq, seq[1:]) if a != b]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("schema_name", pa.string()), ("table_name", pa.string()), ("file_no", pa.int64()), ("column_name", pa.string())]))


_TURNS = "schema_name string, table_name string, column_name string, until long, since long"
_TURNS_ARROW = pa.schema([(n, pa.int64() if n in ("until", "since") else pa.string()) for n in ["schema_name", "table_name", "column_name", "until", "since"]])
_PAIR = "schema_name string, table_name string, file_no long, new_name string, old_name string"
_PAIR_NAMES = ["schema_name", "table_name", "file_no", "new_name", "old_name"]
_PAIR_ARROW = pa.schema([(n, pa.int64() if n == "file_no" else pa.string()) for n in _PAIR_NAMES])


def schema_changes(tagged_cells: DataFrame) -> DataFrame:
    """Every added, removed, renamed and retyped column, with the file of the change: CHANGES.

    Python sees, of a column, the files with which its tags change, and, of a file, the columns that go or come with it. Of
    the values only those of columns that go and come in one file are compared, by key. A type change writes values
    anew, so a column is renamed too if most rows keep their value among those seen before and after without one between.
    """
    ship(tagged_cells.sparkSession)
    per_file = tagged_cells.groupBy(*TABLE, "file_no", "column_name").agg(F.collect_set("tag").alias("tags"))
    per_file = written(per_file, "columns-per-file")
    lives = written(_lives(per_file).filter(F.col("came").isNotNull() | F.col("gone").isNotNull()), "lives")
    came = lives.select(*TABLE, F.col("came").alias("file_no"), F.col("column_name").alias("new_name")).filter("file_no is not null")
    gone = lives.select(*TABLE, F.col("gone").alias("file_no"), F.col("column_name").alias("old_name")).filter("file_no is not null")
    runs = written(_runs(per_file), "runs")
    turns = written(runs.filter(F.size("runs") > 1).select(*TABLE, "column_name", "runs").mapInArrow(_turns, _TURNS), "turns")
    turn = lambda name, at: turns.select(*TABLE, F.col("column_name").alias(name), at)
    pairs = came.join(gone, [*TABLE, "file_no"])
    pairs = written(pairs.join(turn("old_name", "since"), [*TABLE, "old_name"], "left").join(turn("new_name", "until"), [*TABLE, "new_name"], "left"), "pairs")
    valued = tagged_cells.filter(F.col("value").isNotNull() & F.col("row_key").isNotNull()).withColumnRenamed("file_no", "at")
    place = F.struct("at", "line_no")
    few = small(pairs, pairs.count(), 256)

    def under(name: str, alike: str) -> DataFrame:
        same = [valued["column_name"] == pairs[name], *[valued[c] == pairs[c] for c in TABLE]]
        cell = F.struct("value", F.coalesce(F.expr(alike), F.lit(True)).alias("alike")).alias("cell")
        return valued.join(few, same).select(*[valued[c] for c in TABLE], "file_no", "new_name", "old_name", "row_key", cell, "at", "line_no")

    old, new = under("old_name", "at >= since"), under("new_name", "at < until")
    pair = [*TABLE, "file_no", "new_name", "old_name"]
    last = old.groupBy(*pair, "row_key").agg(F.max_by("cell", place).alias("was"))
    first = new.groupBy(*pair, "row_key").agg(F.min_by("cell", place).alias("now"))
    same, alike = F.col("was.value") == F.col("now.value"), F.col("was.alike") & F.col("now.alike")
    kept = last.join(first, [*pair, "row_key"]).groupBy(*pair).agg(
        F.count_if(same).alias("kept"), F.count(F.lit(1)).alias("both"), F.count_if(same & alike).alias("kept_alike"), F.count_if(alike).alias("both_alike")
    )
    likely = kept.filter((F.col("kept") * 2 > F.col("both")) | (F.col("kept_alike") * 2 > F.col("both_alike")))
    likely = likely.withColumn("share", F.greatest(F.col("kept") / F.col("both"), F.try_divide("kept_alike", "both_alike")))
    candidates = likely.groupBy(*TABLE, "file_no").agg(F.collect_list(F.struct("new_name", "old_name", "kept", "share")).alias("candidates"))
    renamed = written(candidates.mapInArrow(_chosen, _PAIR), "renamed")

    before = renamed.select(*TABLE, F.col("new_name").alias("column_name"), F.col("old_name").alias("__old"))
    of_old = runs.select(*TABLE, F.col("column_name").alias("__old"), F.col("runs").alias("old_runs"))
    sequences = runs.join(before.join(of_old, [*TABLE, "__old"]), [*TABLE, "column_name"], "left").filter((F.size("runs") > 1) | F.col("old_runs").isNotNull())
    retyped = sequences.select(*TABLE, "column_name", "runs", "old_runs").mapInArrow(_retyped, "schema_name string, table_name string, file_no long, column_name string")

    none = F.lit(None).cast("string").alias("old_name")
    change = lambda df, kind, name, old=none: df.select(*TABLE, "file_no", F.lit(kind).alias("kind"), F.col(name).alias("column_name"), old)
    added = came.join(renamed, [*TABLE, "file_no", "new_name"], "left_anti")
    removed = gone.join(renamed, [*TABLE, "file_no", "old_name"], "left_anti")
    out = change(added, "added", "new_name").unionByName(change(removed, "removed", "old_name"))
    return out.unionByName(change(renamed, "renamed", "new_name", F.col("old_name"))).unionByName(change(retyped, "retyped", "column_name"))


def _final(pdf: pd.DataFrame) -> pd.DataFrame:
    to = dict(zip(pdf.old_name, pdf.column_name))
    out = []
    for c in to:
        end, seen = c, set()
        while end in to and end not in seen:
            seen.add(end)
            end = to[end]
        out.append((pdf.schema_name.iloc[0], pdf.table_name.iloc[0], c, end))
    return pd.DataFrame(out, columns=[*TABLE, "column_name", "final_name"])


def consistent_table(tagged_cells: DataFrame, changes: DataFrame) -> DataFrame:
    """(schema_name, table_name, file_no, line_no, action, row_key, columns): one row for each readable line, doubled lines once.

    columns holds every column its table ever had, under its last name: a struct of the tag and one typed branch for
    each tag, all null where the line has no value.
    """
    renamed = changes.filter("kind = 'renamed'")
    final = renamed.groupBy(*TABLE).applyInPandas(_final, "schema_name string, table_name string, column_name string, final_name string")
    final = written(final, "final-names")
    named = tagged_cells.filter(F.col("column_name").isNotNull()).join(small(final, final.count(), 256), [*TABLE, "column_name"], "left")
    named = named.withColumn("column_name", F.coalesce("final_name", "column_name")).drop("final_name")
    value, tag = F.col("value"), F.col("tag")
    union = F.struct(
        tag,
        F.when(tag == "whole", value.try_cast("decimal(38,0)")).alias("whole"),
        F.when(tag == "decimal", value.try_cast("double")).alias("decimal"),
        F.when(tag == "flag", value == "true").alias("flag"),
        F.when(tag == "at", F.try_to_timestamp(value)).alias("at"),
        F.when(tag == "list", F.from_json(value, "array<string>")).alias("list"),
        F.when(tag.isNotNull(), value).alias("text"),
    )
    line = [*TABLE, "file_no", "line_no", "action"]
    lines = named.groupBy(*line).agg(F.max("row_key").alias("row_key"), F.sort_array(F.collect_list(F.struct("column_name", union.alias("cell")))).alias("c"))
    once = lines.groupBy(*TABLE, "file_no", "action", "row_key", "c").agg(F.min("line_no").alias("line_no"))
    all_of = named.groupBy(*TABLE).agg(F.sort_array(F.collect_set("column_name")).alias("names"))
    held = F.map_from_entries(F.col("c"))
    columns = F.map_from_arrays(F.col("names"), F.transform("names", lambda n: F.try_element_at(held, n)))
    all_of = written(all_of, "all-columns")
    return once.join(small(all_of, all_of.count(), 4096), TABLE).select(*line, "row_key", columns.alias("columns"))
