"""Applying a stream of inserts, updates and deletes: the state of keyed tables, column by column.

The state of a row is ABSENT or a set of columns. Events apply in log order and are not last-write-wins:

* INSERT creates the row, or overwrites only the listed columns of one that exists;
* UPDATE overwrites the listed columns of a row that exists and never creates one;
* an UPDATE that changes key columns moves the row, which keeps its other columns;
* DELETE removes the row; a later UPDATE does not bring it back;
* no images, no key names, a null or missing key value, other actions: no effect.

Newest first
------------
Change batches, ranges of each instance's log, are processed backwards. A batch is folded to one record per key, combined
map-side, and written: per column the newest position at which it is listed, the newest DELETE, the first and last INSERT.
Keys that a newer batch has resolved with a tombstone are anti-joined away; of the others the first-seen images are
recorded. Base rows whose key no change names are appended at the end as they are.

The newest position of a column does not depend on whether the row existed then: a value counts if its position is not
before the row's birth, the first INSERT after the last DELETE. So one fold is enough, except for keys that are created
again in the batch in which they are deleted: their events after the DELETE are folded once more. A key with a third of
all events costs each task one record. Copies of a message list the same columns at the same position and change nothing.

Moved keys
----------
An UPDATE that moves a row ends a span of the log for the key that it leaves and for the key that it enters. Events of
such keys are told apart by span, found as of their position over ranges of (key, position), so that a key with many
moves is spread as well. A span is folded like a key; then the spans, one record for each move, are linked to the one
that takes over the row, and each chain is evaluated in order. A chain is as long as its row was moved often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import POSITION_BASE, POSITION_TYPE, key_values, position, position_lsn, transactions, with_commit
from tidemark.operators.ordering import as_of, running
from tidemark.session import ship, small, written

TABLE = ["instance_name", "schema_name", "table_name"]
KEY = [*TABLE, "row_key"]
#: A key's span of the log; keys that were never moved have one, from _START.
UNIT = [*KEY, "start"]
STATE = T.StructType([*[T.StructField(c, T.StringType()) for c in [*KEY, "column_name"]], T.StructField("lsn", T.LongType())])
#: Columns held in one folded record; wider tables take several records per key.
SLOTS = 8
#: Ranges of the log that are processed one after the other, newest first.
BATCHES = 3
_START = -1
_KEY_BYTES = 256


def key_identity(values: Column) -> Column:
    """Key values as one text that tells all keys apart: joined with |, with a backslash before a | or \\ within a value."""
    escaped = F.transform(values, lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")))
    joined = F.array_join(values, "|")
    separators = F.length(joined) - F.length(F.replace(joined, F.lit("|"), F.lit("")))
    plain = ~F.contains(joined, F.lit("\\")) & (separators == F.size(values) - 1)
    return F.when(plain, joined).otherwise(F.array_join(escaped, "|"))


def key_shown(identity: Column) -> Column:
    """The key values of key_identity, simply joined with |."""
    return F.when(F.contains(identity, F.lit("\\")), F.regexp_replace(identity, r"\\(.)", "$1")).otherwise(identity)


def _has_null(values: Column) -> Column:
    return F.exists(values, lambda v: v.isNull())


def row_events(changes: DataFrame) -> DataFrame:
    """The events that can have an effect, slim: key, position, op (I, U, D), listed non-key columns, new key.

    new_key is set where an UPDATE moves the row. Events of one row are told apart by position only, so the
    payload, the values, is left behind.
    """
    c = changes.filter(
        (F.coalesce("table_name", F.lit("")) != "")
        & (F.size("key_names") > 0)
        & (
            (F.col("action").isin("INSERT", "UPDATE") & (F.coalesce(F.size("after_image"), F.lit(0)) > 0))
            | ((F.col("action") == "DELETE") & (F.coalesce(F.size("before_image"), F.lit(0)) > 0))
        )
    )
    names, before, after = F.col("key_names"), F.col("before_image"), F.col("after_image")
    key = (
        F.when(F.col("action") == "INSERT", key_values(names, after))
        .when(F.col("action") == "UPDATE", key_values(names, before, after))
        .otherwise(key_values(names, before))
    )
    c = c.withColumn("__key", key).filter(~_has_null(F.col("__key")))
    target = F.transform(
        F.arrays_zip(names.alias("n"), F.col("__key").alias("v")),
        lambda p: F.when(F.map_contains_key(after, p["n"]), F.try_element_at(after, p["n"])).otherwise(p["v"]),
    )
    c = c.withColumn("__new", F.when((F.col("action") == "UPDATE") & before.isNotNull(), target))
    # a key column set to null violates the destination's key and has no effect
    c = c.filter(F.col("__new").isNull() | ~_has_null(F.col("__new")))
    return c.select(
        "instance_name",
        F.coalesce("schema_name", F.lit("")).alias("schema_name"),
        "table_name",
        key_identity(F.col("__key")).alias("row_key"),
        F.substring("action", 1, 1).alias("op"),
        position(F.col("commit_lsn"), F.col("lsn")).alias("pos"),
        "commit_lsn",
        F.when(F.col("action") != "DELETE", F.array_except(F.map_keys(after), names)).alias("cols"),
        F.when(F.col("__new") != F.col("__key"), key_identity(F.col("__new"))).alias("new_key"),
    )


def _batched(events: DataFrame, txns: DataFrame, batches: int) -> DataFrame:
    """events with batch 0 (oldest) to batches - 1, cut at quantiles of the commit positions of each instance."""
    at = [i / batches for i in range(1, batches)]
    cuts = txns.groupBy("instance_name").agg(F.percentile_approx("commit_lsn", F.array(*map(F.lit, at)), 1000).alias("cuts"))
    cuts = written(cuts, "batch-cuts")
    cut = small(cuts, cuts.count(), 200)
    batch = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda x: F.coalesce("commit_lsn", F.lit(POSITION_BASE - 1)) > x))
    return events.join(cut, "instance_name", "left").withColumn("batch", batch).drop("cuts", "commit_lsn")


def _seeded(base: DataFrame) -> DataFrame:
    """Base rows, a state, as INSERT events below every change; one for each set of columns with one lsn.

    A row of base without column_name tells that the row is present; it lists no column.
    """
    grouped = base.groupBy(*KEY, "lsn").agg(F.collect_set("column_name").alias("cols"))
    return grouped.select(
        *KEY, F.lit("I").alias("op"), F.coalesce("lsn", F.lit(0)).cast(POSITION_TYPE).alias("pos"), "cols",
        F.lit(None).cast("string").alias("new_key"), F.lit(0).alias("batch"),
    )


class _Slots:
    """The columns of each table in alphabetical order, cut into groups of SLOTS."""

    def __init__(self, events: DataFrame):
        columns = events.select("schema_name", "table_name", F.explode("cols").alias("column_name")).distinct()
        groups = columns.groupBy("schema_name", "table_name").agg(F.sort_array(F.collect_set("column_name")).alias("names"))
        self.catalog = written(groups, "columns")
        self.tables, width = self.catalog.agg(F.count(F.lit(1)), F.max(F.size("names"))).first()
        self.groups = max(1, -(-(width or 0) // SLOTS))

    def _names(self) -> DataFrame:
        return small(self.catalog, self.tables, 64 * SLOTS * self.groups)

    def spread(self, events: DataFrame) -> DataFrame:
        """events with grp and s0.., the position in the slot of each listed column."""
        e = events.join(self._names(), ["schema_name", "table_name"], "left")
        first = F.lit(0)
        if self.groups > 1:
            used = F.transform(F.col("cols"), lambda c: F.floor((F.array_position("names", c) - 1) / SLOTS).cast("int"))
            e = e.withColumn("grp", F.explode(F.array_union(F.array(F.lit(0)), F.coalesce(used, F.array().cast("array<int>")))))
            first = F.col("grp") * SLOTS
        else:
            e = e.withColumn("grp", F.lit(0))
        slots = {f"s{i}": F.when(F.array_contains("cols", F.get("names", first + i)), F.col("pos")) for i in range(SLOTS)}
        return e.withColumns(slots).drop("names", "cols")

    def named(self, folded: DataFrame, keep: list[str]) -> DataFrame:
        """folded as rows (keep, column_name, pos), one for each filled slot."""
        f = folded.join(self._names(), ["schema_name", "table_name"], "left")
        pairs = F.array(*[F.struct(F.get("names", F.col("grp") * SLOTS + i).alias("column_name"), F.col(f"s{i}").alias("pos")) for i in range(SLOTS)])
        return f.select(*keep, F.explode(F.filter(pairs, lambda p: p["pos"].isNotNull())).alias("p")).select(*keep, "p.*")


_FOLD = [f"s{i}" for i in range(SLOTS)]


def _fold(spread: DataFrame, by: list[str]) -> DataFrame:
    """One record per key: newest position per slot, newest DELETE, first and last INSERT. Combined map-side."""
    op, pos = F.col("op"), F.col("pos")
    return spread.groupBy(*by).agg(
        *[F.max(s).alias(s) for s in _FOLD],
        F.max(F.when(op == "D", pos)).alias("died"),
        F.min(F.when(op == "I", pos)).alias("born"),
        F.max(F.when(op == "I", pos)).alias("reborn"),
    )


def _newest_first(parts: list[DataFrame], slots: _Slots) -> DataFrame:
    """(UNIT, grp, slots, born, dead) of parts, the batches from the oldest to the newest, processed backwards.

    dead tells that a DELETE lies before what is recorded: nothing older, and no row that moves here, counts.
    """
    records: list[DataFrame] = []
    resolved: list[DataFrame] = []
    none = [F.lit(None).cast(POSITION_TYPE).alias(c) for c in [*_FOLD, "born"]]
    for events in reversed(parts):
        images = _fold(slots.spread(events), [*UNIT, "grp"])
        if resolved:
            images = images.join(reduce(DataFrame.union, resolved), UNIT, "left_anti")
        images = written(images, "batch-images")
        gone = images.filter(F.col("died").isNotNull() & (F.col("grp") == 0)).select(*UNIT, "died", "reborn")
        again = gone.filter(F.col("reborn") > F.col("died")).select(*UNIT, "died")
        # every event is in group 0; where there are others, they learn of the tombstone from it
        kept = images.filter(F.col("died").isNull()) if slots.groups == 1 else images.join(gone.select(*UNIT), UNIT, "left_anti")
        records.append(kept.select(*UNIT, "grp", *_FOLD, "born", F.lit(False).alias("dead")))
        records.append(gone.select(*UNIT, F.lit(0).alias("grp"), *none, F.lit(True).alias("dead")))
        later = events.join(small(again, again.count(), _KEY_BYTES), UNIT).filter(F.col("pos") > F.col("died")).drop("died")
        records.append(_fold(slots.spread(later.select(events.columns)), [*UNIT, "grp"]).select(*UNIT, "grp", *_FOLD, "born", F.lit(True).alias("dead")))
        resolved.append(gone.select(*UNIT))
    found = reduce(DataFrame.unionByName, records)
    return found.groupBy(*UNIT, "grp").agg(*[F.max(s).alias(s) for s in _FOLD], F.min("born").alias("born"), F.max("dead").alias("dead"))


def _borders(moves: DataFrame) -> DataFrame:
    """(KEY, pos, kind, to_key): where spans of moved keys end. kind: O moved away to to_key, N moved here."""
    away = moves.select(*KEY, "pos", F.lit("O").alias("kind"), F.col("new_key").alias("to_key"))
    here = moves.select(*TABLE, F.col("new_key").alias("row_key"), "pos", F.lit("N").alias("kind"), F.lit(None).cast("string").alias("to_key"))
    # one statement can move a row away from a key and another to it: what was there goes first, one border for both
    any_of = [F.max(F.when(F.col("kind") == k, F.lit(k))) for k in "ON"]
    return away.unionByName(here).groupBy(*KEY, "pos").agg(F.coalesce(*any_of).alias("kind"), F.max("to_key").alias("to_key"))


def _spans(borders: DataFrame) -> DataFrame:
    """(KEY, start, until, next_key): consecutive spans of each moved key; next_key holds the row after until."""
    start = F.coalesce("start", F.lit(_START).cast(POSITION_TYPE)).alias("start")
    ended = running(borders, KEY, ["pos"], {"start": ("max_before", F.col("pos"))})
    next_key = F.when(F.col("kind") == "O", F.col("to_key")).otherwise(F.col("row_key"))
    ended = ended.select(*KEY, start, F.col("pos").alias("until"), next_key.alias("next_key"))
    last = borders.groupBy(*KEY).agg(F.max("pos").alias("start"))
    return ended.unionByName(last.select(*KEY, "start", F.lit(None).cast(POSITION_TYPE).alias("until"), F.lit(None).cast("string").alias("next_key")))


def _rooted(spans: DataFrame) -> DataFrame:
    """Spans with root_key, root_start: the last span that their row reaches. Spans whose row dies are left out.

    Links are followed by pointer doubling, so the number of rounds is the logarithm of the longest chain of moves.
    """
    link = spans.select(
        *KEY, "start", "until",
        F.when(F.col("until").isNull(), F.col("row_key")).otherwise(F.col("next_key")).alias("root_key"),
        F.when(F.col("until").isNull(), F.col("start")).otherwise(F.col("until")).alias("root_start"),
        F.col("until").isNull().alias("ended"),
    ).filter(F.col("root_key").isNotNull())
    link = written(link, "span-links")
    while not link.filter(~F.col("ended")).isEmpty():
        far = link.select(
            *TABLE, F.col("row_key").alias("root_key"), F.col("start").alias("root_start"),
            F.col("root_key").alias("far_key"), F.col("root_start").alias("far_start"), F.col("ended").alias("far_ended"),
        )
        # a target that is missing is a span whose row dies
        step = link.filter(~F.col("ended")).join(far, [*TABLE, "root_key", "root_start"]).select(
            *KEY, "start", "until", F.col("far_key").alias("root_key"), F.col("far_start").alias("root_start"), F.col("far_ended").alias("ended")
        )
        link = written(link.filter("ended").unionByName(step), "span-links")
    return link.drop("ended")


def _evaluate(presence: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one root together, by start: carry each span's row to the span that takes it over."""
        out: list[tuple] = []
        root, states = None, {}

        def close():
            if root is not None and root in states:
                columns = states[root]
                if presence:
                    out.append((*root[:-1], None, 0))
                for column, pos in columns.items():
                    out.append((*root[:-1], column, int(pos) % POSITION_BASE))

        for frame in batches:
            for r in frame.itertuples(index=False, name="Span"):
                key = (r.instance_name, r.schema_name, r.table_name)
                of = (*key, r.root_key, r.root_start)
                if of != root:
                    close()
                    root, states = of, {}
                me = (*key, r.row_key, r.start)
                row = states.pop(me, None)
                listed = {} if r.images is None else {x["column_name"]: x["pos"] for x in r.images}
                born = r.born is not None and r.born == r.born
                if row is not None and not (r.dead is True or r.dead == 1):
                    row.update(listed)
                else:
                    row = {c: p for c, p in listed.items() if p >= r.born} if born else None
                if row is not None:
                    to = me if r.until is None or r.until != r.until else (*key, r.next_key, r.until)
                    if to in states and to != me:  # two rows under one key: the one that moved here replaces the other
                        row = row if r.next_key != r.row_key else states[to]
                    states[to] = row
            yield pd.DataFrame(out, columns=STATE.names)
            out = []
        close()
        yield pd.DataFrame(out, columns=STATE.names)

    return run


def apply_changes(changes: DataFrame, base: DataFrame | None = None, batches: int = BATCHES, presence: bool = False) -> DataFrame:
    """The state after all changes, as STATE: one row for each non-key column that a present row holds.

    row_key is the key's identity, see key_identity; lsn is that of the change that gave the column its value, nulls
    included. With presence, each present row has one more row, without column_name, so that rows without other
    columns are told too. base is such a state, of the log up to where changes begin, to start from.

    Copies, late and out-of-order rows, empty tables and extra columns are allowed. Two live rows that a move brings under
    one key: the moved row replaces the other. Jobs run while the result is built; their results are in the shared folder.
    """
    ship(changes.sparkSession)
    txns = written(transactions(changes), "transactions")
    columns = ["instance_name", "txn_id", "commit_lsn", "action", "schema_name", "table_name", "key_names", "before_image", "after_image", "lsn"]
    narrow = with_commit(changes.select(*columns), txns)
    events = _batched(row_events(narrow), txns, batches)
    untouched = None
    if base is not None:
        touched = events.select(*KEY).union(events.filter("new_key is not null").select(*TABLE, F.col("new_key").alias("row_key"))).distinct()
        untouched = base.join(touched, KEY, "left_anti")
        events = events.unionByName(_seeded(base.join(touched, KEY, "left_semi")).select(events.columns))
    events = written(events, "row-events", ["batch"])
    slots = _Slots(events)

    moves = written(events.filter(F.col("new_key").isNotNull()).select(*KEY, "pos", "new_key").distinct(), "moves")
    moved_keys = moves.select(*KEY).union(moves.select(*TABLE, F.col("new_key").alias("row_key"))).distinct()
    moved = small(moved_keys, 2 * moves.count(), _KEY_BYTES)  # a move names two keys at most
    borders = _borders(moves)
    start = F.lit(_START).cast(POSITION_TYPE)
    plain = events.drop("new_key").join(moved, KEY, "left_anti").withColumn("start", start)
    spanned = as_of(events.drop("new_key").join(moved, KEY, "left_semi"), borders.select(*KEY, "pos", F.col("pos").alias("start")), KEY, "pos", ["start"])
    spanned = written(spanned.withColumn("start", F.coalesce("start", start)), "spanned", ["batch"])
    parts = [plain.filter(F.col("batch") == b).unionByName(spanned.filter(F.col("batch") == b)).drop("batch") for b in range(batches)]
    folded = written(_newest_first(parts, slots), "folded")

    units = folded
    if slots.groups > 1:  # the birth is known in group 0, where every event is
        units = folded.drop("born", "dead").join(folded.filter("grp = 0").select(*UNIT, "born", "dead"), UNIT)
    live = units.filter(F.col("born").isNotNull()).join(moved, KEY, "left_anti")
    rows = slots.named(live, [*KEY, "born"]).filter(F.col("pos") >= F.col("born"))
    result = rows.select(*KEY, "column_name", position_lsn(F.col("pos")).alias("lsn"))
    if presence:
        result = result.unionByName(live.filter("grp = 0").select(*KEY, F.lit(None).cast("string").alias("column_name"), F.lit(0).cast("long").alias("lsn")))

    spans = written(_spans(borders), "spans")
    chained = units.join(moved, KEY, "left_semi")
    images = slots.named(chained, UNIT).groupBy(*UNIT).agg(F.collect_list(F.struct("column_name", "pos")).alias("images"))
    births = chained.filter("grp = 0").select(*UNIT, "born", "dead")
    ready = (
        _rooted(spans).join(births, UNIT, "left").join(images, UNIT, "left").join(spans.select(*UNIT, "next_key"), UNIT, "left")
        .repartition(*TABLE, "root_key", "root_start")
        .sortWithinPartitions(*TABLE, "root_key", "root_start", "start")
    )
    result = result.unionByName(ready.mapInPandas(_evaluate(presence), STATE))
    return result if untouched is None else result.unionByName(untouched.select(result.columns))
