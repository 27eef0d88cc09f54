"""Queries of the change-data-capture operators, over whole tables, each with its SQL twin where SQL can say it.

The keyed feed of some queries is made from events: signup is INSERT, error is DELETE, other types are UPDATE of the
user; value is listed unless the action is DELETE, props by signup and purchase only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import batching, envelope, flush_history, fold, progress, render
from tidemark.sources import checkpoint_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# the keyed fold ---------------------------------------------------------------------------------------------------

COLUMNS = ["value", "props"]


def feed(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "signup", "INSERT").when(kind == "error", "DELETE").otherwise("UPDATE")
    value = F.create_map(F.lit("value"), F.col("value").cast("decimal(18,4)").cast("string"))
    props = F.when(kind.isin("signup", "purchase"), F.create_map(F.lit("props"), F.col("props"))).otherwise(F.create_map().cast("map<string,string>"))
    return events.select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), action.alias("action"), F.when(action != "DELETE", F.map_concat(value, props)).alias("after_image"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("decimal(18,4)").cast("string").alias("value"), F.col("c_mktsegment").alias("props"))


_FEED = """feed as (select user_id as k, event_id as seq,
    case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end as action,
    event_type <> 'error' as has_value, event_type in ('signup', 'purchase') as has_props,
    cast(cast(value as decimal(18,4)) as varchar) as value, props from events)"""
_SEEDED = """seeded as (select k, seq, action, has_value, has_props, value, props from feed union all
    select c_custkey, -1, 'INSERT', true, true, cast(cast(c_acctbal as decimal(18,4)) as varchar), c_mktsegment from customer)"""


def _fold_sql(source: str) -> str:
    return f"""died as (select k, max(seq) as ld from {source} where action = 'DELETE' group by k),
born as (select k, min(seq) as st from {source} left join died using (k) where action = 'INSERT' and seq > coalesce(ld, -2) group by k),
kept as (select f.k, arg_max({{'v': value}}, seq) filter (has_value) as v, arg_max({{'v': props}}, seq) filter (has_props) as p
    from {source} f join born b on f.k = b.k and f.seq >= b.st where action <> 'DELETE' group by f.k),
state as (select k, v.v as value, p.v as props from kept)"""


@query(f"with {_FEED}, {_fold_sql('feed')} select k, value, props from state")
def q_apply_fold(spark, sf_dir):
    return fold.fold(feed(table(spark, sf_dir, "events")), ["k"], "seq", COLUMNS)


@query(f"with {_FEED}, {_SEEDED}, {_fold_sql('seeded')} select k, value, props from state")
def q_apply_fold_seeded(spark, sf_dir):
    return fold.merged(customers(spark, sf_dir), feed(table(spark, sf_dir, "events")), ["k"], "seq", COLUMNS)


@query(f"""with {_FEED}, {_fold_sql('feed')}, newest as (select k, arg_max(action, seq) as a from feed group by k)
select (select count(*) from newest where a <> 'DELETE') as naive, (select count(*) from state) as folded""")
def q_naive_vs_fold(spark, sf_dir):
    f = feed(table(spark, sf_dir, "events"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    naive = fold.last_write_wins(f, ["k"], "seq").select(one.alias("naive"), none.alias("folded"))
    folded = fold.fold(f, ["k"], "seq", COLUMNS).select(none.alias("naive"), one.alias("folded"))
    return naive.unionByName(folded).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("naive", "folded")])


@query(f"""with {_FEED}, {_SEEDED}, {_fold_sql('seeded')}, named as (select distinct k from feed)
select n.k, case when s.k is not null then 'upsert' when c.c_custkey is not null then 'delete' else 'none' end as net
from named n left join state s on s.k = n.k left join customer c on c.c_custkey = n.k""")
def q_net_changes(spark, sf_dir):
    return fold.net_changes(customers(spark, sf_dir), feed(table(spark, sf_dir, "events")), ["k"], "seq", COLUMNS)


# counters, rates, progress ------------------------------------------------------------------------------------------


@query("select action, count(*) as n from changes group by action")
def q_action_counts(spark, sf_dir):
    return progress.action_counts(table(spark, sf_dir, "changes"))


@query("""select count(*) filter (action = 'INSERT') as inserts, count(*) filter (action = 'UPDATE') as updates,
    count(*) filter (action = 'DELETE') as deletes, count(*) filter (action in ('INSERT', 'UPDATE', 'DELETE')) as total from changes""")
def q_action_totals(spark, sf_dir):
    return progress.action_totals(table(spark, sf_dir, "changes"))


@query("""select instance_name, epoch_us(received_at) // 3600000000 * 3600 as slot, count(*) as n, count(*) / 3600.0 as eps
from changes where received_at is not null group by all""")
def q_eps_window(spark, sf_dir):
    return progress.rates(table(spark, sf_dir, "changes"), "received_at", 3600, ["instance_name"])


@query("""select cast(coalesce(min(ckpt), 0) as bigint) as min_ckpt, cast(coalesce(max(pending) filter (active), 0) as bigint) as max_pending,
    coalesce(bool_or(active), false) as any_active from sink_progress""")
def q_sink_summary(spark, sf_dir):
    return progress.sink_summary(table(spark, sf_dir, "sink_progress"))


@query("select instance_name, cast(min(coalesce(ckpt, 0)) as bigint) as ack from sink_progress where active group by all")
def q_acknowledged(spark, sf_dir):
    return progress.acknowledged(table(spark, sf_dir, "sink_progress"))


@query("""with per as (select instance_name, count(*) as n, max(lsn) as last_lsn from changes group by all)
select sink, n, last_lsn from sink_progress join per using (instance_name) where active""")
def q_fanout(spark, sf_dir):
    return progress.fanned_out(table(spark, sf_dir, "changes"), table(spark, sf_dir, "sink_progress"))


@query("""select sink, (select count(*) from changes c where c.instance_name = p.instance_name and c.table_name <> '' and c.lsn > p.ckpt) as behind
from sink_progress p where ckpt is not null and instance_name is not null""")
def q_pending(spark, sf_dir):
    return progress.pending(table(spark, sf_dir, "changes"), table(spark, sf_dir, "sink_progress"))


_LSN = "try_cast(case when json_valid(checkpoint_data) and json_type(checkpoint_data) = 'OBJECT' and regexp_full_match(json_extract_string(checkpoint_data, '$.lsn'), '[0-9]{1,19}') then json_extract_string(checkpoint_data, '$.lsn') end as bigint)"
_WRITES = f"""writes as (select *, case when lsn > 0 then lsn end as good,
    case when updated_at < 100000000000 then updated_at * 1000000 when updated_at < 100000000000000 then updated_at * 1000 else updated_at end as moment
    from (select *, {_LSN} as lsn from checkpoint_files))"""


@query(f"""with {_WRITES}, before as (select write_no, instance_name, source_type, good,
    max(good) over (partition by instance_name, source_type order by write_no rows between unbounded preceding and 1 preceding) as prior from writes)
select write_no, greatest(good, prior) as reached, good is not null and good > coalesce(prior, -1) as accepted from before""")
def q_monotone_checkpoint(spark, sf_dir):
    files = table(spark, sf_dir, "checkpoint_files").withColumn("lsn", checkpoint_files.checkpoint_lsn(F.col("checkpoint_data")))
    return progress.monotone(files, ["instance_name", "source_type"], ["write_no"]).select("write_no", "reached", "accepted")


@query(f"""with {_WRITES} select source_type, instance_name, max_by(good, row(moment, good)) as lsn
from writes where not ends_with(file_name, '.tmp') and updated_at > 0 and good is not null group by all""")
def q_checkpoint_in_force(spark, sf_dir):
    return checkpoint_files.in_force(table(spark, sf_dir, "checkpoint_files"))


# envelope ---------------------------------------------------------------------------------------------------------

_HELD = ["status", "note", "balance", "reserved", "remark"]


@query(f"""with rows as (select after_image as m from changes where action in ('INSERT', 'UPDATE') and after_image is not null),
cells as (select c as column_name, map_contains(m, c) as has, m[c] is null as no from rows, (select unnest({_HELD}) as c))
select column_name, count(*) filter (has and not no) as present, count(*) filter (has and no) as nulls, count(*) filter (not has) as absent
from cells group by column_name""")
def q_toast_presence(spark, sf_dir):
    return envelope.presence(table(spark, sf_dir, "changes"), _HELD)


@query("""select seq, array_to_string(list_transform(key_names, lambda k:
    coalesce(case when map_contains(before_image, k) then before_image[k] else after_image[k] end, '\\N')), '|') as row_key from changes""")
def q_key_values(spark, sf_dir):
    c = table(spark, sf_dir, "changes")
    return c.select("seq", scalars.row_key_text(F.col("key_names"), F.col("before_image"), F.col("after_image")).alias("row_key"))


@query("""with newest as (select instance_name, relation_id, arg_max({'n': namespace, 't': name, 'c': columns}, seq) as r from relations group by all)
select instance_name, relation_id, r.n as namespace, r.t as name,
    list_transform(list_filter(r.c, lambda x: x.flags = 1), lambda x: x.name) as key_names, cast(len(r.c) as int) as width from newest""")
def q_relation_current(spark, sf_dir):
    return envelope.current_relations(table(spark, sf_dir, "relations"))


def relation_messages(events: DataFrame) -> DataFrame:
    """Every 500th event as a relation message, of eight relations in turn."""
    at = events.filter(F.col("event_id") % 500 == 0)
    columns = F.array(F.struct(F.lit(1).alias("flags"), F.lit("id").alias("name")))
    return at.select(
        F.col("event_id").alias("seq"), (F.floor(F.col("event_id") / 500) % 8).cast("long").alias("relation_id"),
        F.lit("s").alias("namespace"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("name"), columns.alias("columns"),
    )


@query("""with facts as (select event_id as seq, event_id // 500 % 8 as relation_id, 'v' || event_id as name from events where event_id % 500 = 0),
rows as (select event_id as seq, user_id % 8 as relation_id from events where event_id % 500 <> 0)
select r.seq, r.relation_id, f.name from rows r asof join facts f on r.relation_id = f.relation_id and r.seq > f.seq""")
def q_relation_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.filter(F.col("event_id") % 500 != 0).select(F.col("event_id").alias("seq"), (F.col("user_id") % 8).cast("long").alias("relation_id"))
    return envelope.resolved(rows, relation_messages(events)).select("seq", "relation_id", "name")


@query("""select seq, case action when 'INSERT' then 1 when 'UPDATE' then 2 when 'DELETE' then 3 when 'COMMIT' then 4 else 0 end as action_code,
    cast(to_json(before_image) as varchar) as before_json, cast(to_json(after_image) as varchar) as after_json, '{"lsn":"' || lsn || '"}' as checkpoint_json
from changes""")
def q_envelope(spark, sf_dir):
    e = envelope.encoded(table(spark, sf_dir, "changes"), ["seq"])
    return e.select("seq", "action_code", "before_json", "after_json", "checkpoint_json")


@query("select seq, before_image, after_image, lsn from changes")
def q_envelope_round_trip(spark, sf_dir):
    e = envelope.decoded(envelope.encoded(table(spark, sf_dir, "changes"), ["seq"]))
    return e.select("seq", "before_image", "after_image", "lsn")


@query("""select instance_name, txn_id, max(commit_lsn) as lsn from changes group by all
having count(*) filter (table_name <> '') = 0 and max(commit_lsn) is not null""")
def q_commit_markers(spark, sf_dir):
    return envelope.commit_markers(table(spark, sf_dir, "changes"))


@query("""with rows as (select instance_name, txn_id, seq, lsn, max(commit_lsn) over (partition by instance_name, txn_id) as fin,
    row_number() over (partition by instance_name, txn_id order by coalesce(lsn, -1) desc, seq desc) as n from changes where table_name <> '')
select instance_name, txn_id, seq, case when n = 1 then coalesce(fin, lsn) else lsn end as lsn from rows""")
def q_commit_stamp(spark, sf_dir):
    return envelope.commit_stamped(table(spark, sf_dir, "changes"))


# bags, batches, chunks ----------------------------------------------------------------------------------------------

_TXN = ["instance_name", "txn_id"]


@query("""with placed as (select seq, (row_number() over (partition by instance_name, txn_id order by lsn, seq) - 1) // 5 as bag from changes)
select seq, cast(bag as bigint) as bag from placed""")
def q_bag_cut(spark, sf_dir):
    c = table(spark, sf_dir, "changes").select("seq", "instance_name", "txn_id", "lsn")
    return batching.bags(c, _TXN, ["lsn", "seq"], 5).select("seq", "bag")


@query("""with placed as (select instance_name, txn_id, (row_number() over (partition by instance_name, txn_id order by lsn, seq) - 1) // 5 as bag,
    count(*) over (partition by instance_name, txn_id) as total from changes)
select instance_name, txn_id, cast(bag as bigint) as bag, count(*) as n, (bag + 1) * 5 >= any_value(total) as closed from placed group by instance_name, txn_id, bag""")
def q_bag_sizes(spark, sf_dir):
    return batching.bag_sizes(table(spark, sf_dir, "changes"), _TXN, ["lsn", "seq"], 5)


@query("select seq, cast((row_number() over (partition by instance_name order by seq) - 1) // 64 as bigint) as batch_no from changes")
def q_batch_cut(spark, sf_dir):
    c = table(spark, sf_dir, "changes").select("seq", "instance_name")
    return batching.size_cuts(c, ["instance_name"], ["seq"], 64).select("seq", "batch_no")


@query("""with placed as (select instance_name, batch_no as bag, lsn, row_number() over (partition by instance_name order by batch_no, seq) - 1 as pos,
    count(*) over (partition by instance_name) as total from changes),
ends as (select instance_name, bag, max(pos) as pos, arg_max(lsn, pos) as last_lsn from placed group by all),
reached as (select instance_name, pos, max(last_lsn) over (partition by instance_name order by pos) as ckpt from ends),
batches as (select instance_name, pos // 64 as batch_no, count(*) as n, max(pos) as pos from placed group by all)
select b.instance_name, cast(b.batch_no as bigint) as batch_no, n, case when n = 64 then 'size' else 'timeout' end as reason, r.ckpt
from batches b left join reached r using (instance_name, pos)""")
def q_batch_checkpoint(spark, sf_dir):
    c = table(spark, sf_dir, "changes").select("seq", "instance_name", F.col("batch_no").alias("bag"), "lsn")
    return batching.batch_checkpoints(c, ["instance_name"], ["bag", "seq"], 64, ["bag"])


@query("""with placed as (select seq, row_number() over (partition by instance_name, batch_no order by seq) - 1 as pos,
    count(*) over (partition by instance_name, batch_no) as n from changes)
select seq, cast(pos // cast(ceil(n / 4.0) as bigint) as bigint) as chunk from placed""")
def q_worker_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "changes").select("seq", "instance_name", "batch_no")
    return batching.chunked(c, ["instance_name", "batch_no"], ["seq"], 4).select("seq", "chunk")


@query("""select * from changes where coalesce(table_name, '') = '' or (concat_ws('.', schema_name, table_name) in ('core.wallet', 'shop.member', 'ops.flag')
    and concat_ws('.', schema_name, table_name) not in ('shop.member'))""")
def q_table_filter(spark, sf_dir):
    return progress.table_filter(table(spark, sf_dir, "changes"), ["core.wallet", "shop.member", "ops.flag"], ["shop.member"])


# flush history --------------------------------------------------------------------------------------------------------


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery of an instance as one flush of a sink of the same name."""
    c = table(spark, sf_dir, "changes").filter(F.col("received_at").isNotNull())
    at = F.max(F.unix_micros(F.col("received_at").cast("timestamp"))) / F.lit(1e6)
    of = c.groupBy(F.col("instance_name").alias("sink"), F.col("batch_no").alias("flush_no")).agg(at.alias("at"), F.count(F.lit(1)).alias("batch_size"))
    return of.withColumn("reason", F.when(F.col("batch_size") >= 100, "size").otherwise("timeout"))


_HISTORY = """history as (select instance_name as sink, batch_no as flush_no, max(epoch_us(received_at)) / 1e6 as moment, count(*) as batch_size,
    case when count(*) >= 100 then 'size' else 'timeout' end as reason from changes where received_at is not null group by all),
steps as (select *, cast(sum(batch_size) over (partition by sink order by moment, flush_no) as bigint) as cumulative,
    moment - lag(moment) over (partition by sink order by moment, flush_no) as dt from history),
rated as (select *, case when dt > 0 then batch_size / dt end as eps from steps)"""


@query(f"""with {_HISTORY}, ring as (select *, first_value(moment) over w as at0, first_value(cumulative) over w as n0, count(*) over w as ring_n from rated
    window w as (partition by sink order by moment, flush_no rows between 15 preceding and current row))
select sink, flush_no, cumulative, round(dt, 4) as dt, round(eps, 6) as eps, round(case when moment > at0 then (cumulative - n0) / (moment - at0) end, 6) as ring_eps, ring_n from ring""")
def q_flush_history16(spark, sf_dir):
    d = flush_history.deltas(history(spark, sf_dir))
    return d.select("sink", "flush_no", "cumulative", F.round("dt", 4).alias("dt"), F.round("eps", 6).alias("eps"), F.round("ring_eps", 6).alias("ring_eps"), "ring_n")


@query(f"""with {_HISTORY}, lists as (select sink, list(eps order by moment, flush_no) filter (eps is not null) as e, list(cast(batch_size as double) order by moment, flush_no) as b from rated group by sink)
select sink, round(list_reduce(e, lambda a, x: x * 0.2 + a * 0.8), 6) as eps_ewma, round(list_reduce(b, lambda a, x: x * 0.3 + a * 0.7), 6) as batch_ewma from lists""")
def q_ewma_eps(spark, sf_dir):
    e = flush_history.ewma(history(spark, sf_dir))
    return e.select("sink", F.round("eps_ewma", 6).alias("eps_ewma"), F.round("batch_ewma", 6).alias("batch_ewma"))


@query(f"""with {_HISTORY}, ranked as (select *, row_number() over (partition by sink order by eps desc, moment, flush_no) as n from rated where eps is not null)
select sink, round(eps, 6) as eps, batch_size from ranked where n = 1""")
def q_best_batch(spark, sf_dir):
    return flush_history.best_batch(history(spark, sf_dir)).withColumn("eps", F.round("eps", 6))


@query("""with points as (select event_type, cast(event_id % 1000 + 200 as double) as x, 1e6 - pow(event_id % 1000 + 200 - 700, 2) + value as y from events),
top as (select event_type, max(x) as m from points group by all),
s as (select event_type, count(*) as n, any_value(m) as m, sum(x/m) as s1, sum(pow(x/m,2)) as s2, sum(pow(x/m,3)) as s3, sum(pow(x/m,4)) as s4, sum(y) as t0, sum(x/m*y) as t1, sum(x/m*x/m*y) as t2
    from points join top using (event_type) group by event_type)
select event_type, n, round(-(s4*(t1*n - s1*t0) - t2*(s3*n - s1*s2) + s2*(s3*t0 - t1*s2)) / (2 * (t2*(s2*n - s1*s1) - s3*(t1*n - s1*t0) + s2*(t1*s1 - s2*t0))) * m, 2) as peak from s""")
def q_quadratic_fit(spark, sf_dir):
    x = F.col("event_id") % 1000 + 200
    points = table(spark, sf_dir, "events").select("event_type", x.alias("x"), (F.lit(1e6) - F.pow(x - 700, F.lit(2)) + F.col("value")).alias("y"))
    return flush_history.quadratic_fit(points, ["event_type"], "x", "y").withColumn("peak", F.round("peak", 2))


@query(f"""with {_HISTORY}, low as (select *, reason = 'timeout' and batch_size < 0.2 * 300 as is_low from history),
islands as (select *, sum(case when is_low then 0 else 1 end) over (partition by sink order by moment, flush_no) as island from low)
select sink, flush_no, cast(sum(cast(is_low as int)) over (partition by sink, island order by moment, flush_no) as bigint) as run from islands""")
def q_underfill_runs(spark, sf_dir):
    return flush_history.underfilled(history(spark, sf_dir), 300).select("sink", "flush_no", "run")


@query(f"""with {_HISTORY} select sink, flush_no, cast(greatest(20, least(5000, trunc(batch_size / eps * 1000.0 * 1.3))) as bigint) as millis from rated where eps > 0""")
def q_timeout_hint(spark, sf_dir):
    d = flush_history.deltas(history(spark, sf_dir)).filter("eps > 0")
    return d.select("sink", "flush_no", scalars.timeout_hint(F.col("batch_size"), F.col("eps")).cast("long").alias("millis"))


@query("""select sink, cast(case when pending / 2000.0 > 1.5 then least(8, 5) when pending / 2000.0 < 0.1 then 3 else 4 end as bigint) as workers from sink_progress where pending is not null""")
def q_worker_hint(spark, sf_dir):
    p = table(spark, sf_dir, "sink_progress").filter("pending is not null")
    return p.select("sink", scalars.worker_hint(F.col("pending"), F.lit(2000.0), F.lit(4), 8).alias("workers"))


# scalars and statements -----------------------------------------------------------------------------------------------


@query("""with r as (select unnest(range(0, 9)) as retries), w as (select retries, unnest(range(0, retries)) as i from r)
select retries, i + 1 as attempt, least(30.0, 2.0 * pow(2.0, i)) as seconds from w""")
def q_backoff(spark, sf_dir):
    r = spark.range(9).select(F.col("id").alias("retries"))
    waits = r.select("retries", F.posexplode(scalars.backoff(2.0, 30.0, F.col("retries"))).alias("attempt", "seconds"))
    return waits.select("retries", (F.col("attempt") + 1).cast("long").alias("attempt"), "seconds")


@query("""select seq, printf('%X/%X', lsn >> 32, lsn & 4294967295) as text, lsn as back from changes""")
def q_lsn_text(spark, sf_dir):
    t = scalars.lsn_text(F.col("lsn"))
    return table(spark, sf_dir, "changes").select("seq", t.alias("text"), scalars.lsn_number(t).alias("back"))


@query("select sink, sha256(sink) as digest, translate(base64(encode(sink)), '+/', '-_') as safe from sink_progress")
def q_sha256_key(spark, sf_dir):
    s = F.col("sink")
    return table(spark, sf_dir, "sink_progress").select("sink", scalars.key_hash(s).alias("digest"), scalars.url_safe(s.cast("binary")).alias("safe"))


@query("""select seq, source_type || '_' || instance_name || '_ckpt.json' as file_name, strftime(to_timestamp(epoch_us(received_at) // 1000000), '%Y-%m-%dT%H:%M:%SZ') as at_text,
    case when regexp_full_match(txn_id::varchar, '[0-9]+') and txn_id > 0 then txn_id end as txn from changes where received_at is not null""")
def q_names_and_times(spark, sf_dir):
    c = table(spark, sf_dir, "changes").filter("received_at is not null")
    seconds = F.floor(F.unix_micros(F.col("received_at").cast("timestamp")) / 1_000_000).cast("long")
    name = scalars.checkpoint_name(F.col("source_type"), F.col("instance_name"))
    return c.select("seq", name.alias("file_name"), scalars.time_text(seconds).alias("at_text"), scalars.whole_number(F.col("txn_id").cast("string")).alias("txn"))


_Q = "lambda n: '\"' || replace(n, '\"', '\"\"') || '\"'"


@query(f"""with e as (select *, '"' || schema_name || '"."' || table_name || '"' as tab, coalesce(key_names, []) as ks, list_sort(map_keys(after_image)) as cs,
    cardinality(after_image) as na, cardinality(before_image) as nb from changes where table_name <> ''),
p as (select *, list_filter(cs, lambda c: not list_contains(ks, c)) as free, array_to_string(list_transform(cs, {_Q}), ', ') as names,
    array_to_string(list_transform(range(1, len(cs) + 1), lambda i: '$' || i), ', ') as holders, list_transform(ks, {_Q}) as kq,
    list_transform(cs, {_Q}) as cq, list_transform(cs, lambda c: after_image[c]) as vals,
    list_transform(ks, lambda k: case when map_contains(before_image, k) then before_image[k] else after_image[k] end) as kv from e)
select seq, case
    when action = 'INSERT' and na > 0 then 'INSERT INTO ' || tab || ' (' || names || ') VALUES (' || holders || ')' || case when len(ks) = 0 then '' else
        ' ON CONFLICT (' || array_to_string(kq, ', ') || ') ' || case when len(free) = 0 then 'DO NOTHING' else 'DO UPDATE SET ' ||
        array_to_string(list_transform(free, lambda c: '"' || c || '" = EXCLUDED."' || c || '"'), ', ') end end
    when action = 'UPDATE' and na > 0 and len(ks) > 0 then 'UPDATE ' || tab || ' SET ' || array_to_string(list_transform(range(1, len(cq) + 1), lambda i: cq[i] || ' = $' || i), ', ')
        || ' WHERE ' || array_to_string(list_transform(range(1, len(kq) + 1), lambda i: kq[i] || ' = $' || (i + len(cs))), ' AND ')
    when action = 'DELETE' and nb > 0 and len(ks) > 0 then 'DELETE FROM ' || tab || ' WHERE ' || array_to_string(list_transform(range(1, len(kq) + 1), lambda i: kq[i] || ' = $' || i), ' AND ') end as sql,
    case when action = 'INSERT' then vals when action = 'UPDATE' then list_concat(vals, kv) else list_transform(ks, lambda k: before_image[k]) end as args
from p where (action = 'INSERT' and na > 0) or (action = 'UPDATE' and na > 0 and len(ks) > 0) or (action = 'DELETE' and nb > 0 and len(ks) > 0)""")
def q_sql_render(spark, sf_dir):
    return render.statements(table(spark, sf_dir, "changes"), ["seq"])


@query("""select sink, sink as slot_name, 'pub_' || instance_name as publication, 'postgres://h/db?x=1' as url, pending * 100.0 / 4000 >= 85 as high,
    greatest(200, least(2000, pending)) as clamped from sink_progress""")
def q_connection_options(spark, sf_dir):
    url = F.concat(F.lit("postgres://h/db?slot_name="), F.col("sink"), F.lit("&x=1&publication_names=pub_"), F.coalesce("instance_name", F.lit("")))
    p = table(spark, sf_dir, "sink_progress")
    return p.select(
        "sink", scalars.option(url, "slot_name").alias("slot_name"), scalars.option(url, "publication_names").alias("publication"), scalars.without_options(url, ["slot_name", "publication_names"]).alias("url"),
        scalars.over_percent(F.col("pending"), F.lit(4000), 85).alias("high"), scalars.clamp(F.col("pending"), 200, 2000).alias("clamped"),
    )


@query("select doc_id, try(decode(body)) is not null as valid, try(decode(body)) as page from documents where body is not null")
def q_bytes_as_text(spark, sf_dir):
    """Page bodies as text; bytes that are no UTF-8 become U+FFFD, such pages are told apart and left out here."""
    d = table(spark, sf_dir, "documents").filter("body is not null")
    valid = F.is_valid_utf8(F.col("body").cast("string"))
    return d.select("doc_id", valid.alias("valid"), F.when(valid, scalars.text_of(F.col("body"))).alias("page"))
