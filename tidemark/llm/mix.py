"""A mix of sources by token budgets: whole epochs first, then a part drawn by Efraimidis-Spirakis keys.

Each document draws an exponential key, -log(u) / weight, u from a hash of its id and the weight from its quality: in the
order of the keys, documents come out as by weighted sampling without replacement. A source's budget is filled with as
many whole epochs as go into it, and then with the documents of smallest key up to the budget.

The budget is the largest total at which every named source that has tokens can give its share within max_repeats;
shares of sources without tokens go to the others in proportion. Documents of null or unnamed sources are not used.

Documents are range-partitioned by source and key, so a source with a third of them is spread like any other. The prefix
sums take the sums of whole partitions first; rows are put in order only within the one partition of each source in
which its budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokenizer import token_counts
from tidemark.session import ship, small, written

SEED = 42
#: The least weight of a document, so that every key is finite.
LEAST_WEIGHT = 0.05


def quality(documents: DataFrame) -> Column:
    """A document's weight: the share of letters, marks and plain white space in its text, LEAST_WEIGHT at least.

    Halved for pages whose status is an error. Texts that are garbled, lists of figures or full of signs weigh less.
    """
    text = documents["text"]
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\s]", ""))
    share = 1 - signs / F.nullif(F.length(text), F.lit(0))
    error = F.when(documents["http_status"] >= 400, 0.5).otherwise(1.0) if "http_status" in documents.columns else F.lit(1.0)
    return F.greatest(F.coalesce(share * error, F.lit(0.0)), F.lit(LEAST_WEIGHT))


def budgets(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, have, budget, epochs, rest): one row for each source of targets.

    targets has a row for each source, so what is put into one window here is as long as the list of sources.
    """
    have = counts.groupBy("source").agg(F.sum("n_tokens").alias("have"))
    t = targets.select("source", "target_share", "max_repeats").join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    live = (F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    share = F.when(live, F.col("target_share")).otherwise(0.0) / F.sum(F.when(live, F.col("target_share"))).over(Window.partitionBy())
    t = t.withColumn("__share", share)
    most = F.min(F.when(live, F.col("max_repeats") * F.col("have") / F.col("__share"))).over(Window.partitionBy())
    budget = F.when(live, F.floor(most * F.col("__share") + 1e-6)).otherwise(0).cast("long")
    epochs = F.when(live, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("int")
    return t.withColumn("budget", budget).withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("have")).drop("__share")


def mix(documents: DataFrame, targets: DataFrame, seed: int = SEED, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: doc_id, source, n_tokens, repeats. report: source, target_share, max_repeats, budget, tokens, actual_share.

    A row of documents is in mix at most once, with the number of times it is used; rows repeated in documents count each
    for itself. weight is a column of documents, by default its quality. Empty and null texts have no tokens and are
    left out. A named source without tokens is in the report with 0. Empty tables give empty results.
    """
    ship(documents.sparkSession)
    named = targets.filter(F.col("source").isNotNull()).dropDuplicates(["source"])
    n_named = named.count()
    slim = documents.withColumn("__weight", quality(documents) if weight is None else weight)
    slim = slim.join(small(named.select("source"), n_named, 100), "source", "left_semi")
    counts = token_counts(slim.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "__weight", "text"), ["doc_id", "source", "__weight"])
    counts = written(counts.filter("n_tokens > 0"), "token-counts")
    plan = written(budgets(counts, named), "budgets")

    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    key = -F.log(u) / F.greatest(F.col("__weight"), F.lit(1e-9))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = counts.select("doc_id", "source", "n_tokens", key.alias("key")).repartitionByRange(parts, "source", "key")
    drawn = written(drawn.withColumn("part", F.spark_partition_id()), "drawn")

    sums = drawn.groupBy("source", "part").agg(F.sum("n_tokens").alias("held"))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(upto), F.lit(0)))
    sums = written(sums.join(small(plan.select("source", "epochs", "rest"), n_named, 100), "source"), "part-sums")
    d = drawn.join(small(sums, parts + n_named, 100), ["source", "part"])
    within, beyond = F.col("before") + F.col("held") <= F.col("rest"), F.col("before") >= F.col("rest")
    settled = d.filter(within | beyond).withColumn("more", within.cast("int"))
    inside = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # the document on the border is in if that comes nearer to the budget
    edge = d.filter(~within & ~beyond).withColumn("more", (inside - F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    used = settled.unionByName(edge).withColumn("repeats", F.col("epochs") + F.col("more")).filter("repeats > 0")
    chosen = written(used.select("doc_id", "source", "n_tokens", "repeats"), "mix")

    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    report = plan.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy())
    return chosen, report.select("source", "target_share", "max_repeats", "budget", "tokens", (F.col("tokens") / F.nullif(total, F.lit(0))).alias("actual_share"))
