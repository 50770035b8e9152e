"""Mixing sources to target weights.

Tokens (here words) are summed by source, the sources' targets are filled up to a cap, and each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate.

Sources are few against documents: sums are pre-aggregated, so a source with a third of all rows is one partial
sum a task. The source table is joined by broadcast while its counted rows allow, else by a shuffle.

Defined cases: null or empty text has size 0 and is taken with the same chance, adding no words. A null source is
a source of its own, last in order. Draws go by doc_id, text and, for rows that repeat both, by their number among
themselves, so null or repeated doc_ids don't share one draw; reruns agree. A corpus without words has targets of 0 and
rates of 0. Extra columns are kept by `mix` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, prefix_for, word_count, written

#: Rows of the source table up to which it is broadcast (each a short name and two numbers).
BROADCAST_SOURCES = 100_000
#: Rows of the table of repeated keys up to which it is broadcast (a doc_id and a digest each).
BROADCAST_KEYS = 200_000


def draw(doc_id: Column, digest: Column, number: Column, seed: int) -> Column:
    """A number in [0, 1) of a row: the first 32 bits of an MD5 of the seed, its doc_id, its text's digest and its number among equal rows."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest, number.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_sizes(docs: DataFrame) -> DataFrame:
    """source, source_size: words by source."""
    return docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """Adds target and rate to the table of source_sizes.

    Sources in code point order, null last, weigh `weights` in turn, and share `share` times all words by weight. A
    target stops at `cap` times its source's size; what is over goes to the others by weight, until none is above.
    Only sums over sources come to the driver, one row a round.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = written(
        sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight")), "sources"
    )
    limit = F.col("source_size") * F.lit(float(cap))
    level, capped = 0.0, -1
    while True:
        full = limit < F.col("weight") * F.lit(level)
        row = weighed.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("spent"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        left = (row["all"] or 0) * float(share) - row["spent"]
        if row["full"] == capped or not row["free"]:
            break
        capped, level = row["full"], left / row["free"]
    reshared = F.lit(left) * F.col("weight") / F.lit(row["free"] or 1.0)
    target = F.when(F.col("source_size") == 0, 0.0).when(full, limit).otherwise(F.least(reshared, limit))
    return weighed.select(
        "source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate")
    )


def numbered(docs: DataFrame, prefix: str) -> DataFrame:
    """docs with digest (of the text) and number: from 1 among the rows of equal doc_id and text; 1 for all others.

    Only keys are shuffled to find the rows that repeat. Those are written with the task that read them, counted task by
    task, and numbered within a task from where the tasks before it end: no task takes all rows of a key.
    """
    digest, number, task = (f"{prefix}{c}" for c in ("digest", "number", "task"))
    rows = docs.withColumn(digest, F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary")))
    keys = rows.groupBy(F.col("doc_id").alias("_id"), F.col(digest).alias("_digest")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id", "_digest")
    keys = written(keys, "repeated")
    n_keys = keys.count()
    if not n_keys:
        return rows.withColumn(number, F.lit(1).cast("long"))
    side = broadcast_if(keys, n_keys, BROADCAST_KEYS)
    same = lambda left, right: left["doc_id"].eqNullSafe(right["_id"]) & (left[digest] == right["_digest"])
    once = rows.join(side, same(rows, side), "left_anti").withColumn(number, F.lit(1).cast("long"))
    again = written(rows.join(side, same(rows, side), "left_semi").withColumn(task, F.spark_partition_id()), "repeated-rows")
    counts = again.groupBy("doc_id", digest, task).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("doc_id", digest).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(F.col("doc_id").alias("_id"), F.col(digest).alias("_digest"), F.col(task).alias("_task"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    own = again.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", digest, task).orderBy("source")))
    joined = own.join(begins, same(own, begins) & (own[task] == begins["_task"])).withColumn(number, (F.col(number) + F.col("_begin")).cast("long"))
    return once.unionByName(joined.select(*once.columns))


def mix_plan(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, prefix: str = "_") -> DataFrame:
    """docs with size, source_size, target and copies, their names after prefix; one row a document."""
    named = {c: f"{prefix}{c}" for c in ("source", "source_size", "target", "rate")}
    table = targets(source_sizes(docs), weights, share, cap).withColumnsRenamed(named)
    rows = numbered(docs, prefix_for([*docs.columns, prefix]))
    digest, number = rows.columns[-2:]
    rate = table[named["rate"]]
    copies = F.floor(rate) + F.when(draw(rows["doc_id"], rows[digest], rows[number], seed) < rate - F.floor(rate), 1).otherwise(0)
    joined = rows.join(broadcast_if(table, table.count(), BROADCAST_SOURCES), rows["source"].eqNullSafe(table[named["source"]]), "left")
    return joined.select(
        *[rows[c] for c in docs.columns], word_count(rows["text"]).alias(f"{prefix}size"), table[named["source_size"]], table[named["target"]], copies.cast("long").alias(f"{prefix}copies")
    )


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: the columns of docs, each document as often as the mix takes it."""
    prefix = prefix_for(docs.columns)
    plan = mix_plan(docs, prefix=prefix, **settings).where(F.col(f"{prefix}copies") > 0)
    return plan.withColumn(f"{prefix}copy", F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies")))).select(*docs.columns)
