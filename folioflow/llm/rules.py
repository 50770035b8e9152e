"""Quality rules, with DataFrame functions only: counts by text, and an importance ratio over hashed n-grams.

Words and pairs of words are hashed into buckets. Two multinomials over the buckets, one of a trusted target and one
of the raw corpus, are estimated from all their documents, smoothed; a document's score is the mean over its n-grams
of log(target / raw), and it is kept when the score reaches a threshold. Bucket counts are partial sums in each task; the
table of log ratios has `buckets` entries, whatever the corpus, and is broadcast.

Equal texts count as one text in the multinomials, so copies don't move the ratios: each of n rows of a text weighs 1/n.
Where junk is named too, the threshold is taken from the scores of all trusted and all junk rows that pass the base
rules: the middle of the scores at which the share of junk kept and that of trusted rows lost are least in sum. Scores
are counted by STEP for that. Else, or if no such row of either kind is there, it is `least`.

Defined cases: null text has no words. A text without words has score 0, and fails the base rule of words. Without
any trusted document every score is 0. Trusted rows are found by doc_id; a repeated doc_id is trusted in each of its
rows, and a row named both trusted and junk counts as both. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bind, broadcast_if, written

SYMBOLS = "#*$%&|<>"
#: Rows of the trusted table up to which it is broadcast (one long each).
BROADCAST_TRUSTED = 1_000_000
#: Rows of the table of repeated texts up to which it is broadcast (a hash and two longs each).
BROADCAST_COPIES = 1_000_000
#: Width of the steps in which scores are counted for the threshold.
STEP = 0.001
#: Repeated windows of a text up to which places are found by looking each up; beyond, by sorting.
LOOKED_UP = 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def from_place(values: Column, start: int, fewer: int) -> Column:
    """The values from a place on, all but `fewer` of them; empty if there are no more."""
    return F.slice(values, F.lit(start), F.greatest(F.size(values) - F.lit(fewer), F.lit(0)))


def head(values: Column, fewer: int) -> Column:
    return from_place(values, 1, fewer)


def tail(values: Column, after: int) -> Column:
    return from_place(values, 1 + after, after)


def joined_hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def with_grams(rows: DataFrame) -> DataFrame:
    """Adds one and two, the hashes of `words` and of pairs of neighbours: arrays of longs, which stay quick in lambdas."""
    hashed = rows.withColumn("one", F.transform("words", lambda w: F.xxhash64(w)))
    return hashed.withColumn("two", F.zip_with(head(F.col("one"), 1), tail(F.col("one"), 1), joined_hash))


def bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets)).cast("int")


def repeated_words(windows: Column) -> Column:
    """Words in windows of three that occur twice or more, from the windows' hashes."""

    def found_twice(w: Column) -> Column:
        equal = lambda s: F.zip_with(head(s, 1), tail(s, 1), lambda x, y: F.when(x == y, x))
        return F.array_distinct(F.filter(bind(F.sort_array(w), equal), lambda h: h.isNotNull()))

    def placed(w: Column) -> Column:
        # Each next to its neighbour in order of hash: both of an equal pair are repeated.
        by_hash = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        pairs = bind(by_hash, lambda s: F.zip_with(head(s, 1), tail(s, 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))

    def starts(w: Column, twice: Column) -> Column:
        looked_up = F.filter(F.transform(w, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())
        return F.when(F.size(twice) <= LOOKED_UP, looked_up).otherwise(placed(w))

    def covered(s: Column) -> Column:
        steps = F.zip_with(head(s, 1), tail(s, 1), lambda x, y: F.least(y - x, F.lit(3)))
        return F.aggregate(steps, F.lit(3), lambda acc, n: acc + n)

    return bind(windows, lambda w: bind(found_twice(w), lambda twice: F.when(F.size(twice) > 0, bind(starts(w, twice), covered)).otherwise(0)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and the hashes of words and pairs, of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    split = with_grams(docs.select(
        "doc_id", words(F.col("text")).alias("words"), F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.when(text.contains("\n"), bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).otherwise(0).cast("long").alias("n_dup_lines"),
    ))
    windows = F.zip_with(head(F.col("two"), 1), tail(F.col("one"), 2), joined_hash)
    return split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols", "n_dup_lines", repeated_words(windows).cast("long").alias("n_repeat_words"), F.concat("one", "two").alias("grams"),
    )


def scored(docs: DataFrame, ratios: list[float]) -> DataFrame:
    """doc_id, the base counts, base_failed, and llr: the mean log ratio of a text's words and pairs of words."""
    table = F.broadcast(docs.sparkSession.createDataFrame([(ratios,)], "ratios array<double>"))  # one row of `buckets` numbers
    total = F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.element_at("ratios", bucket(g, len(ratios)) + 1))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    llr = F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(0.0)
    return measured(docs).join(table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), llr.alias("llr"))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int, smoothing: float) -> list[float]:
    """log(target share / raw share) of each bucket, from all different texts: `buckets` numbers come to the driver."""
    wanted = trusted.select(F.col("doc_id").alias("_trusted")).where("_trusted is not null").distinct()
    wanted = written(wanted, "trusted")
    side = broadcast_if(wanted, wanted.count(), BROADCAST_TRUSTED)
    key = F.md5(F.col("text").cast("binary"))
    marked = docs.select("doc_id", "text").join(side, docs["doc_id"] == side["_trusted"], "left").select("text", key.alias("_key"), F.col("_trusted").isNotNull().alias("t"))
    copies = marked.groupBy("_key").agg(F.count("*").alias("_n"), F.count(F.when(F.col("t"), 1)).alias("_n_t")).where("_key is not null and _n > 1")
    copies = written(copies.withColumnRenamed("_key", "_copied"), "copies")
    weighed = marked.join(broadcast_if(copies, copies.count(), BROADCAST_COPIES), F.col("_key") == F.col("_copied"), "left")
    raw, target = 1 / F.coalesce("_n", F.lit(1)), F.when(F.col("t"), 1 / F.coalesce("_n_t", F.lit(1))).otherwise(0.0)
    split = with_grams(weighed.select(raw.alias("raw"), target.alias("target"), words(F.col("text")).alias("words")))
    each = split.select("raw", "target", F.explode(F.concat("one", "two")).alias("gram"))
    counts = each.groupBy(bucket(F.col("gram"), buckets).alias("bucket")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = [0.0] * buckets, [0.0] * buckets
    for row in counts.collect():  # at most `buckets` rows
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return [0.0] * buckets
    share = lambda counts, i: (counts[i] + smoothing) / (sum_of[id(counts)] + smoothing * buckets)
    sum_of = {id(raw): sum(raw), id(target): sum(target)}
    return [math.log(share(target, i) / share(raw, i)) for i in range(buckets)]


def threshold(rows: DataFrame, trusted: DataFrame, junk: DataFrame, least: float) -> float:
    """The score that parts trusted from junk rows best, from all of them that pass the base rules."""
    named = trusted.select("doc_id", F.lit(True).alias("good")).unionByName(junk.select("doc_id", F.lit(False).alias("good"))).where("doc_id is not null").distinct()
    steps = rows.where("not base_failed").select("doc_id", F.floor(F.col("llr") / F.lit(STEP)).alias("step")).join(named, "doc_id")
    counts = steps.groupBy("step").agg(F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(~F.col("good"), 1)).alias("bad"))
    steps_met = sorted((r["step"], r["good"], r["bad"]) for r in counts.collect())  # as many rows as steps that occur
    n_good, n_bad = sum(r[1] for r in steps_met), sum(r[2] for r in steps_met)
    if not n_good or not n_bad:
        return least
    # Cuts before each step that occurs; a cut reaches from the end of the step before it.
    lost, kept, found = 0, n_bad, []
    for i, (step, good, bad) in enumerate(steps_met):
        found.append((lost / n_good + kept / n_bad, steps_met[i - 1][0] + 1 if i else step, step))
        lost, kept = lost + good, kept - bad
    fewest = min(x[0] for x in found)
    _, low, high = max((x for x in found if x[0] <= fewest + 1e-12), key=lambda x: x[2] - x[1])
    return (low + high) / 2 * STEP


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = 10_000, smoothing: float = 1.0, least: float = -0.05, junk: DataFrame | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    found = scored(docs, log_ratios(docs, trusted, buckets, smoothing))
    if junk is not None:
        found = written(found, "scored")
        least = threshold(found, trusted, junk, least)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(least)))
