"""Line dedup: a suffix array over line-ID sequences by prefix doubling, with DataFrame functions only.

Each document is a sequence of line IDs. Suffixes whose first line occurs once in the corpus can share nothing and are
left out. Ranks of the others by their first line are doubled: the rank by 2n lines is the order of the pairs (rank
by n lines at a place, rank by n lines n places on). After the last round, the suffixes with an equal rank at depth 2^k
are the interval of the suffix array whose longest common prefix is 2^k lines at least; an interval of depth m between
two powers is the pair of ranks at its begin and at 2^k lines before its end.

A line is deleted if it lies in a run of at least `min_words` words that also occurs earlier, in order of (doc_id, line).
Such lines are found exactly: for every line, the shortest run of min_words words that begins there and the shortest
that ends there are looked up in the intervals; together they cover every maximal repeated run of min_words words or
more. Whatever its length, the first copy stays.

A common line is many rows, counted by partial sums; ranks are numbered over distinct pairs, so copies of a pair never
meet in one task. Windows are over one document's lines.

Defined cases: null text has no lines and stays null. A null doc_id comes last in order. Rows that repeat doc_id and
text are one document: all are treated alike. Lines without words count as lines, with 0 words. Deleting every line
leaves empty text. An empty table gives an empty result. Extra columns are kept by `delete_repeated_runs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if, written

#: Rows of the table of deleted runs up to which it is broadcast (about 60 bytes each).
BROADCAST_RUNS = 200_000


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), at (place of the line), line (its ID), words; one row a line."""
    lines = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n", -1)).alias("at", "x"))
    hashed = lines.select("doc_id", "mark", "at", F.xxhash64("x").alias("line"), F.regexp_count("x", F.lit(WORD)).alias("words"))
    return hashed.dropDuplicates(["doc_id", "mark", "at"])


def numbered(df: DataFrame, first: str, then: str, name: str) -> DataFrame:
    """Ranks of distinct pairs: for each (first, then), the pairs before it in order, by ranges that tasks sort."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(ranges, first, then).withColumn("_range", F.spark_partition_id()), "ranges")
    # One row a range: as many as partitions, whatever the number of pairs.
    totals = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = totals.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(first, then))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").select(first, then, (F.col("_place") + F.col("_before")).alias(name))


def order_key(at: str) -> Column:
    """Order of lines in the corpus: by doc_id, null last, then text, then place."""
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark", F.col(at).alias("at"))


def doubled(base: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Adds r0 .. rk: the ranks by 1, 2, 4 .. lines, null where no other suffix shares so many."""
    k = 0
    while 2 ** (k + 1) <= depth:
        own, step = f"r{k}", 2**k
        on = Window.partitionBy("doc_id", "mark").orderBy("at").rangeBetween(step, step)
        paired = base.withColumn("_then", F.max(own).over(on))
        pairs = paired.where(F.col(own).isNotNull() & F.col("_then").isNotNull()).groupBy(own, "_then").agg(F.count("*").alias("_n")).where("_n > 1").select(own, "_then")
        ranks = written(numbered(pairs, own, "_then", f"r{k + 1}"), "ranks")
        n = ranks.count()
        if not n:
            break
        ranks = broadcast_if(ranks, n, BROADCAST_RUNS)
        base = written(paired.join(ranks, [own, "_then"], "left").drop("_then"), "suffixes")
        k += 1
    return base, k


def blocks(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, mark, start, length: for each line, the shortest runs of min_words words that begin and end at it."""
    own = Window.partitionBy("doc_id", "mark").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = lines.withColumn("_upto", F.sum("words").over(own))
    # The first line at which the sum reaches what stood before a line plus min_words ends the run that begins there.
    goals = summed.select("doc_id", "mark", "at", (F.col("_upto") - F.col("words") + min_words).alias("_sum"), F.lit(1).alias("_goal"))
    marks = summed.select("doc_id", "mark", "at", F.col("_upto").alias("_sum"), F.lit(0).alias("_goal"))
    ahead = Window.partitionBy("doc_id", "mark").orderBy("_sum", F.col("_goal").desc(), "at").rowsBetween(1, Window.unboundedFollowing)
    ends = marks.unionByName(goals).withColumn("_end", F.first(F.when(F.col("_goal") == 0, F.col("at")), ignorenulls=True).over(ahead))
    begin = ends.where("_goal = 1 and _end is not null").select("doc_id", "mark", F.col("at").alias("start"), (F.col("_end") - F.col("at") + 1).alias("length"))
    # Backwards: the last line that still leaves min_words words up to here.
    needs = summed.select("doc_id", "mark", "at", (F.col("_upto") - min_words).alias("_sum"), F.lit(1).alias("_goal"))
    stands = summed.select("doc_id", "mark", "at", (F.col("_upto") - F.col("words")).alias("_sum"), F.lit(0).alias("_goal"))
    behind = Window.partitionBy("doc_id", "mark").orderBy("_sum", "_goal", "at").rowsBetween(Window.unboundedPreceding, -1)
    starts = stands.unionByName(needs).withColumn("_start", F.last(F.when(F.col("_goal") == 0, F.col("at")), ignorenulls=True).over(behind))
    end = starts.where("_goal = 1 and _start is not null").select("doc_id", "mark", F.col("_start").alias("start"), (F.col("at") - F.col("_start") + 1).alias("length"))
    return begin.unionByName(end).distinct()


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, mark, runs (array of from, to: lines to delete), n_deleted; documents that keep all lines are left out."""
    lines = written(line_table(docs), "lines")
    common = written(lines.groupBy("line").agg(F.count("*").alias("_n")).where("_n > 1").select("line", F.col("line").alias("r0")), "repeated-lines")
    marked = written(lines.join(broadcast_if(common, common.count(), BROADCAST_RUNS), "line", "left"), "marked-lines")
    # A run that repeats has only lines that do: a run of such lines is a sequence by itself, and runs go no further.
    gap = F.sum(F.col("r0").isNull().cast("int")).over(Window.partitionBy("doc_id", "mark").orderBy("at"))
    inside = marked.withColumn("_gap", gap).where("r0 is not null")
    wanted = blocks_inside(inside, min_words)
    wanted = written(wanted, "blocks")
    longest = wanted.agg(F.max("length")).first()[0] or 0
    ranked, k = doubled(written(inside.select("doc_id", "mark", "at", "r0"), "suffixes"), longest)
    power = F.floor(F.log2(F.col("length").cast("double") + 1e-9)).cast("int")
    deep = wanted.withColumn("_k", power).where(F.col("_k") <= k)
    levels = F.array(*[F.col(f"r{i}") for i in range(k + 1)])
    ranks = ranked.select("doc_id", F.col("mark"), F.col("at").alias("start"), levels.alias("_levels"))
    heads = deep.join(ranks, same_place(deep, ranks), "inner").select(deep["doc_id"], deep["mark"], deep["start"], "length", "_k", F.element_at("_levels", F.col("_k") + 1).alias("_head"))
    tails = ranked.select("doc_id", "mark", F.col("at").alias("_tail_at"), levels.alias("_levels"))
    heads = heads.withColumn("_tail_at", F.col("start") + F.col("length") - F.expr("int(pow(2, _k))"))
    same = heads["doc_id"].eqNullSafe(tails["doc_id"]) & (heads["mark"] == tails["mark"]) & (heads["_tail_at"] == tails["_tail_at"])
    named = heads.join(tails, same).select(heads["doc_id"], heads["mark"], "start", "length", "_head", F.element_at("_levels", F.col("_k") + 1).alias("_tail"))
    named = written(named.where("_head is not null and _tail is not null"), "named-blocks")
    place = order_key("start")
    firsts = named.groupBy("length", "_head", "_tail").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = named.join(firsts, ["length", "_head", "_tail"]).where(F.col("_first") < place)
    return covered(later)


def same_place(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"]) & (a["start"] == b["start"])


def blocks_inside(inside: DataFrame, min_words: int) -> DataFrame:
    """blocks() of each run of repeated lines; `_gap` names a document's runs."""
    keyed = inside.select(F.struct("doc_id", "_gap").alias("doc_id"), "mark", "at", "words")
    found = blocks(keyed, min_words)
    return found.select("doc_id.doc_id", "mark", "start", "length")


def covered(later: DataFrame) -> DataFrame:
    """Joins overlapping runs of a document."""
    spans = later.select("doc_id", "mark", F.col("start").alias("from"), (F.col("start") + F.col("length") - 1).alias("to")).distinct()
    own = Window.partitionBy("doc_id", "mark").orderBy("from", "to")
    reach = F.max("to").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("_new", F.coalesce((F.col("from") > reach + 1).cast("int"), F.lit(1)))
    joined = begun.withColumn("_group", F.sum("_new").over(own)).groupBy("doc_id", "mark", "_group").agg(F.min("from").alias("from"), F.max("to").alias("to"))
    return joined.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"), F.sum(F.col("to") - F.col("from") + 1).cast("long").alias("n_deleted"))


def delete_repeated_runs(docs: DataFrame, min_words: int = 50, prefix: str = "_") -> DataFrame:
    """docs with text less the later copies of repeated runs; and, after prefix, lines, deleted, and runs (`from-to`, comma-joined)."""
    runs = written(repeated_runs(docs, min_words), "runs").select(F.col("doc_id").alias(f"{prefix}id"), F.col("mark").alias(f"{prefix}mark"), F.col("runs").alias(f"{prefix}ranges"), F.col("n_deleted").alias(f"{prefix}n"))
    joined = docs.join(broadcast_if(runs, runs.count(), BROADCAST_RUNS), docs["doc_id"].eqNullSafe(runs[f"{prefix}id"]) & (F.xxhash64(docs["text"]) == runs[f"{prefix}mark"]), "left")
    lines, ranges = F.split(docs["text"], "\n", -1), runs[f"{prefix}ranges"]
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.exists(ranges, lambda r: i.between(r["from"], r["to"]))), "\n")
    others = [F.when(ranges.isNull(), docs["text"]).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns]
    listed = F.array_join(F.transform(ranges, lambda r: F.concat_ws("-", r["from"], r["to"])), ",")
    count = F.when(docs["text"].isNull(), 0).otherwise(F.size(lines))
    return joined.select(*others, count.cast("long").alias(f"{prefix}lines"), F.coalesce(runs[f"{prefix}n"], F.lit(0)).alias(f"{prefix}deleted"), F.coalesce(listed, F.lit("")).alias(f"{prefix}runs"))
