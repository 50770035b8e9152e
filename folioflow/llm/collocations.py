"""Phrase collocations by Rabin-Karp fingerprints: counted as numbers, checked against the text, spelled only where frequent.

A-Z are lower-cased; texts are split at .,;:!? and line ends into pieces, pieces at spaces and tabs into words. Prefix
polynomials over the words' hashes (sums of hash times power, modulo 2**64) give the fingerprint of every n-gram of a
task's buffer of texts as one difference and one product. Three passes read the corpus:

1. Fingerprints of all words and pairs are counted in each buffer, sorted, and sent as packed arrays to the shard of
   their leading bits, where counts are summed; a fingerprint is frequent from `least` occurrences.
2. The same for triples of which both pairs are frequent (a triple is never more frequent than its pairs).
3. Occurrences of frequent fingerprints are checked against the text at the first of them in the buffer: word by word,
   byte by byte. The phrase at that place is spelled with the count of the occurrences that equal it, any others are
   counted by their own text, and counts are summed by language and phrase. Results are exact, whatever collides.

A fingerprint's pointer is the place of its first occurrence in the buffer that met it; it never leaves the task, as the
third pass meets all occurrences anyway. Frequent fingerprints reach tasks as a Bloom filter of fixed size (`FILTER_BITS`):
what it lets through wrongly costs time and fails `least` later. A buffer sends each fingerprint once, so a common phrase is
one number a buffer; a shard's size is bounded by dealing more shards to larger corpora. A phrase that is part of another
is joined with its parts by shuffle, or by broadcast where the parts were counted to be few.

Defined cases. Null text has no words; null lang is `und`. doc_id isn't read: repeated rows count as often as they stand.
A very long text is one buffer of its own. An empty table, and a language without candidates, give no rows. Extra columns
are not read, whatever their names. Ties in score go by count, then by the phrase's bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, broadcast_if, removed, tidy, written
from .shingles import FACTOR, MIXER, hashed_words, mixed

#: Bytes that part pieces, and those that part words.
BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
BLANKS = BREAKS.copy()
BLANKS[list(b" \t")] = True
#: The polynomial's base (odd) and its inverse modulo 2**64.
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
LONGEST = 3
#: Bytes of text in a buffer, fingerprints in a shard, and bits of the filter.
BUFFER, SHARD, FILTER_BITS = 4 << 20, 1 << 20, 27
#: Rows of a table of parts up to which it is broadcast.
BROADCAST_PARTS = 200_000
UNKNOWN = "und"


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, modulo 2**64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Buffer:
    """The words of some texts: where they begin, how long they are, their pieces, hashes and languages."""

    def __init__(self, texts: list[bytes], langs: list[str]) -> None:
        self.joined = b"\n".join(texts).lower()
        self.langs = sorted(set(langs))
        self.begin, self.size, self.hash = hashed_words(self.joined, BLANKS)
        raw = np.frombuffer(self.joined + b"\n", np.uint8)
        self.piece = np.cumsum(BREAKS[raw], dtype=np.int32)[self.begin]
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        code = {name: i for i, name in enumerate(self.langs)}
        self.lang = np.array([code[x] for x in langs], np.int32)[np.searchsorted(starts, self.begin, "right") - 1]
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        self.seed = seeds[self.lang] if len(self.begin) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            self.power = powers(BASE, len(self.hash))
            self.prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * powers(INVERSE, len(self.hash)), dtype=np.uint64)))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the n-grams within pieces, and their fingerprints."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:count] == self.piece[n - 1 :])
        with np.errstate(over="ignore"):
            value = (self.prefix[at + n] - self.prefix[at]) * self.power[at]
            return at, mixed((value ^ self.seed[at]) + np.uint64(n) * FACTOR)


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[Buffer]:
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), strict=True):
            if text.is_valid:
                texts.append(text.as_py())
                langs.append(UNKNOWN if lang is None else lang)
                size += len(texts[-1])
            if size >= BUFFER:
                yield Buffer(texts, langs)
                texts, langs, size = [], [], 0
    if texts:
        yield Buffer(texts, langs)


def positions(prints: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(x >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for x in (prints, mixed(prints * MIXER))]


def passes(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which fingerprints the filter lets through: all frequent ones, and a few others."""
    found = np.ones(len(prints), bool)
    for at in positions(prints):
        found &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
    return found


def counted(prints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, and the sums of their counts (1 each without counts)."""
    if not len(prints):
        return prints, np.zeros(0, np.int64)
    if counts is None:
        prints = np.sort(prints)
    else:
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
    sums = np.diff(np.concatenate((first, [len(prints)]))) if counts is None else np.add.reduceat(counts, first)
    return prints[first], sums.astype(np.int64)


def frequent(docs: DataFrame, chosen, bits: int, least: int) -> DataFrame:
    """print: the fingerprints with `least` occurrences of those that chosen(buffer) gives, in 2**bits shards."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buffer in buffers(batches):
            prints, counts = counted(chosen(buffer))
            buffer = None  # not kept while the next one is made
            if not len(prints):
                continue
            edges = np.searchsorted(prints, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
            cuts = np.concatenate(([0], edges, [len(prints)])).astype(np.int64)
            filled = np.flatnonzero(cuts[1:] > cuts[:-1])
            slices = [slice(cuts[s], cuts[s + 1]) for s in filled]
            yield pa.RecordBatch.from_arrays([
                pa.array(filled, pa.int32()), pa.array([prints[s].tobytes() for s in slices], pa.binary()), pa.array([counts[s].astype(np.uint32).tobytes() for s in slices], pa.binary()),
            ], names=["shard", "prints", "counts"])
            prints = counts = None

    def summed(table: pa.Table) -> pa.Table:
        both = zip(table.column("prints").to_pylist(), table.column("counts").to_pylist(), strict=True)
        parts = [(np.frombuffer(p, np.uint64), np.frombuffer(c, np.uint32)) for p, c in both]
        prints, counts = counted(np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts]).astype(np.int64))
        return pa.table({"print": pa.array(prints[counts >= least].view(np.int64), pa.int64())})

    return docs.mapInArrow(tidy(packed), "shard int, prints binary, counts binary").groupBy("shard").applyInArrow(summed, "print long")


def filter_of(spark: SparkSession, prints: DataFrame) -> np.ndarray:
    """The Bloom filter of fingerprints: at most 2**(FILTER_BITS - 6) rows of 64 bits come to the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.sort(np.concatenate(positions(batch.column(0).to_numpy().view(np.uint64)))) if batch.num_rows else np.zeros(0, np.int64)
            slot, first = np.unique(at >> 6, return_index=True)
            one = np.uint64(1) << (at & 63).astype(np.uint64)
            both = np.bitwise_or.reduceat(one, first) if len(first) else one
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32() if len(slot) == 0 else None).cast(pa.int32()), pa.array(both.view(np.int64), pa.int64())], names=["slot", "bits"])

    found = prints.mapInArrow(tidy(bits), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def same_words(buffer: Buffer, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b of a buffer are the same bytes, eight at a time."""
    same = buffer.size[a] == buffer.size[b]
    eight = np.ndarray(len(buffer.joined) + 1, "<u8", np.frombuffer(buffer.joined + bytes(8), np.uint8), strides=(1,))
    rest = np.flatnonzero(same)
    at, other, left = buffer.begin[a[rest]], buffer.begin[b[rest]], buffer.size[a[rest]]
    masks = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
    while len(rest):
        equal = (eight[at] ^ eight[other]) & masks[np.minimum(left, 8)] == 0
        same[rest[~equal]] = False
        more = equal & (left > 8)
        rest, at, other, left = rest[more], at[more] + 8, other[more] + 8, left[more] - 8
    return same


def spelled(buffer: Buffer, bits: np.ndarray) -> Iterator[tuple[str, int, str, int] | pa.RecordBatch]:
    """lang, n, phrase and count of the buffer's occurrences that the filter lets through, each checked against the text."""
    if not len(buffer.begin):
        return
    _, first, word = np.unique(buffer.hash, return_index=True, return_inverse=True)
    exact = same_words(buffer, np.arange(len(word)), first[word])
    names = pa.array([buffer.joined[a : a + n] for a, n in zip(buffer.begin[first], buffer.size[first], strict=True)], pa.binary()).cast(pa.string())
    langs = pa.array(buffer.langs, pa.string())
    odd: Counter = Counter()
    for n in range(1, LONGEST + 1):
        at, prints = buffer.grams(n)
        kept = passes(bits, prints)
        at, prints = at[kept], prints[kept]
        if not len(at):
            continue
        _, lead, group = np.unique(prints, return_index=True, return_inverse=True)
        lead = at[lead]  # the pointer: where each fingerprint occurs first
        same = buffer.lang[at] == buffer.lang[lead[group]]
        for k in range(n):
            same &= (word[at + k] == word[lead[group] + k]) & exact[at + k] & exact[lead[group] + k]
        for i in at[~same]:
            parts = [buffer.joined[buffer.begin[j] : buffer.begin[j] + buffer.size[j]].decode() for j in range(i, i + n)]
            odd[buffer.langs[buffer.lang[i]], n, " ".join(parts)] += 1
        counts = np.bincount(group[same], minlength=len(lead))
        lead, counts = lead[counts > 0], counts[counts > 0]
        phrase = pc.binary_join_element_wise(*(names.take(pa.array(word[lead + k])) for k in range(n)), " ") if n > 1 else names.take(pa.array(word[lead]))
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(buffer.lang[lead])), pa.array(np.full(len(lead), n, np.int32)), phrase, pa.array(counts, pa.int64())], names=["lang", "n_words", "phrase", "f"])
    totals = [(name, 0, "", int(c)) for name, c in zip(buffer.langs, np.bincount(buffer.lang, minlength=len(buffer.langs)), strict=True)]
    rows = [*totals, *((*key, c) for key, c in odd.items())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], names=["lang", "n_words", "phrase", "f"])


def phrase_counts(docs: DataFrame, least: int = 10) -> DataFrame:
    """lang, n_words, phrase, f: exact counts of all phrases of one to three words with `least` occurrences; with n_words 0, all words of a language."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("text").alias("_text"), F.col("lang").cast("string").alias("_lang"))
    # Six bytes a word or more, two fingerprints a word.
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(0, int(size / 3 / SHARD).bit_length())
    one_and_two = written(frequent(texts, lambda b: np.concatenate([b.grams(n)[1] for n in (1, 2)]), shards, least), "prints")
    seen = spark.sparkContext.broadcast(filter_of(spark, one_and_two))

    def triples(buffer: Buffer) -> np.ndarray:
        at, pairs = buffer.grams(2)
        frequent_pair = np.zeros(len(buffer.hash) + 1, bool)
        frequent_pair[at] = passes(seen.value, pairs)
        at, prints = buffer.grams(LONGEST)
        return prints[frequent_pair[at] & frequent_pair[at + 1]]

    three = written(frequent(texts, triples, shards, least), "prints")
    every = spark.sparkContext.broadcast(filter_of(spark, one_and_two.unionByName(three)))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for buffer in buffers(batches):
            for part in spelled(buffer, every.value):
                for a in range(0, part.num_rows, 100_000):
                    yield part.slice(a, 100_000)
            buffer = part = None

    found = texts.mapInArrow(tidy(spell), "lang string, n_words int, phrase string, f long").groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))
    kept = written(found.where((F.col("f") >= least) | (F.col("n_words") == 0)), "phrases")
    seen.destroy()
    every.destroy()
    removed(spark, one_and_two, three)
    return kept


def parts_of(phrase: Column, first: int, last: int) -> Column:
    """Words first to last of a phrase, joined by spaces."""
    return F.array_join(F.slice(F.split(phrase, " ", -1), first, last - first + 1), " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, n_words, a, l, r, score of all phrases of two and three words that no longer one stands for."""
    n_rows = counts.count()
    side = lambda name, longest: broadcast_if(
        counts.where(F.col("n_words").between(1, longest)).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(name)), n_rows, BROADCAST_PARTS
    )

    def looked_up(rows: DataFrame, key: Column, name: str) -> DataFrame:
        return rows.join(side(name, LONGEST - 1), (F.col("lang") == F.col("_lang")) & (key == F.col("_phrase"))).drop("_lang", "_phrase")

    candidates = counts.where("n_words >= 2").select("lang", "phrase", "n_words", F.col("f").alias("a"))
    longer = candidates.where(F.col("n_words") == LONGEST)
    inside = longer.select("lang", F.explode(F.array(parts_of(F.col("phrase"), 1, 2), parts_of(F.col("phrase"), 2, 3))).alias("phrase"), F.col("a").alias("_longer"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
    kept = candidates.join(broadcast_if(covered, n_rows, BROADCAST_PARTS), ["lang", "phrase"], "left").where("_longer is null or 100 * _longer < 50 * a").drop("_longer")

    def cut(rows: DataFrame, n: int, k: int) -> DataFrame:
        rows = looked_up(looked_up(rows, parts_of(F.col("phrase"), 1, k), "l"), parts_of(F.col("phrase"), k + 1, n), "r")
        wide = lambda c: F.col(c).cast("decimal(18,0)")
        share = F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")
        rows = rows.withColumn("_share", share.cast("decimal(38,0)")).withColumn("_lr", (wide("l") * wide("r")).cast("decimal(38,0)"))
        return rows.withColumn("score", F.expr("_share div _lr")).withColumn("_k", F.lit(k)).drop("_share", "_lr")

    pairs = cut(kept.where("n_words = 2"), 2, 1)
    triples = kept.where("n_words = 3")
    # Both cuts of a triple in one row: no shuffle to choose between them.
    first = cut(triples, 3, 1).select("lang", "phrase", "n_words", "a", F.struct("score", "_k", "l", "r").alias("_one"))
    second = looked_up(looked_up(first, parts_of(F.col("phrase"), 1, 2), "l"), parts_of(F.col("phrase"), 3, 3), "r")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    second = second.withColumn("_share", (F.lit(1_000_000).cast("decimal(7,0)") * wide("a") * wide("a")).cast("decimal(38,0)")).withColumn("_lr", (wide("l") * wide("r")).cast("decimal(38,0)"))
    second = second.withColumn("_two", F.struct(F.expr("_share div _lr").alias("score"), F.lit(2).alias("_k"), "l", "r")).withColumn("_best", F.least("_one", "_two"))
    columns = ["lang", "phrase", "n_words", "a", "l", "r", "score"]
    return pairs.select(*columns).unionByName(second.select("lang", "phrase", "n_words", "a", "_best.l", "_best.r", "_best.score"))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by score, then count, then the phrase's bytes."""
    counts = phrase_counts(docs, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(counts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    # One row a language.
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
