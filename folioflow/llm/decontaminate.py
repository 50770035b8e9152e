"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming blocks, exact verification.

For each benchmark item, windows of the item's number of words slide over every document, one word at a time (a shorter
document is one window). A window is fingerprinted by two SimHashes of its five-word shingles, one of weighted and one of
equal ones; a shingle's weight is log(1 + items / (1 + items that have it)), where items of equal words count as one.
Fingerprints of 64 bits are cut into 8 blocks: of two within RADIUS bits at least one block differs in RADIUS // 8 bits at
most, so each item is indexed under every such value of each block, and a window looks up its own blocks. This finds every
pair that is within the radius in either fingerprint. Candidates are verified by their shingle sets: they match if the
weighted or the plain Jaccard similarity reaches the least one, as a shingle that no item has weighs more than the items'
own. The similarity that is given is the weighted one, so it may be below the least one.

Windows that have no shingle of any item have similarity 0 and are not fingerprinted: a task looks up each shingle of
whole texts in a table of the items' shingles. The table is broadcast for a block of items at a time, of about
`block_shingles` shingles, so its size does not grow with the benchmark.

Defined cases: null or empty texts, of documents or items, match nothing. Items with equal texts all match. An item is known
by item_id, which may be null, and a hash of its words; matches of items that share a (null) item_id are given as one. A row is
known by doc_id and a 64-bit hash of its text; rows that repeat both give one match. Empty tables give an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, broadcast_if, tidy, written
from .secrets import row_key
from .shingles import FACTOR, WIDTH, chunks, mixed, shingle_hashes, word_hashes

BLOCKS, BITS = 8, 8
#: Bits in which two fingerprints may differ; shingle sets of similarity 0.75 differ in about 11, 3 more or less.
RADIUS = 23
#: Words that a window may be longer than; documents' windows are cut into segments of so many starts.
SEGMENT = 512
#: Rows of the block index up to which it is broadcast (about 60 bytes each); beyond, windows are dealt by block value.
BROADCAST_INDEX = 500_000
SIGNS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int8) * 2 - 1


def bit_signs(hashes: np.ndarray) -> np.ndarray:
    """-1 or 1 for each of a hash's 64 bits."""
    return SIGNS[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)].reshape(-1, 64)


def fingerprints(hashes: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of `size` consecutive shingles; the shingles repeat as often as the window has them."""
    sums = np.concatenate((np.zeros((1, 64)), np.cumsum(bit_signs(hashes) * weights[:, None], axis=0)))
    bits = np.round(sums[size:] - sums[:-size], 6) > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def flips() -> list[int]:
    """Differences of a block in RADIUS // BLOCKS bits at most."""
    return [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BITS), n)]


def shingles_of(text: bytes | None) -> tuple[np.ndarray, int]:
    with np.errstate(over="ignore"):
        words, first = word_hashes([text])
        return shingle_hashes(words, first)[0], len(words)


@tidy
def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item_id, words, hashes (in order of place) of items with words."""
    for batch in batches:
        rows = [(i, *shingles_of(t)) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        rows = [r for r in rows if r[2]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1].view(np.int64) for r in rows], pa.list_(pa.int64()))], names=["item_id", "words", "hashes"])


class Items:
    """A block of items as sorted arrays, for use in tasks: shingles, their weights, and the sizes of the items that have them."""

    def __init__(self, rows, weight_of: dict[int, float], unseen: float):
        self.unseen = unseen
        hashes = np.concatenate([np.zeros(0, np.int64), *(np.array(r["hashes"], np.int64) for r in rows)])
        words = np.repeat(np.array([r["words"] for r in rows], np.int64), [len(r["hashes"]) for r in rows])
        pairs = np.unique(np.stack((hashes, words), axis=1), axis=0)
        # Items of fewer words than a shingle are found as sequences of so many words.
        self.short = {n: pairs[pairs[:, 1] == n, 0] for n in range(1, WIDTH) if (pairs[:, 1] == n).any()}
        self.known, self.first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.sizes = pairs[:, 1]
        self.weights = np.array([weight_of[h] for h in self.known.tolist()])
        self.quick = np.zeros(1 << 16, bool)
        self.quick[self.known.view(np.uint64) & np.uint64(0xFFFF)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands among the known ones, and whether it does."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        own = hashes.view(np.int64)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        return at, self.known[at] == own

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        at, known = self.places(hashes)
        return np.where(known, self.weights[at] if len(self.weights) else 0.0, self.unseen)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of shingles that an item of the block has."""
        maybe = np.flatnonzero(self.quick[hashes & np.uint64(0xFFFF)])
        return maybe[self.places(hashes[maybe])[1]]

    def short_windows(self, words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(text, size, start, hash) of each sequence of words that is a short item."""
        for size, known in self.short.items():
            if len(words) < size:
                continue
            h = np.full(len(words) - size + 1, size, np.uint64)
            for k in range(size):
                h = h * FACTOR + words[k : len(words) - size + 1 + k]
            h = mixed(h)
            for at in np.flatnonzero(np.isin(h.view(np.int64), known)).tolist():
                text = int(np.searchsorted(begin, at, side="right")) - 1
                if at + size <= begin[text + 1]:
                    yield text, size, at - int(begin[text]), h[at : at + 1]

    def windows(self, hashes: np.ndarray, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(size, shingles a window, starts, both fingerprints, hashes from the first start on) of windows with a hit."""
        at: dict[int, list[int]] = defaultdict(list)
        hits = self.hits(hashes)
        for place, k in zip(hits.tolist(), self.places(hashes[hits])[0].tolist(), strict=True):
            for size in self.sizes[self.first[k] : self.first[k + 1]].tolist():
                at[size].append(place)
        for size, places in sorted(at.items()):
            wide = len(hashes) if words <= size else max(1, size - WIDTH + 1)
            last = len(hashes) - wide
            starts = np.unique(np.concatenate([np.arange(max(0, p - wide + 1), min(p, last) + 1) for p in places]))
            for run in np.split(starts, np.flatnonzero((np.diff(starts) > 1) | (np.arange(1, len(starts)) % SEGMENT == 0)) + 1):
                part = hashes[run[0] : run[-1] + wide]
                yield size, wide, run, fingerprints(part, self.weigh(part), wide), fingerprints(part, np.ones(len(part)), wide), part


SEGMENTS = "row_key string, doc_id long, size int, wide int, start int, prints array<long>, plain array<long>, hashes array<long>"


def segmenter(items):
    @tidy
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names = items.value, [x.split()[0] for x in SEGMENTS.split(", ")]
        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), []
            keys, ids = batch.column("row_key").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in chunks(texts):
                with np.errstate(over="ignore"):
                    words, begin = word_hashes(texts[a:b])
                    hashes, first = shingle_hashes(words, begin)
                    for i, size, start, part in block.short_windows(words, begin):
                        rows.append((keys[a + i], ids[a + i], size, 1, start, fingerprints(part, block.weigh(part), 1).view(np.int64), fingerprints(part, np.ones(1), 1).view(np.int64), part.view(np.int64)))
                for i in np.unique(np.searchsorted(first, block.hits(hashes), side="right") - 1).tolist():
                    for size, wide, run, prints, plain, part in block.windows(hashes[first[i] : first[i + 1]], int(begin[i + 1] - begin[i])):
                        rows.append((keys[a + i], ids[a + i], size, wide, int(run[0]), prints.view(np.int64), plain.view(np.int64), part.view(np.int64)))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return segment


def block_index(items: DataFrame) -> DataFrame:
    """item_key, size, print, plain, kind (0: by weights, 1: plain), block, value: each item under every value of its blocks within the radius."""

    @tidy
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda h, w: int(fingerprints(np.array(h, np.int64).view(np.uint64), np.array(w), len(h)).view(np.int64)[0])
        for batch in batches:
            hashes, weights = batch.column("hashes").to_pylist(), batch.column("weights").to_pylist()
            found = [[one(h, w) for h, w in zip(hashes, weights, strict=True)], [one(h, [1.0] * len(h)) for h in hashes]]
            yield pa.RecordBatch.from_arrays([batch.column("item_key"), batch.column("words"), *(pa.array(f, pa.int64()) for f in found)], names=["item_key", "size", "print", "plain"])

    own = F.when(F.col("kind") == 0, F.col("print")).otherwise(F.col("plain"))
    near = F.transform(F.array(*map(F.lit, flips())), lambda x: block_value(own, F.col("block")).bitwiseXOR(x))
    marked = items.mapInArrow(prints, "item_key string, size int, print long, plain long").withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("block", F.explode(F.array(*map(F.lit, range(BLOCKS)))))
    return marked.withColumn("value", F.explode(near))


def block_value(print_, block):
    return F.element_at(F.array(*[F.shiftrightunsigned(print_, BITS * i).bitwiseAND((1 << BITS) - 1).cast("int") for i in range(BLOCKS)]), block + 1)


def verifier(weights, least: float):
    @tidy
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = weights.value
        for batch in batches:
            scores, enough = [], []
            for window, item in zip(batch.column("window"), batch.column("hashes"), strict=True):
                a, b = (np.unique(x.values.to_numpy()) for x in (window, item))
                both = np.intersect1d(a, b, assume_unique=True)
                shared, own, its = (block.weigh(x).sum() for x in (both, a, b))
                scores.append(float(shared / (own + its - shared)))
                enough.append(scores[-1] >= least - 1e-12 or len(both) >= least * (len(a) + len(b) - len(both)))
            table = pa.table([*(batch.column(c) for c in ("row_key", "doc_id", "item_id", "start", "size")), pa.array(scores, pa.float64())], names=["row_key", "doc_id", "item_id", "start", "size", "similarity"])
            yield from table.filter(pa.array(enough, pa.bool_())).to_batches()

    return verify


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, block_shingles: int = 200_000) -> DataFrame:
    """doc_id, row_key, item_id, similarity, start, size: the best window of each document and item that match."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.where("text is not null").select("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.col("text").cast("binary").alias("text"))
    items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(items_of, "item_id long, words int, hashes array<long>").distinct(), "items")
    sums = items.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("shingles")).first()
    different = items.select("words", "hashes").distinct()
    n_different = different.count()
    unseen = float(np.log(1 + n_different))
    counted = different.select(F.explode(F.array_distinct("hashes")).alias("h")).groupBy("h").agg(F.count("*").cast("double").alias("n"))
    weights = written(counted.select("h", F.log(1 + n_different / (1 + F.col("n"))).alias("w")), "weights")
    n_blocks = max(1, -(-sums["shingles"] // block_shingles))
    found = None
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n_blocks)) == block)
        rows = own.collect()  # about block_shingles longs
        of = own.select(F.explode("hashes").alias("h")).distinct().join(weights, "h")
        items_in = Items(rows, {r["h"]: r["w"] for r in of.collect()}, unseen)
        table = spark.sparkContext.broadcast(items_in)
        segments = written(texts.mapInArrow(segmenter(table), SEGMENTS), "segments")
        weighed = spark.createDataFrame([(r["item_id"], r["words"], r["hashes"], items_in.weigh(np.array(r["hashes"], np.int64)).tolist()) for r in rows], "item_id long, words int, hashes array<long>, weights array<double>")
        weighed = weighed.withColumn("item_key", row_key(F.col("item_id"), F.array_join(F.col("hashes").cast("array<string>"), " ")))
        index = block_index(weighed)
        one = segments.select("row_key", "size", F.col("start").alias("_first"), F.posexplode(F.arrays_zip("prints", "plain")).alias("at", "p"))
        one = one.select("row_key", "size", "_first", "at", F.col("p.prints").alias("window_print"), F.col("p.plain").alias("window_plain"))
        values = [F.struct(F.lit(k).alias("kind"), F.lit(i).alias("block"), block_value(F.col(c), F.lit(i)).alias("value")) for k, c in enumerate(("window_print", "window_plain")) for i in range(BLOCKS)]
        blocks = one.withColumn("b", F.explode(F.array(*values))).select("*", "b.kind", "b.block", "b.value").drop("b")
        # An item has two fingerprints of 8 blocks under 37 values each.
        met = blocks.join(broadcast_if(index, len(rows) * 2 * BLOCKS * len(flips()), BROADCAST_INDEX), ["size", "kind", "block", "value"])
        # A pair that meets in several blocks is taken in the first of them only, and by plain ones only if weights don't find it.
        by_weights, by_plain = F.col("print").bitwiseXOR(F.col("window_print")), F.col("plain").bitwiseXOR(F.col("window_plain"))
        near = met.where(F.when(F.col("kind") == 0, F.bit_count(by_weights) <= RADIUS).otherwise((F.bit_count(by_plain) <= RADIUS) & (F.bit_count(by_weights) > RADIUS)))
        differ = F.when(F.col("kind") == 0, by_weights).otherwise(by_plain)
        first = F.array_min(F.filter(F.array(*map(F.lit, range(BLOCKS))), lambda i: F.bit_count(block_value(differ, i).cast("long")) <= RADIUS // BLOCKS))
        pairs = written(near.where(F.col("block") == first).select("row_key", "size", F.col("_first").alias("start"), "at", "item_key"), "pairs")
        # Shingles come to the pairs last: a segment's once, and the window is cut from it.
        windows = pairs.join(segments.select("row_key", "doc_id", "size", "wide", "start", "hashes").withColumnRenamed("hashes", "part"), ["row_key", "size", "start"])
        windows = windows.select("row_key", "doc_id", "item_key", "size", (F.col("start") + F.col("at")).alias("start"), F.slice("part", F.col("at") + 1, F.col("wide")).alias("window"))
        texts_of = weighed.select("item_key", "item_id", "hashes").dropDuplicates(["item_key"])  # about block_shingles longs
        checked = windows.join(F.broadcast(texts_of), ["item_key"]).mapInArrow(verifier(table, least), "row_key string, doc_id long, item_id long, start int, size int, similarity double")
        best = checked.groupBy("row_key", "doc_id", "item_id").agg(F.max_by(F.struct("similarity", "start", "size"), F.struct("similarity", -F.col("start"))).alias("m"))
        best = written(best.select("doc_id", "row_key", "item_id", "m.similarity", "m.start", "m.size"), "matches")
        table.destroy()
        found = best if found is None else found.unionByName(best)
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.75, broadcast_rows: int = 200_000) -> DataFrame:
    """docs less those that match an item; all columns."""
    bad = written(contaminated(docs, benchmark, least).select(F.col("row_key").alias("_row_key")).distinct(), "contaminated")
    side = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    return docs.join(side, row_key(docs["doc_id"], docs["text"]) == side["_row_key"], "left_anti")
