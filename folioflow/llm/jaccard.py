"""N-gram Jaccard join over all documents, by token-combination prefixes.

Tokens are a document's distinct five-word shingles. They are ordered: rare ones first, then frequent ones by count.
A document of n tokens links only with documents that miss at most n - ceil(t n) of them, so of a prefix of one more
token at least one is shared: single tokens are indexed for the rare class. Frequent tokens are dealt into groups by
hash; a group shares two tokens unless all of its tokens in the prefix but one are missed, so the prefix is extended
by one token a group, and pairs of tokens of a group are indexed. Sets of fewer than SMALL tokens index single
tokens only. Which tokens count as frequent affects cost and never the result.

Documents with the same token set are one class from the start. Candidates must pass two bounds that no linked pair
fails: the indexed tokens that they share, and a sketch (tokens counted by hash in about as many bins as tokens; the
lesser counts sum to no less than the shared tokens). Those that do are verified on their whole token sets. Groups of similar documents are not expanded into pairs: in each bucket, members are first verified against a hub
of about their size, and buckets whose members are of one component by then are done. What is left (members of different components in
one bucket, not yet verified) is verified pair by pair. Every linked pair thus ends in one component.

Buckets of very frequent pairs are salted by class for the hub rounds. Only the table of frequent tokens is broadcast,
at most `most_frequent` rows.

Defined cases: null or empty text has no tokens, is a component of its own and links with nothing. A null doc_id is
never a component's id while another is there. Rows that repeat doc_id and text are alike. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, broadcast_if, removed, tidy, written
from .shingles import FACTOR, mixed, sets

#: Token sets below this size index single tokens only.
SMALL = 16
#: Times a token must occur in a task to be counted there: others are rare for sure.
LOCAL = 2
#: Rows of a table of ids up to which it is broadcast.
BROADCAST_IDS = 500_000
#: Members that a salted bucket of a frequent pair is expected to have.
SALTED = 2000
#: Pairs in buckets, by row, up to which members meet pair by pair at once and not their hubs first.
FEW_PAIRS = 16


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def set_key(tokens: np.ndarray) -> int | None:
    """A 64-bit name of a token set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


MEASURED = "doc_id long, text_hash long, n int, cls long, token long, sketch binary, parity array<long>"
#: Words of 64 bits of a set's parity: how often the tokens of a bin occur, modulo 2. Two sets differ in as many tokens at least as in bits.
PARITY = 12
#: The first words of a parity: all of it folded into so many, enough to tell sets of up to WIDE tokens apart. Larger ones have the rest too.
FOLDED = 4
WIDE = 256


def parity(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((mixed(tokens + FACTOR) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    parts = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(-1, FOLDED)
    folded = np.bitwise_xor.reduce(parts)
    return np.concatenate((folded, parts[1:].ravel() if len(tokens) > WIDE else np.zeros(PARITY - FOLDED, np.int64)))


def bits_apart(a: str, b: str, both_wide: Column) -> Column:
    """Bits in which two parities differ; words of the first are in columns a0, a1 .., of the second in b0, b1 .."""
    xor = [F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}")) for i in range(PARITY)]
    first = [reduce(Column.bitwiseXOR, xor[i::FOLDED]) for i in range(FOLDED)]
    total = lambda parts: reduce(Column.__add__, map(F.bit_count, parts))
    return F.when(both_wide, total(first + xor[FOLDED:])).otherwise(total(xor[:FOLDED]))


def sketch(tokens: np.ndarray) -> bytes | None:
    """Counts of tokens in 2**k bins, at most as many as tokens; none if a count passes 255."""
    if not len(tokens):
        return None
    bins = 1 << (len(tokens).bit_length() - 1)
    counts = np.bincount((mixed(tokens) & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return None if counts.max() > 255 else counts.astype(np.uint8).tobytes()


def may_share(x: bytes | None, y: bytes | None) -> int | None:
    """At least as many tokens as the two sets share; none if that isn't known."""
    if x is None or y is None:
        return None
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    small = min(len(a), len(b))
    a, b = (v.reshape(-1, small).sum(axis=0, dtype=np.int64) for v in (a, b))
    return int(np.minimum(a, b).sum())


@tidy
def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document, with size and class; then rows (n: count, token) of tokens that the task met often."""
    held: list[np.ndarray] = []
    size = 0

    def often() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= LOCAL
        n = int(keep.sum())
        empty = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([empty, empty, pa.array(counts[keep], pa.int32()), empty, signed(tokens[keep]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], names=[x.split()[0] for x in MEASURED.split(", ")])

    for batch in batches:
        tokens = list(sets(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(map(len, tokens), pa.int32()), pa.array(map(set_key, tokens), pa.int64()), pa.nulls(len(tokens), pa.int64()), pa.array(map(sketch, tokens), pa.binary()), pa.array(map(parity, tokens), pa.list_(pa.int64()))],
            names=[x.split()[0] for x in MEASURED.split(", ")],
        )
        held += tokens
        size += sum(map(len, tokens))
        if size > 1_000_000:
            yield often()
            held, size = [], 0
    if held:
        yield often()


def level(n: int) -> int:
    return 0 if n < SMALL else n.bit_length()


def signatures(tokens: np.ndarray, rank: np.ndarray, count: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a token set, and in how many salts each bucket is dealt; rank is -1 for rare tokens."""
    n = len(tokens)
    least = -(-percent * n // 100)
    need = n - least + 1
    order = np.lexsort((tokens, rank))
    tokens, rank, count = tokens[order], rank[order], count[order]
    rare = int((rank < 0).sum())
    out, salts = [tokens[: min(rare, need)]], [np.ones(min(rare, need), np.int64)]
    levels = {level(n), level(max(1, least))}
    if 0 in levels and rare < need:
        out.append(mixed(tokens[rare:need]))
        salts.append(1 + count[rare:need] // SALTED)
    for lv in sorted(levels - {0}) if rare < need else ():
        groups = np.uint64(1 << (lv - 4))  # about an eighth of the tokens
        group = (mixed(tokens[rare:]) % groups).astype(np.int64)
        by = np.argsort(group, kind="stable")
        repeats = np.zeros(len(by), np.int64)  # does a token add one to what must be missed: all but a group's first do
        repeats[by[1:]] = group[by[1:]] == group[by[:-1]]
        end = int(np.searchsorted(np.cumsum(repeats), need - rare)) + 1
        by = by[by < end]
        sized = np.diff(np.flatnonzero(np.concatenate(([True], group[by[1:]] != group[by[:-1]], [True]))))
        start = np.repeat(np.cumsum(sized) - sized, sized)
        for back in range(1, int(sized.max(initial=1))):
            at = np.flatnonzero(np.arange(len(by)) - back >= start)
            a, b = tokens[rare:][by[at - back]], tokens[rare:][by[at]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            out.append(mixed(low * np.uint64(3) + mixed(high) + np.uint64(lv)))
            salts.append(1 + np.minimum(count[rare:][by[at - back]], count[rare:][by[at]]) // SALTED)
    return np.concatenate(out), np.concatenate(salts)


def indexer(frequent, percent: int):
    """sig, cls, and a note: the bucket's salt (-1: none), and in the low half twice the size, and 1 if the prefix is of rare tokens only."""

    @tidy
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks, counts = frequent.value
        for batch in batches:
            found, classes, notes = [], [], []
            for tokens in sets(batch.column("text").to_pylist()):
                if not len(tokens):
                    continue
                at = np.minimum(np.searchsorted(known, tokens), max(len(known) - 1, 0))
                hit = known[at] == tokens if len(known) else np.zeros(len(tokens), bool)
                rank = np.where(hit, ranks[at] if len(known) else 0, -1)
                with np.errstate(over="ignore"):
                    own, dealt = signatures(tokens, rank, np.where(hit, counts[at] if len(known) else 0, 0), percent)
                cls = set_key(tokens)
                n = len(tokens)
                pure = int((rank < 0).sum()) > n - -(-percent * n // 100)
                found.append(own)
                classes.append(np.full(len(own), cls, np.int64))
                notes.append((np.where(dealt > 1, abs(cls) % dealt, -1) << 32) + 2 * n + pure)
            if found:
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(found)), pa.array(np.concatenate(classes)), pa.array(np.concatenate(notes))], names=["sig", "cls", "note"])

    return index


@tidy
def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = list(sets(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(map(set_key, tokens), pa.int64()), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["cls", "tokens"])


def linker(percent: int):
    @tidy
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return link


def sifter(percent: int):
    """Keeps the pairs whose sketches allow a link."""

    @tidy
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                both = may_share(x, y)
                keep.append(both is None or 100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sift


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, standing: DataFrame, percent: int) -> DataFrame:
    """a, b, linked of the pairs that may link by their sketches, on whole token sets. A set moves once a pair."""
    dealt = sketches.select("cls", "sketch", "n").repartition("cls")  # once, for both sides
    left = dealt.select(F.col("cls").alias("a"), F.col("sketch").alias("x"), "n")
    right = dealt.select(F.col("cls").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("m"))
    close = written(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(sifter(percent), "a long, b long"), "sifted")
    named = close.select(F.col("a").alias("cls")).unionByName(close.select(F.col("b").alias("cls"))).distinct()
    chosen = written(standing.join(named, "cls", "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "needed")
    tokens = written(keyed(texts, chosen, "left_semi").select("text").mapInArrow(whole_sets, "cls long, tokens binary"), "tokens")
    dealt = tokens.dropDuplicates(["cls"]).repartition("cls")
    left, right = dealt.select(F.col("cls").alias("a"), F.col("tokens").alias("x")), dealt.select(F.col("cls").alias("b"), F.col("tokens").alias("y"))
    both = close.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    found = written(both.mapInArrow(linker(percent), "a long, b long, linked boolean"), "verified")
    removed(pairs.sparkSession, close, chosen, tokens)
    return found


def components(edges: DataFrame) -> DataFrame:
    """cls, comp: the least class of each component, by passing minima along edges and jumping to the label's label."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "cls").select("cls", F.col("comp").alias("_was"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("_jump"))
        after = written(lower.join(jump, "comp", "left").select("cls", "_was", F.least("comp", F.coalesce("_jump", "comp")).alias("comp")), "labels")
        labels = after.select("cls", "comp")
        if after.where("comp <> _was").isEmpty():
            return labels


def join_components(docs: DataFrame, percent: int = 75, frequent: int = 24, most_frequent: int = 1 << 20, hub_rounds: int = 1, by_row: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id; if by_row, doc_id, text_hash, component (null if there are no shingles)."""
    spark = docs.sparkSession
    arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    rows = written(texts.mapInArrow(measured, MEASURED), "measured")
    members = rows.where("token is null")
    # The first of each class by doc_id stands for it; only it goes on.
    standing = written(
        members.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"), F.min("n").alias("n"))
        .select("cls", "n", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash")), "classes",
    )
    copies = members.join(standing.select("cls", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "cls")
    copies = written(copies.where(~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "copies")
    known = written(rows.where("token is not null").groupBy("token").agg(F.sum("n").alias("count")).where(F.col("count") >= frequent), "frequent")
    top = known.orderBy(F.desc("count"), "token").limit(most_frequent).toPandas()
    token, count = top["token"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    rank = np.empty(len(top), np.int64)
    rank[np.lexsort((token, count))] = np.arange(len(top))
    order = np.argsort(token)
    table = spark.sparkContext.broadcast((token[order], rank[order], count[order]))

    one_each = keyed(texts, copies, "left_anti")
    signs = one_each.select("text").mapInArrow(indexer(table, percent), "sig long, cls long, note long")
    low = F.col("note").bitwiseAND(0xFFFFFFFF)
    facts = {"salt": F.shiftright("note", 32).cast("int"), "n": F.shiftright(low, 1).cast("int"), "pure": low.bitwiseAND(1) == 1}
    buckets = Window.partitionBy("sig", "salt")
    met_in = Window.partitionBy("sig", F.shiftright("note", 32))
    # Buckets of one class are done; salted ones are met again through their hubs and in the last step.
    # Sums of 32 bits of two hashes name a bucket's members, repeated ones as often as they are there.
    halves = [(F.shiftright(h, 32), h.bitwiseAND(0xFFFFFFFF)) for h in (F.xxhash64("cls"), F.xxhash64("cls", F.lit(7)))]
    names = ["f", "g", "f2", "g2"]
    marks = {"size": F.count("*")} | dict(zip(names, [F.sum(x) for pair in halves for x in pair], strict=True))
    buckets_met = signs.withColumns({c: m.over(met_in) for c, m in marks.items()}).where("size > 1 or note >= 0")
    buckets_met = written(buckets_met.withColumns(facts).drop("note"), "buckets")
    table.destroy()
    # Of buckets of equal members (tokens of one passage) one is kept, with their number as its weight.
    whole = buckets_met.where("salt = -1")
    kept = whole.groupBy("size", *names).agg(F.min("sig").alias("sig"), (F.count("*") / F.col("size")).cast("long").alias("w")).select("sig", "w")
    shared = written(whole.join(kept, "sig").drop(*names).unionByName(buckets_met.where("salt >= 0").drop(*names).withColumn("w", F.lit(1).cast("long"))), "shared")
    # A hub is the class of about the same size that meets most others: the origin of edited copies rather than one of them.
    degree = shared.groupBy("cls").agg(F.sum(F.col("size") * F.col("w")).alias("degree"))
    alike = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    around = buckets.orderBy("alike").rangeBetween(-1, 1)
    hubs = shared.join(degree, "cls").withColumn("alike", alike).withColumn("hub", F.max(F.struct("degree", "cls", "n")).over(around))
    index = written(hubs.select("sig", "salt", "cls", "n", "pure", "w", "degree", "alike", F.col("hub.cls").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.degree").alias("hub_degree")), "index")
    removed(spark, buckets_met, shared)
    salted = index.where("salt >= 0").select("sig").distinct()
    across = Window.partitionBy("sig").orderBy("alike").rangeBetween(-1, 1)
    heads = index.join(salted, "sig", "left_semi").select("sig", "alike", F.col("hub").alias("cls"), F.col("hub_n").alias("n"), F.col("hub_degree").alias("degree")).distinct()
    heads = heads.withColumn("top", F.max(F.struct("degree", "cls", "n")).over(across)).select("sig", "cls", "n", F.col("top.cls").alias("hub"), F.col("top.n").alias("hub_n"), F.lit(1).cast("long").alias("w"))
    near = (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (F.col("cls") != F.col("hub"))
    met = index.select("sig", "cls", "n", "hub", "hub_n", "w").unionByName(heads).where(near).groupBy("cls", "hub").agg(F.sum("w").alias("shared"))
    needed = index.select("cls").distinct()
    sketches = written(members.join(needed, "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity")), "sketches")

    # Round 0: each class against the hub that it shares most buckets with.
    pairs = met.groupBy(F.col("cls").alias("a")).agg(F.max_by("hub", F.struct("shared", "hub")).alias("b")).distinct()
    done = verified(pairs, sketches, texts, standing, percent)
    labels = components(done.where("linked"))
    for step in range(hub_rounds + 1):
        open_rows = written(unresolved(index, labels), "open")
        counts = open_rows.groupBy("sig", "comp").agg(F.count("*").alias("c")).groupBy("sig").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        work = counts.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"), F.sum("s").alias("rows")).first()
        if not work["rows"]:
            break
        last = step == hub_rounds or work["pairs"] <= FEW_PAIRS * work["rows"]
        pairs = crossing(open_rows, sketches, percent) if last else to_hubs(open_rows, percent, step)
        pairs = written(pairs.join(done.select("a", "b"), ["a", "b"], "left_anti").join(done.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"), "pairs")
        done = written(done.unionByName(verified(pairs, sketches, texts, standing, percent)), "done")
        labels = components(done.where("linked"))
        removed(spark, open_rows, pairs)
        if last:
            break

    named = standing.join(labels, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "doc_id")
    if by_row:
        return members.join(written(named.select("cls", F.col("comp").alias("component")), "components"), "cls", "left").select("doc_id", "text_hash", "component")
    ids = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_class = written(named.join(ids, "comp").select(F.col("cls"), "component_id"), "components")
    found = members.join(of_class, "cls", "left")
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keyed(texts: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    side = broadcast_if(ids, ids.count(), BROADCAST_IDS)
    return texts.join(side, texts["doc_id"].eqNullSafe(side["_id"]) & texts["text_hash"].eqNullSafe(side["_hash"]), how)


def unresolved(index: DataFrame, labels: DataFrame) -> DataFrame:
    """sig, cls, n, pure, w, comp of the buckets that have members of different components."""
    named = index.select("sig", "cls", "n", "pure", "w").distinct().join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    several = named.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
    return named.join(several, "sig", "left_semi")


def to_hubs(rows: DataFrame, percent: int, step: int) -> DataFrame:
    """Members against a hub of their bucket; each bucket has another one, and each round."""
    hub = rows.groupBy("sig").agg(F.min_by(F.struct("cls", "n", "comp"), F.xxhash64("cls", "sig", F.lit(step))).alias("h"))
    met = rows.join(hub, "sig").where(F.col("comp") != F.col("h.comp")).where(100 * F.least("n", F.col("h.n")) >= percent * F.greatest("n", F.col("h.n")))
    return met.select(F.col("cls").alias("a"), F.col("h.cls").alias("b")).distinct()


def crossing(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of two components that meet in a bucket.

    Components are paired first. Two of one class each must allow a link by their parities, and if their prefixes are
    rare tokens only, share enough of what is indexed: all that the one prefix that ends first shares is, and the rest
    can add no more than the tokens after it. Then a pair of components is expanded: into all pairs of their members
    if those are fewer than the meetings in buckets, else into the pairs that meet.
    """
    words = [f"p{i}" for i in range(PARITY)]
    known = sketches.select("cls", *[F.col("parity")[i].alias(w) for i, w in enumerate(words)])
    classes = written(rows.select("cls", "n", "pure", "comp").distinct().join(known, "cls"), "open-classes")
    one = F.count("*") == 1
    info = classes.groupBy("comp").agg(F.count("*").alias("size"), F.min("n").alias("low"), F.max("n").alias("high"), F.every("pure").alias("pure"), *[F.when(one, F.first(w)).alias(w) for w in words])
    counts = written(rows.groupBy("sig", "comp", "w").agg(F.count("*").alias("c")).join(info, "comp"), "bucket-counts")
    # Dealt once: the other side of the join is the same exchange under other names.
    dealt = counts.repartition("sig")
    other = dealt.select("sig", *[F.col(c).alias(f"b_{c}") for c in ("comp", "w", "c", "size", "low", "high", "pure")], *[F.col(w).alias(f"b_{w}") for w in words])

    def close(n, m):
        """Bits that differ, against the most tokens in which linked sets of these sizes do; true where a parity is not known."""
        bits = bits_apart("p", "b_p", (n > WIDE) & (m > WIDE))
        return F.coalesce((100 + percent) * bits <= (100 - percent) * (n + m), F.lit(True))

    fits = (F.col("comp") < F.col("b_comp")) & (100 * F.least("high", "b_high") >= percent * F.greatest("low", "b_low")) & close(F.col("low"), F.col("b_low"))
    same = ("size", "b_size", "low", "b_low", "pure", "b_pure")
    meetings = written(dealt.join(other, "sig").where(fits).select("sig", "comp", "b_comp", F.least("w", "b_w").alias("w"), "c", "b_c", *same), "meetings")
    met = meetings.groupBy("comp", "b_comp").agg(F.sum("w").alias("k"), F.sum(F.col("w") * F.col("c") * F.col("b_c")).alias("met"), *[F.first(c).alias(c) for c in same])
    after = F.ceil(F.greatest("low", "b_low") * F.lit(percent) / 100) - 1
    enough = (F.col("k") + after) * (100 + percent) >= percent * (F.col("low") + F.col("b_low"))
    alone = (F.col("size") == 1) & (F.col("b_size") == 1) & F.col("pure") & F.col("b_pure")
    # The smaller component comes first, so that its members meet the other's and not the other way round.
    swap = F.col("size") > F.col("b_size")
    first, second = F.when(swap, F.col("b_comp")).otherwise(F.col("comp")), F.when(swap, F.col("comp")).otherwise(F.col("b_comp"))
    # Two single classes that meet are the pair itself.
    single = (F.col("size") == 1) & (F.col("b_size") == 1)
    kept = met.where(enough | ~alone).select("comp", "b_comp", first.alias("small"), second.alias("large"), single.alias("single"), (F.col("size") * F.col("b_size") <= F.col("met")).alias("whole"))
    kept = written(kept, "component-pairs")
    near = (100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")) & close(F.col("n"), F.col("b_n"))
    own, its = classes.select("cls", "n", "comp", *words), classes.select(F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("comp").alias("b_comp"), *[F.col(w).alias(f"b_{w}") for w in words])
    only = classes.groupBy("comp").agg(F.first("cls").alias("cls"), F.count("*").alias("classes")).where("classes = 1").select("comp", "cls")
    singles = kept.where("single").select("comp", "b_comp").join(only, "comp").withColumnRenamed("cls", "a")
    singles = singles.join(only.select(F.col("comp").alias("b_comp"), F.col("cls").alias("b")), "b_comp").select("a", "b")
    whole = kept.where("whole and not single").select("small", "large").join(own, F.col("small") == F.col("comp"))
    all_pairs = whole.join(its, (F.col("large") == F.col("b_comp")) & near).select(F.col("cls").alias("a"), "b")
    meet = meetings.join(kept.where("not whole and not single").select("comp", "b_comp", "small", "large"), ["comp", "b_comp"]).select("sig", "small", "large")
    several = kept.where("not whole and not single").select("small", "large")
    needed = several.select(F.col("small").alias("comp")).unionByName(several.select(F.col("large").alias("comp"))).distinct()
    members = rows.select("sig", "cls").join(own.join(needed, "comp", "left_semi"), "cls").repartition("sig", "comp")
    ours, theirs = members, members.select(F.col("sig").alias("sig_b"), F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("comp").alias("b_comp"), *[F.col(w).alias(f"b_{w}") for w in words])
    near_members = meet.join(ours, (meet["sig"] == ours["sig"]) & (meet["small"] == ours["comp"])).select(meet["sig"].alias("at_sig"), "large", "cls", "n", *words)
    in_buckets = near_members.join(theirs, (F.col("at_sig") == F.col("sig_b")) & (F.col("large") == F.col("b_comp")) & near).select(F.col("cls").alias("a"), "b")
    return singles.unionByName(all_pairs).unionByName(in_buckets).distinct()
