"""Scores of texts by a hierarchical Pitman-Yor model of word pairs, seated by Gibbs sampling.

A-Z are lower-cased; tokens are words and one end a text. Each context (the word before, or the text's start) is a
restaurant whose customers are the tokens that follow it; a customer at a new table of a dish is also a customer of the
parent restaurant, which all contexts share and whose own parent is uniform over the known tokens and an unknown one. With
c customers and t tables of a dish, and C and T of its restaurant, the dish has probability
(c - d t + (theta + d T) * parent) / (theta + C); it is averaged over the sampled seatings, which it is linear in.

How it runs. Tokens are 64-bit hashes in contexts and the leading 40 bits of them as dishes (of n different tokens about
n * n / 2**41 pairs share a dish, which moves their probabilities and nothing else; counts and n_known go by 64 bits).
1. Training tokens are counted in shards of their hash: their number, how many differ, and the frequent ones.
2. Each buffer of texts sends its distinct pairs with their training counts to the shard of the context; a shard seats its
   restaurants, with its own dishes' shares of contexts for the parent (contexts are dealt by hash, so they are a fair
   sample), and tells the dishes' shards how many tables they have.
3. Dishes' shards seat the parent restaurant, and answer each context's shard with its dishes' probabilities.
4. Pairs go to the contexts' shards again, with the documents that hold them; shards seat their restaurants given the
   parent and send each buffer its documents' sums, which are added up.
Nothing but a table of frequent contexts (at most 2**20, two longs each) and a few totals passes the driver. Frequent
contexts, and the start, are dealt by context and dish; their C is known to all, and their T is taken from the part at
hand. Shards are as many as the corpus needs, so each holds a bounded number of tokens.

Gibbs: a restaurant with T tables has the weight Gamma(theta / d + T) d**T in all its seatings, which is the integral of
(d u)**T over u ~ Gamma(theta / d). Each step draws u given T; given u the dishes are independent, and a dish of c customers
has t tables with weight S(c, t) (d u parent)**t, S being the generalized Stirling numbers of discount d, the sums over all
ways to seat c customers at t tables. So each step seats all customers of each dish anew, by the exact conditional: t is
drawn from these weights, listed up to `LISTED` customers. For more customers of one dish in a shard, where the lists end,
t is drawn from the law's saddle point (its mean is off by less than 0.5 % there). `BURN` steps pass, then `SAMPLES` count. Discounts
come from the numbers of dishes that occur once and twice. Draws are seeded by shard: reruns agree.

Defined cases. Null and empty texts have one token, the end. A null doc_id counts as empty text in the split, repeated
rows are scored and learned from as often as they stand, a very long text is a buffer of its own. Without training rows every
token is unknown: the base score is log10(0.1 / 0.1) a token, V being 0, and so is the model's. An empty table gives an
empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import counted
from .common import arrow_batches, removed, split_of, tidy, written
from .shingles import BLANK, FACTOR, hashed_words, mixed

START, END = np.uint64(0x51A7C0DE00000001), np.uint64(0xE4D0C0DE00000002)
DISH = np.uint64(24)  # bits of a hash that a dish drops
#: Bytes of text in a buffer, tokens in a shard, contexts that are dealt by dish at most.
BUFFER, SHARD, SPLIT = 8 << 20, 2 << 20, 1 << 20
FIRST, BURN, SAMPLES, THETA = 12, 4, 4, 1.0
#: Customers of a dish up to which the weights of its numbers of tables are listed.
LISTED = 2048
PACKED = "shard int, kind int, rid long, u binary, width binary, low binary, high binary, c binary, refs binary, doc_low binary, doc_high binary, times binary"
HEADER = "doc_id array<long>, held array<boolean>, n_tokens array<long>"


class Tokens:
    """Contexts, tokens and documents of a buffer of texts, and which documents are held out."""

    def __init__(self, texts: list[bytes], held: list[bool]) -> None:
        joined = b"\n".join(texts).lower()
        begin, _, words = hashed_words(joined, BLANK)
        first = np.searchsorted(begin, np.cumsum([0, *[len(t) + 1 for t in texts]]))
        sizes = np.diff(first)
        n = len(words) + len(texts)
        place = np.arange(len(words)) + np.repeat(np.arange(len(texts)), sizes)
        self.context, self.token = np.full(n, START, np.uint64), np.full(n, END, np.uint64)
        self.token[place], self.context[place + 1] = words, words
        self.sizes = sizes + 1
        self.doc = np.repeat(np.arange(len(texts), dtype=np.uint32), self.sizes)
        self.train = ~np.array(held, bool)[self.doc]


class Batch(NamedTuple):
    rid: int
    ids: list
    held: list
    tokens: Tokens


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
    """Buffers of text, held, doc_id; their numbers are the same whenever the task runs again."""
    rid, texts, held, ids, size = TaskContext.get().partitionId() << 32, [], [], [], 0
    for batch in batches:
        for text, out, doc_id in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            texts.append(text.as_py() or b"")
            held.append(out)
            ids.append(doc_id)
            size += len(texts[-1])
            if size >= BUFFER or len(texts) >= 1 << 16:
                yield Batch(rid, ids, held, Tokens(texts, held))
                rid, texts, held, ids, size = rid + 1, [], [], [], 0
    if texts:
        yield Batch(rid, ids, held, Tokens(texts, held))


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def packed(batch: Batch, split: np.ndarray, bits: int, with_docs: bool) -> list[tuple]:
    """Rows of PACKED: the distinct pairs of a buffer by shard, with training counts and, if asked for, documents."""
    t = batch.tokens
    dish = t.token >> DISH
    is_split = np.isin(t.context, split)
    with np.errstate(over="ignore"):
        place = np.where(is_split, mixed(t.context ^ dish * FACTOR), t.context)
    shard = shard_of(place, bits)
    _, rank = np.unique(t.context, return_inverse=True)
    order = np.argsort((rank.astype(np.uint64) << np.uint64(40)) | dish, kind="stable")
    # Tokens of unsplit contexts are in order of shard now; those of split ones are sorted into it.
    order = order[np.argsort(shard[order], kind="stable")]
    shard, context, dish, doc, train = shard[order], t.context[order], dish[order], t.doc[order], t.train[order]
    pair = runs(shard, context, dish)
    count = np.add.reduceat(train.astype(np.uint32), pair).astype(np.uint32) if len(pair) else np.zeros(0, np.uint32)
    held_by = runs(shard, context, dish, doc)
    times = np.diff(np.concatenate((held_by, [len(doc)]))).astype(np.uint32)
    refs = np.diff(np.concatenate((np.searchsorted(held_by, pair), [len(held_by)]))).astype(np.uint32)
    first = runs(shard[pair], context[pair])  # of each context's pairs
    width = np.diff(np.concatenate((first, [len(pair)]))).astype(np.uint32)
    out, wanted = [], np.unique(shard)
    cut = lambda values: np.searchsorted(values, np.append(wanted, 1 << 40))
    p, c, h = cut(shard[pair]), cut(shard[pair[first]]), cut(shard[held_by])
    dish, docs = dish[pair], doc[held_by]
    for i, s in enumerate(wanted):
        a, b = slice(p[i], p[i + 1]), slice(c[i], c[i + 1])
        row = [int(s), 1, batch.rid, context[pair[first[b]]], width[b], dish[a].astype(np.uint32), (dish[a] >> np.uint64(32)).astype(np.uint8), count[a]]
        if with_docs:
            r = slice(h[i], h[i + 1])
            row += [refs[a], docs[r].astype(np.uint16), (docs[r] >> 16).astype(np.uint16), times[r]]
        out.append(tuple(x.tobytes() if isinstance(x, np.ndarray) else x for x in row) + (None,) * (0 if with_docs else 4))
    return out


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


PACKED_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("rid", pa.int64()), *[(c, pa.binary()) for c in ("u", "width", "low", "high", "c", "refs", "doc_low", "doc_high", "times")]])


class Shard:
    """The dishes of a shard: distinct pairs of all its rows, their restaurants, words and training counts."""

    def __init__(self, rows: pa.Table) -> None:
        def read(name: str, kind: type) -> list[np.ndarray]:
            return [np.frombuffer(x or b"", kind) for x in rows.column(name).to_pylist()]

        u = np.concatenate([np.repeat(a, b) for a, b in zip(read("u", np.uint64), read("width", np.uint32), strict=True)])
        high = np.concatenate(read("high", np.uint8)).astype(np.uint64)
        dish = (high << np.uint64(32)) | np.concatenate(read("low", np.uint32)).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mixed(u * FACTOR ^ mixed(dish))
        _, first, self.of_row = np.unique(key, return_index=True, return_inverse=True)
        self.c = np.bincount(self.of_row, np.concatenate(read("c", np.uint32)), len(first)).astype(np.int64)
        self.contexts, self.rest = np.unique(u[first], return_inverse=True)
        self.dishes, self.word = np.unique(dish[first], return_inverse=True)

    def totals(self, split: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers of each restaurant in the whole corpus, and that number over those that are here."""
        here = np.bincount(self.rest, self.c, len(self.contexts))
        at = np.minimum(np.searchsorted(split, self.contexts), max(len(split) - 1, 0))
        everywhere = np.where(split[at] == self.contexts, sizes[at], here) if len(split) else here
        return everywhere, everywhere / np.maximum(here, 1)


def stirling(wanted: np.ndarray, d: float) -> dict[int, np.ndarray]:
    """For each wanted c the logs of the generalized Stirling numbers S(c, 1) to S(c, c): all seatings of c customers, by tables."""
    out, row, wanted = {}, np.zeros(1), set(wanted.tolist())
    for c in range(1, max(wanted, default=0) + 1):
        if c in wanted:
            out[c] = row
        opened, row = row, np.concatenate((row + np.log(c - d * np.arange(1, c + 1)), [0.0]))
        row[1:c] = np.logaddexp(row[1:c], opened[: c - 1])
    return out


def listed(log_s: np.ndarray, log_x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes of as many customers as log_s is long, by weights S(c, t) x**t."""
    log_w = log_s + log_x[:, None] * np.arange(1, len(log_s) + 1)
    sums = np.cumsum(np.exp(log_w - log_w.max(axis=1, keepdims=True)), axis=1)
    return 1 + (sums[:, :-1] < (rng.random(len(log_x)) * sums[:, -1])[:, None]).sum(axis=1)


def saddle(c: np.ndarray, x: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """The same for dishes of many customers: these weights belong to exp(x / d (1 - (1 - z)**d)), whose saddle point is
    where x z (1 - z)**(d - 1) = c; tables are Poisson but for what the sum of their sizes, c, takes from their variance."""
    s = np.minimum(np.log(x / (x + c)), np.minimum(np.log(x / c) / (1 - d), -1e-12))
    for _ in range(12):  # Newton for log(1 - z), from the right
        q = np.exp(s)
        s = s + (np.log(x) + np.log1p(-q) - (1 - d) * s - np.log(c)) / (q / (1 - q) + 1 - d)
    q = np.exp(s)
    mean = x / d * -np.expm1(d * s)
    spread = np.sqrt(np.maximum(mean - c * q / (q + (1 - d) * (1 - q)), 0))
    few = mean < 200
    t = np.where(few, 1 + rng.poisson(np.where(few, mean, 0)), np.rint(mean + 1 + spread * rng.standard_normal(len(c))))
    return np.clip(t, 1, c).astype(np.int64)


def seated(c: np.ndarray, rest: np.ndarray, scale: np.ndarray, parent: np.ndarray, d: float, seed: int) -> np.ndarray:
    """Mean tables of each dish over the sampled seatings, of c customers in restaurants rest, whose tables here count scale times."""
    rng = np.random.default_rng(seed)
    t = np.minimum(c, 1).astype(float)

    def all_tables() -> np.ndarray:
        return np.bincount(rest, t, len(scale)) * scale

    # Where the chain begins: as many tables as let as many customers open one as leave one of their own (about d in t sit alone).
    for _ in range(FIRST):
        w = (THETA + d * all_tables()[rest]) * parent
        t = np.clip(w / d * c / np.maximum(c + w - d * t, 1e-9), np.minimum(c, 1), c)
    order = np.flatnonzero(c >= 2)
    order = order[np.argsort(c[order], kind="stable")]
    cut = np.searchsorted(c[order], LISTED, "right")
    few, many = order[:cut], order[cut:]
    sizes, first = np.unique(c[few], return_index=True)
    groups = np.split(few, first[1:])
    log_s, total = stirling(sizes, d), np.zeros(len(c))
    for step in range(BURN + SAMPLES):
        u = rng.gamma(THETA / d + all_tables())
        x = d * u[rest] * parent
        for n, dishes in zip(sizes.tolist(), groups, strict=False):
            t[dishes] = listed(log_s[n], np.log(x[dishes]), rng)
        if len(many):
            t[many] = saddle(c[many], x[many], d, rng)
        if step >= BURN:
            total += t
    return total / SAMPLES


def discount(once: float, twice: float) -> float:
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


def training_tokens(docs: DataFrame, bits: int, least: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Training tokens, how many differ, and the frequent ones in order with their counts: at most SPLIT rows come here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers(batches):
            found, times = counted(batch.tokens.token[batch.tokens.train])
            cuts = np.concatenate(([0], np.searchsorted(shard_of(found, bits), np.arange(1, 1 << bits)), [len(found)]))
            rows = [(int(s), found[cuts[s] : cuts[s + 1]].tobytes(), times[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes()) for s in np.flatnonzero(np.diff(cuts))]
            yield table(rows, pa.schema([("shard", pa.int32()), ("token", pa.binary()), ("c", pa.binary())]))

    def summed(rows: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint32)) for t, c in zip(rows.column("token").to_pylist(), rows.column("c").to_pylist(), strict=True)]
        token, c = counted(np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]).astype(np.int64))
        often = c >= least
        both = lambda a, b: pa.array(np.concatenate((a, b)), pa.int64())
        # The first row of a shard tells its totals.
        return pa.table({"total": both([c.sum()], np.zeros(often.sum(), np.int64)), "kinds": both([len(c)], np.zeros(often.sum(), np.int64)), "token": both([0], token[often].view(np.int64)), "c": both([0], c[often])})

    found = docs.mapInArrow(tidy(count), "shard int, token binary, c binary").groupBy("shard").applyInArrow(summed, "total long, kinds long, token long, c long")
    found = written(found, "tokens")
    total, kinds = found.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    often = found.where("c > 0").select("token", "c").toArrow()
    removed(docs.sparkSession, found)
    token, c = often.column("token").to_numpy().view(np.uint64), often.column("c").to_numpy()
    order = np.argsort(token)
    return total, kinds, token[order], c[order]


def tables_told(docs: DataFrame, split: np.ndarray, sizes: np.ndarray, bits: int) -> DataFrame:
    """Step 2: for each shard and each range of dishes the dishes and their tables, and the numbers that discounts come from."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers(batches):
            yield table(packed(batch, split, bits, with_docs=False), PACKED_ARROW)

    def seat(rows: pa.Table) -> pa.Table:
        shard, here = rows.column("shard")[0].as_py(), Shard(rows)
        _, scale = here.totals(split, sizes)
        known = here.c > 0
        met = np.bincount(here.word[known], minlength=len(here.dishes)) + 0.1
        once, twice = int((here.c == 1).sum()), int((here.c == 2).sum())
        t = seated(here.c, here.rest, scale, (met / met.sum())[here.word], discount(once, twice), shard)
        n = np.rint(np.bincount(here.word, t, len(here.dishes))).astype(np.uint32)
        n = np.maximum(n, (met > 1).astype(np.uint32))
        edges = np.searchsorted(here.dishes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(40 - bits)) if bits else []
        cuts = np.concatenate(([0], edges, [len(n)])).astype(np.int64)
        filled = np.flatnonzero(np.diff(cuts))
        out = [(int(w), shard, here.dishes[a:b].astype(np.uint32).tobytes(), (here.dishes[a:b] >> np.uint64(32)).astype(np.uint8).tobytes(), n[a:b].tobytes(), int(n[a:b].sum()), once * (i == 0), twice * (i == 0)) for i, (w, a, b) in enumerate(zip(filled, cuts[filled], cuts[filled + 1], strict=True))]
        return pa.Table.from_batches([table(out, TOLD)])

    return docs.mapInArrow(tidy(pairs), PACKED).groupBy("shard").applyInArrow(seat, "range int, shard int, low binary, high binary, n binary, customers long, once long, twice long")


TOLD = pa.schema([("range", pa.int32()), ("shard", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("n", pa.binary()), ("customers", pa.int64()), ("once", pa.int64()), ("twice", pa.int64())])


def answers(told: DataFrame, customers: int, kinds: int) -> DataFrame:
    """Step 3: shard, range, p: the share that dishes have of the parent restaurant, in their order; tables: mean tables of a range, told once."""

    def seat(rows: pa.Table) -> pa.Table:
        get = lambda name, kind: [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
        low, n = get("low", np.uint32), get("n", np.uint32)
        dish = (np.concatenate(get("high", np.uint8)).astype(np.uint64) << np.uint64(32)) | np.concatenate(low).astype(np.uint64)
        _, word = np.unique(dish, return_inverse=True)
        c = np.bincount(word, np.concatenate(n)).astype(np.int64)
        d = discount((c == 1).sum(), (c == 2).sum())
        t = seated(c, np.zeros(len(c), np.int64), np.array([customers / max(c.sum(), 1)]), np.full(len(c), 1 / (kinds + 1)), d, rows.column("range")[0].as_py())
        p = ((c - d * t) / (THETA + customers))[word].astype(np.float32)
        ends = np.cumsum([len(x) for x in low])
        parts = [p[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        told_once = np.zeros(len(parts))
        told_once[0] = d * t.sum()
        return pa.table({"shard": rows.column("shard"), "range": rows.column("range"), "p": pa.array(parts, pa.binary()), "tables": pa.array(told_once, pa.float64())})

    return told.groupBy("range").applyInArrow(seat, "shard int, range int, p binary, tables double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: learned from rows whose crc32(doc_id) mod 10 is not 0."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col("text").alias("_text"), (split_of(F.col("doc_id"), 10) == 0).alias("_held"), F.col("doc_id").cast("long").alias("_id"))
    size, n_docs, n_train = rows.agg(F.sum(F.octet_length("_text")), F.count("*"), F.count(F.when(~F.col("_held"), 1))).first()
    guess = (size or 0) // 6 + n_docs
    bits = min(24, max(0, int(guess / SHARD).bit_length()))
    total, kinds, split, sizes = training_tokens(rows, bits, max(SHARD // 4, guess // SPLIT + 1))
    # The start and, as a token, the end are not words: the start is always dealt by dish.
    own = (split != END) & (split != START)
    split, sizes = np.append(split[own], START), np.append(sizes[own], n_train)
    order = np.argsort(split)
    split, sizes = split[order], sizes[order]

    told = written(tables_told(rows, split, sizes, bits), "told")
    customers, once, twice = told.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "once", "twice")]).first()
    d = discount(once, twice)
    answered = written(answers(told, customers, kinds), "answers")
    unknown = (THETA + (answered.agg(F.coalesce(F.sum("tables"), F.lit(0.0))).first()[0])) / (THETA + customers) / (kinds + 1)
    log_base = lambda c: np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in buffers(batches):
            for row in packed(batch, split, bits, with_docs=True):
                yield with_header([row], [(None, None, None)])
            # The header takes a way of its own, past the shards.
            yield with_header([(-1 - batch.rid % 64, 0, batch.rid, *[None] * 9)], [(batch.ids, batch.held, batch.tokens.sizes.tolist())])

    def score(found: pa.Table) -> pa.Table:
        kind = np.array(found.column("kind"))
        if kind[0] == 0:
            return found.select(["rid", "doc_id", "held", "n_tokens"]).append_column("docs", pa.nulls(len(kind), pa.binary())).append_column("sums", pa.nulls(len(kind), pa.binary()))
        shard, own = found.column("shard")[0].as_py(), found.filter(pa.array(kind == 1))
        told_p = found.filter(pa.array(kind == 2))
        if not own.num_rows:
            return OUT_ARROW.empty_table()
        here = Shard(own)
        ranges = np.argsort(np.array(told_p.column("rid")))
        answer = told_p.column("u").to_pylist()
        parent = np.concatenate([np.frombuffer(answer[i], np.float32) for i in ranges]).astype(float) + unknown
        everywhere, scale = here.totals(split, sizes)
        t = seated(here.c, here.rest, scale, parent[here.word], d, shard)
        tables = np.bincount(here.rest, t, len(here.contexts)) * scale
        p = (here.c - d * t + (THETA + d * tables[here.rest]) * parent[here.word]) / (THETA + everywhere[here.rest])
        # A word is met as a token wherever it is met as a context.
        base = np.where(here.contexts == START, 0.0, log_base(everywhere))
        known = (everywhere > 0) & (here.contexts != START)
        log_p, at, out = np.log10(p), 0, []
        for i in range(own.num_rows):
            get = lambda name, dtype, i=i: np.frombuffer(own.column(name)[i].as_py(), dtype)
            refs = get("refs", np.uint32)
            dish = np.repeat(here.of_row[at : at + len(refs)], refs)
            at += len(refs)
            doc = get("doc_low", np.uint16).astype(np.int64) | (get("doc_high", np.uint16).astype(np.int64) << 16)
            times = get("times", np.uint32).astype(float)
            met, of = np.unique(doc, return_inverse=True)
            sums = [np.bincount(of, times * x[dish], len(met)) for x in (log_p, base[here.rest], known[here.rest].astype(float))]
            out.append((own.column("rid")[i].as_py(), None, None, None, met.astype(np.uint32).tobytes(), np.stack(sums).tobytes()))
        return pa.Table.from_batches([table(out, OUT_ARROW)])

    answer_rows = answered.select("shard", F.lit(2).alias("kind"), F.col("range").cast("long").alias("rid"), F.col("p").alias("u"))
    every = rows.mapInArrow(tidy(pairs), f"{PACKED}, {HEADER}").unionByName(answer_rows, allowMissingColumns=True)
    parts = every.groupBy("shard").applyInArrow(score, f"rid long, {HEADER}, docs binary, sums binary")

    def summed(found: pa.Table) -> pa.Table:
        head = next(i for i in range(found.num_rows) if found.column("doc_id")[i].is_valid)
        ids, held, sizes_of = (found.column(c)[head].as_py() for c in ("doc_id", "held", "n_tokens"))
        sums = np.zeros((3, len(ids)))
        for docs_at, values in sorted((x, y) for x, y in zip(found.column("docs").to_pylist(), found.column("sums").to_pylist(), strict=True) if x is not None):
            at = np.frombuffer(docs_at, np.uint32)
            sums[:, at] += np.frombuffer(values).reshape(3, len(at))
        known = np.rint(sums[2]).astype(np.int64) + (n_train > 0)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": pa.array(sizes_of, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([total] * len(ids), pa.int64()), "base_score": pa.array(sums[1] + log_base(n_train), pa.float64()), "score": pa.array(sums[0], pa.float64()),
        })

    return parts.groupBy("rid").applyInArrow(summed, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


LISTS = [("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64()))]
OUT_ARROW = pa.schema([("rid", pa.int64()), *LISTS, ("docs", pa.binary()), ("sums", pa.binary())])


def with_header(rows: list[tuple], heads: list[tuple]) -> pa.RecordBatch:
    return table([a + b for a, b in zip(rows, heads, strict=True)], pa.schema([*PACKED_ARROW, *LISTS]))
