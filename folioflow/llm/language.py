"""Language of documents by words first, then character n-grams.

A word is a run of letters and marks; a 64-bit hash stands for it where texts are scored. A known word scores by its log frequency
in each language. An unseen word falls back to its character n-grams, from
the longest down: the first length of which any n-gram is known scores by the mean of those n-grams. A text's
language is the one of the highest sum.

Frequencies are counted by Spark over at most `train_documents` documents of each language, the first in order of a hash
of doc_id; the model keeps every word and n-gram of that sample, with its counts in all languages, and is broadcast: words as
sorted hashes, n-grams as places in one table of numbers. It grows with the number of languages, not with the corpus.
All documents are scored whole. Rows without a doc_id are not learned from, as the sample goes by doc_id.

Defined cases: text that is null or has no letters is `und` with score 0. A null lang is not learned from; without any
language every text is `und`. Ties go to the language first in code point order. A repeated doc_id is scored in
each of its rows. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, broadcast_if, split_of, tidy, written
from .shingles import FACTOR, mixed

LONGEST = 4
#: Unseen words whose scores a task remembers before it starts anew.
CACHE_WORDS = 100_000
#: Characters of text worked on at once; a longer text is taken alone.
CHUNK = 256 << 10
#: Places of a word that weigh differently in its hash.
PLACES = 4096
#: Rows of the table of chosen documents up to which it is broadcast.
BROADCAST_CHOSEN = 1_000_000
#: Words that make a posterior as sure as it gets; more of them don't sharpen it.
SURE = 40


@cache
def letters() -> np.ndarray:
    """By code point: 1 for letters, 2 for marks, 0 for others. Made once in a worker."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8)


@cache
def place_weights() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, PLACES + 1, dtype=np.uint64) * FACTOR)


class Words:
    """Words of some texts: runs of letters and marks with a letter among them, in lower case. Vectorised over all texts."""

    def __init__(self, texts: list[str | None]):
        lower = [(t or "").lower() for t in texts]
        self.joined = "\n".join(lower)
        codes = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letters()[codes]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], kind > 0, [False]))))
        begin, end = edges[::2], edges[1::2]
        if len(begin):
            marks_only = np.minimum.reduceat(np.where(kind == 0, 3, kind), begin) == 2
            has_letter = ~marks_only if not marks_only.any() else np.array([(kind[a:b] == 1).any() for a, b in zip(begin, end, strict=True)])
            begin, end = begin[has_letter], end[has_letter]
        self.begin, self.end = begin, end
        size = end - begin
        inside = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else begin, size) + np.arange(size.sum())
        place = inside - np.repeat(begin, size)
        with np.errstate(over="ignore"):
            parts = (codes[inside].astype(np.uint64) + np.uint64(1)) * place_weights()[place % PLACES]
            sums = np.add.reduceat(parts, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
            self.hashes = mixed(sums + size.astype(np.uint64) * FACTOR)
        starts = np.cumsum([0, *[len(t) + 1 for t in lower]])
        self.first = np.searchsorted(begin, starts)

    def word(self, i: int) -> str:
        return self.joined[self.begin[i] : self.end[i]]


def words(text: str) -> list[str]:
    found = Words([text])
    return [found.word(i) for i in range(len(found.hashes))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between marks of its begin and end; its letters if n is 1."""
    marked = word if n == 1 else f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@tidy
def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, count; summed over some texts."""
    for batch in batches:
        by: dict[str, list[str | None]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for a, b in chunks(texts):
                found = Words(texts[a:b])
                _, first, counts = np.unique(found.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(map(found.word, first.tolist()), pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "count"])


@tidy
def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, n (0: a word, else the length of the n-gram), piece, count of words with their counts."""
    for batch in batches:
        sums: Counter = Counter()
        for lang, word, count in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "count")), strict=True):
            sums[lang, 0, word] += count
            for n in range(1, LONGEST + 1):
                for gram in grams(word, n):
                    sums[lang, n, gram] += count
        if sums:
            langs, ns, pieces = zip(*sums, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(ns, pa.int32()), pa.array(pieces), pa.array(sums.values(), pa.int64())], names=["lang", "n", "piece", "count"])


def logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(1, len(counts))))


class Model:
    """Log frequencies by language: of words by sorted hashes, of n-grams by their text."""

    def __init__(self, rows: Iterable[dict], langs: list[str] | None = None):
        rows = rows if langs else list(rows)
        self.langs = sorted(langs or {r["lang"] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        # By length: where a piece's row is, and the cells (row, language, count) of its table.
        raw: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        cells = [array("q") for _ in range(LONGEST + 1)]
        for r in rows:
            n = r["n"]
            cells[n].extend((raw[n].setdefault(r["piece"], len(raw[n])), at[r["lang"]], r["count"]))
        tables = []
        for places, flat in zip(raw, cells, strict=True):
            row, lang, count = np.array(flat, np.int64).reshape(-1, 3).T
            table = np.zeros((len(places), len(self.langs)))
            np.add.at(table, (row, lang), count)
            tables.append(logs(table) if places else table)
        hashes = Words(list(raw[0])).hashes
        order = np.argsort(hashes)
        self.known, self.word_logs = hashes[order], tables[0][order]
        #: By length: where the rows of an n-gram are in gram_logs.
        self.grams = [{}, *raw[1:]]
        self.gram_logs = tables

    def unseen(self, word: str) -> tuple:
        """The mean of a word's known n-grams of the longest length of which there are any; zeros if there are none."""
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            table = self.grams[n]
            if hits := [table[g] for g in grams(word, n) if g in table]:
                return tuple(self.gram_logs[n][hits].mean(axis=0).tolist())
        return (0.0,) * len(self.langs)

    def languages(self, texts: list[str | None], cached: dict[int, tuple]) -> list[tuple[str, float]]:
        """Language and score of each text; cached keeps what unseen words came to."""
        found = Words(texts)
        if not self.langs or not len(found.hashes):
            return [("und", 0.0)] * len(texts)
        own, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, own), max(len(self.known) - 1, 0))
        hit = self.known[at] == own if len(self.known) else np.zeros(len(own), bool)
        scores = self.word_logs[at] if len(self.known) else np.zeros((len(own), len(self.langs)))
        for i in np.flatnonzero(~hit).tolist():
            key = int(own[i])
            if (seen := cached.get(key)) is None:
                if len(cached) >= CACHE_WORDS:
                    cached.clear()
                seen = cached[key] = self.unseen(found.word(int(first[i])))
            scores[i] = seen
        upto = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(scores[back], axis=0)))
        sums, total = upto[found.first[1:]] - upto[found.first[:-1]], np.diff(found.first)
        best = sums.argmax(axis=1)
        apart = (sums - sums.max(axis=1, keepdims=True)) * np.minimum(1.0, SURE / np.maximum(total, 1))[:, None]
        sure = 1 / np.exp(apart).sum(axis=1)
        return [(self.langs[b], float(p)) if n else ("und", 0.0) for b, p, n in zip(best, sure, total, strict=True)]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text or "") > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if texts:
        yield start, len(texts)


def first_of(df: DataFrame, key: list[str], coarse: Column, fine: list[Column], most: Column) -> DataFrame:
    """The first `most` rows of each key in order of coarse, then fine. Only rows of one coarse value are ever sorted together."""
    marked = df.withColumn("_at", coarse)
    up_to = Window.partitionBy(*key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sizes = marked.groupBy(*key, "_at").agg(F.count("*").alias("_n"))
    begun = sizes.withColumn("_before", F.sum("_n").over(up_to) - F.col("_n")).where(F.col("_before") < most).select(*key, "_at", "_before")
    placed = marked.join(begun, [*key, "_at"]).withColumn("_place", F.row_number().over(Window.partitionBy(*key, "_at").orderBy(*fine)))
    return placed.where(F.col("_before") + F.col("_place") <= most).select(*df.columns)


def train(docs: DataFrame, train_documents: int) -> Model:
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null").where(split_of(F.col("doc_id"), 3) != 1)
    ids = usable.select("doc_id", "lang").where("doc_id is not null").distinct().withColumn("h", F.xxhash64("doc_id"))
    chosen = written(first_of(ids, ["lang"], F.shiftright("h", 52), [F.col("h"), F.col("doc_id")], F.lit(train_documents)).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), "chosen")
    side = broadcast_if(chosen, chosen.count(), BROADCAST_CHOSEN)
    sample = usable.join(side, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")
    known = written(sample.mapInArrow(counted, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count")), "words")
    counts = written(known.mapInArrow(spelled, "lang string, n int, piece string, count long").groupBy("lang", "n", "piece").agg(F.sum("count").alias("count")), "pieces")
    langs = [r["lang"] for r in counts.select("lang").distinct().collect()]
    found = counts.select("lang", "n", "piece", "count").toArrow()  # all pieces of a bounded sample
    return Model((r for batch in found.to_batches(max_chunksize=5000) for r in batch.to_pylist()), langs)


def identifier(model):
    @tidy
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cached = model.value, {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [x for a, b in chunks(texts) for x in own.languages(texts[a:b], cached)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return identify


def identify_language(docs: DataFrame, train_documents: int = 500) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    arrow_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, train_documents))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(identifier(model), "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", (split_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
