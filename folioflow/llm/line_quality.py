"""Quality of documents by a linear-chain conditional random field over their lines.

Every line is labelled good or bad from its own features and its neighbours'. Marginals by the forward-backward
recursions, weighted by line length, make a document's quality; a logistic curve, fitted on the training documents,
turns it into a score. All lines of a training document bear its label.

The field is fitted on at most `train_documents` rows of labelled documents, the first in order of a hash of doc_id, and of
these on as many as have `train_lines` lines together; their line features (108 bytes a line) come to the driver. All
documents are scored whole, in the executors, batch by batch.

Defined cases: null text counts as empty, and empty text is one empty line. Without labels every score is 0.5. A
label that is null, or whose doc_id is, is not learned from; of several labels of one doc_id the highest holds.
A repeated doc_id is scored in each of its rows. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, split_of, tidy

CLASSES = ("lower", "upper", "digit", "space", "stop", "shout", "symbol", "other", "wide")
#: Features of a line by itself.
OWN = 18
#: Bytes of text whose features are made at once; a longer text is taken alone.
CHUNK = 512 << 10


def char_classes() -> np.ndarray:
    table = np.full(256, CLASSES.index("other"), np.uint8)
    for name, chars in {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\r\x0b\x0c\n", "stop": b".,;:?", "shout": b"!", "symbol": b"#*$%&|<>", "wide": range(128, 256)}.items():
        table[list(chars)] = CLASSES.index(name)
    return table


CLASS_OF = char_classes()


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x 3 * OWN), lengths of lines in bytes, and where each text's lines begin (one more than texts)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    length = ends - starts
    n = len(ends)
    line = np.repeat(np.arange(n, dtype=np.int32), length + 1)
    cls = CLASS_OF[raw]
    counts = np.bincount(line * np.int32(len(CLASSES)) + cls, minlength=n * len(CLASSES)).reshape(n, -1).astype(np.float32)
    counts[:, CLASSES.index("space")] -= 1  # the line's own end
    blank = cls == CLASSES.index("space")
    begins = ~blank & np.concatenate(([True], blank[:-1]))
    words = np.bincount(line[begins], minlength=n)
    capitals = np.bincount(line[begins & (cls == CLASSES.index("upper"))], minlength=n)
    sizes = np.array([t.count(b"\n") + 1 for t in texts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    again, same, distinct = np.zeros(n, np.float32), np.zeros(n, np.float32), np.ones(n, np.float32)
    at = 0
    for text in texts:
        seen: set[bytes] = set()
        for x in text.split(b"\n"):
            if x and x in seen:
                again[at] = 1
            seen.add(x)
            if len(parts := x.split()) > 1:
                same[at] = sum(map(eq, parts, parts[1:])) / (len(parts) - 1)
                distinct[at] = len(set(parts)) / len(parts)
            at += 1
    own = np.zeros((n, OWN), np.float32)
    per = np.maximum(length, 1)[:, None]
    own[:, :9] = counts / per
    own[:, 9] = np.log1p(length) / 5
    own[:, 10] = np.log1p(words) / 5
    own[:, 11] = np.minimum(length / np.maximum(words, 1), 40) / 10
    own[:, 12] = capitals / np.maximum(words, 1)
    own[:, 13] = again
    own[:, 14] = length == 0
    own[:, 15] = same
    own[:, 16] = distinct
    own[:, 17] = words < 5
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack((own, before, after)), length, first


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


@dataclass
class Field:
    weights: np.ndarray  # of good against bad, standardised features
    bias: float
    stay: np.ndarray  # 2 x 2 log potentials of (from, to)
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def line_scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights + self.bias


def forward_backward(scores: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of good for each line, expected transitions of each chain (chains x 2 x 2), summed log partition."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    longest, n = int(sizes[0]) if len(sizes) else 0, len(scores)
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    emit = np.stack((np.zeros(n), np.clip(scores, -50, 50)), axis=1)
    emit = np.exp(emit - emit.max(axis=1, keepdims=True))
    move = np.exp(trans)
    ahead, scale = np.zeros((n, 2)), np.ones(n)
    for t in range(longest):
        at = begin[: active[t]] + t
        a = emit[at] if t == 0 else (ahead[at - 1] @ move) * emit[at]
        scale[at] = total = a.sum(axis=1)
        ahead[at] = a / total[:, None]
    behind = np.ones((n, 2))
    pairs = np.zeros((len(sizes), 2, 2))
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        b = emit[at + 1] * behind[at + 1] / scale[at + 1][:, None]
        behind[at] = b @ move.T
        pairs[: active[t + 1]] += ahead[at][:, :, None] * move * b[:, None, :]
    both = ahead * behind
    out = np.zeros_like(pairs)
    out[order] = pairs
    return both[:, 1] / both.sum(axis=1), out, float(np.log(scale).sum() + np.maximum(scores, 0).sum())


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = 120, decay: float = 1e-3) -> Field:
    """Gradient ascent (with Adam's step sizes) on the mean log likelihood of a document's line labels."""
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    x = (features - mean) / scale
    sizes = np.diff(first)
    gold = np.repeat(labels, sizes).astype(float)
    weight = np.repeat(1 / sizes, sizes) / len(labels)
    same = np.zeros((len(labels), 2, 2))
    same[np.arange(len(labels)), labels, labels] = sizes - 1
    theta = np.zeros(x.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        marginals, pairs, _ = forward_backward(x @ theta[:-5] + theta[-5], first, theta[-4:].reshape(2, 2))
        off = (gold - marginals) * weight
        moves = ((same - pairs) / sizes[:, None, None]).mean(axis=0)
        gradient = np.concatenate((off @ x, [off.sum()], moves.ravel())) - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field = Field(theta[:-5], theta[-5], theta[-4:].reshape(2, 2), mean, scale)
    z = logit(quality(field, features, first, lengths))
    for _ in range(50):  # Newton's steps for the logistic curve
        p = 1 / (1 + np.exp(-(field.slope * z + field.shift)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((labels - p) * z).sum() - 0.1 * field.slope, (labels - p).sum() - 0.1 * field.shift])
        hess = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        field.slope, field.shift = float(max(field.slope + step[0], 0.01)), float(field.shift + step[1])
    return field


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def quality(field: Field, features: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Mean marginal of good, weighted by length; of equal weights if all lines are empty."""
    marginals, _, _ = forward_backward(field.line_scores(features), first, field.stay)
    weight = lengths + 1e-9
    return np.add.reduceat(marginals * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


@tidy
def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """quality, features and lengths of each training document."""
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        feats, lens = [], []
        for a, b in chunks(texts):
            features, length, first = line_features(texts[a:b])
            for i in range(b - a):
                own = slice(first[i], first[i + 1])
                feats.append(features[own].astype("<f2").tobytes())
                lens.append(length[own].astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(feats, pa.binary()), pa.array(lens, pa.binary())], names=["quality", "features", "lengths"])


def train(docs: DataFrame, labels: DataFrame, train_documents: int, train_lines: int) -> Field | None:
    """The field, from at most train_documents rows of labelled documents that are not held out."""
    usable = labels.where("doc_id is not null and quality is not null").where(split_of(F.col("doc_id"), 4) != 2)
    chosen = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_documents)
    chosen = chosen.select(F.col("doc_id").alias("_id"), "quality")
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(1))
    texts = docs.select("doc_id", "text", lines.alias("_lines")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    order = [F.xxhash64("_id"), F.col("_id"), F.xxhash64("text")]
    # Rows may repeat a doc_id: bounded once more, then by a running sum over at most train_documents rows.
    # A text that alone is over the bound is left out, not those after it: the sum runs over the others.
    upto = F.sum("_lines").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    few = texts.where(F.col("_lines") <= train_lines).orderBy(*order).limit(train_documents).withColumn("_upto", upto).where(F.col("_upto") <= train_lines)
    rows = few.select("quality", F.col("text").cast("binary").alias("text")).mapInArrow(sampled, "quality int, features binary, lengths binary").collect()
    if not rows:
        return None
    lengths = [np.frombuffer(r["lengths"], "<i4") for r in rows]
    features = np.frombuffer(b"".join(r["features"] for r in rows), "<f2").astype(np.float32).reshape(-1, 3 * OWN)
    first = np.concatenate(([0], np.cumsum([len(x) for x in lengths])))
    return fit(features, first, np.array([r["quality"] for r in rows]), np.concatenate(lengths))


def scorer(field: Field | None, name: str):
    """Replaces the last column, a text's bytes, by its score."""

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.columns[-1].to_pylist()]
            found = [np.zeros(0)]
            for a, b in chunks(texts):
                if field is None:
                    found.append(np.full(b - a, 0.5))
                    continue
                features, length, first = line_features(texts[a:b])
                found.append(1 / (1 + np.exp(-(field.slope * logit(quality(field, features, first, length)) + field.shift))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(found), pa.float64())], names=[*batch.schema.names[:-1], name])

    return score


def with_score(docs: DataFrame, labels: DataFrame, columns: list[str], name: str = "_score", train_documents: int = 4000, train_lines: int = 400_000) -> DataFrame:
    """The named columns of docs, and the score under a name that isn't one of them."""
    arrow_batches(docs.sparkSession)
    field = train(docs, labels, train_documents, train_lines)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*columns).dtypes) + f", `{name}` double"
    return docs.select(*columns, F.col("text").cast("binary").alias(name)).mapInArrow(scorer(field, name), schema)


def score_quality(docs: DataFrame, labels: DataFrame, train_documents: int = 4000, train_lines: int = 400_000, least: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    scored = with_score(docs, labels, ["doc_id"], train_documents=train_documents, train_lines=train_lines)
    return scored.select("doc_id", (split_of(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= least).cast("int").alias("predicted"))
