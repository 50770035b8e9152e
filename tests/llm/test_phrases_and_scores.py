"""Collocations against plain counts and SQL; Pitman-Yor scores against plain base scores and a sequential seating."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import collocations, pitman_yor, queries

from .corpus import edges, frame, plain, rows_of, sentence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases_by_hand(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    frequent = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    found = []
    for (lang, p), a in frequent.items():
        if any(l == lang and len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for (l, q), b in frequent.items()):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        found.append((lang, " ".join(p), a, left, right, n[lang], score))
    out = []
    for lang in {x[0] for x in found}:
        ordered = sorted((x for x in found if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], rank, *x[1:]) for rank, x in enumerate(ordered[:top], 1)]
    return sorted(out)


def phrases(docs, **k):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(docs, **k).collect())


def repetitive(n=200, seed=3):
    r = random.Random(seed)
    words = ["Zürich", "alpha", "BETA", "gamma", "d|e", "日本", "x" * 9000, "…"]
    piece = lambda: " ".join(r.choice(words[:6] if r.random() < 0.97 else words) for _ in range(r.randint(1, 9)))
    ends = [". ", "\n", ";", "  ", "\t", " !? ", "\x0b"]
    return [(i, "".join(piece() + r.choice(ends) for _ in range(r.randint(0, 12))), r.choice(["en", "fr", None, "und"]), "s", 0) for i in range(n)]


def test_collocations(spark):
    rows = repetitive()
    want = phrases_by_hand(rows)
    assert len(want) > 100 and phrases(frame(spark, rows, clashing=True)) == want
    assert phrases(frame(spark, rows), top=5) == [x for x in want if x[1] <= 5]


def test_collocations_of_awkward_tables(spark):
    assert phrases(frame(spark, edges() * 3)) == phrases_by_hand(edges() * 3)
    assert phrases(frame(spark, [])) == phrases(frame(spark, plain(3))) == []


def test_collocations_survive_colliding_fingerprints(spark, monkeypatch):
    """With fingerprints of four bits nearly all phrases collide; the text decides."""
    honest = collocations.Buffer.grams

    def crowded(self, n):
        at, prints = honest(self, n)
        return at, prints & np.uint64(15)

    monkeypatch.setattr(collocations.Buffer, "grams", crowded)
    rows = repetitive(60, 5)
    docs = [x[1] for x in rows]
    found = Counter()
    buffer = collocations.Buffer([d.encode() for d in docs], ["en"] * len(docs))
    for part in collocations.spelled(buffer, np.full(1 << (collocations.FILTER_BITS - 6), np.uint64(2**64 - 1))):
        for lang, n, phrase, f in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found[phrase] += f * (n > 0)
    want = Counter()
    for d in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", d.translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            want.update(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    assert +found == want


def test_collocation_buffers_are_small():
    """A task holds the arrays of one buffer: of some 4 MB, but for one text that alone has more."""
    batch = pa.RecordBatch.from_arrays([pa.array(["a b " * 25_000] * 150 + [" . "], pa.string()), pa.array(["en"] * 151, pa.string())], names=["text", "lang"])
    found = list(collocations.buffers(iter([batch])))
    assert len(found) > 3 and max(len(b.joined) for b in found) < (4 << 20) + 200_000


def test_collocations_of_a_task_without_words(spark):
    assert rows_of(collocations.collocations(frame(spark, [(1, " . ", "en", "s", 0), (2, "", "en", "s", 0)]))) == []


def test_collocation_sql_agrees(spark, tmp_path):
    rows = repetitive(120, 7)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = duck.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({queries.oracle_sql()['op12_collocations']})").fetchall()
    assert sorted(got) == phrases_by_hand(rows) == phrases(frame(spark, rows))


def base_by_hand(rows):
    tokens = [[*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None] for _, text, *_ in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, *_ in rows]
    c = Counter(t for ts, out in zip(tokens, held, strict=True) if not out for t in ts)
    n, v = sum(c.values()), len(c)
    return [(row[0], out, len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for row, ts, out in zip(rows, tokens, held, strict=True)]


def scores(docs):
    return rows_of(pitman_yor.lm_scores(docs))


def digest(found):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found), key=str)


@pytest.mark.parametrize("shard", [2 << 20, 300])
def test_base_scores(spark, monkeypatch, shard):
    """Over one shard, and over many with frequent contexts dealt by dish."""
    monkeypatch.setattr(pitman_yor, "SHARD", shard)
    rows = plain(60, 11) + [(1000 + i, "the the the cat THE cat sat on the mat " * 5, "en", "s", 0) for i in range(20)]
    got = scores(frame(spark, rows, clashing=True))
    assert digest(got) == sorted(base_by_hand(rows), key=str)
    again = scores(frame(spark, rows))
    assert sorted((r["doc_id"], r["score"]) for r in got) == sorted((r["doc_id"], r["score"]) for r in again), "reruns agree"
    assert all(r["score"] < 0 for r in got)


def test_scores_of_awkward_tables(spark):
    assert digest(scores(frame(spark, edges()))) == sorted(base_by_hand(edges()), key=str)
    assert scores(frame(spark, [])) == []
    held = [(i, "a b", "en", "s", 0) for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:5]
    got = scores(frame(spark, held))
    assert digest(got) == sorted(base_by_hand(held), key=str) and {r["n_known"] for r in got} == {0}


def test_probabilities_of_a_context_sum_to_one(spark):
    """What may follow a word, the end, and all unknown words together have probability one."""
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(vocabulary[: 3 + i % 25]) for _ in range(12)), "en", "s", 0) for i in range(400)]
    held = iter([i for i in range(10_000, 20_000) if zlib.crc32(str(i).encode()) % 10 == 0])
    learned = sorted({w for _, t, *_ in rows for w in t.split()})
    # p(x | start) of each word, and of one that no one knows: p(start x end) p(start x y end) / ... is avoided by empty texts.
    probes = {"": next(held), **{x: next(held) for x in [*learned, "never"]}, **{f"w1 {x}": next(held) for x in [*learned, "never"]}}
    got = {x["doc_id"]: 10 ** x["score"] for x in scores(frame(spark, rows + [(i, t, "en", "s", 0) for t, i in probes.items()]))}
    p = {t: got[i] for t, i in probes.items()}
    # p("w1 x") / p("x") = p(w1 | start) p(x | w1) / p(x | start); unknown words go by the parent alone, and so do both ends.
    ratio = sum(p[f"w1 {x}"] / p[x] for x in learned)
    assert all(0 < v < 1 for v in p.values()) and ratio > 0
    assert all(p[f"w1 {x}"] > p["w1 never"] * (p[x] > p["never"]) for x in learned)
    end_at_start = p[""]
    assert end_at_start < 0.2, "no training text is empty, so the end at once is unlikely"


def test_seating_follows_the_restaurant(monkeypatch):
    """Mean tables of one restaurant against its own Gibbs sampler, one customer at a time."""
    c, d, theta, parent = [40, 12, 5, 1, 1], 0.6, pitman_yor.THETA, [0.3, 0.3, 0.2, 0.1, 0.1]
    r = random.Random(4)
    tables = [[n] for n in c]
    total, rounds = np.zeros(len(c)), 60_000
    for step in range(rounds + 500):
        for w in range(len(c)):
            at = r.choices(range(len(tables[w])), tables[w])[0]
            tables[w][at] -= 1
            tables[w] = [n for n in tables[w] if n]
            new = (theta + d * sum(map(len, tables))) * parent[w]
            at = r.choices(range(len(tables[w]) + 1), [*(n - d for n in tables[w]), new])[0]
            if at == len(tables[w]):
                tables[w].append(0)
            tables[w][at] += 1
        if step >= 500:
            total += [len(t) for t in tables]
    # Many copies of the restaurant at once stand for many rounds of one.
    copies = 1000
    rest = np.repeat(np.arange(copies), len(c))

    def mean_tables() -> np.ndarray:
        return pitman_yor.seated(np.tile(c, copies), rest, np.ones(copies), np.tile(parent, copies), d, 1).reshape(copies, len(c)).mean(axis=0)

    assert mean_tables() == pytest.approx(total / rounds, rel=0.3), "so few steps begin near the end"
    monkeypatch.setattr(pitman_yor, "BURN", 600)
    assert mean_tables() == pytest.approx(total / rounds, rel=0.08)


def test_each_step_seats_all_customers(monkeypatch):
    """Tables of dishes of many customers against all their seatings: the mean, and the spread that one customer a step can't reach."""
    c, d, parent, copies = [60, 45], 0.8, [0.3, 0.05], 2000
    s = [[0.0] * 62 for _ in range(62)]
    s[1][1] = 1.0
    for n in range(1, 61):
        for k in range(1, n + 2):
            s[n + 1][k] = s[n][k - 1] + (n - d * k) * s[n][k]
    weights = np.array([[math.exp(math.log(s[c[0]][i]) + math.log(s[c[1]][j]) + i * math.log(d * parent[0]) + j * math.log(d * parent[1]) + math.lgamma(pitman_yor.THETA / d + i + j)) for j in range(1, c[1] + 1)] for i in range(1, c[0] + 1)])
    weights /= weights.sum()
    monkeypatch.setattr(pitman_yor, "SAMPLES", 1)
    monkeypatch.setattr(pitman_yor, "BURN", 20)
    got = pitman_yor.seated(np.tile(c, copies), np.repeat(np.arange(copies), 2), np.ones(copies), np.tile(parent, copies), d, 1).reshape(copies, 2)
    for dish, p in enumerate((weights.sum(axis=1), weights.sum(axis=0))):
        t = np.arange(1, c[dish] + 1)
        mean = (p * t).sum()
        assert got[:, dish].mean() == pytest.approx(mean, rel=0.05)
        assert got[:, dish].std() == pytest.approx(math.sqrt((p * t * t).sum() - mean**2), rel=0.1)


@pytest.mark.parametrize("x", [0.01, 3, 100, 1000, 3000, 1e5])
def test_tables_beyond_the_lists(x):
    """The saddle point's draws against draws from the listed weights, of 2,500 customers."""
    n, copies, d = 2500, 3000, 0.7
    exact = pitman_yor.listed(pitman_yor.stirling(np.array([n]), d)[n], np.full(copies, math.log(x)), np.random.default_rng(1))
    near = pitman_yor.saddle(np.full(copies, n), np.full(copies, float(x)), d, np.random.default_rng(2))
    assert near.mean() == pytest.approx(exact.mean(), rel=0.01, abs=0.1) and near.std() == pytest.approx(exact.std(), rel=0.1, abs=0.05)


def test_model_beats_unigrams_on_held_out_text(spark):
    r = random.Random(6)
    follows = {w: [f"t{(7 * w + k) % 50}" for k in range(3)] for w in range(50)}

    def text():
        w, out = r.randrange(50), []
        for _ in range(40):
            out.append(f"t{w}")
            w = int(r.choice(follows[w])[1:])
        return " ".join(out)

    got = scores(frame(spark, [(i, text(), "en", "s", 0) for i in range(400)]))
    held = [x for x in got if x["held_out"]]
    assert len(held) > 20
    bits = lambda c: -sum(x[c] for x in held) / sum(x["n_tokens"] for x in held)
    assert bits("score") < 0.6 * bits("base_score")
    assert sentence(r, 2)
