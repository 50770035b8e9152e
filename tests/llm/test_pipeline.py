"""The pipeline's stages on a corpus with planted cases."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
from folioflow.llm import common

from .corpus import frame, saved, sentence


def test_pipeline(spark, tmp_path):
    r = random.Random(11)
    good = [sentence(r, 80) for _ in range(60)]
    bad = ["\n".join("!! ".join(sentence(r, 12).upper().split()) + "!!" for _ in range(4)) for _ in range(30)]
    item = sentence(r, 30)
    texts = good + bad + [good[0], " ".join([*good[1].split()[:-1], "edited"]), f"{sentence(r, 40)} {item} {sentence(r, 40)}"]
    rows = [(i, t, "en", f"s{i % 2}", 0) for i, t in enumerate(texts)]
    labels = [(i, int(i < 60), 0) for i in range(90)]
    folder = saved(tmp_path, spark, rows, labels, [(1, item)])
    docs, seen = frame(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        seen[name] = Counter(x["doc_id"] for x in docs.collect())
    assert set(seen["quality classifier"]) == set(range(60)) | {90, 91, 92}
    assert set(seen["n-gram Jaccard join"]) == set(range(60)) | {92}
    assert set(seen["benchmark decontamination"]) == set(range(60))
    assert max(seen["mixing sources to target weights"].values()) <= 2
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(x["doc_id"] for x in out) == seen["mixing sources to target weights"]
    starts = sorted((x["start"], x["n_tokens"]) for x in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_one_of_each_component_stays(spark):
    r = random.Random(16)
    a, b, c, d = [sentence(r, 60) for _ in range(4)]
    near = lambda t: " ".join([*t.split()[:-1], "edited"])
    rows = [(None, a), (None, near(a)), (1, b), (1, b), (2, c), (3, d), (3, near(c)), (None, None), (None, "")]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    kept = corpus_pipeline.join_near(spark, docs, "")
    assert kept.columns == docs.columns
    got = Counter((x["doc_id"], x["text"]) for x in kept.collect())
    assert sum(got[None, t] for t in (a, near(a))) == 1
    assert {k: n for k, n in got.items() if k[1] not in (a, near(a))} == {(1, b): 1, (2, c): 1, (3, d): 1, (None, None): 1, (None, ""): 1}


def test_near_copies_leave_no_tables_of_the_join(spark):
    r = random.Random(17)
    texts = [sentence(r, 60) for _ in range(20)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts + texts[:5])])
    shared = Path(common.shared_folder(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    assert corpus_pipeline.join_near(spark, docs, "").count() == 20
    assert [x.name.rsplit("-", 1)[0] for x in set(shared.iterdir()) - before] == ["near-copies"]
