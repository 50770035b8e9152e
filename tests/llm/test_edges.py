"""Every operator and every pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import pytest

import corpus_pipeline
from folioflow.llm import queries

from .corpus import edges, frame, plain, saved

QUERIES = queries.queries()
ONE_A_DOCUMENT = sorted(set(QUERIES) - {"op10_decontaminate", "op11_conversation_repair", "op12_collocations"})
LABELS = [(i, i % 2, 0) for i in range(4, 14)] + [(None, 1, 0), (6, None, 0), (5, 0, 1)]
BENCHMARK = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (None, ""), (3, "short item")]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    made = lambda name, **k: saved(tmp_path_factory.mktemp(name), spark, **k)
    return {
        "edges": made("edges", rows=edges(), labels=LABELS, benchmark=BENCHMARK),
        "clashing": made("clashing", rows=edges() + plain(20, 3)[14:], labels=LABELS, benchmark=BENCHMARK, clashing=True),
        "empty": made("empty", rows=[]),
        "unlabelled": made("unlabelled", rows=plain(10)),
    }


@pytest.mark.parametrize("kind", ["edges", "clashing", "empty", "unlabelled"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folders, name, kind):
    got = QUERIES[name](spark, folders[kind]).collect()
    if name in ONE_A_DOCUMENT:
        assert len(got) == spark.read.parquet(f"{folders[kind]}/documents.parquet").count()
    assert all(len(r) >= 4 or name == "op7_jaccard_join" for r in got)


@pytest.mark.parametrize("kind", ["edges", "clashing", "empty"])
@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, folders, stage, kind):
    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folders[kind])
    if stage != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == docs.columns
    out.collect()


def test_near_copies_with_columns_that_have_no_order(spark, folders):
    """Extra columns of any type pass the stages; of equal rows one stays."""
    docs = frame(spark, plain(6, 9) + [(50, plain(1, 9)[0][1], "en", "s", 0)] * 3).selectExpr("*", "map('k', doc_id) AS labels", "named_struct('a', map(1, 2)) AS deep")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["n-gram Jaccard join"](spark, docs, folders["unlabelled"])
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == [0, 1, 2, 3, 4, 5]
    alone = docs.where("doc_id = 50")
    assert stages["n-gram Jaccard join"](spark, alone, folders["unlabelled"]).count() == 1
    assert stages["mixing sources to target weights"](spark, docs, folders["unlabelled"]).columns == docs.columns


def test_defined_results(spark, folders):
    by = lambda name: {(r["doc_id"]): r for r in QUERIES[name](spark, folders["edges"]).collect()}
    assert by("op1_mix_sources")[1]["size"] == 0
    assert by("op4_language")[3]["lang_pred"] == by("op4_language")[11]["lang_pred"] == "und"
    assert by("op5_token_files")[2]["n_tokens"] == 1
    assert by("op6_quality_rules")[2]["base_failed"]
    assert by("op7_jaccard_join")[6]["component_id"] == 5 and by("op7_jaccard_join")[2]["component_id"] == 2
    assert by("op7_jaccard_join")[None]["component_id"] in (5, None)
    assert by("op9_line_runs")[6]["n_deleted"] == 1 and by("op9_line_runs")[5]["n_deleted"] == 0 and by("op9_line_runs")[1]["text"] is None
    assert by("op2_private_data")[12]["n_email"] == 300


def test_repeated_rows_share_results(spark, folders):
    for name in ("op2_private_data", "op6_quality_rules", "op8_secrets", "op9_line_runs"):
        twice = [tuple(r) for r in QUERIES[name](spark, folders["edges"]).collect() if r["doc_id"] == 5]
        assert len(twice) == 2 and twice[0] == twice[1]


def test_stages_keep_clean_documents(spark, folders):
    docs = frame(spark, plain(12, 5))
    stages = dict(corpus_pipeline.STAGES)
    for name in ("n-gram Jaccard join", "benchmark decontamination"):
        assert stages[name](spark, docs, folders["unlabelled"]).count() == 12
