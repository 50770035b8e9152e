"""Markdown repair, substitution, signals and types on hand-made rows."""

from __future__ import annotations

import base64

import pytest
from pyspark.sql import functions as F

from folioflow.functions import files, tables, text
from folioflow.operators import pages

TABLES = [
    ("rows stay", "| a | b |\n| --- | --- |\n| 1 | 2 |", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ("continued cell", "| a\nmore | b |\n|---|---|\n| 1   x | 2 |", "| a more | b |\n|---|---|\n| 1 x | 2 |"),
    ("no header", "|---|---|\n| 1 | 2 | 3 |", "|  |  |  |\n|---|---|\n| 1 | 2 | 3 |"),
    ("single orphan that says little", "|  | - |  |\n|---|---|---|\n| 1 | 2 | 3 |", "|  |  |  |\n|---|---|---|\n| 1 | 2 | 3 |"),
    ("orphans above a header", "| x | y |\n| - | . |\n| h | i |\n|---|---|\n| 1 | 2 |", "| h | i |\n|---|---|\n| x | y |\n| 1 | 2 |"),
    ("orphans, no header", "| x | y | z |\n|  | a |  |\n|---|---|---|", "|  |  |  |\n|---|---|---|\n| x | y | z |\n| | a | |"),
    ("no separator", "| a | b |\n| 1 | 2 |", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ("one row", "| a | b |", "| a | b |"),
    ("blank lines", "\n\n| a |\n| - |\n\n\n| 1 |\n\n", "| a |\n| - |\n\n| 1 |"),
    ("all blank", "\n \n", "\n \n"),
    ("no table", "only\ntext", "only text"),
    ("empty", "", ""),
]


@pytest.mark.parametrize(("name", "broken", "fixed"), TABLES)
def test_table_repair(spark, name, broken, fixed):
    got = spark.createDataFrame([(broken,)], "c string").select(tables.repaired(F.col("c"))).first()[0]
    assert got == fixed


def test_table_repair_of_null(spark):
    assert spark.createDataFrame([(None,)], "c string").select(tables.repaired(F.col("c"))).first()[0] is None


def test_substitution(spark):
    page = [(1, 1, "A [tbl-0.md](tbl-0.md) B [tbl-1](tbl-1) C ![x](img-0.jpeg) ![](img-1) ![z](other) [tbl](q) ![tbl-0.md](tbl-0.md) [no](way)", " Head ", "   ")]
    pages_ = spark.createDataFrame(page, "document_id long, page_number int, markdown string, header string, footer string")
    tabs = spark.createDataFrame([(1, 1, "tbl-0", "| a |\n| - |"), (1, 1, "tbl-1.md", "| b |\n| - |"), (1, 1, None, "x"), (1, 2, "no", "y")], "document_id long, page_number int, table_id string, content string")
    png = base64.b64encode(b"\x89PNG\r\n\x1a\n0123456789").decode()
    imgs = spark.createDataFrame([(1, 1, "img-0.jpeg", f"data:image/png;base64,{png}"), (1, 1, "img-1.png", png), (1, 1, "other", "")], "document_id long, page_number int, image_id string, image_base64 string")
    figures = pages.figures(imgs, "https://host/")
    urls = {r["image_id"]: r["url"] for r in figures.collect()}
    assert set(urls) == {"img-0.jpeg", "img-1.png"} and urls["img-1.png"].endswith(".png") and urls["img-1.png"].startswith("https://host/api/v1/ocr/images/ocr_img_")
    got = pages.finished(pages.with_figures(pages.with_tables(pages_, tabs), figures)).first()["text"]
    want = f"Head\n\nA | a |\n| - | B | b |\n| - | C ![x]({urls['img-0.jpeg']}) ![image]({urls['img-1.png']}) ![z](other) | a |\n| - | ![tbl-0.md](tbl-0.md) [no](way)\n\n"
    assert got == want


@pytest.mark.parametrize(("content", "kind", "mime"), [
    (b"%PDF-1.7xxxx", "pdf", "image/jpeg"), (b"%PDF-1.7x", "unknown", "image/jpeg"), (b"\xff\xd8\xff\xe0123456", "image", "image/jpeg"), (b"\x89PNG\r\n\x1a\n00", "image", "image/png"),
    (b"\x89PNGxxxxxx", "image", "image/jpeg"), (b"GIF89a0000", "image", "image/gif"), (b"GIF8xx0000", "unknown", "image/gif"), (b"BM00000000", "image", "image/bmp"),
    (b"RIFF0000WEBP", "image", "image/webp"), (b"RIFF0000WAVE", "unknown", "image/jpeg"), (b"II*\x00000000", "image", "image/tiff"), (b"MM\x00*000000", "image", "image/tiff"), (b"", "unknown", "image/jpeg"), (None, "unknown", "image/jpeg"),
])
def test_types(spark, content, kind, mime):
    row = spark.createDataFrame([(content,)], "c binary").select(files.file_type(F.col("c")), files.image_mime(F.col("c"))).first()
    assert tuple(row) == (kind, mime)


def test_bad_base64_is_jpeg(spark):
    assert spark.createDataFrame([("??not base64",)], "c string").select(files.base64_mime(F.col("c"))).first()[0] == "image/jpeg"


@pytest.mark.parametrize(("t", "want"), [("", 0.0), (None, 0.0), ("###", 50.0), ("hello world", 97.27), ("ab�", 73.33), ("\x00\x01", 20.0), ("a" * 30, 80.0), ("[x](y) ok go", 94.0)])
def test_confidence(spark, t, want):
    got = spark.createDataFrame([(t,)], "c string").select(text.page_confidence(F.col("c"))).first()[0]
    assert got == pytest.approx(want, abs=0.011)


def test_order_of_tables(spark):
    """The first table that fits by prefix is the first in the array; of equal ids the last content holds."""
    response = '{"pages": [{"index": 0, "markdown": "[tbl](q) [a](a)", "tables": [{"id": "tbl-9", "content": "| nine |"}, {"id": "a", "content": "| old |"}, {"id": "tbl-1", "content": "| one |"}, {"id": "a", "content": "| new |"}]}]}'
    got = pages.page_pipeline(pages.from_responses(spark.createDataFrame([(1, response)], "document_id long, response string"))).first()
    assert got["text"] == "| nine | | new |" and got["character_count"] == 16


def test_token_confidence(spark):
    tokens = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.0), (1, 1, 1.0), (1, 2, 0.0)], "document_id long, page_number int, confidence double")
    assert {tuple(r) for r in pages.token_confidence(tokens, tokens).collect()} == {(1, 1, 75.0), (1, 2, 99.0)}


def test_languages(spark):
    shares = spark.createDataFrame([(1, "en", 0.9), (1, "fr", 0.1), (2, "en", 0.5), (2, "fr", 0.3), (2, "de", 0.2), (3, "xx", 0.15), (3, "en", 0.1)], "document_id long, lang string, p double")
    docs = spark.createDataFrame([(1, "long enough"), (2, "long enough"), (3, "long enough"), (4, "short"), (5, None)], "document_id long, text string")
    got = {r["document_id"]: (r["languages"], r["mode"]) for r in pages.detected_languages(docs, shares).collect()}
    assert got == {1: (["en"], "english"), 2: (["en", "fr", "de"], "mixed"), 3: (["xx"], "xx"), 4: (["en"], "english"), 5: (["en"], "english")}


def test_language_profiles_are_accurate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("document_id"), "text", "lang")
    profiles = pages.language_profiles(docs.where("document_id % 3 <> 1").select("lang", "text"))
    held = docs.where("document_id % 3 = 1 and length(text) >= 50")
    got = pages.detected_languages(held, pages.language_shares(held, profiles)).join(held, "document_id").collect()
    assert sum(r["languages"][0] == r["lang"] for r in got) >= 0.95 * len(got)


def test_languages_of_whole_texts(spark):
    one = "abca bcab cabc " * 200
    other = one.translate(str.maketrans("abc", "xyz"))
    labelled = spark.createDataFrame([("aa", one + "ddd"), ("bb", other + "www")], "lang string, text string")
    profiles = pages.language_profiles(labelled)
    assert {r["gram"] for r in profiles.collect()} >= {"ddd", "www"}, "profiles are of whole texts"
    docs = spark.createDataFrame([(1, one + other), (2, one)], "document_id long, text string")
    got = {r["document_id"]: (sorted(r["languages"]), r["mode"]) for r in pages.detected_languages(docs, pages.language_shares(docs, profiles)).collect()}
    assert got == {1: (["aa", "bb"], "mixed"), 2: (["aa"], "aa")}


def test_mean_confidence_of_a_tie(spark):
    """93.825 is half up 93.83, though the sum of the two doubles is a little less."""
    rows = spark.createDataFrame([(1, 1, "a", 93.80), (1, 2, "b", 93.85)], "document_id long, page_number int, text string, confidence double")
    facts = spark.createDataFrame([(1, ["en"], "english", "x", "\n")], "document_id long, languages array<string>, mode string, engine string, separator string")
    reply = pages.replies(rows, facts).first()
    assert '"average_confidence":93.83' in reply["by_page"] and "with 93.83%" in reply["by_page"] and '"confidence":93.83,"pages"' in reply["document"]
    assert pages.assembled(rows).first()["confidence"] == 93.83


def test_token_confidence_bounds_the_rows_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(pages, "TASK_ROWS", 50)
    tokens = spark.createDataFrame([(i // 4, i % 4, 0.0 if i % 4 == 3 else 0.5) for i in range(400)], "document_id long, page_number int, confidence double")
    found = pages.token_confidence(tokens, tokens)
    assert found.rdd.getNumPartitions() == 17, "800 rows of pages and tokens, of which AQE joins no two parts"
    assert sorted(map(tuple, found.collect())) == [(i // 4, i % 4, 99.0 if i % 4 == 3 else 50.0) for i in range(400)]
