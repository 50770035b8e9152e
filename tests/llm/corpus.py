"""Small corpora for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names are also names inside the operators.
CLASHES = "size string, score string, n string, cls string, row_key string, _size string, _copies string, mark string, at string, h string"


def sentence(r: random.Random, n: int, letters: str = "abcdefghijklm") -> str:
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))


def plain(n: int = 40, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    return [(i, "\n".join(sentence(r, r.randint(5, 30)) for _ in range(r.randint(1, 5))), r.choice(["en", "fr"]), f"s{i % 3}", 0) for i in range(n)]


def edges() -> list[tuple]:
    """Nulls in each column, empty and blank texts, repeated rows, a very long text, ties."""
    r = random.Random(2)
    long = sentence(r, 60_000)
    same = sentence(r, 80)
    return [
        (None, same, None, None, None), (None, None, None, None, None), (1, None, "en", "s0", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "s1", 0), (4, "word", "fr", "s1", 4),
        (5, same, "en", "s2", 0), (5, same, "en", "s2", 0), (6, same, "en", "s2", 0), (7, long, "en", "s2", None), (8, "\n\n\n", "en", "s0", 3), (9, "日本語 текст é ü 1234", "en", "s0", 0),
        (10, "…—“”", "en", "s0", 0), (11, "5" * 50_000, "en", "s0", 0), (12, "a@b.co " * 300, "fr", "s0", 0), (13, "x" * 40_000, "fr", "s0", 0),
    ]


def frame(spark, rows, clashing: bool = False):
    docs = spark.createDataFrame(rows, DOCS)
    if clashing:
        for c in CLASHES.split(", "):
            docs = docs.selectExpr("*", f"'x' AS {c.split()[0]}")
    return docs


def saved(tmp_path, spark, rows, labels=(), benchmark=(), clashing=False) -> str:
    """A folder with the tables that the queries read."""
    frame(spark, rows, clashing).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(d[0], k, ("user", "assistant")[k % 2], text) for d in rows for k, text in enumerate([d[1], "Yes."])]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def rows_of(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]
