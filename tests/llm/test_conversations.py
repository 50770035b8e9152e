"""Conversation repair against exhaustive search and SQL, on small and awkward conversations."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, place string, symbols string"


def searched(symbols: str) -> tuple[int, str]:
    """Every choice of edits for each row, with up to two inserted rows in each gap."""
    best = (10**9, "")
    kept = {"D": [("D", 3, "")]}
    for s in "suaxSUAX":
        stays = [("K", int(s.isupper()), s.lower())] if s.lower() != "x" else []
        kept[s] = [*kept["D"], *stays, ("R", 2 + s.isupper(), "u"), ("R", 2 + s.isupper(), "a")]
    gaps = [("", 0, ""), ("I", 2, "u"), ("I", 2, "a"), ("II", 4, "ua"), ("II", 4, "au")]
    for rows in itertools.product(*(kept[s] for s in symbols)):
        for between in itertools.product(gaps, repeat=len(symbols) + 1):
            order = [x for pair in itertools.zip_longest(between, rows) for x in pair if x]
            if re.fullmatch("(s?(ua)+)?", "".join(x[2] for x in order)):
                best = min(best, (sum(x[1] for x in order), "".join(x[0] for x in order)))
    return best


@pytest.mark.parametrize("n", [0, 1, 2])
def test_every_short_sequence(n):
    found = conversations.matrices([])
    for symbols in map("".join, itertools.product("suaxSUAXD", repeat=n)):
        assert conversations.cheapest(symbols, found) == searched(symbols), symbols


@settings(max_examples=200, deadline=None)
@given(st.text("suaxSUAXD", max_size=60), st.lists(st.text("suaxSUAXD", min_size=2, max_size=2), max_size=6, unique=True))
def test_grammar_changes_nothing(symbols, pairs):
    """Any rules, nested ones among them, give the edits that symbol by symbol gives."""
    rules = list(pairs)
    for i in range(len(pairs) - 1):
        rules.append(chr(conversations.FIRST_RULE + i) + chr(conversations.FIRST_RULE + i + 1))
    assert conversations.cheapest(conversations.compressed(symbols, rules), conversations.matrices(rules)) == conversations.cheapest(symbols, conversations.matrices([]))


def test_long_sequences_share_rules(spark):
    r = random.Random(3)
    rows = [("".join(r.choice(["ua", "uaua", "uA", "sua", "uu"]) for _ in range(40)), 3) for _ in range(50)]
    rules = conversations.grammar(spark.createDataFrame(rows, "symbols string, weight long"), most=60)
    assert 20 < len(rules) <= 60 and conversations.expanded(rules).max() >= 8
    assert sum(len(conversations.compressed(s, rules)) for s, _ in rows) < 0.4 * sum(len(s) for s, _ in rows)


def awkward(r: random.Random) -> list[tuple]:
    texts = ["Yes.", "No!", "open", "", " \t\n", None, "tail.  \n", "a.\x0b", "Yes.", "x" * 30_000, "é?"]
    roles = ["user", "assistant", "system", None, "User", "", "support", "tool"]
    rows = [(c, r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for c in [None, *range(60)] for _ in range(r.randint(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(400)]
    return [(*x, "x", "y") for x in rows + rows[:7] * 2]


def against_sql(spark, tmp_path, rows):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    got = sorted((tuple(x) for x in queries.op11_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(duck.sql(queries.oracle_sql()["op11_conversation_repair"]).fetchall(), key=str)
    return got


def test_awkward_conversations(spark, tmp_path):
    rows = awkward(random.Random(5))
    got = against_sql(spark, tmp_path, rows)
    assert len(got) == len({x[0] for x in rows})


def test_pieces_of_one_conversation(spark, tmp_path, monkeypatch):
    """A conversation dealt over many small Arrow batches and tasks has one answer."""
    monkeypatch.setattr(conversations, "arrow_batches", lambda session, rows: session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7"))
    r = random.Random(8)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "", f"{t}!"]), None, None) for t in range(300)]
    assert len(against_sql(spark, tmp_path, rows)[0][7]) >= 200


def test_nothing_is_left(spark, tmp_path):
    """Conversations whose rows are all dropped, and tables without rows."""
    import zlib

    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = against_sql(spark, tmp_path / "a", [(c, 0, "user", "Hi.", None, None) for c in gone])
    assert [x[1:] for x in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())] * 3
    assert against_sql(spark, tmp_path / "b", []) == []
