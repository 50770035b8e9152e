"""The records' payloads: what they take, and that they are read back as they were."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from folioflow.llm import queries, token_files

from .corpus import frame, sentence


def test_records_take_less_than_two_bytes_an_id(spark, tmp_path):
    """Texts of a few hundred words from a vocabulary of some hundreds, as most are."""
    r = random.Random(18)
    words = [sentence(r, 1) for _ in range(300)]
    rows = [(i, " ".join(r.choices(words, k=600)), "en", "s", 0) for i in range(40)]
    index = token_files.write_records(frame(spark, rows), f"file://{tmp_path}/out", queries.tokenizer_path(), ranges=3)
    n_tokens = sum(x["n_tokens"] for x in index.collect())
    assert sum(x.stat().st_size for x in Path(tmp_path, "out/records").glob("*.rec")) < 0.85 * 2 * n_tokens
    encoder = token_files.WordEncoder(queries.tokenizer_path())
    counts = {x["doc_id"]: x["n_tokens"] for x in token_files.read_records(spark, f"file://{tmp_path}/out").collect()}
    assert counts == {i: len(encoder.ids(t.encode())) // 4 + 1 for i, t, *_ in rows}


@pytest.mark.parametrize("most", [5, 300, 1 << 16, 1 << 17, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 2, 30, 5_000])
def test_payloads_are_read_back(most, n):
    ids = np.random.default_rng(n).integers(0, most, n).astype("<u4")
    payload = token_files.payload_of(ids.tobytes())
    assert token_files.ids_of(payload) == ids.tobytes()
    assert len(payload) <= 1 + (2 if ids.max(initial=0) < 1 << 16 else 4) * n
    if n == 5_000 and most <= 300:
        assert payload[0] == 2 + token_files.COMPRESSED and len(payload) < 2 * 0.8 * n


def test_payloads_of_before_are_read():
    assert token_files.ids_of(b"\2\1\0\2\0") == np.array([1, 2], "<u4").tobytes()
    assert token_files.ids_of(b"\4\1\0\0\0\0\0\1\0") == np.array([1, 1 << 16], "<u4").tobytes()


def test_damage_in_compressed_ids_is_told():
    record = token_files.framed(token_files.payload_of(np.ones(5_000, "<u4").tobytes()))
    for at in range(12, len(record)):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unframed(bytes(bad), "x")
