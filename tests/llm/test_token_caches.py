"""The token encoder's caches."""

from __future__ import annotations

import itertools
import random

from folioflow.llm import queries, token_files


def test_letters_are_merged_once():
    """150,000 words, first small and then capital: the letters are the same."""
    encoder, merge, calls = token_files.WordEncoder(queries.tokenizer_path()), None, [0]
    merge = encoder.merge

    def counted(text):
        calls[0] += 1
        return merge(text)

    encoder.merge = counted
    words = ["".join(w).encode() for w in itertools.islice(itertools.product("abcdefgh", repeat=6), 150_000)]
    small = [encoder[w] for w in words]
    assert [encoder[w.upper()] for w in words] == small and calls[0] == len(words)


def test_unseen_words_are_merged_by_one_call():
    """1,000 new words, some with punctuation after them: no call a word."""
    encoder, calls = token_files.WordEncoder(queries.tokenizer_path()), [0]
    whole, merge = encoder.tokenizer, encoder.merge

    def counted(text):
        calls[0] += 1
        return merge(text)

    encoder.merge = counted
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefghé", repeat=5), 1_000)]
    text = " ".join(w + (",", "", '."', "")[i % 4] for i, w in enumerate(words))
    # Before é the tail goes with its word, so that word is merged by itself.
    assert encoder.ids(text.encode()) == token_files.packed(whole.encode(text, add_special_tokens=False).ids)
    assert calls[0] <= sum(w.endswith("é") for w in words)


def test_ids_are_those_of_whole_texts(monkeypatch):
    """Case, marks, tails and the tokenizer's own tokens, in any order; caches that start anew."""
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    monkeypatch.setattr(token_files, "TOGETHER", 7)
    r = random.Random(5)
    parts = [
        "The", "word", "WORD", "Été", "ŉé", "İi", "ſt", "don't", "IT'S", "dogs'", "3,000a,", "a—,", "“quoted.”", "(x).", "x_", "J̌", "ẗ", "H̱", "≠", "́", "Σ", "ς",
        "<|ENDOFTEXT|>", "<|endoftext|>", "a<|endoftext|>b", "日本", " ", "a, b", "\x1c", "\x85", "5", ",", "...", "é,", "|", "'s", "'S", "K", "ß", "ÿŸ",
    ]
    encoder = token_files.WordEncoder(queries.tokenizer_path())
    for n in range(3_000):
        some = r.sample(parts, r.randint(0, 12)) if n % 2 else [x for x in r.sample(parts, 20) if not set(x) & set("̸̱̌̈́|")]
        text = "".join(x + r.choice([" ", " ", "\n", "\t", "", "  "]) for x in some)
        assert encoder.ids(text.encode()) == token_files.packed(encoder.tokenizer.encode(text, add_special_tokens=False).ids), ascii(text)
