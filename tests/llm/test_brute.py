"""Operators held against plain Python on small corpora."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import decontaminate, jaccard, language, line_quality, line_runs, mixing, private_data, queries, rules, secrets, shingles, token_files

from .corpus import frame, plain, rows_of, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_mix_targets(spark):
    r = random.Random(4)
    rows = [(i, sentence(r, r.randint(1, 40)), "en", r.choice(["a", "b", "c", None, "é"]), 0) for i in range(200)]
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(WORD.findall(text))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    weight = dict(zip(names, [3, 1, 2] * 3))
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    got = mixing.mix_plan(frame(spark, rows)).collect()
    assert {g["source"]: pytest.approx(g["_target"]) for g in got} == target
    assert all(g["_copies"] <= 2 for g in got)
    mixed = mixing.mix(frame(spark, rows)).count()
    assert mixed == sum(g["_copies"] for g in got)


def test_mix_is_near_its_targets(spark):
    rows = [(i, "w " * 20, "en", f"s{i % 3}", 0) for i in range(6000)]
    taken, target = Counter(), {}
    for g in mixing.mix_plan(frame(spark, rows)).collect():
        taken[g["source"]] += g["_copies"] * g["_size"]
        target[g["source"]] = g["_target"]
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)


def test_mix_of_null_and_repeated_ids_is_near_its_targets(spark):
    """Rows without a doc_id, and rows that are all equal, draw one by one."""
    texts = ["w " * 20 + str(i % 50) for i in range(1500)]
    rows = [(None, t, "en", "s0", 0) for t in texts] + [(7, "same " * 21, "en", "s1", 0)] * 1500 + [(i, t, "en", "s2", 0) for i, t in enumerate(texts)]
    for seed in (17, 18, 19):
        taken, target = Counter(), {}
        for g in mixing.mix_plan(frame(spark, rows).repartition(7), seed=seed).collect():
            taken[g["source"]] += g["_copies"] * g["_size"]
            target[g["source"]] = g["_target"]
        assert all(abs(taken[s] - target[s]) < 0.06 * target[s] for s in target)
    again = [sorted((g["source"], g["_copies"]) for g in mixing.mix_plan(frame(spark, rows).repartition(n)).collect()) for n in (3, 8)]
    assert again[0] == again[1], "whatever task reads a row"


def test_quality_learns_past_a_text_over_the_line_bound(spark):
    r = random.Random(12)
    rows = [(i, "\n".join(sentence(r, 12) for _ in range(3)) if i % 2 else "\n".join("x1 x1 x1 # # #" for _ in range(3)), "en", "s", 0) for i in range(400)]
    rows += [(1000 + i, "\n".join(["long line here"] * 30), "en", "s", 0) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    got = line_quality.score_quality(frame(spark, rows), labels, train_lines=20).collect()
    assert len({g["score"] for g in got}) > 1, "texts that are too long are left out, the others are learned from"


def base_private(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and private_data.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], private_data.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a0159.@-+ %_()é", max_size=60))
def test_private_base_patterns(text):
    assert private_data.base_spans(text) == base_private(text)


def test_private_bootstrap(spark):
    r = random.Random(6)
    good = [f"{sentence(r, 5)} card number: 4{i:02}1111111111{private_luhn(f'4{i:02}111111111' + '1')} thanks {sentence(r, 3)}" for i in range(12)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(good)] + [(50, f"{sentence(r, 4)} card number: 4111111111111112 thanks", "en", "s", 0), (51, f"{sentence(r, 4)} 4111111111111112 {sentence(r, 4)}", "en", "s", 0)]
    got = {g["doc_id"]: g for g in rows_of(private_data.find_private(frame(spark, rows)))}
    for i, t, *_ in rows:
        assert got[i]["base_sha256"] == sha(base_private(t))
    assert got[50]["n_card"] == 0 and got[50]["spans"].startswith("card:"), "a number in the seeds' context is found though its check digit fails"
    assert got[51]["spans"] == "", "the same number elsewhere is not"


def test_private_candidates_of_all_forms(spark):
    """Candidates don't depend on other words of a text, and may be written in groups."""
    r = random.Random(15)
    rows = [(i, f"{sentence(r, 5)} my phone: +44 20 7946 {i:04} thanks {sentence(r, 3)}", "en", "s", 0) for i in range(40)]
    rows += [(100 + i, f"{sentence(r, 5)} card number: 4{i:02}1111111111{private_luhn(f'4{i:02}1111111111')} thanks {sentence(r, 3)}", "en", "s", 0) for i in range(40)]
    unseen = ["555-123-456", "06-12-34-56-78", "555 123 4567", "(020) 123 4567", "(020) 1234567", "020 123-4567", "411-111-111-111-111", "4111 1111 1111 1112", "4111-1111 1111 1112"]
    for k, token in enumerate(unseen):
        kind = "card number" if sum(map(str.isdigit, token)) >= 12 else "my phone"
        rows.append((1000 + k, f"{sentence(r, 5)} {kind}: {token} thanks {sentence(r, 3)}", "en", "s", 0))
    got = {g["doc_id"]: g["spans"] for g in rows_of(private_data.find_private(frame(spark, rows)))}
    for k, token in enumerate(unseen):
        a = rows[80 + k][1].index(token)
        assert got[1000 + k] == f"{'card' if sum(map(str.isdigit, token)) >= 12 else 'phone'}:{a}:{a + len(token)}", token


def private_luhn(head: str) -> str:
    return next(str(d) for d in range(10) if private_data.luhn(head + str(d)))


def base_secrets(text):
    """The contract's patterns, spelled out here: letters of the first in either case (A-Z and a-z only), group 2 of six or more; 20 and 24 characters."""
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    out = [("assign", *m.span()) for m in re.finditer(rf"({either})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def test_secrets(spark):
    r = random.Random(7)
    bits = ["password = hunter22", "API_KEY:'abcDEF12'", "apikey=short1", "tOkEn\"=\"zzzzzzz", "secret: x", "AKIA" + "Z9" * 8, "AKIAshort", "0f" * 12, "deadbeef", "passwd=a/b+c=d", "ſecret=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "é" * 3]
    rows = [(i, " ".join(r.choice(bits) if r.random() < 0.3 else sentence(r, 2) for _ in range(12)), "en", "s", 0) for i in range(120)]
    got = {g["doc_id"]: g for g in rows_of(secrets.find_secrets(frame(spark, rows)))}
    for i, t, *_ in rows:
        assert got[i]["base_sha256"] == sha(base_secrets(t)), t
        assert ("private_key" in got[i]["spans"]) == ("PRIVATE KEY" in t)


def test_trigram_queries():
    assert frozenset({"pas", "ass", "ssw", "swo", "wor", "ord"}) in secrets.trigram_query(secrets.BASE_RULES[0].regex)
    assert len(secrets.trigram_query(secrets.BASE_RULES[0].regex)) == 6
    assert secrets.trigram_query(secrets.BASE_RULES[1].regex) == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(secrets.BASE_RULES[2].regex) == []


def test_token_files(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = ["", None, "Don't STOP it's 3rd—ok", "É È ß İstanbul ŉ", "<|endoftext|> x<|startoftext|>y", "a\x1cb\xa0c d", "日本語です。", "étude Å", "x" * 3000, "... !!! #$%", "don’t 12,345.67", "ΣΑΣ σας"]
    rows = [(i * 3 % 17, t, "en", "s", 0) for i, t in enumerate(odd)] + [(100 + i, t, "en", "s", 0) for i, t, *_ in plain(60)]
    index = token_files.write_records(frame(spark, rows), f"file://{tmp_path}/out", path, ranges=3, file_bytes=2000)
    assert index.select("file").distinct().count() > 3, "several files"
    got = {g["doc_id"]: g for g in rows_of(token_files.read_records(spark, f"file://{tmp_path}/out"))}
    start = 0
    for i, t, *_ in sorted(rows, key=lambda x: x[0]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)


def test_records_notice_damage():
    record = token_files.framed(token_files.payload_of(np.array([1, 2, 70000], "<u4").tobytes()))
    assert token_files.ids_of(token_files.unframed(record, "x")) == np.array([1, 2, 70000], "<u4").tobytes()
    for at in (0, 9, 13, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unframed(bytes(bad), "x")


def test_rules(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["a", "b", "c", "#d", "e$"]) for _ in range(r.randint(0, 70))) + ("\nline x\nline x\n \n" if i % 3 else ""), "en", "s", 0) for i in range(60)]
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "doc_id long")
    got = {g["doc_id"]: g for g in rows_of(rules.quality_rules(frame(spark, rows), trusted, buckets=50))}
    for i, t, *_ in rows:
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows, covered = Counter(zip(w, w[1:], w[2:])), set()
        for j in range(len(w) - 2):
            if windows[tuple(w[j : j + 3])] > 1:
                covered |= {j, j + 1, j + 2}
        want = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(t.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
        assert {k: got[i][k] for k in want} == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    # The ratio: buckets as Spark hashes them, all else by hand.
    hashed = rules.measured(frame(spark, rows)).select("doc_id", rules.F.transform("grams", lambda g: rules.bucket(g, 50)).alias("g"))
    grams = {x["doc_id"]: x["g"] for x in hashed.collect()}
    assert all(len(grams[i]) == max(0, 2 * len(WORD.findall(t)) - 1) for i, t, *_ in rows)
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        target.update(g if i % 2 == 0 else ())
    ratio = [math.log((target[b] + 1) / (sum(target.values()) + 50)) - math.log((raw[b] + 1) / (sum(raw.values()) + 50)) for b in range(50)]
    for i, g in grams.items():
        assert got[i]["llr"] == pytest.approx(sum(ratio[b] for b in g) / len(g) if g else 0.0)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["llr"] >= -0.05)


def test_rules_hold_where_copies_abound(spark):
    """Scores stay when one text is copied, and the threshold lies between what is labelled, wherever that is."""
    r = random.Random(12)
    clean, poor = [f"c{i}" for i in range(60)], [f"j{i}" for i in range(60)]
    text = lambda share: " ".join(r.choice(poor if r.random() < share else clean) for _ in range(90))
    rows = [(i, text(0.3 if i % 4 else 0.7), "en", "s", 0) for i in range(200)]
    labels = [(i, int(i % 4 > 0)) for i in range(0, 200, 3)]
    named = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = []
    for more in (0, 100):
        docs = frame(spark, rows + [(1000 + i, rows[1][1], "en", "s", 0) for i in range(more)])
        got = {g["doc_id"]: g for g in rows_of(rules.quality_rules(docs, named.where("quality = 1"), buckets=500, junk=named.where("quality = 0")))}
        assert all(got[i]["kept"] == (i % 4 > 0) for i, q in labels)
        kept.append({i: (pytest.approx(got[i]["llr"]), got[i]["kept"]) for i, *_ in rows})
    assert kept[0] == {i: (got[i]["llr"], got[i]["kept"]) for i, *_ in rows}
    assert all(got[1000 + i]["kept"] for i in range(100))


def token_set(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_corpus(seed, groups=12):
    """Groups of edited copies, small texts, shared passages: rows of all kinds of similarity."""
    r, rows, passage = random.Random(seed), [], sentence(random.Random(99), 40)
    for _ in range(groups):
        base = sentence(r, r.choice([3, 7, 20, 60, 200])).split()
        for _ in range(r.randint(1, 12)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
            rows.append(" ".join(w) + (" " + passage if r.random() < 0.4 else ""))
    r.shuffle(rows)
    return [(i, t, "en", "s", 0) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "settings_"), [(1, {}), (2, {"frequent": 4, "hub_rounds": 0}), (3, {"frequent": 4, "hub_rounds": 2})])
def test_jaccard(spark, seed, settings_, monkeypatch):
    monkeypatch.setattr(jaccard, "LOCAL", 1)
    rows = near_corpus(seed)
    sets = {i: token_set(t) for i, t, *_ in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    got = {g["doc_id"]: g for g in rows_of(jaccard.join_components(frame(spark, rows), **settings_))}
    assert {i: (got[i]["n_shingles"], got[i]["component_id"]) for i in sets} == {i: (len(sets[i]), find(i)) for i in sets}


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**32), st.floats(0, 0.3), st.floats(0, 1))
def test_prefixes_of_linked_sets_meet(n, seed, loss, common):
    """Whatever tokens are frequent, two sets that link share a signature, and no bound rejects them."""
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, 2 * n + 4, dtype=np.uint64))
    a = np.sort(pool[:n])
    keep = rng.random(len(a)) >= loss / 2
    b = np.unique(np.concatenate((a[keep], pool[n : n + int(loss * n / 2)])))
    if not len(b) or 100 * len(np.intersect1d(a, b)) < 75 * len(np.union1d(a, b)):
        return
    count_of = {int(t): int(rng.integers(64, 9000)) if rng.random() < common else 0 for t in pool}
    order = sorted((t for t in count_of if count_of[t]), key=lambda t: (count_of[t], t))
    rank_of = {t: i for i, t in enumerate(order)}
    signs = []
    for s in (a, b):
        with np.errstate(over="ignore"):
            sig, salts = jaccard.signatures(s, np.array([rank_of.get(int(t), -1) for t in s]), np.array([count_of[int(t)] for t in s]), 75)
        assert len(sig) == len(salts)
        signs.append(set(sig.tolist()))
    assert signs[0] & signs[1]
    assert jaccard.may_share(jaccard.sketch(a), jaccard.sketch(b)) >= len(np.intersect1d(a, b))


def test_shingles_are_the_words():
    texts = [b"a b c d e f", b"A b c d e", b"x", b"", None, b"b c d e f", b"a b"]
    got = list(shingles.sets(texts))
    assert [len(g) for g in got] == [2, 1, 1, 0, 0, 1, 1]
    assert set(got[0]) == set(got[1]) | set(got[5]) and got[2][0] != got[6][0]


def brute_runs(rows, least):
    seqs = [(i, t.split("\n")) for i, t in rows]
    out, where = {i: set() for i, _ in seqs}, defaultdict(list)
    for k, (_, lines) in enumerate(seqs):
        for j, line in enumerate(lines):
            where[line].append((k, j))
    for k, (i, lines) in enumerate(seqs):
        for a in range(len(lines)):
            for k2, a2 in where[lines[a]]:
                if (k2, a2) >= (k, a):
                    break
                other, n = seqs[k2][1], 0
                while a + n < len(lines) and a2 + n < len(other) and lines[a + n] == other[a2 + n]:
                    n += 1
                if sum(len(WORD.findall(x)) for x in lines[a : a + n]) >= least:
                    out[i] |= set(range(a, a + n))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_runs(spark, seed):
    r = random.Random(seed)
    pool = [sentence(r, r.randint(0, 6)) for _ in range(12)]
    runs = [[r.choice(pool) for _ in range(r.randint(1, 12))] for _ in range(6)]
    rows = [(i, "\n".join(x for _ in range(r.randint(1, 5)) for x in (r.choice(runs) if r.random() < 0.6 else [sentence(r, 4), r.choice(pool)]))) for i in range(40)]
    want = brute_runs(rows, 10)
    got = rows_of(line_runs.delete_repeated_runs(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]), min_words=10))
    assert sum(map(len, want.values())) > 50
    for g in got:
        gone = {n for part in g["_runs"].split(",") if part for n in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}
        assert gone == want[g["doc_id"]]
        assert g["text"] == "\n".join(x for n, x in enumerate(dict(rows)[g["doc_id"]].split("\n")) if n not in gone)


@pytest.mark.parametrize("block", [1_000_000, 40])
def test_decontaminate(spark, block):
    r = random.Random(9)
    items = [(i, sentence(r, r.choice([2, 6, 20, 45]))) for i in range(8)]
    rows = []
    for i in range(60):
        words, item = sentence(r, r.randint(0, 120)).split(), r.choice(items)[1].split()
        kind = i % 4
        if kind == 1:
            words[len(words) // 2 : len(words) // 2] = item
        elif kind == 2:
            item = [w if r.random() > 0.04 else "swap" for w in item]
            words = words[:10] + item
        elif kind == 3:
            words += item[: len(item) // 2]
        rows.append((i, " ".join(words), "en", "s", 0))
    toks = {i: t.encode().lower().split() for i, t in items}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    df = Counter(g for w in toks.values() for g in grams(w))
    weight = lambda g: math.log(1 + len(items) / (1 + df[g]))
    want = {}
    for i, t, *_ in rows:
        w = t.encode().lower().split()
        for item, own in toks.items():
            a = grams(own)
            for s in range(max(1, len(w) - len(own) + 1)):
                x = grams(w[s : s + len(own)])
                if x & a and sum(map(weight, x & a)) / sum(map(weight, x | a)) >= 0.75:
                    want[i, item] = max(want.get((i, item), 0), sum(map(weight, x & a)) / sum(map(weight, x | a)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(g["doc_id"], g["item_id"]): g["similarity"] for g in rows_of(decontaminate.contaminated(frame(spark, rows), bench, block_shingles=block))}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 15
    left = {g["doc_id"] for g in rows_of(decontaminate.without_contaminated(frame(spark, rows), bench))}
    assert left == {i for i, *_ in rows} - {i for i, _ in want}


@pytest.mark.parametrize(("same", "near", "others"), [(67, 0, 133), (1, 66, 133), (1, 0, 0)])
def test_decontaminate_by_plain_similarity(spark, same, near, others):
    """One changed word in 45 leaves 36 of 46 shingles, however many items share the text, and however many there are."""
    r = random.Random(13)
    words = sentence(r, 45).split()
    items = [" ".join(words)] * same + [" ".join([*words[:-1], f"end{i}"]) for i in range(near)] + [sentence(r, 45) for _ in range(others)]
    rows = [(i, " ".join([*sentence(r, 20).split(), *words[:22], f"changed{i}", *words[23:], *sentence(r, 20).split()]), "en", "s", 0) for i in range(12)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(g["doc_id"], g["item_id"]) for g in rows_of(decontaminate.contaminated(frame(spark, rows), bench)) if g["item_id"] < same}
    assert got == {(i, j) for i in range(12) for j in range(same)}


def test_items_without_id_are_found(spark):
    r = random.Random(17)
    items = [(None, sentence(r, 20)), (None, sentence(r, 30)), (1, sentence(r, 20)), (1, sentence(r, 30)), (None, None)]
    rows = [(i, f"{sentence(r, 20)} {t} {sentence(r, 20)}", "en", "s", 0) for i, (_, t) in enumerate(items[:4])] + [(9, sentence(r, 60), "en", "s", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(g["doc_id"], g["item_id"]) for g in rows_of(decontaminate.contaminated(frame(spark, rows), bench))} == {(0, None), (1, None), (2, 1), (3, 1)}
    assert [g["doc_id"] for g in rows_of(decontaminate.without_contaminated(frame(spark, rows), bench))] == [9]


def test_hamming_blocks_find_all_within_radius():
    rng = np.random.default_rng(3)
    near = set(decontaminate.flips())
    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a
        for bit in rng.choice(64, int(rng.integers(0, decontaminate.RADIUS + 1)), replace=False):
            b ^= 1 << int(bit)
        assert any(((a >> 8 * i) & 255) ^ ((b >> 8 * i) & 255) in near for i in range(8))


def test_forward_backward_is_exact():
    rng = np.random.default_rng(5)
    sizes = [1, 4, 2, 6]
    first = np.concatenate(([0], np.cumsum(sizes)))
    scores, trans = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    marginals, pairs, z = line_quality.forward_backward(scores, first, trans)
    total = 0.0
    for k, n in enumerate(sizes):
        sums, mass, moves = np.zeros(n), 0.0, np.zeros((2, 2))
        for labels in range(2**n):
            y = [(labels >> i) & 1 for i in range(n)]
            w = math.exp(sum(scores[first[k] + i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            mass += w
            sums += w * np.array(y)
            for i in range(n - 1):
                moves[y[i], y[i + 1]] += w
        assert marginals[first[k] : first[k + 1]] == pytest.approx(sums / mass)
        assert pairs[k] == pytest.approx(moves / mass)
        total += math.log(mass)
    assert z == pytest.approx(total)


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    got = queries.op3_line_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(g["predicted"] == g["quality"] for g in got) >= 0.97 * len(got)


def test_language_on_held_out_documents(spark):
    got = queries.op4_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(g["lang_pred"] == g["lang"] for g in got) >= 0.99 * len(got)


def test_rare_languages_are_learned(spark):
    """A big language takes no room from a rare one: neither in the sample nor among the words that are kept."""
    r = random.Random(14)
    rare = [sentence(r, 30, "nopqrst").split() for _ in range(2)]
    held = [i for i in range(1000, 1040) if zlib.crc32(str(i).encode()) % 3 == 1]
    learned = [i for i in range(1000, 1040) if i not in held]
    rows = [(i, sentence(r, 30), "big", "s", 0) for i in range(400)]
    rows += [(learned[0], " ".join(rare[0]), "rare", "s", 0), (learned[1], " ".join(rare[1]), "other", "s", 0)]
    rows += [(i, " ".join(r.sample(rare[k % 2], 20)), ("rare", "other")[k % 2], "s", 0) for k, i in enumerate(held)]
    got = {g["doc_id"]: g["lang_pred"] for g in rows_of(language.identify_language(frame(spark, rows), train_documents=20))}
    assert all(got[i] == lang for i, _, lang, *_ in rows)
    model = language.train(frame(spark, [*rows, (learned[2], f"{rows[0][1].split()[0]} " + sentence(r, 30, "uvw"), "third", "s", 0)]), 1000)
    both = model.word_logs[np.searchsorted(model.known, language.Words([rows[0][1].split()[0]]).hashes[0])]
    assert len(both) == 4 and both[model.langs.index("third")] > min(both), "a word's single occurrence counts"
    usable = [t for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(model.known) >= len({w for t in usable for w in t.split()}), "no word of the sample is left out"


def test_language_scores_by_brute_force(spark):
    """Words first, then the longest known n-grams, summed over all words; in plain Python, from the same documents."""
    r = random.Random(21)
    letters = {"x": "abcdé", "y": "cdefg", "z": "असमीि"}
    rows = [(i, "; ".join(sentence(r, r.randint(1, 12), letters[lang]).replace(" ", r.choice([" ", ", ", "1"])) for _ in range(3)), lang, "s", 0) for i in range(120) for lang in [r.choice("xyz")]]
    rows += [(500, "… 12", "x", "s", 0), (501, None, "y", "s", 0), (502, "ी ी", None, "s", 0), (503, "ABC aBć Def", None, "s", 0)]
    learned = [(t, lang) for i, t, lang, *_ in rows if lang and zlib.crc32(str(i).encode()) % 3 != 1 and t]

    def split(text):
        words, run = [], ""
        for c in (text or "").lower() + "\n":
            if unicodedata.category(c)[0] in "LM":
                run += c
            elif run:
                words += [run] if any(unicodedata.category(x)[0] == "L" for x in run) else []
                run = ""
        return words

    langs = sorted({lang for _, lang in learned})
    counts = [defaultdict(Counter) for _ in range(5)]
    for text, lang in learned:
        for w in split(text):
            counts[0][w][lang] += 1
            for n in range(1, 5):
                for g in language.grams(w, n):
                    counts[n][g][lang] += 1
    sums = [{lang: sum(c[lang] for c in t.values()) for lang in langs} for t in counts]
    log = lambda n, piece: [math.log((counts[n][piece][x] + 0.5) / (sums[n][x] + 0.5 * len(counts[n]))) for x in langs]

    def score(w):
        if w in counts[0]:
            return log(0, w)
        for n in range(min(4, len(w) + 2), 0, -1):
            if hits := [log(n, g) for g in language.grams(w, n) if g in counts[n]]:
                return [sum(x) / len(hits) for x in zip(*hits)]
        return [0.0] * len(langs)

    got = {g["doc_id"]: g for g in rows_of(language.identify_language(frame(spark, rows)))}
    for i, text, *_ in rows:
        words = split(text)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = [sum(x) for x in zip(*map(score, words))]
        best = max(range(len(langs)), key=lambda k: total[k])
        assert got[i]["lang_pred"] == langs[best]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp((x - total[best]) * min(1, 40 / len(words))) for x in total))


def test_language_falls_back_to_grams():
    rows = [{"lang": "x", "n": 0, "piece": "aba", "count": 9}, {"lang": "y", "n": 0, "piece": "zyz", "count": 9}]
    rows += [{"lang": lang, "n": n, "piece": g, "count": 5} for lang, w in (("x", "aba"), ("y", "zyz")) for n in range(1, 5) for g in language.grams(w, n)]
    model = language.Model(rows)
    got = model.languages(["aba aba", "zyzyz", "123 ...", None], {})
    assert [g[0] for g in got] == ["x", "y", "und", "und"] and got[2] == got[3] == ("und", 0.0)
