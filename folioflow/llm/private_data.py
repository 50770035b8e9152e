"""Personal data: bootstrapped contextual extraction.

Base detectors find e-mail addresses, IP addresses, card numbers and phone numbers. These seed entities induce
lexical patterns: the words around them. Patterns and identifier-like tokens form a graph that Spark scores
iteratively: a pattern is as good for a kind as the instances in it (weighted by how many different seeds bear it
out, against all that occurs in it), an instance as good as its patterns. Tokens in high-confidence patterns, of a
form that fits the kind, are new spans. Base spans always stay. A token is a run without white space, or digit groups
joined by single spaces, brackets or hyphens; where both are found at one place the longer stays.

All instances of all documents take part; counts are sums of rows, pre-aggregated, and the two joins of a round are
between aggregated tables and the edges, by pattern or instance. Patterns are never collected.

Defined cases: null text counts as empty. A row is known by doc_id and a 64-bit hash of its text; rows that repeat both
have the same spans. Contexts reach CONTEXT characters to each side; base spans have no such bound. An empty table
gives an empty result. Very long texts are searched whole. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, tidy, written
from .secrets import digest, row_key

#: Kinds, in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
CONTEXT = 80
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GROUP = r"[0-9]++(?![^\W_]|[_@]|[.,:/][0-9A-Za-z])"
#: Digit groups, of which a single space, a hyphen or a bracket stands between two.
GROUPS = re.compile(rf"(?<![\w@])(?<![0-9][.,:/+-])\+?\(?{GROUP}(?:(?:[\x20-]|\)[\x20-]?|[\x20-]?\(){GROUP})+")
EDGES = ".,;:!?()[]{}<>\"'"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What the pattern finds, at each @ in turn: the local part is all of the run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time from each run of numbers joined by single dots."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        for run in re.finditer(r"[0-9]++(?:\.[0-9]++)*+", m[0]):
            parts, at = run[0].split("."), m.start() + run.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    yield at, end
                at = end + 1


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [(k, a, b) for k, f in zip(KINDS, (emails, ips, cards, phones), strict=True) for a, b in f(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def form(token: str) -> str:
    """The kind that an identifier-like token may be of by its form alone; empty if none."""
    digits = sum(map(str.isdigit, token))
    if "@" in token:
        return "email"
    if digits < 6 or 2 * digits < len(token):
        return ""
    if len(re.split(r"[.:]", token)) >= 4:
        return "ip"
    return "card" if digits >= 12 else "phone" if digits >= 7 else ""


def patterns(left: str, right: str) -> list[str]:
    """Lexical patterns: two words before, one word each side, two words after, and a cue word that ends in a colon."""
    a, b = left.lower().split(), right.lower().split()
    found = []
    if len(a) >= 2:
        found.append(f"{a[-2]} {a[-1]} _")
    if a and b:
        found.append(f"{a[-1]} _ {b[0]}")
    if len(b) >= 2:
        found.append(f"_ {b[0]} {b[1]}")
    if a and a[-1][-1] in ":=":
        found.append(f"{a[-1]} _")
    return found


def instances(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Identifier-like tokens: those of the base spans, and others of a form that fits a kind; place is where the longest one around begins."""
    found, taken = [], sorted((a, b) for _, a, b in spans)
    ends = 0
    tokens = []
    for m in re.finditer(r"[0-9@]", text):
        if m.start() < ends:
            continue
        start, ends = m.start(), m.end()
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        while ends < len(text) and not text[ends].isspace():
            ends += 1
        token = text[start:ends]
        core = token.strip(EDGES)
        a = start + token.find(core) if core else start
        if core and (kind := form(core)):
            tokens.append((kind, a, a + len(core)))
    spaced = []
    for m in GROUPS.finditer(text):
        if " " not in m[0]:
            continue
        a = m.start() + (m[0][0] == "(" and ")" not in m[0])
        if kind := form(text[a : m.end()]):
            spaced.append((kind, a, m.end()))
    tokens += spaced
    free, i = [], 0
    for kind, a, b in sorted(tokens, key=lambda t: t[1]):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i == len(taken) or taken[i][0] >= b:
            free.append((kind, a, b))
    within = {}
    for _, a, b in spaced:
        within |= dict.fromkeys(range(a, b), a)
    for (kind, a, b), seed in [*((s, True) for s in spans), *((s, False) for s in free)]:
        for pattern in patterns(text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]):
            found.append({"kind": kind, "a": a, "b": b, "value": text[a:b], "seed": seed, "pattern": pattern, "place": within.get(a, a)})
    return found


SCAN = "doc_id long, row_key string, base array<struct<kind:string,a:int,b:int>>, found array<struct<kind:string,a:int,b:int,value:string,seed:boolean,pattern:string,place:int>>"


@tidy
def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32())])
    seen = pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.string()), ("seed", pa.bool_()), ("pattern", pa.string()), ("place", pa.int32())])
    for batch in batches:
        base, found = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text) if text else []
            base.append([{"kind": k, "a": a, "b": b} for k, a, b in spans])
            found.append(instances(text, spans) if text else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(seen))], names=["doc_id", "row_key", "base", "found"])


def score(edges: DataFrame, rounds: int, prior: float) -> DataFrame:
    """kind, pattern, score after some rounds over the graph of (kind, value, seed, pattern) edges."""
    kept = edges.groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed"))
    instance = kept.groupBy("kind", "value").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("belief"))
    # All that occurs in a pattern counts against each kind, of whatever kind it is itself.
    total = kept.groupBy("pattern").agg(F.count_distinct("kind", "value").alias("all"))
    links = written(kept.join(total, "pattern").where("all > 1"), "pattern-links")
    for step in range(rounds):
        scored = (
            links.join(instance, ["kind", "value"]).groupBy("kind", "pattern")
            .agg((F.sum("belief") / (F.first("all") + F.lit(prior))).alias("score"), F.count(F.when(F.col("seed"), 1)).alias("support"))
        )
        if step < rounds - 1:
            beliefs = links.join(scored, ["kind", "pattern"]).groupBy("kind", "value")
            instance = written(beliefs.agg(F.greatest(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)), F.max("score")).alias("belief")), "beliefs")
    return scored


def find_private(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: int = 8, prior: float = 2.0) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, code points).

    A pattern is of high confidence when its score is `confidence` and `support` different seeds occur in it.
    """
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = written(docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text"))).mapInArrow(scan, SCAN), "private-scan")
    edges = scanned.select("row_key", F.explode("found").alias("f")).select("row_key", "f.*")
    good = score(edges, rounds, prior).where((F.col("score") >= confidence) & (F.col("support") >= support)).select("kind", "pattern")
    # A discovered span: an unseen token in a high-confidence pattern of the kind that its form fits.
    fit = edges.where("not seed").join(good, ["kind", "pattern"], "left_semi").select("row_key", "place", "kind", "a", "b").distinct()
    # Where a token lies within digit groups that are found too, they stand for it.
    longest = fit.withColumn("whole", F.max(F.struct((F.col("b") - F.col("a")).alias("length"), "b")).over(Window.partitionBy("row_key", "place")))
    inside = (F.col("b") - F.col("a") < F.col("whole.length")) & (F.col("b") <= F.col("whole.b")) & (F.col("a") >= F.col("whole.b") - F.col("whole.length"))
    new = longest.where(~inside).groupBy("row_key").agg(F.collect_set(F.struct("kind", "a", "b")).alias("new"))
    return scanned.join(new, "row_key", "left").select("doc_id", *digests("base", "new", KINDS))


def digests(base: str, new: str, kinds: tuple[str, ...]) -> list:
    """Counts, base_sha256 and spans from arrays of (kind, a, b)."""

    def text(spans):
        keyed = F.transform(spans, lambda s: F.struct(s["a"].alias("a"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("o"), s["b"].alias("b"), s["kind"].alias("kind")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["a"], s["b"])), ",")

    both = F.concat(F.col(base), F.coalesce(F.col(new), F.array().cast("array<struct<kind:string,a:int,b:int>>")))
    def count(kind):
        return F.size(F.filter(F.col(base), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return [*map(count, kinds), F.sha2(text(F.col(base)).cast("binary"), 256).alias("base_sha256"), text(both).alias("spans")]


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(digest(spans).encode()).hexdigest()
