"""Secret scans through a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams: an OR of ANDs, one AND for each way of spelling its mandatory
literal, found from the regex's own syntax tree. The index holds the postings of the trigrams that the queries name
(trigram, document), one row a posting, so a trigram that a third of all documents hold is many rows and never a
list in one task. Postings are intersected by counting, per document and AND, the trigrams that are there, and only
candidates are verified with the regex. Rules without mandatory trigrams scan every text.

Base spans are those of the three rules `assign`, `access` and `hex`; `more_rules` add spans of further kinds.

Defined cases: null text counts as empty and has no spans. A row is known by doc_id and a 64-bit hash of its text, so
rows that repeat both have the same spans. An empty table gives an empty result. Texts are searched whole.
Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, broadcast_if, tidy, written

try:
    from re import _parser as tree
except ImportError:  # pragma: no cover
    import sre_parse as tree


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Group whose length must reach `least`; 0 is the whole match.
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The three base rules, in the order in which spans of one start are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Public formats of further secrets.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", 0, 0),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
)
#: Rows of the candidate table up to which it is broadcast (about 40 bytes each).
BROADCAST_CANDIDATES = 500_000
#: Spellings of one literal run beyond which it is cut, which only loosens the query.
SPELLINGS = 64


def spellings(node) -> list[str] | None:
    """All strings that a parsed node can match, if they are few; else None."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return [chr(arg)]
    if name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
        found = [c for o, a in arg for c in ([chr(a)] if str(o) == "LITERAL" else map(chr, range(a[0], min(a[1], a[0] + SPELLINGS) + 1)))]
        return found if len(found) <= 4 else None
    if name == "SUBPATTERN":
        return joined(arg[3])
    if name == "BRANCH":
        parts = [joined(x) for x in arg[1]]
        return None if any(p is None for p in parts) else [x for p in parts for x in p]
    if name == "MAX_REPEAT" and arg[1] <= 1:
        inner = joined(arg[2])
        return None if inner is None else ([""] if arg[0] == 0 else []) + inner
    if name == "MAX_REPEAT" and arg[0] == arg[1] <= 8:
        inner = joined(arg[2])
        return [x * arg[0] for x in inner] if inner and len(inner) == 1 else None
    return None


def joined(nodes) -> list[str] | None:
    found = [""]
    for node in nodes:
        more = spellings(node)
        if more is None or len(found) * len(more) > SPELLINGS:
            return None
        found = [a + b for a in found for b in more]
    return found


def trigram_query(regex: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match needs; empty if the regex has no mandatory trigram."""
    runs, best = [[""]], None
    for node in tree.parse(regex):
        more = spellings(node)
        if more is None or len(runs[-1]) * len(more) > SPELLINGS:
            runs.append([""] if more is None else more)
        else:
            runs[-1] = [a + b for a in runs[-1] for b in more]
    for run in runs:
        ands = [frozenset(x.lower()[i : i + 3] for i in range(len(x) - 2)) for x in run]
        if all(ands) and (best is None or min(map(len, ands)) > min(map(len, best))):
            best = ands
    # An AND that contains another adds nothing to the OR.
    return sorted({a for a in best if not any(b < a for b in best)}, key=sorted) if best else []


def row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)))


def postings(docs: DataFrame, grams: Iterable[str]) -> DataFrame:
    """The inverted index over the named trigrams: gram, row_key."""
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    low = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), text.alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in sorted(grams)]))
    return low.select("row_key", F.explode(present).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """row_key, kinds: documents that satisfy a rule's query, from the intersected postings."""
    ands = [(kind, n, gram, len(grams)) for kind, query in queries.items() for n, grams in enumerate(query) for gram in sorted(grams)]
    wanted = index.sparkSession.createDataFrame(ands, "kind string, n int, gram string, needed int")
    return (
        index.join(F.broadcast(wanted), "gram")  # as many rows as the rules have trigrams
        .groupBy("row_key", "kind", "n", "needed").agg(F.count_distinct("gram").alias("there"))
        .where("there = needed").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))
    )


def verified(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough."""
    found = re.finditer(rule.regex, text, re.IGNORECASE | re.ASCII if rule.any_case else re.ASCII)
    return [m.span() for m in found if len(m[rule.group]) >= rule.least]


def digest(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def finder(rules: tuple[Rule, ...], base: int):
    order = {r.kind: i for i, r in enumerate(rules)}
    always = {r.kind for r in rules if not trigram_query(r.regex)}

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(base + 2)]
            for text, kinds in zip(batch.column("text").to_pylist(), batch.column("kinds").to_pylist(), strict=True):
                spans = [(r.kind, a, b) for r in rules if text and (r.kind in always or r.kind in (kinds or ())) for a, b in verified(r, text)]
                spans.sort(key=lambda s: (s[1], order[s[0]]))
                first = [s for s in spans if order[s[0]] < base]
                for i in range(base):
                    out[i].append(sum(s[0] == rules[i].kind for s in first))
                out[base].append(hashlib.sha256(digest(first).encode()).hexdigest())
                out[base + 1].append(digest(spans))
            kinds_of = [pa.int64()] * base + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out, kinds_of)], names=["doc_id", *[f"n_{r.kind}" for r in rules[:base]], "base_sha256", "spans"])

    return find


def find_secrets(docs: DataFrame, more_rules: tuple[Rule, ...] = MORE_RULES) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, code points)."""
    arrow_batches(docs.sparkSession)
    rules = (*BASE_RULES, *more_rules)
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(candidates(postings(docs, {g for q in queries.values() for a in q for g in a}), queries), "secret-candidates")
    # Rules without trigrams scan fully: in the JVM, for a run that is long enough; Python only finds its place.
    full = [F.col("text").rlike(f"(?:{r.regex.removesuffix('+')}){{{r.least}}}" if r.regex.endswith("]+") else r.regex) for r in rules if r.kind not in queries]
    keyed = docs.withColumn("row_key", row_key(F.col("doc_id"), F.col("text")))
    marked = keyed.join(broadcast_if(found, found.count(), BROADCAST_CANDIDATES), "row_key", "left")
    needed = F.col("kinds").isNotNull()
    for scan in full:
        needed = needed | F.coalesce(scan, F.lit(False))
    schema = "doc_id long, " + ", ".join(f"n_{r.kind} long" for r in BASE_RULES) + ", base_sha256 string, spans string"
    return marked.select("doc_id", F.when(needed, F.col("text")).alias("text"), "kinds").mapInArrow(finder(rules, len(BASE_RULES)), schema)
