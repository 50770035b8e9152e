"""Repair of the structure of conversations at least cost, by a grammar-compressed dynamic programme.

A row is damaged by nothing here but `damaged`, which plants the faults that the query repairs. A row's first fault counts:
blank (no character but ASCII white space), duplicate (its role and text stood earlier in the conversation), truncated
(its last such character is none of .!?). Edits: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows
must go), Insert a row of user or assistant without text 2; a truncated row that stays adds 1. The initials of the roles
that remain must read (s?(ua)+)?; of the cheapest repairs, the one whose edits' initials are least in ASCII is taken.

Method. A row is one of nine symbols, by its role's initial and whether it is truncated or must go. Symbols of
conversations are compressed by Re-Pair: rounds of Spark count the neighbouring pairs of all different sequences, and the
most frequent pairs become rules, until none occurs twice or `rules` are made (what is left over is worked on symbol by
symbol: that decides cost, not results). Each symbol has one min-plus transfer matrix over the four states of the pattern
(nothing yet, s, an open u, a closed ua); a rule's matrix is the product of its two halves, and an entry's edits are a rope:
a pair of its halves' ropes, shared by all that use them. Matrices are made bottom-up once a task and serve all
conversations. Entries of one row of a matrix carry their rank in order of edits, so ties never compare whole ropes: no
list of edits of n rows that ends in a row's own edit is the beginning of another, so order passes on to products.

Rows are dealt by ranges of (conversation, turn), so that one conversation may lie in many tasks, whose pieces are put
together by their symbols. The repaired text's SHA-256 has to be taken in order: rows of a conversation pass through one
task as a stream, in constant memory but for the edits. Rows are kept apart by an MD5 of their text.

Defined cases. A null turn comes first; rows of equal turn go by role, then by the MD5 of the text. A null conv_id is a
conversation of its own. A null role or text, and a null in the damage's key, is one space. A role that doesn't begin with
s, u or a can't stay. Repeated rows are duplicates. Very long texts are hashed once and never compared. An empty table
gives an empty result. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, removed, tidy, written

BLANKS = " \t\n\x0b\x0c\r"
GONE = "D"
#: Rules of the grammar, pairs made into rules in one round of counting, and the first character that names a rule.
RULES, PER_ROUND, FIRST_RULE = 192, 32, 0xE000
NONE = 1 << 40
#: States: nothing yet, after s, an open u, a closed ua.
STATES = 4
KEY = ["_none", "_conv"]
ROW = [*KEY, "_turn", "_role", "_digest"]
OUT = (
    "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults: by crc32 of conv_id:turn modulo 20, 0 drops a row, 1 empties its text, 2 takes its .!?, 3 repeats it, 4 makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))).alias("_copy")).drop("_copy")


def keyed(rows: DataFrame) -> DataFrame:
    """ROW and text: the conversation as two columns without nulls, the turn, and the digest of the text."""
    text = F.coalesce("text", F.lit(" "))
    zero = F.lit(0).cast(rows.schema["conv_id"].dataType)
    return rows.select(
        F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", zero).alias("_conv"), F.col("turn").alias("_turn"),
        F.coalesce("role", F.lit(" ")).alias("_role"), F.md5(text.cast("binary")).alias("_digest"), text.alias("_text"),
    )


def runs(rows: DataFrame) -> DataFrame:
    """One row for equal rows of keyed rows: ROW, n, blank, and first: it is the first of its role and text."""
    blank = F.length(F.trim(F.col("_text"), F.lit(BLANKS))) == 0
    open_end = ~F.substring(F.rtrim(F.col("_text"), F.lit(BLANKS)), -1, 1).isin(".", "!", "?")
    same = rows.groupBy(*ROW).agg(F.count("*").alias("n"), F.first(blank).alias("blank"), F.first(open_end).alias("open"))
    place = F.struct(F.col("_turn").isNotNull(), "_turn")
    firsts = same.groupBy(*KEY, "_role", "_digest").agg(F.min(place).alias("_first"))
    return same.join(firsts, [*KEY, "_role", "_digest"]).withColumn("first", place == F.col("_first")).drop("_first")


def symbol() -> Column:
    """The symbol of a run's first row; all others must go."""
    initial = F.substring("_role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    return F.when(F.col("blank") | ~F.col("first"), GONE).when(F.col("open"), F.upper(known)).otherwise(known)


def pieces(found: DataFrame, parts: int) -> DataFrame:
    """KEY, place, head, tail (initials of the first and last row), illegal and symbols of stretches of conversations, in order of place."""
    dealt = found.select(*ROW, "n", F.substring("_role", 1, 1).alias("initial"), symbol().alias("symbol")).repartitionByRange(parts, *ROW).sortWithinPartitions(*ROW)
    id_type = found.schema["_conv"].dataType.simpleString()

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for batch in batches:
            t = {c: batch.column(c).to_pylist() for c in (*KEY, "n", "initial", "symbol")}
            begins = [i for i in range(batch.num_rows) if i == 0 or t["_conv"][i] != t["_conv"][i - 1] or t["_none"][i] != t["_none"][i - 1]]
            out = []
            for a, b in zip(begins, [*begins[1:], batch.num_rows], strict=True):
                initials, symbols, illegal = t["initial"][a:b], [], 0
                for i in range(a, b):
                    initial, n = t["initial"][i], t["n"][i]
                    symbols.append(t["symbol"][i] + GONE * (n - 1))
                    illegal += (n - 1) + (i > a and t["initial"][i - 1] + initial not in ("su", "ua", "au"))
                out.append((t["_none"][a], t["_conv"][a], place, initials[0], initials[-1], illegal, "".join(symbols)))
                place += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.bool_(), batch.schema.field("_conv").type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=[*KEY, "place", "head", "tail", "illegal", "symbols"])

    return dealt.mapInArrow(tidy(stretch), f"_none boolean, _conv {id_type}, place long, head string, tail string, illegal long, symbols string")


def compressed(symbols: str, rules: list[str]) -> str:
    """The symbols with each rule's pair replaced by its name, in the order in which the rules were made."""
    for i, pair in enumerate(rules):
        if len(symbols) < 2:
            break
        symbols = symbols.replace(pair, chr(FIRST_RULE + i))
    return symbols


def grammar(sequences: DataFrame, most: int = RULES, per_round: int = PER_ROUND) -> list[str]:
    """Re-Pair over `symbols, weight`: the pairs that rules stand for, in order. At most (symbols + rules) ** 2 counted pairs come to the driver."""
    rules: list[str] = []
    while len(rules) < most:

        def count(batches: Iterator[pa.RecordBatch], rules: list[str] = rules) -> Iterator[pa.RecordBatch]:
            met: Counter = Counter()
            for batch in batches:
                for symbols, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    left = compressed(symbols, rules)
                    for pair, times in Counter(map(str.__add__, left, left[1:])).items():
                        met[pair] += times * weight
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array(list(met.values()), pa.int64())], names=["pair", "times"])

        counted = sequences.select("symbols", "weight").mapInArrow(tidy(count), "pair string, times long").groupBy("pair").agg(F.sum("times").alias("times"))
        best = counted.where("times >= 2").orderBy(F.desc("times"), "pair").limit(4 * per_round).collect()
        # Rules of one round must not share symbols at their edges, or one would eat the other's occurrences unevenly: the more frequent one goes first.
        made, edges = [], set()
        for pair, _ in best:
            if len(made) < min(per_round, most - len(rules)) and not edges & set(pair):
                made.append(pair)
                edges |= set(pair)
        if not made:
            break
        rules = [*rules, *made]
    return rules


class Matrix:
    """Least costs between states, with each entry's rope of edits, and its rank among its row's in order of edits."""

    __slots__ = ("cost", "rank", "rope")

    def __init__(self, cost: list[list[int]], rank: list[list[int]], rope: list[list]) -> None:
        self.cost, self.rank, self.rope = cost, rank, rope


def ranked(keys: list) -> list[int]:
    """Ranks of keys, of which None has none (it ranks last)."""
    order = sorted({k for k in keys if k is not None})
    return [len(order) if k is None else order.index(k) for k in keys]


def terminal(symbol: str) -> Matrix:
    """The matrix of one row: inserted rows before it, then its own edit."""
    gone, truncated = symbol == GONE, symbol.isupper()
    best: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]

    def reach(i: int, j: int, cost: int, edits: str) -> None:
        if best[i][j] is None or (cost, edits) < best[i][j]:
            best[i][j] = (cost, edits)

    after_u, after_a = (0, 1, 3), (2,)  # states from which a u or an a may follow
    for i in range(STATES):
        before = {i: ""}
        if i in after_u:
            before |= {2: "I", 3: min("II", before.get(3, "II"))}
        if i == 2:
            before |= {3: "I"}
        for k, edits in before.items():
            paid = 2 * len(edits)
            reach(i, k, paid + 3, edits + "D")
            if gone:
                continue
            kind, more = symbol.lower(), paid + truncated
            if kind == "s" and k == 0:
                reach(i, 1, more, edits + "K")
            for states, j, name in ((after_u, 2, "u"), (after_a, 3, "a")):
                if k in states:
                    reach(i, j, more + (0 if kind == name else 2), edits + ("K" if kind == name else "R"))
    return Matrix([[NONE if e is None else e[0] for e in row] for row in best], [ranked([None if e is None else e[1] for e in row]) for row in best], [[None if e is None else e[1] for e in row] for row in best])


def product(a: Matrix, b: Matrix) -> Matrix:
    """First a, then b: least cost, then the least edits, by ranks alone."""
    cost, rank, rope = [], [], []
    for i in range(STATES):
        row_cost, row_key, row_rope = [], [], []
        for j in range(STATES):
            best = min((a.cost[i][k] + b.cost[k][j], a.rank[i][k], k) for k in range(STATES))
            k = best[2]
            none = best[0] >= NONE
            row_cost.append(NONE if none else best[0])
            row_key.append(None if none else (a.rank[i][k], b.rank[k][j]))
            row_rope.append(None if none else (a.rope[i][k], b.rope[k][j]))
        cost.append(row_cost)
        rank.append(ranked(row_key))
        rope.append(row_rope)
    return Matrix(cost, rank, rope)


def matrices(rules: list[str]) -> dict[str, Matrix]:
    """Of all symbols and rules, bottom-up."""
    found = {s: terminal(s) for s in "suaxSUAX" + GONE}
    for i, pair in enumerate(rules):
        found[chr(FIRST_RULE + i)] = product(found[pair[0]], found[pair[1]])
    return found


def spelled(rope) -> str:
    """A rope's edits, without recursion."""
    out, left = [], [rope]
    while left:
        top = left.pop()
        if isinstance(top, str):
            out.append(top)
        else:
            left += [top[1], top[0]]
    return "".join(out)


def cheapest(symbols: str, found: dict[str, Matrix]) -> tuple[int, str]:
    """Cost and edits of a compressed sequence: a row of states passes through its matrices."""
    state: list[tuple[int, int, object] | None] = [(0, 0, ""), None, None, None]
    for s in symbols:
        m, after, keys = found[s], [], []
        for j in range(STATES):
            ways = [(state[k][0] + m.cost[k][j], state[k][1], k) for k in range(STATES) if state[k] is not None and m.cost[k][j] < NONE]
            if not ways:
                after.append(None)
                keys.append(None)
                continue
            cost, rank, k = min(ways)
            after.append((cost, (state[k][2], m.rope[k][j])))
            keys.append((rank, m.rank[k][j]))
        state = [None if x is None else (x[0], r, x[1]) for x, r in zip(after, ranked(keys), strict=True)]
    ends = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}  # inserted rows at the end; s alone needs a whole ua
    cost, _, i = min((state[i][0] + more, state[i][1], i) for i, (more, _) in ends.items() if state[i] is not None)
    return cost, spelled(state[i][2]) + ends[i][1]


def audits(stretches: DataFrame, rules: list[str]) -> DataFrame:
    """KEY, illegal, cost, audit of each conversation that has rows."""
    whole = stretches.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("place", "head", "tail", "illegal", "symbols"))).alias("p"))
    id_type = stretches.schema["_conv"].dataType.simpleString()
    whole = whole.select(*KEY, F.transform("p", lambda x: x["symbols"]).alias("symbols"), F.transform("p", lambda x: x["head"]).alias("heads"), F.transform("p", lambda x: x["tail"]).alias("tails"), F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["illegal"]).alias("illegal"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = matrices(rules)
        short = lru_cache(50_000)(lambda symbols: cheapest(compressed(symbols, rules), found))
        for batch in batches:
            illegal, cost, audit = [], [], []
            for parts, heads, tails, n in zip(*(batch.column(c).to_pylist() for c in ("symbols", "heads", "tails", "illegal")), strict=True):
                illegal.append(n + sum(tails[i] + heads[i + 1] not in ("su", "ua", "au") for i in range(len(parts) - 1)))
                symbols = "".join(parts)
                paid, edits = short(symbols) if len(symbols) <= 64 else cheapest(compressed(symbols, rules), found)
                cost.append(paid)
                audit.append(edits)
            yield pa.RecordBatch.from_arrays([batch.column("_none"), batch.column("_conv"), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), pa.array(audit, pa.string())], names=[*KEY, "illegal", "cost", "audit"])

    return whole.mapInArrow(tidy(solve), f"_none boolean, _conv {id_type}, illegal long, cost long, audit string")


def counts(found: DataFrame) -> DataFrame:
    """KEY, gaps, blank, duplicate, truncated of runs."""
    n, stays = F.col("n"), F.col("first").cast("long")
    each = found.groupBy(*KEY, "_turn").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).otherwise(n - stays)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & F.col("open"), stays).otherwise(0)).alias("truncated"),
    )
    gaps = F.max("_turn") - F.min("_turn") + 1 - F.count("_turn")
    return each.groupBy(*KEY).agg(F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


class Repair:
    """Applies a conversation's edits to its rows in order, and hashes what stays."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.turns, self.any, self.hash = audit, 0, 0, False, hashlib.sha256()

    def put(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.any = True
        self.hash.update(role.encode("utf-8", "surrogatepass") + b":" + text.encode("utf-8", "surrogatepass"))

    def expected(self) -> str:
        self.turns += 1
        return "user" if self.turns % 2 else "assistant"

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.put(self.expected(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            if not role.startswith("s"):
                self.expected()
            self.put(role, text)
        elif edit == "R":
            self.put(self.expected(), text)

    def end(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def repaired(rows: DataFrame, heads: DataFrame, id_type: str) -> DataFrame:
    """OUT of keyed rows and of heads: KEY, gaps, blank, duplicate, truncated, illegal, cost, audit. Rows pass as a stream."""
    measures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    stream = heads.select(*KEY, F.lit(0).alias("_kind"), *measures).unionByName(rows.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    ordered = stream.repartition(*KEY).sortWithinPartitions(*KEY, "_kind", *ROW[2:])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, work = None, None

        def finished(kind: pa.DataType, done: list) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [[]] * 9
            kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *measures, "repaired_sha256"])

        kind = None
        for batch in batches:
            kind, done = batch.schema.field("_conv").type, []
            t = {c: batch.column(c).to_pylist() for c in ("_none", "_conv", "_kind", "_role", "_text", *measures)}
            for i in range(batch.num_rows):
                if t["_kind"][i] == 0:
                    if head:
                        done.append((*head, work.end()))
                    head = (None if t["_none"][i] else t["_conv"][i], *(t[m][i] for m in measures))
                    work = Repair(head[-1])
                else:
                    work.row(t["_role"][i], t["_text"][i])
            yield finished(kind, done)
        if head:
            yield finished(kind, [(*head, work.end())])

    return ordered.mapInArrow(tidy(fold), OUT.format(id=id_type))


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """OUT: one row for each conversation of rows, and for each other conv_id of `conversations`."""
    spark: SparkSession = rows.sparkSession
    arrow_batches(spark, 5_000)
    id_type = rows.schema["conv_id"].dataType.simpleString()
    own = keyed(rows)
    found = written(runs(own), "runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    stretches = written(pieces(found, parts), "stretches")
    sequences = written(stretches.groupBy("symbols").agg(F.count("*").alias("weight")), "sequences")
    rules = grammar(sequences)
    measured = audits(stretches, rules).unionByName(counts(found), allowMissingColumns=True)
    names = (conversations if conversations is not None else rows).select("conv_id")
    zero = F.lit(0).cast(rows.schema["conv_id"].dataType)
    all_of_them = names.select(F.col("conv_id").isNull().alias("_none"), F.coalesce("conv_id", zero).alias("_conv"))
    numbers = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    heads = measured.unionByName(all_of_them, allowMissingColumns=True).groupBy(*KEY).agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    heads = written(heads, "heads")
    removed(spark, found, stretches, sequences)
    return repaired(own, heads, id_type)


def expanded(rules: list[str]) -> np.ndarray:
    """Rows that each rule stands for: how far the grammar shares work."""
    size = {s: 1 for s in "suaxSUAX" + GONE}
    for i, pair in enumerate(rules):
        size[chr(FIRST_RULE + i)] = size[pair[0]] + size[pair[1]]
    return np.array([size[chr(FIRST_RULE + i)] for i in range(len(rules))], np.int64)
