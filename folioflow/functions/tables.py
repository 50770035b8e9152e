"""Repair of markdown tables as columns: arrays of lines and higher-order functions, one table a row.

A null table stays null. Steps follow each other: continuation lines are glued to their row, spaces collapse, blank
ends go, rows above the separator are sorted out (or a separator is added), and blank lines are squeezed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separator row, and cells that say nothing.
SEPARATOR = r"^\|\s*[-:]+[\s|:-]*\|$"
EMPTY_CELLS = ("", "-", "–", "—", ".")
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def bind(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def glued(lines: Column) -> Column:
    """Lines that don't begin with | go to the row before, after a space; blank lines end a row."""

    def step(acc: Column, line: Column) -> Column:
        last = acc["last"]
        flushed = F.when(last != "", F.concat(acc["rows"], F.array(last))).otherwise(acc["rows"])
        rows = F.when(line == "", F.concat(flushed, F.array(F.lit("")))).when(line.startswith("|"), flushed).otherwise(acc["rows"])
        now = F.when(line == "", F.lit("")).when(line.startswith("|") | (last == ""), line).otherwise(F.concat(F.regexp_replace(last, r"(?U)[\s\x1c-\x1f]+$", ""), F.lit(" "), line))
        return F.struct(rows.alias("rows"), now.alias("last"))

    start = F.struct(F.array().cast("array<string>").alias("rows"), F.lit("").alias("last"))
    return F.aggregate(F.transform(lines, strip), start, step, lambda acc: F.when(acc["last"] != "", F.concat(acc["rows"], F.array(acc["last"]))).otherwise(acc["rows"]))


def squeezed_cells(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.when(r.startswith("|"), F.regexp_replace(r, " {2,}", " ")).otherwise(r))


def without_blank_ends(rows: Column) -> Column:
    full = F.filter(F.transform(rows, lambda r, i: F.when(r != "", i)), lambda i: i.isNotNull())
    return F.when(F.size(full) == 0, F.array().cast("array<string>")).otherwise(F.slice(rows, F.array_min(full) + 1, F.array_max(full) - F.array_min(full) + 1))


def cells(row: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(strip(row), r"^\|+|\|+$", ""), r"\|", -1), strip)


def is_empty_row(row: Column) -> Column:
    return F.forall(cells(row), lambda c: c.isin(*EMPTY_CELLS))


def is_header_like(row: Column) -> Column:
    """Half of the cells at least are filled."""
    return bind(cells(row), lambda c: 2 * F.size(F.filter(c, lambda x: x != "")) >= F.size(c))


def columns_of(row: Column) -> Column:
    return F.length(row) - F.length(F.replace(row, F.lit("|"), F.lit(""))) - 1


def row_of(cell: str, n: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit(cell), n.cast("int")), " | "), F.lit(" |"))


def separator_at(rows: Column) -> Column:
    """Place of the first separator row, from 1; 0 if there is none."""
    return F.coalesce(F.array_position(F.transform(rows, lambda r: r.rlike(SEPARATOR)), F.lit(True)), F.lit(0)).cast("int")


def with_header(rows: Column, at: Column) -> Column:
    """Rows above the separator sorted out: one header row, blank if need be; others that say something go below."""

    def parts(p: Column) -> Column:
        above, line, rest, last = p["above"], p["line"], p["rest"], p["last"]
        widest = F.array_max(F.concat(F.array(columns_of(line), F.lit(1)), F.transform(F.filter(rest, lambda r: r.startswith("|")), columns_of)))
        kept = lambda xs: F.filter(xs, lambda r: ~is_empty_row(r))
        none = F.concat(F.array(row_of("", widest), line), rest)
        promoted = F.concat(F.array(last, line), kept(F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0)))), rest)
        demoted = F.concat(F.array(row_of("", F.greatest(columns_of(line), F.lit(1))), line), kept(above), rest)
        return F.when(F.size(above) == 0, none).when(is_header_like(last), promoted).otherwise(demoted)

    above = F.slice(rows, F.lit(1), at - 1)
    rest = F.slice(rows, at + 1, F.greatest(F.size(rows) - at, F.lit(0)))
    return bind(F.struct(above.alias("above"), F.element_at(rows, at).alias("line"), rest.alias("rest"), F.try_element_at(above, F.lit(-1)).alias("last")), parts)


def with_separator(rows: Column) -> Column:
    """A separator below the first of several pipe rows."""
    flags = F.transform(rows, lambda r: r.startswith("|"))
    first = F.array_position(flags, F.lit(True)).cast("int")
    line = row_of("---", F.greatest(columns_of(F.element_at(rows, F.greatest(first, F.lit(1)))), F.lit(1)))
    added = F.concat(F.slice(rows, F.lit(1), first), F.array(line), F.slice(rows, first + 1, F.greatest(F.size(rows) - first, F.lit(0))))
    return F.when(F.size(F.filter(flags, lambda x: x)) > 1, added).otherwise(rows)


def single_blanks(rows: Column) -> Column:
    return F.filter(F.zip_with(rows, F.concat(strings("x"), F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))), lambda r, before: F.when(~((strip(r) == "") & (strip(before) == "")), r)), lambda r: r.isNotNull())


def repaired(content: Column) -> Column:
    """The repaired table; content of blank lines only is left as it is."""
    lines = F.split(F.regexp_replace(content, rf"(?:{BREAKS})$", ""), BREAKS, -1)

    def fix(rows: Column) -> Column:
        headed = bind(separator_at(rows), lambda at: F.when(at > 0, with_header(rows, F.greatest(at, F.lit(1)))).otherwise(with_separator(rows)))
        return F.when(F.size(rows) == 0, F.lit(None).cast("string")).otherwise(F.array_join(bind(headed, single_blanks), "\n"))

    return F.coalesce(bind(bind(squeezed_cells(glued(lines)), without_blank_ends), fix), content)
