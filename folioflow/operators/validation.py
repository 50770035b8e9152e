"""Validation of form rows: a table of rules, compiled to one column of violations."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Field(NamedTuple):
    """What a form asks of a field. Null is a missing value: refused where it is required, else fine."""

    name: str
    required: bool = False
    shortest: int | None = None
    longest: int | None = None
    least: int | None = None
    above: int | None = None
    one_of: tuple[str, ...] = ()
    email: bool = False


class Whole(NamedTuple):
    """A rule on a whole row, asked only if all fields are fine: SQL of when it is broken, and of its message."""

    broken: str
    message: str


#: A number as the service writes it: 7.0, 7.25.
NUMBER = "CASE WHEN {0} = floor({0}) AND abs({0}) < 1e15 THEN concat(CAST(CAST({0} AS BIGINT) AS STRING), '.0') ELSE CAST({0} AS STRING) END"
ADDRESS = r"^[A-Za-z0-9._%+'-]+@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"
ADVANCE, COST = "coalesce(advance_bill, 0.0D)", "(total_pages * coalesce(unit_price, 10.0D))"
# The forms' limits and the words of their messages.
FORMS: dict[str, tuple[list[Field], list[Whole]]] = {
    "contract": (
        [
            Field("name", True, 1, 255), Field("phone", longest=50), Field("email", email=True), Field("total_pages", True, least=1), Field("unit_price", least=0),
            Field("advance_bill", least=0), Field("no_of_documents", least=0), Field("payment_status", one_of=("paid", "partial_paid", "due")),
        ],
        [
            Whole("end_date < start_date", "'Value error, end_date must be on or after start_date'"),
            Whole(f"{ADVANCE} > {COST}", f"concat('Value error, advance_bill (', {NUMBER.format(ADVANCE)}, ') cannot exceed total cost (', {NUMBER.format(COST)}, ')')"),
        ],
    ),
    "payment": ([Field("pages", True, above=0), Field("cust_name", True, 2, 100), Field("cust_phone", True, 7, 20), Field("cust_address", longest=255)], []),
    "account": ([Field("username", True, 3, 50), Field("email", True, email=True), Field("full_name", longest=255), Field("role", one_of=("super_user", "admin", "user"))], []),
    "plan": ([Field("pages", True, above=0)], []),
}


def rules_of(field: Field) -> list[tuple[Column, str, str]]:
    """(broken, message, type) of a field, in order; of the rules on a field the first broken one tells."""
    c, found = F.col(field.name), []
    plural = lambda n: f"{n} character{'' if n == 1 else 's'}"
    if field.required:
        found.append((c.isNull(), "Field required", "missing"))
    if field.shortest is not None:
        found.append((F.length(c) < field.shortest, f"String should have at least {plural(field.shortest)}", "string_too_short"))
    if field.longest is not None:
        found.append((F.length(c) > field.longest, f"String should have at most {plural(field.longest)}", "string_too_long"))
    if field.least is not None:
        found.append((c < field.least, f"Input should be greater than or equal to {field.least}", "greater_than_equal"))
    if field.above is not None:
        found.append((c <= field.above, f"Input should be greater than {field.above}", "greater_than"))
    if field.one_of:
        names = [f"'{x}'" for x in field.one_of]
        found.append((~c.isin(*field.one_of), f"Input should be {', '.join(names[:-1])} or {names[-1]}", "enum"))
    if field.email:
        found.append((~c.rlike(ADDRESS), "value is not a valid email address", "value_error"))
    return found


def violation(field: str, message: Column, kind: str) -> Column:
    return F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit(kind).alias("type"))


def violations(form: str) -> Column:
    """Array of (field, message, type) of a form's broken rules: at most one a field; one of the whole row if the fields are fine."""
    fields, wholes = FORMS[form]
    each = []
    for f in fields:
        told = F.lit(None)
        for broken, message, kind in reversed(rules_of(f)):
            told = F.when(F.coalesce(broken, F.lit(False)), violation(f"body -> {f.name}", F.lit(message), kind)).otherwise(told)
        each.append(told)
    found = F.array_compact(F.array(*each))
    whole = F.lit(None).cast("array<struct<field:string,message:string,type:string>>")
    for w in reversed(wholes):
        whole = F.when(F.coalesce(F.expr(w.broken), F.lit(False)), F.array(violation("body", F.expr(w.message), "value_error"))).otherwise(whole)
    return F.when(F.size(found) > 0, found).otherwise(F.coalesce(whole, F.array().cast("array<struct<field:string,message:string,type:string>>")))


def checked(rows: DataFrame, form: str, counts: Observation | None = None) -> DataFrame:
    """rows with violations; counts observes how many rows there are, are refused, and by which field, in the same pass."""
    found = rows.withColumn("violations", violations(form))
    if counts is None:
        return found
    told = F.transform("violations", lambda v: v["field"])
    by_field = [F.count_if(F.array_contains(told, f"body -> {f.name}")).alias(f.name) for f in FORMS[form][0]]
    whole = F.count_if(F.array_contains(told, "body")).alias("whole_row")
    return found.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("violations") > 0).alias("refused"), *by_field, whole)


def split(rows: DataFrame, form: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows as they came, and refused ones with their violations."""
    found = checked(rows, form)
    return found.where(F.size("violations") == 0).drop("violations"), found.where(F.size("violations") > 0)


def write_split(rows: DataFrame, form: str, path: str) -> dict[str, int]:
    """Writes path/valid=true and path/valid=false in one pass over rows; returns the observed counts."""
    counts = Observation()
    checked(rows, form, counts).withColumn("valid", F.size("violations") == 0).write.mode("overwrite").partitionBy("valid").parquet(path)
    return counts.get
