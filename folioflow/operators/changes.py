"""Changes to tables as frames: partial updates, deletes, payments posted, schema conforming, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import business as b


def updated(df: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with the fields that a change names in `set_fields`, be it to null; others stay."""
    renamed = changes.select(key, F.col("set_fields").alias("_set"), *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = df.join(renamed, key, "left")
    value = lambda f: F.when(F.array_contains("_set", f), F.col(f"_new_{f}")).otherwise(F.col(f)).alias(f)
    return joined.select(*[value(c) if c in fields else F.col(c) for c in df.columns])


def rederived(contracts: DataFrame) -> DataFrame:
    """Cost, duration and due after an update; the status stays."""
    cost = F.col("total_pages") * F.col("unit_price")
    return contracts.withColumns({"total_cost": cost, "duration_days": b.duration_days(F.col("start_date"), F.col("end_date")), "due_amount": b.contract_due(cost, F.col("advance_bill"), True)})


def owned(df: DataFrame, keys: DataFrame, key: str, owner: str) -> DataFrame:
    """keys (key, caller_id, privileged) with found: there is such a row and it is the caller's, or the caller is privileged."""
    rows = df.select(key, F.col(owner).alias("_owner"), F.lit(True).alias("_there")).dropDuplicates([key])
    mine = F.col("privileged") | (F.col("caller_id") == F.col("_owner"))
    return keys.join(rows, key, "left").select(*keys.columns, (F.coalesce("_there", F.lit(False)) & F.coalesce(mine, F.lit(False))).alias("found"))


def delete_replies(df: DataFrame, keys: DataFrame, key: str, owner: str) -> DataFrame:
    """key, caller_id, reply of delete requests: deleted, or not_found for keys that aren't there or are others'."""
    return owned(df, keys, key, owner).select(key, "caller_id", F.when(F.col("found"), "deleted").otherwise("not_found").alias("reply"))


def soft_deleted(df: DataFrame, keys: DataFrame, key: str, owner: str) -> DataFrame:
    """df with is_deleted set on the callers' own keys; others' keys change nothing."""
    mine = owned(df, keys, key, owner).where("found").select(key, F.lit(True).alias("_gone")).distinct()
    return df.join(mine, key, "left").select(*[(F.col("is_deleted") | F.coalesce("_gone", F.lit(False))).alias(c) if c == "is_deleted" else F.col(c) for c in df.columns])


def hard_deleted(df: DataFrame, keys: DataFrame, key: str, owner: str) -> DataFrame:
    """df without the callers' own keys."""
    return df.join(owned(df, keys, key, owner).where("found").select(key).distinct(), key, "left_anti")


def created(contracts: DataFrame) -> DataFrame:
    """New contracts with cost, duration, due (not clamped) and no pages used; the status is the one given, due by default."""
    cost, advance = F.col("total_pages") * F.coalesce("unit_price", F.lit(float(b.PAGE_COST))), F.coalesce("advance_bill", F.lit(0.0))
    return contracts.withColumns({
        "total_cost": cost, "due_amount": b.contract_due(cost, advance, False), "duration_days": b.duration_days(F.col("start_date"), F.col("end_date")),
        "payment_status": F.coalesce("payment_status", F.lit("due")), "pages_used": F.lit(0),
    })


def payments_posted(contracts: DataFrame, payments: DataFrame) -> DataFrame:
    """contracts (id, total_cost, advance_bill, due_amount) after payments (enterprise_id, amount): sums, then status."""
    sums = payments.groupBy(F.col("enterprise_id").alias("id")).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("_paid"))
    joined = contracts.join(sums, "id", "left")
    advance = F.when(F.col("_paid").isNotNull(), F.round(F.coalesce("advance_bill", F.lit(0.0)) + F.col("_paid"), 2)).otherwise(F.col("advance_bill"))
    due = F.when(F.col("_paid").isNotNull(), F.round(F.greatest(F.lit(0.0), F.coalesce("total_cost", F.lit(0.0)) - advance), 2)).otherwise(F.col("due_amount"))
    return joined.select("id", advance.alias("advance_bill"), due.alias("due_amount"), b.payment_status(due, advance).alias("payment_status"))


def appended(contracts: DataFrame, new_documents: DataFrame) -> DataFrame:
    """contracts with the pages of new documents added to pages_used."""
    more = new_documents.groupBy(F.col("enterprise_id").alias("id")).agg(F.sum("total_pages").alias("_more"))
    return contracts.join(more, "id", "left").withColumn("pages_used", b.zero(F.col("pages_used")) + b.zero(F.col("_more"))).drop("_more")


def conformed(df: DataFrame, schema: StructType, defaults: dict[str, Column]) -> DataFrame:
    """df in the target schema: columns that are missing or null take their default, others are cast."""
    have = set(df.columns)
    columns = []
    for f in schema.fields:
        value = F.col(f.name) if f.name in have else F.lit(None)
        value = F.coalesce(value, defaults[f.name]) if f.name in defaults else value
        columns.append(value.cast(f.dataType).alias(f.name))
    return df.select(*columns)


def append_documents(df: DataFrame, path: str, batch: int, day: str = "created_at") -> None:
    """Appends processed documents below path, by batch and day. A batch that is appended again replaces itself."""
    written_once(df.withColumn("created_date", F.to_date(day)), path, batch, "created_date")


def written_once(df: DataFrame, path: str, batch: int, *partitions: str) -> None:
    """Writes a batch to path/batch=n in place of what an earlier attempt left there, so a retried batch stands once."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path.rstrip('/')}/batch={batch}")
