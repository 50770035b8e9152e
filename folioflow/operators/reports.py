"""Listings, histories, dashboards and totals, for all owners at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import business as b


def money(c: Column) -> Column:
    """Exact sums: cents as decimals, so that the order of addition doesn't matter."""
    return F.coalesce(F.sum(c.cast("decimal(18,2)")), F.lit(0)).cast("double")


def contracts(enterprises: DataFrame, documents: DataFrame) -> DataFrame:
    """Contracts with pages used (from their documents) and derived columns; one row a contract."""
    used = documents.groupBy(F.col("enterprise_id").alias("id")).agg(F.sum("total_pages").alias("pages_used"))
    joined = enterprises.join(used, "id", "left").withColumn("pages_used", b.zero(F.col("pages_used")))
    cost = F.col("total_pages") * F.col("unit_price")
    due = b.contract_due(cost, F.col("advance_bill"), True)
    return joined.select(
        *enterprises.columns, "pages_used", cost.alias("total_cost"), due.alias("due_amount"), b.payment_status(due, F.col("advance_bill")).alias("payment_status"),
        b.duration_days(F.col("start_date"), F.col("end_date")).alias("duration_days"), b.at_least_zero(F.col("total_pages") - F.col("pages_used")).alias("pages_remaining"),
    )


def status_counts() -> list[Column]:
    return [F.count_if(F.col("payment_status") == s).alias(f"{s}_count") for s in b.ENTERPRISE_STATUS]


def billing_summary(c: DataFrame) -> DataFrame:
    """One row over contracts that aren't deleted."""
    return c.where("not is_deleted").agg(
        F.count("*").alias("total_enterprises"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"), money(F.col("total_cost")).alias("total_cost"),
        money(F.col("advance_bill")).alias("total_advance"), money(F.col("due_amount")).alias("total_due"), *status_counts(),
    )


def portfolio(admins: DataFrame, c: DataFrame, own_documents: DataFrame) -> DataFrame:
    """Per admin (`id`): contracts, pages (remaining clamped after the sum), advances collected and due, counts by status, own documents; empty admins show 0."""
    sums = c.where("not is_deleted").groupBy(F.col("created_by").alias("id")).agg(
        F.count("*").alias("contracts"), F.sum("total_pages").alias("allocated"), F.sum("pages_used").alias("used"),
        money(F.col("advance_bill")).alias("revenue_collected"), money(F.col("due_amount")).alias("due"), *status_counts(),
    )
    docs = own_documents.where("not is_deleted").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("documents"))
    joined = admins.select("id").join(sums, "id", "left").join(docs, "id", "left").na.fill(0)
    return joined.withColumn("remaining", b.at_least_zero(F.col("allocated") - F.col("used")))


def platform(users: DataFrame, docs: DataFrame, payments: DataFrame, c: DataFrame, devices: DataFrame) -> DataFrame:
    """One row: joins of frames of one row each. Revenue is what was collected: settled payments, and advances on live contracts."""
    roles = [F.count_if(F.col("role") == r).alias(f"{r}s") for r in ("user", "admin", "super_user")]
    people = users.agg(F.count("*").alias("total_users"), *roles, F.count_if(b.zero(F.col("subscription_pages_total")) > b.zero(F.col("subscription_pages_used"))).alias("active_subscriptions"))
    live = docs.where("not is_deleted").agg(F.count("*").alias("documents"))
    revenue = payments.where("status = 'success'").agg(money(F.col("payment_amount")).alias("subscription_revenue"))
    deals = c.where("not is_deleted").agg(F.count("*").alias("enterprises"), money(F.col("advance_bill")).alias("enterprise_revenue_collected"), money(F.col("due_amount")).alias("enterprise_due"))
    trials = devices.agg(F.count("*").alias("free_trial_users"))
    return people.crossJoin(live).crossJoin(revenue).crossJoin(deals).crossJoin(trials)


def user_stats(users: DataFrame, docs: DataFrame) -> DataFrame:
    """Per user: documents, pages, the latest file and its time, balances."""
    own = docs.where("not is_deleted").groupBy("user_id").agg(
        F.count("*").alias("documents"), F.sum("total_pages").alias("pages"), F.max_by("filename", F.struct("created_at", "id")).alias("latest_file"), F.max("created_at").alias("latest_at"),
    )
    joined = users.join(own, users["id"] == own["user_id"], "left")
    return joined.select(
        users["id"], b.zero(F.col("documents")).alias("documents"), b.zero(F.col("pages")).alias("pages"), "latest_file", "latest_at",
        b.free_remaining(F.col("free_ocr_used")).alias("free_remaining"), b.pages_remaining(F.col("subscription_pages_total"), F.col("subscription_pages_used")).alias("pages_remaining"),
    )


def page_of(df: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: int = 200) -> DataFrame:
    """A page of a listing; order must end in a key. A limit beyond the listing's cap is refused."""
    if not 1 <= limit <= cap:
        raise ValueError(f"limit {limit} is not from 1 to {cap}")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_per_owner(df: DataFrame, owner: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """The same page for every owner; Spark keeps a task's best rows before the shuffle."""
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    return ranked.where((F.col("place") > offset) & (F.col("place") <= offset + limit))


def page_numbers(total: Column, page: Column, size: Column) -> list[Column]:
    """total_pages, has_next, has_prev; a page size of 0 has no pages."""
    pages = F.when(size > 0, F.ceil(total / F.nullif(size, F.lit(0)))).otherwise(0).cast("long")
    return [pages.alias("total_pages"), (page < pages).alias("has_next"), (page > 1).alias("has_prev")]


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key."""
    value = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("_r")).select("_r.*")


def fetched(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of a set of keys."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def missing(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    return keys.select(key).distinct().join(df, key, "left_anti")


def visible(docs: DataFrame, caller_id: int, role: str) -> DataFrame:
    """The documents that a caller sees: all for super users, own live ones for others."""
    return docs if role == "super_user" else docs.where((F.col("user_id") == caller_id) & ~F.col("is_deleted"))


def visible_totals(callers: DataFrame, docs: DataFrame) -> DataFrame:
    """caller_id, documents, id_sum of what each caller sees, of callers that see any; what all super users see is summed once."""
    totals = [F.count("*").alias("documents"), F.sum("id").alias("id_sum")]
    own = docs.where("not is_deleted").groupBy(F.col("user_id").alias("caller_id")).agg(*totals)
    others = callers.where("role <> 'super_user'").select(F.col("id").alias("caller_id")).join(own, "caller_id")
    supers = callers.where("role = 'super_user'").select(F.col("id").alias("caller_id"))
    return others.unionByName(supers.crossJoin(docs.agg(*totals))).where("documents > 0")  # one row a super user


def by_enum(df: DataFrame, column: str, value: str | None, allowed: tuple[str, ...]) -> DataFrame:
    """Filter by an enum's value; any other value filters nothing."""
    return df.where(F.col(column) == value) if value in allowed else df


def by_mode(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """Optional filter: empty filters nothing, an unknown value leaves no rows."""
    return df.where(F.col(column) == value) if value else df


def with_creator(c: DataFrame, users: DataFrame, key: str = "created_by", name: str = "created_by_name") -> DataFrame:
    people = users.select(F.col("id").alias(key), b.display_name(F.col("full_name"), F.col("username")).alias(name))
    return c.join(people, key, "left")


def contract_history(c: DataFrame, documents: DataFrame, caller_id: int, role: str) -> DataFrame:
    """Documents of the contracts that a caller owns; deleted contracts only for super users, who own all."""
    own = c if role == "super_user" else c.where((F.col("created_by") == caller_id) & ~F.col("is_deleted"))
    return documents.join(own.select(F.col("id").alias("enterprise_id")), "enterprise_id", "left_semi")


def contract_totals(callers: DataFrame, c: DataFrame, documents: DataFrame) -> DataFrame:
    """caller_id, documents, pages of each caller's contract history; what all super users see is summed once."""
    by_contract = documents.groupBy(F.col("enterprise_id").alias("id")).agg(F.count("*").alias("n"), F.sum("total_pages").alias("p"))
    met = c.select("id", "created_by", "is_deleted").join(by_contract, "id")
    totals = [F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.sum("p").alias("pages")]
    own = met.where("not is_deleted").groupBy(F.col("created_by").alias("caller_id")).agg(*totals)
    others = callers.where("role <> 'super_user'").select(F.col("id").alias("caller_id")).join(own, "caller_id")
    supers = callers.where("role = 'super_user'").select(F.col("id").alias("caller_id"))
    return others.unionByName(supers.crossJoin(met.agg(*totals))).where("documents > 0")  # one row a super user
