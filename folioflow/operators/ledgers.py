"""Ordered ledgers: who may do what, in order of time, for all keys at once.

A rejected request uses nothing, so a running sum is exact only for keys that never overflow. Windows decide those;
keys that overflow go through an ordered fold in Arrow-sized groups by key. A key's rows are one user's or contract's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import business as b

EVENTS = "key long, at timestamp_ntz, kind int, event_id long, pages long, free_left long, balance long"
DECIDED = "key long, event_id long, decision string"


def ordered(key: str = "key"):
    """Simultaneous events: credits before debits, then by id."""
    return Window.partitionBy(key).orderBy("at", "kind", "event_id")


class Allowance:
    """What a key has left: free slots, for one page each, then pages."""

    def __init__(self, free: int, balance: int) -> None:
        self.free, self.balance = int(free), int(balance)

    def take(self, kind: int, pages: int) -> str | None:
        """The decision on a request; None for a credit (kind 0), which is added."""
        if kind == 0:
            self.balance += pages
            return None
        if self.free > 0:
            self.free -= pages <= 1
            return "400" if pages > 1 else "free"
        if pages <= self.balance:
            self.balance -= pages
            return "paid"
        return "402"


def folded(events: DataFrame) -> DataFrame:
    """key, event_id, decision of events (kind 0: credit, 1: request), by an ordered fold over each key."""

    def fold(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key and order; state is carried over batches."""
        key, left = None, None
        for batch in rows:
            out = []
            for r in batch.itertuples(index=False):
                if left is None or r.key != key:
                    key, left = r.key, Allowance(r.free_left, r.balance)
                if decision := left.take(r.kind, r.pages):
                    out.append((key, r.event_id, decision))
            yield pd.DataFrame(out, columns=["key", "event_id", "decision"])

    return events.repartition("key").sortWithinPartitions("key", "at", "kind", "event_id").mapInPandas(fold, DECIDED)


def quota(events: DataFrame) -> DataFrame:
    """key, event_id, decision (free, 400, paid, 402) of EVENTS rows: free slots first, for one page only, then pages."""
    w = ordered()
    single = (F.col("kind") == 1) & (F.col("pages") == 1)
    # The free phase ends after the one-page request that takes the last slot.
    marked = events.withColumn("_slots", F.sum(single.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    free = (F.col("kind") == 1) & (F.coalesce("_slots", F.lit(0)) < F.col("free_left"))
    staged = marked.withColumn("_free", free)
    change = F.when(F.col("kind") == 0, F.col("pages")).when(F.col("_free"), 0).otherwise(-F.col("pages"))
    running = staged.withColumn("_sum", F.col("balance") + F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lows = running.withColumn("_low", F.min("_sum").over(Window.partitionBy("key")))
    fast = lows.where((F.col("_low") >= 0) & (F.col("kind") == 1))
    decision = F.when(F.col("_free") & (F.col("pages") > 1), "400").when(F.col("_free"), "free").otherwise("paid")
    slow = lows.where("_low < 0").select(*events.columns)
    return fast.select("key", "event_id", decision.alias("decision")).unionByName(folded(slow))


def user_events(requests: DataFrame, users: DataFrame, credits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """EVENTS of regular users' admitted requests and purchases; and decisions of privileged users' requests."""
    joined = requests.join(users.select(F.col("id").alias("user_id"), "role", "free_ocr_used", "subscription_pages_total", "subscription_pages_used"), "user_id")
    free = b.privileged(F.col("role"))
    start = [b.free_remaining(F.col("free_ocr_used")).cast("long").alias("free_left"), (b.zero(F.col("subscription_pages_total")) - b.zero(F.col("subscription_pages_used"))).cast("long").alias("balance")]
    asked = joined.where(~free).select(F.col("user_id").cast("long").alias("key"), F.col("requested_at").alias("at"), F.lit(1).alias("kind"), F.col("request_id").alias("event_id"), F.col("pages_needed").cast("long").alias("pages"), *start)
    people = users.where(~free).select(F.col("id").cast("long").alias("key"), *start)
    bought = credits.join(people, credits["user_id"] == people["key"]).select("key", F.col("paid_at").alias("at"), F.lit(0).alias("kind"), F.col("credit_id").alias("event_id"), F.col("pages").cast("long").alias("pages"), "free_left", "balance")
    return asked.unionByName(bought), joined.where(free).select(F.col("user_id").cast("long").alias("key"), F.col("request_id").alias("event_id"), F.lit("unlimited").alias("decision"))


def user_quota(requests: DataFrame, users: DataFrame, credits: DataFrame) -> DataFrame:
    """The user ledger over requests that passed admission."""
    events, bypass = user_events(requests, users, credits)
    return quota(events).unionByName(bypass)


def contract_quota(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """The contract ledger: requests (enterprise_id, requested_at, request_id, pages) against contracts (id, total, used)."""
    start = contracts.select(F.col("id").alias("key"), F.lit(0).cast("long").alias("free_left"), b.at_least_zero(F.col("total") - F.col("used")).cast("long").alias("balance"))
    events = requests.join(start, requests["enterprise_id"] == start["key"]).select("key", F.col("requested_at").alias("at"), F.lit(1).alias("kind"), F.col("request_id").alias("event_id"), F.col("pages").cast("long").alias("pages"), "free_left", "balance")
    return quota(events)


def trial(requests: DataFrame, devices: DataFrame, most: int = b.TRIAL_LIMIT) -> DataFrame:
    """request_id, decision of (device_id, requested_at, request_id, pages): blocked, 400 several pages, 403 limit, ok.

    Each countable request before the limit is granted, so a running count decides; no state is needed.
    """
    known = devices.select("device_id", "usage_count", "max_usage", "is_blocked")
    joined = requests.join(known, "device_id", "left")
    used, limit = b.zero(F.col("usage_count")), F.coalesce("max_usage", F.lit(most))
    countable = F.coalesce(~F.col("is_blocked"), F.lit(True)) & (F.col("pages") <= 1)
    w = Window.partitionBy("device_id").orderBy("requested_at", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    place = F.sum(countable.cast("int")).over(w)
    decision = F.when(F.col("pages") > 1, "400").when(F.coalesce("is_blocked", F.lit(False)), "blocked").when(place + used <= limit, "ok").otherwise("403")
    return joined.select("request_id", "device_id", decision.alias("decision"))


def settled(callbacks: DataFrame, payments: DataFrame, users: DataFrame) -> DataFrame:
    """Each callback's outcome, in order of arrival by invoice: the first valid success settles, later ones are duplicates."""
    bills = payments.select("invoice_number", F.col("id").alias("payment_id"), F.col("user_id").alias("payer"), "pages_purchased", "payment_amount", F.col("status").alias("before"))
    people = users.select(F.col("id").alias("payer"), F.lit(True).alias("has_user"))
    joined = callbacks.join(bills, "invoice_number", "left").join(people, "payer", "left")
    amount = F.expr("try_cast(reported_amount AS DOUBLE)")
    word = F.lower(b.stripped(F.coalesce("reported_status", F.lit(""))))
    first_look = (
        F.when(F.col("payment_id").isNull(), "not found").when(F.coalesce(F.abs(amount - F.col("payment_amount")) > 0.01, F.lit(False)), "amount mismatch")
        .when(~word.isin(*b.PAID_WORDS), F.when(word == "failed", "failed").otherwise("cancelled")).when(F.col("has_user").isNull(), "no user").otherwise("success")
    )
    seen = joined.withColumn("_look", first_look)
    before = Window.partitionBy("invoice_number").orderBy("received_at", "callback_id").rowsBetween(Window.unboundedPreceding, -1)
    paid = F.coalesce(F.max((F.col("_look") == "success").cast("int")).over(before), F.lit(0)) == 1
    outcome = F.when(F.col("payment_id").isNull(), "not found").when((F.col("before") == "success") | paid, "duplicate").otherwise(F.col("_look"))
    return seen.select("callback_id", "invoice_number", "received_at", "payer", "pages_purchased", outcome.alias("outcome"))


def final_status(outcomes: DataFrame, payments: DataFrame) -> DataFrame:
    """payments with their status after the callbacks, and paid_at."""
    told = outcomes.where("outcome not in ('not found', 'duplicate')")
    status = F.when(F.col("outcome").isin("failed", "amount mismatch", "no user"), "failed").when(F.col("outcome") == "cancelled", "cancelled").otherwise("success")
    last = told.groupBy("invoice_number").agg(F.max_by(status, F.struct("received_at", "callback_id")).alias("_last"), F.min(F.when(F.col("outcome") == "success", F.col("received_at"))).alias("paid_at"))
    joined = payments.join(last, "invoice_number", "left")
    return joined.select("id", "invoice_number", F.when(F.col("paid_at").isNotNull(), "success").otherwise(F.coalesce("_last", "status")).alias("status"), "paid_at")


def credits(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("outcome = 'success'").groupBy(F.col("payer").alias("user_id")).agg(F.sum("pages_purchased").alias("pages"), F.count("*").alias("payments"))


def initiated(replies: DataFrame) -> DataFrame:
    """payment_id, status, url of stored gateway replies: failed unless status 200 with a url."""
    code, url = F.get_json_object("reply", "$.status_code"), F.coalesce(F.nullif(F.get_json_object("reply", "$.payment_url"), F.lit("")), F.get_json_object("reply", "$.redirectGatewayURL"))
    return replies.select("payment_id", F.when((code == "200") & (F.coalesce(url, F.lit("")) != ""), "pending").otherwise("failed").alias("status"), url.alias("url"))


def lines(items: Column) -> Column:
    """Explodes invoice lines: (n, label, amount) each, null ones left out."""
    return F.posexplode(F.array_compact(items)).alias("line", "item")


def item(label: str, value: Column, when: Column | None = None) -> Column:
    made = F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))
    return made if when is None else F.when(when, made)


def subscription_invoice(payments: DataFrame) -> DataFrame:
    """Lines of paid subscriptions, with the currency; tax is part of the amount."""
    priced = lambda amount: F.concat_ws(" ", "currency", F.round(amount, 2).cast("decimal(18,2)").cast("string"))
    paid = priced(F.col("payment_amount"))
    rows = F.array(
        item("pages", F.col("pages_purchased")), item("unit price", priced(b.unit_price(F.col("payment_amount"), F.col("pages_purchased")))), item("amount", paid),
        item("subtotal", paid), item("tax", F.lit("Included")), item("total", paid),
    )
    return payments.select("invoice_number", lines(rows)).select("invoice_number", "line", "item.label", "item.value")


def contract_invoices(contracts: DataFrame) -> DataFrame:
    """Lines of contracts' invoices; documents only if there are, duration only if known."""
    label = F.upper(F.replace(F.col("payment_status"), F.lit("_"), F.lit(" ")))
    rows = F.array(
        item("allocation", F.col("total_pages")), item("used", F.col("pages_used")), item("remaining", F.col("pages_remaining")),
        item("documents", F.col("no_of_documents"), F.col("no_of_documents") > 0), item("contract value", F.col("total_cost").cast("decimal(18,2)")),
        item("advance", F.col("advance_bill").cast("decimal(18,2)")), item("due", F.col("due_amount").cast("decimal(18,2)")),
        item("duration", F.col("duration_days"), F.col("duration_days").isNotNull()), item("status", label),
    )
    return contracts.select(b.contract_invoice(F.col("id")).alias("invoice_number"), lines(rows)).select("invoice_number", "line", "item.label", "item.value")
