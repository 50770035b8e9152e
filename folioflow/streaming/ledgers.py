"""Live forms of the ledgers: one writer a key, with the state that the batch forms derive by windows.

Events of a batch are handled in order of time within a key; events that come later than others of their key that were
handled before are handled when they come. States are a few numbers a key and never expire: they hold lifetime counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import business as b
from ..functions import files
from ..operators.ledgers import Allowance

NO_TIMEOUT = GroupStateTimeout.NoTimeout


def admitted_files(arrivals: DataFrame, channel: str = "user") -> DataFrame:
    """Arriving raw files with type and admission; stateless."""
    kind = files.file_type(F.col("content"))
    return arrivals.select("path", "length", kind.alias("kind"), files.admission(F.col("length"), kind, F.lit(channel)).alias("admission"))


def quota(events: DataFrame) -> DataFrame:
    """key, event_id, decision of a stream of ledger events (see the batch ledger), decided when they come; `ordered` waits for late ones."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["at", "kind", "event_id"])
        left = Allowance(*(state.get if state.exists else (rows["free_left"].iloc[0], rows["balance"].iloc[0])))
        decided = [(key[0], r.event_id, left.take(r.kind, r.pages)) for r in rows.itertuples(index=False)]
        out = [x for x in decided if x[2]]
        state.update((left.free, int(left.balance)))
        yield pd.DataFrame(out, columns=["key", "event_id", "decision"])

    return events.groupBy("key").applyInPandasWithState(step, "key long, event_id long, decision string", "free long, balance long", "append", NO_TIMEOUT)


def trial(requests: DataFrame, devices: DataFrame, most: int = b.TRIAL_LIMIT) -> DataFrame:
    """device_id, request_id, decision of a stream of (device_id, requested_at, request_id, pages) against known devices.

    A device's count before the stream and its own limit are taken when its first request comes; blocks are looked up with
    every batch.
    """
    known = devices.select("device_id", b.zero(F.col("usage_count")).cast("long").alias("used_before"), F.col("max_usage").cast("long").alias("own_most"), "is_blocked")
    joined = requests.join(known, "device_id", "left").select(
        "device_id", "requested_at", "request_id", "pages", b.zero(F.col("used_before")).alias("used_before"),
        F.coalesce("own_most", F.lit(most)).cast("long").alias("limit"), F.coalesce("is_blocked", F.lit(False)).alias("blocked"),
    )

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["requested_at", "request_id"])
        used, limit = state.get if state.exists else (int(rows["used_before"].iloc[0]), int(rows["limit"].iloc[0]))
        out = []
        for r in rows.itertuples(index=False):
            if r.pages > 1:
                out.append((key[0], r.request_id, "400"))
            elif r.blocked:
                out.append((key[0], r.request_id, "blocked"))
            elif used < limit:
                used += 1
                out.append((key[0], r.request_id, "ok"))
            else:
                out.append((key[0], r.request_id, "403"))
        state.update((used, limit))
        yield pd.DataFrame(out, columns=["device_id", "request_id", "decision"])

    return joined.groupBy("device_id").applyInPandasWithState(step, "device_id string, request_id long, decision string", "used long, most long", "append", NO_TIMEOUT)


def settled(callbacks: DataFrame, payments: DataFrame, users: DataFrame) -> DataFrame:
    """callback_id, invoice_number, outcome of a stream of callbacks against snapshots of payments and users.

    Only success is terminal, so dropping repeated invoices would be wrong: a failed one may succeed later.
    """
    people = users.select(F.col("id").alias("user_id"), F.lit(True).alias("has_user"))
    bills = payments.join(people, "user_id", "left").select("invoice_number", "payment_amount", "has_user", (F.col("status") == "success").alias("settled_before"), F.lit(True).alias("known"))
    word = F.lower(b.stripped(F.coalesce("reported_status", F.lit(""))))
    amount = F.expr("try_cast(reported_amount AS DOUBLE)")
    look = (
        F.when(F.col("known").isNull(), "not found").when(F.coalesce(F.abs(amount - F.col("payment_amount")) > 0.01, F.lit(False)), "amount mismatch")
        .when(~word.isin(*b.PAID_WORDS), F.when(word == "failed", "failed").otherwise("cancelled")).when(F.col("has_user").isNull(), "no user").otherwise("success")
    )
    joined = callbacks.join(bills, "invoice_number", "left").select("callback_id", "invoice_number", "received_at", F.coalesce("settled_before", F.lit(False)).alias("settled_before"), look.alias("look"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches).sort_values(["received_at", "callback_id"])
        paid = state.get[0] if state.exists else bool(rows["settled_before"].iloc[0])
        out = []
        for r in rows.itertuples(index=False):
            outcome = "duplicate" if paid and r.look != "not found" else r.look
            paid = paid or outcome == "success"
            out.append((r.callback_id, key[0], outcome))
        state.update((paid,))
        yield pd.DataFrame(out, columns=["callback_id", "invoice_number", "outcome"])

    return joined.groupBy("invoice_number").applyInPandasWithState(step, "callback_id long, invoice_number string, outcome string", "paid boolean", "append", NO_TIMEOUT)


def counters(documents: DataFrame, key: str) -> DataFrame:
    """Documents and pages by key, for update mode."""
    return documents.groupBy(key).agg(F.count("*").alias("documents"), F.sum("total_pages").alias("pages"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is, into Parquet, and ends. In update mode, path/batch=n has what batch n changed."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}")).start()
    query.awaitTermination()


def newest(changes: DataFrame, *key: str) -> DataFrame:
    """What update mode wrote (path, read with its batch column), one row a key: that of the last batch."""
    return changes.groupBy(*key).agg(F.max_by(F.struct(*changes.columns), "batch").alias("_last")).select("_last.*").drop("batch")
