"""The quota ledger in order of time over a stream that comes out of order.

Events wait in a list state until the watermark has passed them; a timer then takes them in order of time, so decisions are
those of the batch ledger over the same events. An event that comes when the watermark has passed it can change nothing
any more: it comes out as `late` and goes to a table of its own.

Spark drops late rows before a stateful operator sees them. Here each event is therefore two rows: a clock row, which has
the event's time, moves the watermark and ends there; and the event itself, whose clock is null, which no watermark drops.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.changes import written_once
from ..operators.ledgers import Allowance

#: The state store that timers and list states need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["key", "event_id", "decision"]
LATE = "late"


class OrderedQuota(StatefulProcessor):
    """Of one key: what it has left, and the events that the watermark hasn't passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "free long, balance long")
        self.waiting = handle.getListState("waiting", "at_ms long, kind int, event_id long, pages long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            if not self.left.exists():
                self.left.update((int(batch["free_left"].iloc[0]), int(batch["balance"].iloc[0])))
            on_time = batch[batch["at_ms"] > passed]
            if len(on_time):
                self.waiting.appendList([tuple(map(int, r)) for r in on_time[["at_ms", "kind", "event_id", "pages"]].itertuples(index=False)])
                self.handle.registerTimer(int(on_time["at_ms"].min()))
            late = batch[(batch["at_ms"] <= passed)]
            if len(late):
                yield pd.DataFrame({"key": key[0], "event_id": late["event_id"], "decision": LATE})[COLUMNS]

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, events = timerValues.getCurrentWatermarkInMs(), sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in events if r[0] <= passed], [r for r in events if r[0] > passed]
        left = Allowance(*self.left.get())
        decided = [(key[0], event_id, left.take(kind, pages)) for _, kind, event_id, pages in due]
        self.left.update((left.free, int(left.balance)))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame([x for x in decided if x[2]], columns=COLUMNS)

    def close(self) -> None:
        pass


def quota(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """key, event_id, decision (those of the batch ledger, or late) of a stream of its events that come up to `delay` out of order."""
    spark: SparkSession = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    at = F.col("at").cast("timestamp")
    row = F.struct("key", F.unix_millis(at).alias("at_ms"), "kind", "event_id", "pages", "free_left", "balance")
    clock = F.array(F.struct(at.alias("clock"), F.lit(None).cast(events.select(row.alias("r")).schema["r"].dataType).alias("r")), F.struct(F.lit(None).cast("timestamp").alias("clock"), row.alias("r")))
    # Clock rows end after the watermark: a condition on the clock isn't moved before it.
    both = events.select(F.explode(clock).alias("x")).select("x.clock", "x.r").withWatermark("clock", delay).where("clock is null")
    return both.select("clock", "r.*").groupBy("key").transformWithStateInPandas(OrderedQuota(), "key long, event_id long, decision string", "Append", "EventTime")


def run_available(decisions: DataFrame, decided: str, late: str, checkpoint: str) -> None:
    """Runs the ledger over what there is: decisions to one table, late events to another, each batch once."""

    def both(batch: DataFrame, n: int) -> None:
        rows = batch.persist()
        written_once(rows.where(F.col("decision") != LATE), decided, n)
        written_once(rows.where(F.col("decision") == LATE).drop("decision"), late, n)
        rows.unpersist()

    writer = decisions.writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    writer.foreachBatch(both).start().awaitTermination()
