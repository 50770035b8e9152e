"""Streams whose events come out of order, retried batches, and uploads."""

from __future__ import annotations

import datetime
import random

from folioflow.operators import ledgers
from folioflow.sources import files
from folioflow.streaming import ordered, uploads

START = datetime.datetime(2024, 1, 1)


def landed(spark, rows, path):
    """One file a list of rows, in order of arrival."""
    for batch in rows:
        spark.createDataFrame(batch, ledgers.EVENTS).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(ledgers.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_shuffled_arrival_within_the_watermark_gives_the_batch_decisions(spark, tmp_path):
    r = random.Random(12)
    events = [(k, START + datetime.timedelta(minutes=10 * i + k), int(r.random() < 0.8), 1000 * k + i, r.choice([1, 1, 2, 3]), 2, 3) for k in range(1, 4) for i in range(20)]
    # Arrival is late by up to 50 minutes; the watermark waits for 60.
    arrival = sorted(events, key=lambda e: e[1] + datetime.timedelta(minutes=r.randint(0, 50)))
    batches = [arrival[i : i + 15] for i in range(0, len(arrival), 15)]
    flush = [(99, START + datetime.timedelta(days=9), 0, 999_999, 1, 0, 0)]
    stream = landed(spark, [*batches, flush, [(99, START + datetime.timedelta(days=19), 0, 999_998, 1, 0, 0)]], tmp_path / "in")
    ordered.run_available(ordered.quota(stream, "60 minutes"), f"{tmp_path}/decided", f"{tmp_path}/late", f"{tmp_path}/state")
    want = {x["event_id"]: x["decision"] for x in ledgers.quota(spark.createDataFrame(events, ledgers.EVENTS)).collect()}
    got = spark.read.parquet(f"{tmp_path}/decided").collect()
    assert len(got) == len(want) and {x["event_id"]: x["decision"] for x in got} == want
    assert spark.read.parquet(f"{tmp_path}/late").count() == 0
    assert {"free", "400", "paid", "402"} <= set(want.values()), "the case meets every decision"


def test_events_behind_the_watermark_go_to_the_side(spark, tmp_path):
    at = lambda hours: START + datetime.timedelta(hours=hours)
    batches = [
        [(1, at(0), 1, 1, 1, 1, 2), (1, at(3), 1, 2, 1, 1, 2)],
        [(1, at(10), 1, 3, 1, 1, 2)],
        [(1, at(11), 1, 4, 1, 1, 2)],
        [(1, at(1), 1, 5, 1, 1, 2), (1, at(12), 1, 6, 1, 1, 2)],  # 5 comes ten hours late
        [(2, at(200), 0, 7, 1, 0, 0)],
        [(2, at(300), 0, 8, 1, 0, 0)],
    ]
    ordered.run_available(ordered.quota(landed(spark, batches, tmp_path / "in"), "1 hour"), f"{tmp_path}/decided", f"{tmp_path}/late", f"{tmp_path}/state")
    assert [x["event_id"] for x in spark.read.parquet(f"{tmp_path}/late").collect()] == [5]
    got = {x["event_id"]: x["decision"] for x in spark.read.parquet(f"{tmp_path}/decided").collect()}
    assert got == {1: "free", 2: "paid", 3: "paid", 4: "402", 6: "402"}


def test_uploads_meet_users_and_are_appended_once(spark, tmp_path):
    users = spark.createDataFrame([(7, "user", 10, 2), (8, "user", 5, 5), (9, "admin", None, None)], "id long, role string, subscription_pages_total int, subscription_pages_used int")
    png, pdf = b"\x89PNG\r\n\x1a\n1234567890", b"%PDF-1.7 abcdef"
    for place, content in {"7/a.pdf": pdf, "8/b.png": png, "9/c.pdf": pdf, "5/d.pdf": pdf, "x/e.pdf": pdf, "7/f.bin": b"0123456789abc"}.items():
        (tmp_path / "in" / place).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / place).write_bytes(content)
    arrivals = files.raw_file_stream(spark, f"{tmp_path}/in/*")
    for state in ("state", "state-again"):  # a second run from the start repeats batch 0
        uploads.run_available(arrivals, users, f"{tmp_path}/out", f"{tmp_path}/{state}")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 6
    assert {x["path"].rsplit("/in/", 1)[1]: (x["user_id"], x["kind"], x["admission"], x["engine"]) for x in got} == {
        "7/a.pdf": (7, "pdf", "ok", "mistral"), "8/b.png": (8, "image", "ok", "docai"), "9/c.pdf": (9, "pdf", "ok", "mistral"), "5/d.pdf": (5, "pdf", "ok", "docai"),
        "x/e.pdf": (None, "pdf", "ok", "docai"), "7/f.bin": (7, "unknown", "415 unknown", None),
    }
