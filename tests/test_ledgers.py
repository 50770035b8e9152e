"""Ledgers: windows against a plain fold, identities, streams against batch, logs and writers."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import functions as F

from folioflow.operators import changes, identity, ledgers
from folioflow.sources import files
from folioflow.streaming import ledgers as live

START = datetime.datetime(2024, 1, 1)


def events(seed, keys=60):
    r, rows = random.Random(seed), []
    for key in range(keys):
        free, balance = r.randint(0, 3), r.randint(-5, 30)
        for i in range(r.randint(1, 25)):
            rows.append((key, START + datetime.timedelta(minutes=r.randint(0, 12)), int(r.random() < 0.85), key * 100 + i, r.randint(1, 4), free, balance))
    return rows


def fold(rows):
    out, state = {}, {}
    for key, _, kind, event, pages, free, balance in sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3])):
        f, b = state.get(key, (free, balance))
        if kind == 0:
            b += pages
        elif f > 0:
            out[event], f = ("400", f) if pages > 1 else ("free", f - 1)
        elif pages <= b:
            out[event], b = "paid", b - pages
        else:
            out[event] = "402"
        state[key] = f, b
    return out


def test_quota_windows_agree_with_fold(spark):
    for seed in (1, 2):
        rows = events(seed)
        df = spark.createDataFrame(rows, ledgers.EVENTS)
        assert {r["event_id"]: r["decision"] for r in ledgers.quota(df).collect()} == fold(rows)
        assert {r["event_id"]: r["decision"] for r in ledgers.folded(df).collect()} == fold(rows)


def test_identities_agree_with_fold(spark, tmp_path):
    r = random.Random(5)
    visits = [(i, START + datetime.timedelta(minutes=i), f"d{r.randint(0, 30)}", r.choice([None, f"c{r.randint(0, 15)}"])) for i in range(300)]
    by_print, by_cookie, want = {}, {}, {}
    for i, _, p, c in visits:
        d, new = by_print.get(p), False
        if d:
            if c and not d["c"]:
                d["c"] = c
                by_cookie.setdefault(c, d)
        elif c and c in by_cookie:
            d = by_cookie[c]
            by_print.pop(d["p"], None)
            d["p"] = p
            by_print[p] = d
        else:
            new, d = True, {"p": p, "c": c, "first": p}
            by_print[p] = d
            if c:
                by_cookie.setdefault(c, d)
        want[i] = (d["first"], new)
    df = spark.createDataFrame(visits, "request_id long, requested_at timestamp_ntz, fingerprint string, cookie_id string")
    got = {r["request_id"]: (r["device"], r["is_new"]) for r in identity.trial_identities(df).collect()}
    assert got == want


def test_accounts_in_order(spark):
    users = spark.createDataFrame([(1, None, "a@x", None), (2, "g2", "b@x", "Bo")], "id long, google_id string, email string, full_name string")
    logins = [(1, "gY", "a@x", "Al"), (2, "gY", "other@x", "Not used"), (3, "g9", "new@x", "Nu"), (4, "g9", "else@x", None), (5, "gZ", "b@x", "Other"), (6, "g2", "third@x", "T")]
    got = identity.linked(spark.createDataFrame(logins, "login_id long, external_id string, email string, full_name string"), users).orderBy("login_id").collect()
    assert [tuple(r) for r in got] == [(1, "by email", 1, None, "Al"), (2, "by id", 1, None, "Al"), (3, "new", None, 3, "Nu"), (4, "by id", None, 3, "Nu"), (5, "by email", 2, None, "Bo"), (6, "new", None, 6, "T")]


def test_refused_registrations_take_nothing(spark):
    users = spark.createDataFrame([("old", "old@x")], "username string, email string")
    new = [(1, "ann", "old@x"), (2, "ann", "a@x"), (3, "bob", "a@x"), (4, "bob", "b@x"), (5, "old", "c@x"), (6, "cy", "c@x"), (7, "ann", "b@x")]
    got = {r["id"]: r["conflict"] for r in identity.conflicts(spark.createDataFrame(new, "id long, username string, email string"), users).collect()}
    assert got == {1: "email", 2: None, 3: "email", 4: None, 5: "username", 6: None, 7: "username"}


def test_consent_in_order(spark):
    devices = spark.createDataFrame([("d1", "c0"), ("d2", None), ("d3", "c3")], "device_id string, cookie_id string")
    answers = [(1, "d1", None, False), (2, "d1", None, True), (3, "d2", "c2", True), (4, "zz", "c3", False), (5, "zz", "no", True), (6, "zz", "c3", True)]
    df = spark.createDataFrame([(i, f, c, g, START + datetime.timedelta(minutes=i)) for i, f, c, g in answers], "answer_id long, fingerprint string, cookie_id string, given boolean, at timestamp_ntz")
    got = {r["device_id"]: (r["consent_given"], r["cookie_id"]) for r in identity.consents(devices, df).collect()}
    assert got == {"d1": (True, None), "d2": (True, "c2"), "d3": (False, None)}
    assert {r["answer_id"]: r["reply"] for r in identity.answered(devices, df).collect()} == {1: 200, 2: 200, 3: 200, 4: 200, 5: 404, 6: 404}, "a cookie that was cleared finds no device any more"


def in_batches(spark, df, path, order):
    """The rows as a stream of files in order."""
    rows = df.orderBy(order).collect()
    for n in range(0, len(rows), 40):
        spark.createDataFrame(rows[n : n + 40], df.schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_live_quota_agrees_with_batch(spark, tmp_path):
    rows = sorted(events(3, 20), key=lambda x: (x[1], x[2], x[3]))
    df = spark.createDataFrame(rows, ledgers.EVENTS)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    live.run_available(live.quota(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r["event_id"]: r["decision"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["event_id"]: r["decision"] for r in ledgers.quota(df).collect()}


def test_live_trials_over_batches(spark, tmp_path):
    r = random.Random(8)
    rows = [(f"d{r.randint(0, 9)}", START + datetime.timedelta(minutes=i), i, r.choice([1, 1, 2])) for i in range(80)]
    df = spark.createDataFrame(rows, "device_id string, requested_at timestamp_ntz, request_id long, pages int")
    devices = spark.createDataFrame([("d1", 2, 3, False), ("d2", 0, 5, None), ("d3", 0, 3, True), ("d4", None, None, False)], "device_id string, usage_count int, max_usage int, is_blocked boolean")
    live.run_available(live.trial(in_batches(spark, df, tmp_path / "in", "requested_at"), devices), f"{tmp_path}/out", f"{tmp_path}/state")
    want = {x["request_id"]: x["decision"] for x in ledgers.trial(df, devices).collect()}
    assert {x["request_id"]: x["decision"] for x in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_live_settlement_and_counters(spark, tmp_path):
    payments = spark.createDataFrame([(1, 7, "a", 5, 50.0, "pending"), (2, 7, "b", 5, 50.0, "success"), (3, 8, "c", 5, 50.0, "pending"), (4, 99, "d", 5, 50.0, "pending")], "id long, user_id long, invoice_number string, pages_purchased int, payment_amount double, status string")
    users = spark.createDataFrame([(7,), (8,)], "id long")
    calls = [(1, "a", "Failed", None), (2, "a", " success ", 50.0), (3, "a", "success", 50.0), (4, "b", "success", None), (5, "c", "1", 49.0), (6, "c", "odd", None), (7, "zz", "success", None), (8, "d", "\tsuccess\n", 50.0)]
    df = spark.createDataFrame([(i, n, s, a, START + datetime.timedelta(minutes=i)) for i, n, s, a in calls], "callback_id long, invoice_number string, reported_status string, reported_amount double, received_at timestamp_ntz")
    # Three batches: a settlement of one batch makes duplicates of later ones.
    for n in range(0, len(calls), 3):
        df.where(f"callback_id > {n} and callback_id <= {n + 3}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    live.run_available(live.settled(stream, payments, users), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {r["callback_id"]: r["outcome"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r["callback_id"]: r["outcome"] for r in ledgers.settled(df, payments, users).collect()}
    assert got == {1: "failed", 2: "success", 3: "duplicate", 4: "duplicate", 5: "amount mismatch", 6: "cancelled", 7: "not found", 8: "no user"}
    docs = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("total_pages", F.lit(2))
    live.run_available(live.counters(docs, "invoice_number"), f"{tmp_path}/counts", f"{tmp_path}/state2", "update")
    changed = spark.read.parquet(f"{tmp_path}/counts")
    assert {r["invoice_number"]: r["pages"] for r in live.newest(changed, "invoice_number").collect()} == {"a": 6, "b": 2, "c": 4, "zz": 2, "d": 2}
    twice = changed.unionByName(changed.withColumns({"batch": F.col("batch") + 1, "pages": F.col("pages") + 2}))
    assert {r["pages"] for r in live.newest(twice, "invoice_number").collect()} == {8, 4, 6}


def test_arriving_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.7 abcdef")
    (tmp_path / "in/b.bin").write_bytes(b"12345")
    live.run_available(live.admitted_files(files.raw_file_stream(spark, str(tmp_path / "in"))), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {(r["kind"], r["admission"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {("pdf", "ok"), ("unknown", "415 unknown")}
    assert files.raw_files(spark, str(tmp_path / "in"), "*.pdf").count() == 1


def test_operation_log(spark, tmp_path):
    row = lambda *x: " | ".join(f"{v:<{w}}" for v, w in zip(x, (6, 12, 10, 8, 8, 28, 25, 40)))
    lines = [
        "=" * 158, f"{'OPERATION LOG':^158}", "=" * 158, row("#", "Date", "Time", "Level", "User ID", "User Email", "Module/Function", "Event"), "-" * 158,
        row(1, "2024-01-01", "10:00:00", "INFO", 7, "a@x.org", "ocr_service.run", "engine | mistral"), row(2, "2024-01-01", "10:00:05", "ERROR", "-", "-", "ocr_service.run", "it failed because of ..."),
        f"{'':9}Details: it failed because of all | 1 | that", f"{'':9}Exception: Traceback", "  File 12 | x", "-" * 158,
    ]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    got = files.operation_log(spark, str(tmp_path / "log.txt")).orderBy("serial").collect()
    assert [tuple(r) for r in got] == [
        (1, datetime.datetime(2024, 1, 1, 10), "INFO", 7, "a@x.org", "ocr_service.run", "engine | mistral"),
        (2, datetime.datetime(2024, 1, 1, 10, 0, 5), "ERROR", None, None, "ocr_service.run", "it failed because of ..."),
    ]


def test_append_documents(spark, tmp_path):
    df = spark.createDataFrame([(1, START), (2, START + datetime.timedelta(days=1))], "id long, created_at timestamp_ntz")
    for batch, rows in ((0, df), (1, df.where("id = 1")), (0, df), (1, df.where("id = 1"))):
        changes.append_documents(rows, str(tmp_path / "docs"), batch)
    got = spark.read.parquet(str(tmp_path / "docs"))
    assert got.count() == 3 and got.where("created_date = '2024-01-01'").count() == 2, "a batch that runs twice is there once"


def test_free_names_across_bases(spark):
    new = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "ab1"), (4, "ab"), (5, "cd")], "id long, base string")
    taken = spark.createDataFrame([("ab2",), ("cd",)], "username string")
    got = {r["id"]: r["username"] for r in identity.free_names(new, taken).collect()}
    assert len(set(got.values())) == 5 and not {"ab2", "cd"} & set(got.values())
    assert got[1] == "ab" and got[2] == "ab1" and got[5] == "cd1"
