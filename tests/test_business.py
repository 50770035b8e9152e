"""Validation, zones, declared tables and deletes, row by row."""

from __future__ import annotations

import datetime
import zoneinfo

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioflow.functions import business as b
from folioflow.operators import changes, identity, validation
from folioflow.sources import schemas, zones

CONTRACT = "id int, name string, phone string, email string, total_pages int, unit_price double, start_date date, end_date date, advance_bill double, no_of_documents int, payment_status string"
DAY = datetime.date(2024, 1, 2)


def contracts(spark):
    good = dict(name="N", phone=None, email=None, total_pages=10, unit_price=None, start_date=None, end_date=None, advance_bill=None, no_of_documents=None, payment_status=None)
    odd = [{}, {"name": None}, {"name": ""}, {"name": "x" * 255}, {"name": "x" * 256, "phone": "1" * 51, "total_pages": 0}, {"start_date": DAY, "end_date": DAY}, {"start_date": DAY, "end_date": DAY - datetime.timedelta(1), "advance_bill": 1e6},
           {"advance_bill": 100.0}, {"advance_bill": 100.5}, {"total_pages": None, "advance_bill": 5.0}, {"payment_status": "PAID"}, {"email": "a@b"}, {"email": "a.b+c@d.example.org"}, {"unit_price": -0.5, "no_of_documents": -1}]
    return spark.createDataFrame([(i, *{**good, **x}.values()) for i, x in enumerate(odd)], CONTRACT)


def test_contract_rules(spark):
    valid, refused = validation.split(contracts(spark), "contract")
    assert sorted(r["id"] for r in valid.collect()) == [0, 3, 5, 7, 12] and "violations" not in valid.columns
    got = {r["id"]: [tuple(v) for v in r["violations"]] for r in refused.collect()}
    assert got == {
        1: [("body -> name", "Field required", "missing")], 2: [("body -> name", "String should have at least 1 character", "string_too_short")],
        4: [("body -> name", "String should have at most 255 characters", "string_too_long"), ("body -> phone", "String should have at most 50 characters", "string_too_long"), ("body -> total_pages", "Input should be greater than or equal to 1", "greater_than_equal")],
        6: [("body", "Value error, end_date must be on or after start_date", "value_error")], 8: [("body", "Value error, advance_bill (100.5) cannot exceed total cost (100.0)", "value_error")],
        9: [("body -> total_pages", "Field required", "missing")], 10: [("body -> payment_status", "Input should be 'paid', 'partial_paid' or 'due'", "enum")],
        11: [("body -> email", "value is not a valid email address", "value_error")],
        13: [("body -> unit_price", "Input should be greater than or equal to 0", "greater_than_equal"), ("body -> no_of_documents", "Input should be greater than or equal to 0", "greater_than_equal")],
    }


def test_split_is_written_and_counted_in_one_pass(spark, tmp_path):
    counts = validation.write_split(contracts(spark), "contract", f"{tmp_path}/out")
    assert (counts["rows"], counts["refused"], counts["name"], counts["whole_row"]) == (14, 9, 3, 2)
    assert {r["valid"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("valid").agg(F.count("*").alias("n")).collect()} == {"true": 5, "false": 9}
    empty = validation.write_split(contracts(spark).limit(0), "contract", f"{tmp_path}/none")
    assert empty["rows"] == 0


def test_other_forms(spark):
    pay = spark.createDataFrame([(1, 1, "ab", "1234567", None), (2, 0, "a", "123456", "x" * 256)], "id int, pages int, cust_name string, cust_phone string, cust_address string")
    assert [len(r["violations"]) for r in validation.checked(pay, "payment").orderBy("id").collect()] == [0, 4]
    accounts = spark.createDataFrame([(1, "abc", "a@b.co", None, None), (2, "ab", None, "x" * 256, "root")], "id int, username string, email string, full_name string, role string")
    assert [len(r["violations"]) for r in validation.checked(accounts, "account").orderBy("id").collect()] == [0, 4]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Asia/Dhaka", "Australia/Lord_Howe", "UTC"])
def test_zones_on_both_sides_of_changes(spark, zone):
    utc, there = datetime.timezone.utc, zoneinfo.ZoneInfo(zone)
    changes_at = [at for at, _, _ in zones.transitions(zone)[1:]][-30:] or [0]
    times = [datetime.datetime.fromtimestamp(at + d, utc).replace(tzinfo=None) for at in changes_at for d in (-1, 0, 1)]
    rows = spark.createDataFrame([(i, x, zone) for i, x in enumerate(times)], "i int, at timestamp_ntz, z string")
    day, clock = b.local_time(F.col("at").cast("timestamp"), F.col("offset"), F.col("abbreviation"))
    got = [(r["day"], r["clock"]) for r in zones.with_zone(rows, "at", "z").select("i", day.alias("day"), clock.alias("clock")).orderBy("i").collect()]
    local = [x.replace(tzinfo=utc).astimezone(there) for x in times]
    assert got == [(x.strftime("%B %d, %Y"), x.strftime("%I:%M %p %Z")) for x in local]


def test_unknown_zones_are_utc(spark):
    rows = spark.createDataFrame([(1, datetime.datetime(2024, 7, 1), "Nowhere/At all"), (2, datetime.datetime(2024, 7, 1), None), (3, None, "Asia/Dhaka")], "i int, at timestamp_ntz, z string")
    got = {r["i"]: (r["offset"], r["abbreviation"]) for r in zones.with_zone(rows, "at", "z").collect()}
    assert got == {1: (0, "UTC"), 2: (0, "UTC"), 3: (None, None)}


def test_declared_tables(spark, tmp_path):
    assert len(schemas.TABLES) == 7
    users = spark.createDataFrame([(1, "u", "e@x.co", "user"), (2, None, "f@x.co", "user")], "id int, username string, email string, role string")
    made = dict(auth_provider="local", is_active=True, is_verified=True, free_ocr_used=0, subscription_pages_total=0, subscription_pages_used=0, created_at=datetime.datetime(2024, 1, 1))
    schemas.conformed(users, "users", **made).write.parquet(f"{tmp_path}/users")
    table = schemas.table(spark, f"{tmp_path}/users", "users")
    assert table.columns == schemas.schema_of("users").names and dict(table.dtypes)["id"] == "bigint"
    assert table.select("id", "full_name").count() == 2, "columns that aren't read aren't checked"
    with pytest.raises(PySparkException, match="users.username is null"):
        table.select("username").collect()


def test_jdbc_by_the_sources_own_bounds(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/base;create=true"
    rows = [(i * 7 - 50, f"name {i}") for i in range(40)]
    spark.createDataFrame(rows, "id int, name string").write.format("jdbc").options(url=url, dbtable="people").save()
    got = schemas.jdbc_table(spark, url, "people", "id", 4)
    assert got.rdd.getNumPartitions() == 4
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted(rows)
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert max(sizes) <= 20, "no task reads all"
    spark.createDataFrame([], "id int, name string").write.format("jdbc").options(url=url, dbtable="nobody").save()
    assert schemas.jdbc_table(spark, url, "nobody", "id", 4).count() == 0


def test_deletes_of_others_keys_are_not_found(spark):
    docs = spark.createDataFrame([(1, 7, False), (2, 7, True), (3, 8, False)], "id int, user_id int, is_deleted boolean")
    keys = spark.createDataFrame([(1, 7, False), (3, 7, False), (2, 7, False), (9, 7, False), (3, 1, True), (3, None, None)], "id int, caller_id int, privileged boolean")
    assert sorted((r["id"], r["reply"]) for r in changes.delete_replies(docs, keys, "id", "user_id").collect()) == [(1, "deleted"), (2, "deleted"), (3, "deleted"), (3, "not_found"), (3, "not_found"), (9, "not_found")]
    mine = keys.where("not privileged and id in (1, 3)")
    assert {r["id"]: r["is_deleted"] for r in changes.soft_deleted(docs, mine, "id", "user_id").collect()} == {1: True, 2: True, 3: False}
    assert {r["id"] for r in changes.hard_deleted(docs, mine, "id", "user_id").collect()} == {2, 3}


def test_unknown_devices_are_new(spark):
    devices = spark.createDataFrame([("a", 1, 3, False), ("b", 5, 3, True), ("c", 3, 3, None)], "device_id string, usage_count int, max_usage int, is_blocked boolean")
    keys = spark.createDataFrame([("a",), ("b",), ("zz",)], "device_id string")
    got = {r["device_id"]: (r["usage_count"], r["remaining"], r["is_blocked"], r["is_new"]) for r in identity.trial_status(keys, devices).collect()}
    assert got == {"a": (1, 2, False, False), "b": (5, 0, True, False), "zz": (0, 3, None, True)}
    assert {r["device_id"]: (r["allowed"], r["usage_count"], r["remaining"]) for r in identity.trial_attempts(devices).collect()} == {"a": (True, 2, 1), "b": (False, 5, 0), "c": (False, 3, 0)}
