"""Time zones as a table of transitions, for lookups of a time in its zone."""

from __future__ import annotations

import datetime
import zoneinfo
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years whose transitions the table has; before and after, the first and last ones hold.
YEARS = (1970, 2038)
#: Seconds between the looks at a zone; two changes closer than this would be taken for none.
STEP = 7 * 86_400
NEVER = 1 << 60


@cache
def transitions(zone: str) -> tuple[tuple[int, int, str], ...]:
    """(from, offset, abbreviation) of a zone, times in seconds, in order."""
    info = zoneinfo.ZoneInfo(zone)

    def look(at: int) -> tuple[int, str]:
        there = datetime.datetime.fromtimestamp(at, info)
        return int(there.utcoffset().total_seconds()), there.tzname()

    first, last = (int(datetime.datetime(y, 1, 1, tzinfo=datetime.timezone.utc).timestamp()) for y in YEARS)
    found, now = [(-NEVER, *look(first))], look(first)
    for at in range(first + STEP, last, STEP):
        if (after := look(at)) != now:
            low, high = at - STEP, at
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if look(middle) == now else (low, middle)
            found.append((high, *after))
            now = after
    return tuple(found)


def zone_table(spark: SparkSession, asked: DataFrame) -> DataFrame:
    """zone, since, until, offset, abbreviation of the valid ids in asked (zone), and of UTC.

    Distinct ids are matched with the known ones before they come to the driver: 600 at most.
    """
    known = spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "zone string")
    wanted = {r["zone"] for r in asked.select("zone").distinct().join(F.broadcast(known), "zone").collect()} | {"UTC"}
    rows = []
    for zone in sorted(wanted):
        steps = transitions(zone)
        rows += [(zone, at, until, offset, name) for (at, offset, name), until in zip(steps, [*(s[0] for s in steps[1:]), NEVER], strict=True)]
    return spark.createDataFrame(rows, "zone string, since long, until long, offset long, abbreviation string")


def with_zone(rows: DataFrame, at: str, zone: str) -> DataFrame:
    """rows with offset and abbreviation of their time `at` (UTC) in their zone; invalid and null ids are UTC.

    Each row meets the one transition that holds at its time; the table has at most a few rows a year and zone and is broadcast.
    """
    spark = rows.sparkSession
    table = zone_table(spark, rows.select(F.col(zone).alias("zone")))
    ids = F.broadcast(table.select(F.col("zone").alias("_id")).distinct())
    resolved = rows.join(ids, F.col(zone) == F.col("_id"), "left").withColumn("_id", F.coalesce("_id", F.lit("UTC")))
    seconds: Column = F.unix_seconds(F.col(at).cast("timestamp"))
    holds = (F.col("_id") == F.col("zone_id")) & (seconds >= F.col("since")) & (seconds < F.col("until"))
    return resolved.join(F.broadcast(table.withColumnRenamed("zone", "zone_id")), holds, "left").drop("_id", "zone_id", "since", "until")
