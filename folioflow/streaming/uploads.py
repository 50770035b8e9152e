"""Uploads as a stream: raw files to type, admission and engine, appended to a table once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import business as b
from ..functions import files
from ..operators.changes import written_once

#: The caller's id in an upload's path: .../<user id>/<file>.
OWNER = r"/([0-9]+)/[^/]+$"


def routed(arrivals: DataFrame, users: DataFrame, channel: str = "user") -> DataFrame:
    """path, arrived_at, length, user_id, kind, admission, engine of arriving files against a snapshot of users.

    The owner is the last folder's name; files without one, or of unknown users, are anonymous. Only admitted files have
    an engine. Bytes are looked at and left behind: none go on.
    """
    kind = files.file_type(F.col("content"))
    owner = F.expr("try_cast(nullif(regexp_extract(path, '" + OWNER + "', 1), '') AS BIGINT)")
    seen = arrivals.select("path", F.col("modificationTime").alias("arrived_at"), "length", owner.alias("user_id"), kind.alias("kind"))
    active = b.pages_remaining(F.col("subscription_pages_total"), F.col("subscription_pages_used")) > 0
    people = users.select(F.col("id").alias("_user"), "role", active.alias("_active"))
    joined = seen.join(people, F.col("user_id") == F.col("_user"), "left")
    admission = files.admission(F.col("length"), F.col("kind"), F.lit(channel))
    return joined.select("path", "arrived_at", "length", "user_id", "kind", admission.alias("admission"), F.when(admission == "ok", files.engine(F.col("role"), F.col("_active"))).alias("engine"))


def run_available(arrivals: DataFrame, users: DataFrame, path: str, checkpoint: str, channel: str = "user") -> None:
    """Routes the files that are there into path, a folder a batch and a day; a batch that runs twice is there once."""
    dated = routed(arrivals, users, channel).withColumn("arrived_date", F.to_date("arrived_at"))
    writer = dated.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda rows, n: written_once(rows, path, n, "arrived_date")).start().awaitTermination()
