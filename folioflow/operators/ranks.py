"""Row numbers of any group without one task for a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def numbered(df: DataFrame, key: str, *order: str, name: str) -> DataFrame:
    """df with the place (from 0) of each row among those of its key, in order; equal rows get different places.

    Rows are dealt by ranges of (key, order) and written with the number of their range. Counts by key and range give the
    place at which a key's part of a range begins, so only those counts (keys times ranges that they touch) are summed
    along a key; places within a range are counted range by range. A key of any size is thus dealt over many tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Equal keys of one range may be cut by AQE's coalescing of ranges only at their edges: ranges stay in order.
    dealt = written(df.repartitionByRange(parts, key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    own = dealt.withColumn("_place", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)) - 1)
    joined = own.join(begins, own[key].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_part")))
    return joined.select(*df.columns, (F.col("_begin") + F.col("_place")).alias(name))
