"""Running values and row numbers over long ordered groups without gathering a group in one task.

A group is cut into blocks of its order column. Windows run inside blocks; one row per block carries what comes before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treadle.plans.storage import stored


def last_before(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """``out``: the last non-null ``value`` among the earlier rows with the same keys. ``block`` must not fall as the rows go on."""
    df = df.withColumn("_block", block).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    ends = df.where("_value is not null").groupBy(*keys, "_block").agg(F.max_by("_value", place).alias("_end"))
    blocks = df.select(*keys, "_block").distinct().join(ends, [*keys, "_block"], "left")
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    df = df.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(blocks, [*keys, "_block"])
    return df.withColumn(out, F.coalesce("_inside", "_carried")).drop("_block", "_value", "_inside", "_carried")


def running_sum(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the row and the earlier ones with the same keys."""
    df = df.withColumn("_block", block).withColumn("_value", value)
    blocks = df.groupBy(*keys, "_block").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_inside", F.sum("_value").over(inside)).join(blocks, [*keys, "_block"])
    return df.withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_value", "_inside", "_before")


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """``out``: the row's place, from 0, among rows with the same keys, by ``order``.

    Rows are range-partitioned by keys and order and stored with their partition's number; the counts of each part
    before a row's, and its place inside the part, add up. Only the table of parts, one row for each key and
    partition, is joined.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    return own.join(counts, [*keys, "_part"]).withColumn(out, (F.col("_before") + F.col("_own") - 1).cast("int")).drop("_part", "_own", "_before")


def minute(ts: str = "ts") -> Column:
    return F.date_trunc("minute", ts)
