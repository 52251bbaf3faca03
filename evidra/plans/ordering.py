"""Consecutive numbers in a global order, without a task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Rows of a range, about, and ranges at least; one count a range reaches the driver.
IN_RANGE, LEAST = 2_000_000, 200


def numbered(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the given order.

    Rows are dealt into ranges of the order and written, so that the ranges
    are the same for the counts and the rows; each range is then numbered by
    itself from the count of those before it.  Ranges grow in number with the
    rows.  Rows that tie on the whole order share a range and are numbered in
    any order.
    """
    spark = df.sparkSession
    kept = materialize(df, "unordered")
    ranges = max(min(LEAST, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-kept.count() // IN_RANGE))
    dealt = materialize(kept.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()
    total, before = 0, []
    for r in sorted(sizes):
        before.append((r["__range"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "__range int, __start long"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt.withColumn("__within", within).join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__within")).cast("long")).drop("__range", "__start", "__within")
