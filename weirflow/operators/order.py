"""Positions and running sums in a total order without putting all rows in one task.

Rows are dealt out by ranges of the whole order, which Spark takes from a sample of the data, sorted
within them and written with their place in their range. Ranges follow the data, so neither a second in
which everything arrives nor a column of nulls makes a range larger than others; only rows that are
equal in all columns of the order share one. One row per range is put in one task, to add up their sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.sources.staging import staged

#: monotonically_increasing_id has the partition above so many bits and the row's place in it below.
PLACE_BITS = 33


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """Adds _b, the number of the row's range, and _r, its place from 0 in that; nulls come first. The result is a written table."""
    laid = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    place = F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return laid.select("*", F.shiftright("_m", PLACE_BITS).alias("_b"), place.alias("_r")).drop("_m")


def bases(laid: DataFrame, size, name: str = "_base") -> DataFrame:
    """(_k, name, _whole): what ranges before each one add up to, and all of them; size is an aggregate. One row per range."""
    per = laid.groupBy("_b").agg(size.alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(F.col("_b").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name), F.sum("_n").over(Window.partitionBy()).alias("_whole"))


def position(df: DataFrame, *order: str, name: str = "i", total: str | None = None) -> DataFrame:
    """Adds `name`: the row's place from 0 in the order of the columns; and `total`: the number of rows."""
    laid = in_ranges(df, *order)
    out = laid.join(F.broadcast(bases(laid, F.count("*"))), F.col("_b") == F.col("_k"))  # one row per range
    out = out.withColumn(name, F.col("_base") + F.col("_r"))
    if total:
        out = out.withColumn(total, F.col("_whole"))
    return out.drop("_b", "_k", "_base", "_whole", "_r")


def running_sum(df: DataFrame, value: str, *order: str, name: str, total: str | None = None) -> DataFrame:
    """Adds `name`: the sum of value over all rows before this one; and `total`: over all rows."""
    laid = in_ranges(df, *order)
    before = Window.partitionBy("_b").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    out = laid.withColumn("_s", F.coalesce(F.sum(value).over(before), F.lit(0)))
    out = out.join(F.broadcast(bases(laid, F.sum(value))), F.col("_b") == F.col("_k"))  # one row per range
    out = out.withColumn(name, F.col("_base") + F.col("_s"))
    if total:
        out = out.withColumn(total, F.col("_whole"))
    return out.drop("_b", "_k", "_base", "_whole", "_r", "_s")


def following(df: DataFrame, col: str, name: str) -> DataFrame:
    """Adds `name`: the next larger value of col, of which df holds each value once; null for the last."""
    laid = in_ranges(df, col)
    firsts = laid.groupBy("_b").agg(F.min(col).alias("_first"))
    firsts = firsts.select(F.col("_b").alias("_k"), F.lead("_first").over(Window.orderBy("_b")).alias("_first"))  # one row per range
    inside = F.lead(col).over(Window.partitionBy("_b").orderBy("_r"))
    out = laid.withColumn("_l", inside).join(F.broadcast(firsts), F.col("_b") == F.col("_k"))
    return out.withColumn(name, F.coalesce("_l", "_first")).drop("_b", "_k", "_r", "_l", "_first")
