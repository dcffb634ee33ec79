"""Counts of all smaller values of a key, without gathering a key's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different values of a key that one window may see; keys with more are split into ranges.
SPLIT = 65_536
#: Ranges of a split key, about: their bounds are a sample of its values.
RANGES = 256
_STEPS = 12


def _place(bounds: Column, value: Column) -> Column:
    """How many of the sorted bounds are below the value, by binary search."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(_STEPS))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < value, at + step).otherwise(at))


def running_counts(counts: DataFrame, by: list[str], value: str, count: str, into: str = "before", split: int | None = None) -> DataFrame:
    """Adds to rows (by, value, count), one for each different value of a key, the sum of the counts of the key's smaller values.

    A key with more than ``split`` values is cut into ranges between values chosen by their hash,
    about one in 1 / RANGES of them: the same ones wherever and however often they are computed, as many
    values between each two however the values are spread, and no more than a window within a range and one over
    the ranges. Keys may be null.
    """
    split = SPLIT if split is None else split
    keyed = counts.withColumn("key_", F.struct(*by) if by else F.struct(F.lit(0)))
    large = keyed.groupBy("key_").agg(F.count(F.lit(1)).alias("values_")).where(F.col("values_") > split)
    one_in = F.greatest(F.lit(1), F.floor(F.col("values_") / RANGES))
    chosen = keyed.select("key_", F.col(value).alias("bound_")).join(large, "key_").where(F.pmod(F.xxhash64("key_", "bound_"), one_in) == 0)
    bounds = chosen.groupBy("key_").agg(F.sort_array(F.collect_list("bound_")).alias("bounds_"))
    placed = keyed.join(bounds, "key_", "left").withColumn("range_", F.when(F.col("bounds_").isNull(), F.lit(0)).otherwise(_place(F.col("bounds_"), F.col(value)))).drop("bounds_")
    lower = Window.partitionBy("key_", "range_").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("within_", F.coalesce(F.sum(count).over(lower), F.lit(0)))
    # A row for each range.
    ranges = placed.groupBy("key_", "range_").agg(F.sum(count).alias("held_"))
    earlier = Window.partitionBy("key_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("key_", "range_", F.coalesce(F.sum("held_").over(earlier), F.lit(0)).alias("earlier_"))
    return within.join(ranges, ["key_", "range_"]).select(*counts.columns, (F.col("within_") + F.col("earlier_")).alias(into))
