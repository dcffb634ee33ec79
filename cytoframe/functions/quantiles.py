"""Exact quantiles without gathering a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import stored
from .running import running_counts


def quantiles(df: DataFrame, column: str, wanted: Sequence[float], by: str | None = None, split: int | None = None) -> DataFrame:
    """(by, n, q_0, q_1, ..): interpolated quantiles of a column's values, null ones left out, one row for each group.

    Values are counted, and the counts of smaller values are running sums over ranges of about as many
    different values each (see :func:`.running.running_counts`), so that neither a large group nor outliers
    bring many values into one task.
    """
    keys = ["by_"] if by else []
    values = df.select(*([F.col(by).alias("by_")] if by else []), F.col(column).cast("double").alias("x_")).where("x_ is not null")
    # Stored, as several passes follow, and those of a plan over this one's result would multiply.
    counts = stored(values.groupBy(*keys, "x_").agg(F.count(F.lit(1)).alias("n_")), "values")
    bounds = counts.groupBy(*keys).agg(F.sum("n_").alias("all_"))
    placed = running_counts(counts, keys, "x_", "n_", split=split).withColumn("upto_", F.col("before") + F.col("n_"))
    # One row for each group, or one row.
    placed = placed.join(bounds.withColumnRenamed("by_", "of_"), F.col("by_").eqNullSafe(F.col("of_"))).drop("of_") if by else placed.crossJoin(bounds)
    sides, out = [], []
    for i, q in enumerate(wanted):
        place = (F.col("all_") - 1) * F.lit(float(q))
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            sides.append(F.min(F.when(F.col("upto_") > rank, F.col("x_"))).alias(f"{side}{i}_"))
        out.append((F.col(f"low{i}_") + (place - F.floor(place)) * (F.col(f"high{i}_") - F.col(f"low{i}_"))).alias(f"q_{i}"))
    found = placed.groupBy(*keys).agg(F.max("all_").alias("all_"), *sides)
    return found.select(*([F.col("by_").alias(by)] if by else []), F.col("all_").alias("n"), *out)
