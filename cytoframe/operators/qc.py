"""Quality control. Zeros are implicit, so numbers of cells and genes come from their own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles

MAD_SCALE = 1.4826


def cell_metrics(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """total, n_genes, max_count, top_share for every cell; a cell without counts has 0, 0, 0 and no share."""
    own = counts.groupBy("cell_id").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_genes"), F.max("cnt").alias("max_count"))
    out = cells.select("cell_id").join(own, "cell_id", "left").fillna(0, ["total", "n_genes", "max_count"])
    return out.withColumn("top_share", F.try_divide(F.col("max_count"), F.col("total")))


def gene_metrics(counts: DataFrame, genes: DataFrame, n_cells: int) -> DataFrame:
    """total, n_cells, mean and dropout_pct over all ``n_cells`` cells for every gene."""
    own = counts.groupBy("gene_id").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n_cells"))
    out = genes.select("gene_id").join(own, "gene_id", "left").fillna(0, ["total", "n_cells"])
    return out.select("gene_id", "total", "n_cells", (F.col("total") / n_cells).alias("mean"), (100 - 100 * F.col("n_cells") / n_cells).alias("dropout_pct"))


def gene_set_fraction(counts: DataFrame, gene_sets: DataFrame) -> DataFrame:
    """The share of each cell's counts in each gene set; sets without counts in a cell are left out.

    Counts are summed per cell and set before they meet the cells' totals.
    """
    inside = counts.join(gene_sets, "gene_id").groupBy("cell_id", "set_name").agg(F.sum("cnt").alias("in_set"))
    total = counts.groupBy("cell_id").agg(F.sum("cnt").alias("total"))
    return inside.join(total, "cell_id").select("cell_id", "set_name", "in_set", (F.col("in_set") / F.col("total")).alias("fraction"))


def top_k_share(counts: DataFrame, k: int) -> DataFrame:
    """The share of each cell's counts in its ``k`` largest genes."""
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("cnt"), "gene_id"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("cell_id").agg(F.sum("cnt").alias("top"))
    total = counts.groupBy("cell_id").agg(F.sum("cnt").alias("total"))
    return top.join(total, "cell_id").select("cell_id", "top", (F.col("top") / F.col("total")).alias("share"))


def keep_between(metrics: DataFrame, key: str, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """The keys whose metric lies between fixed thresholds, both inclusive."""
    ok = F.lit(True)
    if low is not None:
        ok &= F.col(column) >= low
    if high is not None:
        ok &= F.col(column) <= high
    return metrics.where(ok).select(key)


def filter_cells(counts: DataFrame, keep: DataFrame) -> DataFrame:
    return counts.join(keep, "cell_id", "left_semi")


def filter_genes(counts: DataFrame, keep: DataFrame) -> DataFrame:
    return counts.join(keep, "gene_id", "left_semi")


def mad_outliers(metrics: DataFrame, column: str, n_mads: float, by: str | None = None, scale: float = MAD_SCALE) -> DataFrame:
    """Adds median, mad and keep: whether the metric is within ``n_mads`` scaled MADs of its group's median."""
    group = [by] if by else []
    centre = quantiles(metrics, column, [0.5], by).select(*group, F.col("q_0").alias("median"))
    # One row per group, or one row.
    joined = metrics.join(centre, group) if by else metrics.crossJoin(centre)
    spread = quantiles(joined.withColumn("off_", F.abs(F.col(column) - F.col("median"))), "off_", [0.5], by).select(*group, F.col("q_0").alias("mad"))
    joined = joined.join(spread, group) if by else joined.crossJoin(spread)
    return joined.withColumn("keep", F.abs(F.col(column) - F.col("median")) <= n_mads * scale * F.col("mad"))


def downsample_cells(cells: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Cells kept by the first eight hex digits of md5('seed:id'): the same ones wherever and however it runs."""
    limit = f"{int(fraction * 0x100000000):08x}" if fraction < 1 else "g"
    return cells.where(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("cell_id").cast("string"))), 1, 8) < limit)


def qc_summary(metrics: DataFrame, by: str, keep: str = "keep") -> DataFrame:
    """Cells before and after, and their counts, for each group and (group null) in all."""
    kept = F.col(keep).cast("long")
    return metrics.rollup(by).agg(F.count(F.lit(1)).alias("n_before"), F.sum(kept).alias("n_after"), F.sum("total").alias("total_before"), F.sum(kept * F.col("total")).alias("total_after"))
