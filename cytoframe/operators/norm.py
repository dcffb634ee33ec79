"""Normalization. A layer is (cell_id, gene_id, v) with f(0) = 0, so it stays sparse; statistics add the zeros back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles


def cell_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("cnt").alias("total"))


def size_factors(counts: DataFrame, target: float | str = "median") -> DataFrame:
    """total / target for each cell with counts; ``median``: the median total."""
    totals = cell_totals(counts)
    if target != "median":
        return totals.select("cell_id", (F.col("total") / float(target)).alias("size_factor"))
    middle = quantiles(totals, "total", [0.5]).select(F.col("q_0").alias("target"))  # one row
    return totals.crossJoin(middle).select("cell_id", (F.col("total") / F.col("target")).alias("size_factor"))


def _scaled(counts: DataFrame, scale: float) -> DataFrame:
    """x = cnt * scale / total; totals meet the counts by their key and are not broadcast, as they grow with the cells."""
    return counts.join(cell_totals(counts), "cell_id").select("cell_id", "gene_id", "cnt", (F.col("cnt") * scale / F.col("total")).alias("x"))


def log_norm(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """v = ln(1 + cnt * scale / total)"""
    return _scaled(counts, scale).select("cell_id", "gene_id", F.log1p("x").alias("v"))


def cpm(counts: DataFrame) -> DataFrame:
    """v = cnt * 1e6 / total"""
    return _scaled(counts, 1e6).select("cell_id", "gene_id", F.col("x").alias("v"))


def gene_moments(layer: DataFrame, n_cells: int) -> DataFrame:
    """mean and sample variance of each gene that occurs, over all ``n_cells`` cells."""
    sums = layer.groupBy("gene_id").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    mean = F.col("s1") / n_cells
    variance = F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / n_cells) / max(1, n_cells - 1))
    return sums.select("gene_id", mean.alias("mean"), variance.alias("variance"))


def scale(layer: DataFrame, moments: DataFrame, max_value: float | None = None) -> DataFrame:
    """Z-scores of the stored entries; an implicit zero's is -mean / sd (see ``zero_score``), kept apart so that nothing densifies."""
    sd = F.sqrt("variance")
    z = (F.col("v") - F.col("mean")) / F.nullif(sd, F.lit(0.0))
    zero = -F.col("mean") / F.nullif(sd, F.lit(0.0))
    if max_value is not None:
        z, zero = (F.greatest(F.least(x, F.lit(max_value)), F.lit(-max_value)) for x in (z, zero))
    return layer.join(moments, "gene_id").select("cell_id", "gene_id", F.coalesce(z, F.lit(0.0)).alias("z"), F.coalesce(zero, F.lit(0.0)).alias("zero_score"))


def hvg(moments: DataFrame, n: int, n_bins: int = 20, digits: int = 9) -> DataFrame:
    """Highly variable genes: ln(variance / mean) as a z-score within bins of equal numbers of genes by mean.

    Returns gene_id, mean, variance, bin, dispersion (the z-score), rank, is_hvg. Values are rounded before
    they are ranked, so that the order does not hang on the last bit.
    """
    some = moments.where("mean > 0 and variance > 0").select("gene_id", F.round("mean", digits).alias("mean"), F.round("variance", digits).alias("variance"))
    some = some.where("mean > 0 and variance > 0").withColumn("d", F.log(F.col("variance") / F.col("mean")))
    binned = some.withColumn("bin", F.ntile(n_bins).over(Window.orderBy("mean", "gene_id")))  # a row per gene
    within = Window.partitionBy("bin")
    z = (F.col("d") - F.avg("d").over(within)) / F.nullif(F.stddev_samp("d").over(within), F.lit(0.0))
    scored = binned.withColumn("dispersion", F.round(F.coalesce(z, F.lit(0.0)), 6))
    rank = F.row_number().over(Window.orderBy(F.desc("dispersion"), "gene_id"))
    return scored.withColumn("rank", rank).select("gene_id", "mean", "variance", "bin", "dispersion", "rank", (F.col("rank") <= n).alias("is_hvg"))


def regress_out(layer: DataFrame, covariate: DataFrame, n_cells: int) -> DataFrame:
    """Residuals of each gene on one covariate (cell_id, x) over all cells, zeros included, for the stored entries.

    Sums over the stored entries and over all cells give slope and intercept; no zero is made.
    """
    total = covariate.agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))  # one row
    joined = layer.join(covariate, "cell_id")
    sums = joined.groupBy("gene_id").agg(F.sum("v").alias("sy"), F.sum(F.col("v") * F.col("x")).alias("sxy")).crossJoin(total)
    slope = F.coalesce((n_cells * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(n_cells * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0)), F.lit(0.0))
    lines = sums.withColumn("slope", slope).select("gene_id", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / n_cells).alias("intercept"))
    return joined.join(lines, "gene_id").select("cell_id", "gene_id", (F.col("v") - F.col("intercept") - F.col("slope") * F.col("x")).alias("residual"), "slope", "intercept")


def batch_center(layer: DataFrame, cells: DataFrame, batch: str = "batch") -> DataFrame:
    """The stored entries minus the gene's mean in the cell's batch, zeros included."""
    sizes = cells.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))
    tagged = layer.join(cells.select("cell_id", batch), "cell_id")
    means = tagged.groupBy(batch, "gene_id").agg(F.sum("v").alias("s")).join(sizes, batch).select(batch, "gene_id", (F.col("s") / F.col("n")).alias("batch_mean"))
    return tagged.join(means, [batch, "gene_id"]).select("cell_id", "gene_id", (F.col("v") - F.col("batch_mean")).alias("centered"))
