"""Tidy tables behind figures, and provenance. Nothing is drawn."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def violin_data(metrics: DataFrame, column: str, by: str) -> DataFrame:
    """Exact quantiles of a metric in each group."""
    found = quantiles(metrics, column, QUANTILES, by)
    return found.select(by, "n", *(F.col(f"q_{i}").alias(f"q{int(100 * q)}") for i, q in enumerate(QUANTILES)))


def hist_data(metrics: DataFrame, column: str, by: str, width: float) -> DataFrame:
    """Counts of fixed bins [bin, bin + width) in each group."""
    return metrics.groupBy(by, (F.floor(F.col(column) / width) * width).cast("double").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scatter_qc(metrics: DataFrame, fractions: DataFrame, set_name: str) -> DataFrame:
    """(cell_id, total, n_genes, fraction) with the fraction of one gene set."""
    one = fractions.where(F.col("set_name") == set_name).select("cell_id", "fraction")
    return metrics.select("cell_id", "total", "n_genes").join(one, "cell_id", "left").withColumn("fraction", F.coalesce("fraction", F.lit(0.0)))


def mean_variance(moments: DataFrame, hvgs: DataFrame) -> DataFrame:
    return moments.join(hvgs.select("gene_id", "dispersion", "is_hvg"), "gene_id", "left").withColumn("is_hvg", F.coalesce("is_hvg", F.lit(False)))


def elbow(explained: DataFrame) -> DataFrame:
    return explained.select((F.col("pc") + 1).alias("component"), "variance", "ratio")


def embedding_scatter(layout: DataFrame, labels: DataFrame) -> DataFrame:
    return layout.join(labels, "cell_id").select("cell_id", "x", "y", F.col("label").alias("cluster"))


def dotplot(means: DataFrame, genes: DataFrame) -> DataFrame:
    """mean_in and pct_in of chosen genes (gene_id) in each group."""
    return means.join(genes.select("gene_id").distinct(), "gene_id", "left_semi").select("grp", "gene_id", "mean_in", "pct_in")


def heatmap(means: DataFrame, genes: DataFrame) -> DataFrame:
    """Means of chosen genes as z-scores across all groups."""
    chosen = dotplot(means, genes)
    s = chosen.groupBy("gene_id").agg(F.avg("mean_in").alias("m"), F.stddev_samp("mean_in").alias("sd"))
    z = F.coalesce((F.col("mean_in") - F.col("m")) / F.nullif("sd", F.lit(0.0)), F.lit(0.0))
    return chosen.join(s, "gene_id").select("grp", "gene_id", z.alias("z"))


def volcano(tests: DataFrame, changes: DataFrame) -> DataFrame:
    """log_fc against -log10 q, from log_q where tests have it; else q = 0 is shown as 300."""
    y = -F.col("log_q") / math.log(10) if "log_q" in tests.columns else F.when(F.col("q") <= 1e-300, 300.0).otherwise(-F.log10("q"))
    return tests.join(changes, ["grp", "gene_id"]).select("grp", "gene_id", "log_fc", y.alias("neg_log10_q"))


def composition(labels: DataFrame, cells: DataFrame, batch: str) -> DataFrame:
    """Cells of each batch in each cluster, and their share of the cluster."""
    n = labels.join(cells.select("cell_id", batch), "cell_id").groupBy("label", batch).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("label").agg(F.sum("n").alias("all"))
    return n.join(total, "label").select("label", batch, "n", (F.col("n") / F.col("all")).alias("share"))


def _row_hash(df: DataFrame) -> list[Column]:
    row = F.xxhash64(*(F.to_json(F.struct(F.col(c).alias("v"))) for c in sorted(df.columns)))
    return [F.sum(row.cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")]


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows, whatever their order and partitioning: the sum of row hashes as a decimal, with their count."""
    out = df.agg(*_row_hash(df)).first()
    return f"{out['h'] or 0}:{out['n']}"


def fingerprinted(df: DataFrame, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """What ``store`` makes of ``df``, and its fingerprint, observed while it is stored: no second pass reads it."""
    seen = Observation()
    out = store(df.observe(seen, *_row_hash(df)))
    return out, f"{seen.get['h'] or 0}:{seen.get['n']}"


def provenance_row(spark: SparkSession, step: str, params: dict[str, object], source: str, result: str, run_id: str | None = None) -> DataFrame:
    """One row: run_id, step, params, input_fingerprint, output_fingerprint."""
    row = (run_id or uuid.uuid4().hex, step, {k: json.dumps(v, sort_keys=True) for k, v in params.items()}, source, result)
    return spark.createDataFrame([row], "run_id string, step string, params map<string,string>, input_fingerprint string, output_fingerprint string")


def provenance(spark: SparkSession, step: str, params: dict[str, object], source: DataFrame, result: DataFrame, run_id: str | None = None) -> DataFrame:
    """:func:`provenance_row` of two tables, each read once more."""
    return provenance_row(spark, step, params, fingerprint(source), fingerprint(result), run_id)
