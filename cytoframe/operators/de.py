"""Differential expression, one group against the rest, with implicit zeros and without densifying."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cuts import stored
from ..functions.running import running_counts


def _grid(own: DataFrame, total: DataFrame, groups: DataFrame) -> DataFrame:
    """``own`` with a row for each group and each gene of ``total``, 0 where a group has no stored entry, and n1, n2, n_all.

    The groups (few; one row holds them all) are spread over the genes: the rows are those of the result.
    """
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n1"))
    everyone = sizes.agg(F.collect_list(F.struct("grp", "n1")).alias("sizes"), F.sum("n1").alias("n_all"))  # one row
    spread = total.crossJoin(everyone).withColumn("of", F.explode("sizes")).select(*total.columns, "of.grp", "of.n1", "n_all")
    sums = [c for c in own.columns if c not in ("grp", "gene_id")]
    out = spread.join(own, ["grp", "gene_id"], "left").fillna(0, sums)
    return out.withColumn("n2", F.col("n_all") - F.col("n1"))


def _inside_outside(layer: DataFrame, groups: DataFrame, *sums: Column) -> DataFrame:
    """Sums of each gene that occurs in each group, those over all cells beside them (all_*), n1, n2 and n_all."""
    own = layer.join(groups, "cell_id").groupBy("grp", "gene_id").agg(*sums)
    # "Rest" is total minus group: totals come from the groups' sums, not from another pass over the layer.
    total = own.groupBy("gene_id").agg(*(F.sum(c).alias(f"all_{c}") for c in own.columns[2:]))
    return _grid(own, total, groups)


def group_means(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """mean_in and pct_in of each gene that occurs in each group (cell_id, grp), over all the group's cells."""
    s = _inside_outside(layer, groups, F.sum("v").alias("s"), F.count(F.lit(1)).alias("nnz"))
    return s.select("grp", "gene_id", (F.col("s") / F.col("n1")).alias("mean_in"), (100 * F.col("nnz") / F.col("n1")).alias("pct_in"))


def log_fc(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """mean_in, mean_out and their difference for each group and each gene that occurs."""
    s = _inside_outside(layer, groups, F.sum("v").alias("s"))
    inside, outside = F.col("s") / F.col("n1"), F.try_divide(F.col("all_s") - F.col("s"), F.col("n2"))
    return s.select("grp", "gene_id", inside.alias("mean_in"), outside.alias("mean_out"), (inside - outside).alias("log_fc"))


#: From here on the tail is a continued fraction, below it one less a series; and terms of both.
_SERIES_UP_TO, _TERMS = 3.0, 48
_LOG_SQRT_2PI = 0.5 * math.log(2 * math.pi)


def normal_log_p(z: Column) -> Column:
    """ln of the two-sided p of a normal statistic, with a relative error of p under 1e-9 however far out it lies.

    Up to 3 it is ln(1 - 2 phi(z) (z + z^3 / 3 + z^5 / 15 + ..)); beyond, Q(z) = phi(z) / (z + 1 / (z + 2 / (z + 3 / ..))),
    of which the logarithm is taken factor by factor, so that nothing underflows.
    """
    a = F.abs(z)
    near, far = F.least(a, F.lit(_SERIES_UP_TO)), F.greatest(a, F.lit(_SERIES_UP_TO))
    # From the last term inwards: a * (1 + a^2 / 3 * (1 + a^2 / 5 * (..))).
    series = F.aggregate(F.sequence(F.lit(2 * _TERMS + 1), F.lit(3), F.lit(-2)), F.lit(1.0), lambda rest, k: 1 + near * near / k * rest)
    inside = F.log1p(-2 * F.exp(-near * near / 2 - _LOG_SQRT_2PI) * near * series)
    fraction = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), far, lambda rest, k: far + k / rest)
    outside = math.log(2) - far * far / 2 - _LOG_SQRT_2PI - F.log(fraction)
    return F.when(a.isNull(), F.lit(None)).when(a <= _SERIES_UP_TO, inside).otherwise(outside)


def normal_p(z: Column) -> Column:
    """Two-sided p of a normal statistic (see :func:`normal_log_p`); 0 where it is below the least double."""
    return F.exp(normal_log_p(z))


def wilcoxon(layer: DataFrame, groups: DataFrame, digits: int = 6) -> DataFrame:
    """Rank-sum of each group against the rest for each gene that occurs: u, z (tie-corrected, no continuity correction), p and log_p.

    Values are rounded before ranking and may be negative, as centred or scaled ones are; null ones count
    as zeros. Only non-zeros are ranked: the block of zeros stands between negative and positive values
    with a rank in closed form. Ranks come from counts of different values, and those of a gene with very many are
    summed up in ranges (see :func:`~..functions.running.running_counts`), so no gene is one task.
    """
    rows = layer.select("cell_id", "gene_id", F.round("v", digits).alias("v")).where("v <> 0").join(groups, "cell_id")
    by_group = stored(rows.groupBy("gene_id", "v", "grp").agg(F.count(F.lit(1)).alias("n")), "values")
    by_value = stored(by_group.groupBy("gene_id", "v").agg(F.sum("n").alias("tie")), "ties")  # ranks and totals take several passes
    ranked = running_counts(by_value, ["gene_id"], "v", "tie").select("gene_id", "v", (F.col("before") + (F.col("tie") + 1) / 2).alias("rank"))
    tie = F.col("tie").cast("double")
    per_gene = by_value.groupBy("gene_id").agg(F.sum("tie").alias("nnz"), F.sum(tie * tie * tie - tie).alias("ties"), F.sum(F.when(F.col("v") < 0, F.col("tie")).otherwise(0)).alias("negative"))
    positive = F.when(F.col("v") > 0, F.col("n")).otherwise(0)
    inside = by_group.join(ranked, ["gene_id", "v"]).groupBy("grp", "gene_id").agg(F.sum(F.col("n") * F.col("rank")).alias("r"), F.sum("n").alias("nnz1"), F.sum(positive).alias("above"))
    s = _grid(inside, per_gene, groups)
    n1, n2, n, z0 = F.col("n1").cast("double"), F.col("n_all") - F.col("n1"), F.col("n_all").cast("double"), (F.col("n_all") - F.col("nnz")).cast("double")
    rank_sum = F.col("r") + F.col("above") * z0 + (n1 - F.col("nnz1")) * (F.col("negative") + (z0 + 1) / 2)
    u = rank_sum - n1 * (n1 + 1) / 2
    t = F.col("ties") + z0 * z0 * z0 - z0
    variance = n1 * n2 / 12 * ((n + 1) - t / F.nullif(n * (n - 1), F.lit(0.0)))
    z = F.when(variance > 1e-12, (u - n1 * n2 / 2) / F.sqrt(F.greatest(variance, F.lit(1e-12)))).otherwise(0.0)
    return s.withColumn("u", u).withColumn("z", z).withColumn("log_p", normal_log_p(F.col("z"))).select("grp", "gene_id", "u", "z", F.exp("log_p").alias("p"), "log_p")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function of positive numbers: Stirling's series eight steps up, and back down by the recurrence."""
    y = x + 8
    down = np.log(x)
    for k in range(1, 8):
        down = down + np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - down


def _fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, by Lentz's method on whole columns."""
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(x), 1 / safe(1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / safe(1 + k * d)
            c = safe(1 + k / c)
            out = out * c * d
        if (np.abs(c * d - 1) < 1e-14).all():
            break
    return out


def t_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t; not a number where t or its degrees of freedom aren't."""
    ok = (df > 0) & np.isfinite(t) & np.isfinite(df)
    t, df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    x, a, b = df / (df + t * t), df / 2, np.full(len(t), 0.5)
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inside) + b * np.log1p(-inside))
    near = x < (a + 1) / (a + b + 2)
    tail = front * _fraction(np.where(near, inside, 1 - inside), np.where(near, a, b), np.where(near, b, a)) / np.where(near, a, b)
    return np.where(ok, np.where(x >= 1, 1.0, np.where(near, tail, 1 - tail)), np.nan)


def _t_tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        p = t_tail(pdf["t"].to_numpy(np.float64), pdf["df"].to_numpy(np.float64)) if len(pdf) else []
        yield pdf.assign(p=pd.array(p, "Float64") if len(pdf) else pd.Series([], dtype="float64"))


def welch_statistic(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """Welch's t and its degrees of freedom from n, sums and sums of squares, zeros included; null where both variances are 0."""
    s = _inside_outside(layer, groups, F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    s2, q2 = F.col("all_s") - F.col("s"), F.col("all_q") - F.col("q")
    v1 = F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("s") * F.col("s") / n1, n1 - 1)) / n1
    v2 = F.greatest(F.lit(0.0), F.try_divide(q2 - F.try_divide(s2 * s2, n2), n2 - 1)) / n2
    moments = s.select("grp", "gene_id", "n1", "n2", (F.col("s") / n1 - F.try_divide(s2, n2)).alias("difference"), v1.alias("v1"), v2.alias("v2"))
    spread = F.when(F.col("v1") + F.col("v2") > 1e-12, F.col("v1") + F.col("v2"))
    df = spread * spread / (F.try_divide(F.col("v1") * F.col("v1"), F.col("n1") - 1.0) + F.try_divide(F.col("v2") * F.col("v2"), F.col("n2") - 1.0))
    return moments.select("grp", "gene_id", (F.col("difference") / F.sqrt(spread)).alias("t"), df.alias("df"))


def welch_t(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """Welch's t-test with two-sided p, null where t is."""
    tested = welch_statistic(layer, groups).mapInPandas(_t_tails, "grp string, gene_id long, t double, df double, p double")
    return tested.withColumn("p", F.when(~F.isnan("p"), F.col("p"))).withColumn("t", F.when(~F.isnan("t"), F.col("t"))).withColumn("df", F.when(~F.isnan("df"), F.col("df")))


def pseudobulk(counts: DataFrame, cells: DataFrame, by: str) -> DataFrame:
    """Counts summed over the cells of each sample."""
    return counts.join(cells.select("cell_id", by), "cell_id").groupBy(by, "gene_id").agg(F.sum("cnt").alias("cnt"))


def bh_adjust(tests: DataFrame, by: str = "grp", p: str = "p") -> DataFrame:
    """Adds q (Benjamini-Hochberg within ``by``); equal p-values share the largest rank among them.

    Where there is a column ``log_p``, it is what is ranked, and log_q is added too: values of p too small for
    a double stay apart.
    """
    group, logs = Window.partitionBy(by), "log_p" in tests.columns and p == "p"
    order = "log_p" if logs else p
    ranked = tests.withColumn("rank_", F.count(F.lit(1)).over(group.orderBy(order))).withColumn("m_", F.count(F.lit(1)).over(group))
    downward = group.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    if logs:
        log_q = F.least(F.lit(0.0), F.min(F.col("log_p") + F.log(F.col("m_") / F.col("rank_"))).over(downward))
        return ranked.withColumn("log_q", log_q).withColumn("q", F.exp("log_q")).drop("rank_", "m_")
    raw = F.min(F.col(p) * F.col("m_") / F.col("rank_")).over(downward)
    return ranked.withColumn("q", F.least(F.lit(1.0), raw)).drop("rank_", "m_")


def markers(tests: DataFrame, top_n: int, score: str = "z", digits: int = 6) -> DataFrame:
    """The ``top_n`` genes of each group by score, ties by gene."""
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "gene_id"))
    return tests.select("grp", "gene_id", F.round(score, digits).alias("score")).withColumn("rank", rank).where(F.col("rank") <= top_n)


def chisq_pct(layer: DataFrame, groups: DataFrame) -> DataFrame:
    """Chi-squared, for each gene that occurs, of detection (non-zero or not) against group, one degree of freedom, no continuity correction."""
    s = _inside_outside(layer, groups, F.count(F.lit(1)).cast("double").alias("a"))
    a, c = F.col("a"), F.col("all_a") - F.col("a")
    b, d = F.col("n1") - a, F.col("n2") - c
    n = F.col("n_all").cast("double")
    chi2 = F.coalesce(F.try_divide(n * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d)), F.lit(0.0))
    return s.select("grp", "gene_id", chi2.alias("chi2")).withColumn("p", normal_p(F.sqrt("chi2")))
