"""The whole analysis on planted clusters: found, and the same under any partitioning."""

import numpy as np
from pyspark.sql import functions as F

from cytoframe.operators import cluster
from cytoframe.plans.pipeline import Params, Pipeline


def test_planted_clusters_are_found_again(spark):
    rng = np.random.default_rng(2)
    m = rng.poisson(1.0, (60, 24))
    for k in range(3):
        m[20 * k : 20 * k + 20, 8 * k : 8 * k + 8] += rng.poisson(12, (20, 8))
    rows = [(i, j, int(v)) for i, line in enumerate(m) for j, v in enumerate(line) if v]
    counts = spark.createDataFrame(rows, "cell_id long, gene_id long, cnt long")
    cells = spark.createDataFrame([(i, f"b{i % 2}") for i in range(60)], "cell_id long, batch string")
    genes = spark.createDataFrame([(j,) for j in range(24)], "gene_id long")
    params = Params(n_hvg=24, n_bins=1, n_pcs=3, n_neighbors=6, top_markers=4)
    first = Pipeline(spark).run(counts, cells, genes, params)
    truth = cells.select("cell_id", F.floor(F.col("cell_id") / 20).cast("int").alias("truth"))
    assert cluster.agreement(first["clusters"], truth).first().purity >= 0.95
    kept = {r.cell_id for r in first["metrics"].where("keep").collect()}
    assert {r.cell_id for r in first["clusters"].collect()} == kept
    assert first["markers"].count() == 4 * first["clusters"].select("label").distinct().count()
    again = Pipeline(spark).run(counts.repartition(7), cells.repartition(3), genes, params)
    prints = [sorted((r.step, r.output_fingerprint) for r in x["provenance"].collect()) for x in (first, again)]
    assert prints[0] == prints[1] and len(prints[0]) == 8
    laid = Pipeline(spark).run(counts, cells, genes, Params(n_hvg=24, n_bins=1, n_pcs=3, n_neighbors=6, top_markers=4, layout="neighbors"))
    steps = {r.step: r.output_fingerprint for r in laid["provenance"].collect()}
    assert set(prints[0]) <= set(steps.items()) and steps.keys() - dict(prints[0]).keys() == {"layout"}
    chart = laid["chart_embedding"].collect()
    assert {r.cell_id for r in chart} == kept and [(r.x, r.y) for r in chart] != [(r.x, r.y) for r in first["chart_embedding"].collect()]
