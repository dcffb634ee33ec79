"""The analysis from a matrix to tables and chart data, as one object."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cuts import stored
from ..functions.shipping import ship
from ..operators import cluster, de, norm, outputs, qc, reduce


@dataclass(frozen=True)
class Params:
    min_genes: int = 1
    min_cells: int = 1
    n_mads: float = 5.0
    scale: float = 1e4
    n_hvg: int = 2_000
    n_bins: int = 20
    n_pcs: int = 20
    n_neighbors: int = 15
    #: ``exact`` (all pairs), or ``descent`` for tables of which that is too much.
    neighbors: str = "exact"
    #: ``leiden`` or ``louvain``.
    communities: str = "leiden"
    resolution: float = 1.0
    #: ``components`` (the first two), or ``neighbors`` for a layout that draws neighbours together.
    layout: str = "components"
    top_markers: int = 20


@dataclass
class Result:
    """Tables by name; ``provenance`` has a row for each step."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, folder: str, fmt: str = "parquet") -> None:
        """One folder for each table that the format can hold."""
        for name, df in self.tables.items():
            df.write.format(fmt).mode("overwrite").save(f"{folder}/{name}")


class Pipeline:
    """Quality control, normalization, variable genes, PCA, neighbours, clusters, markers and chart data.

    ``counts``: cell_id, gene_id, cnt. ``cells``: cell_id and ``batch``. ``genes``: gene_id. The driver holds
    what is bounded by ``n_hvg`` and ``n_pcs``; everything that has a row per cell stays distributed.
    """

    def __init__(self, spark: SparkSession, batch: str = "batch") -> None:
        self.spark, self.batch = spark, batch

    def run(self, counts: DataFrame, cells: DataFrame, genes: DataFrame, params: Params = Params()) -> Result:
        ship(self.spark)
        out, steps = Result(), []
        prints = {id(counts): outputs.fingerprint(counts)}  # what a step has stored was hashed on its way

        def step(name: str, source: DataFrame, result: DataFrame, *used: str) -> DataFrame:
            """Stores a step's result; its row of provenance has the parameters that it used."""
            table, found = outputs.fingerprinted(result, lambda df: stored(df, name))
            prints[id(table)] = found
            chosen = {k: v for k, v in asdict(params).items() if k in used}
            steps.append(outputs.provenance_row(self.spark, name, chosen, prints[id(source)], found, run_id="run"))
            return table

        metrics = qc.cell_metrics(counts, cells).join(cells.select("cell_id", self.batch), "cell_id")
        judged = qc.mad_outliers(metrics, "total", params.n_mads, by=self.batch)
        metrics = step("cell_metrics", counts, judged.withColumn("keep", F.col("keep") & (F.col("n_genes") >= params.min_genes)), "n_mads", "min_genes")
        keep = metrics.where("keep").select("cell_id")
        kept_cells = cells.join(keep, "cell_id", "left_semi")
        n = keep.count()
        kept = qc.filter_cells(counts, keep)
        kept = step("filter", counts, qc.filter_genes(kept, qc.keep_between(qc.gene_metrics(kept, genes, n), "gene_id", "n_cells", params.min_cells)), "min_cells")

        layer = step("log_norm", kept, norm.log_norm(kept, params.scale).withColumn("v", F.round("v", 9)), "scale")
        moments = norm.gene_moments(layer, n)
        variable = step("variable_genes", layer, norm.hvg(moments, params.n_hvg, params.n_bins), "n_hvg", "n_bins")
        chosen = sorted(r["gene_id"] for r in variable.where("is_hvg").select("gene_id").collect())
        k = min(params.n_pcs, len(chosen))
        loadings, variances, mean = reduce.pca(layer, chosen, n, k)
        table = reduce.loadings_table(layer, chosen, loadings, mean)
        scores = step("scores", layer, reduce.project(layer, table, kept_cells).withColumn("score", F.round("score", 6) + 0.0), "n_pcs")
        emb = scores.groupBy("cell_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pc", "score"))), lambda e: e["score"]).alias("vec"))

        search = {"exact": reduce.knn, "descent": reduce.knn_descent}[params.neighbors]
        near = step("neighbors", scores, search(emb, params.n_neighbors, "euclidean"), "n_neighbors", "neighbors")
        graph = near.select(F.least("cell_id", "neighbor").alias("i"), F.greatest("cell_id", "neighbor").alias("j")).distinct().withColumn("w", F.lit(1.0))
        divide = {"leiden": cluster.leiden, "louvain": cluster.louvain}[params.communities]
        found = divide(graph, params.resolution).select(F.col("node").alias("cell_id"), "label")
        labels = step("clusters", near, cluster.relabel_by_size(found), "resolution", "communities")

        if params.layout not in ("components", "neighbors"):
            raise ValueError(f"unknown layout {params.layout}")
        layout = reduce.layout_2d(scores)
        if params.layout == "neighbors":
            layout = step("layout", near, reduce.layout_neighbors(near, layout), "layout")

        groups = labels.select("cell_id", F.col("label").cast("string").alias("grp"))
        tests = step("tests", layer, de.bh_adjust(de.wilcoxon(layer, groups)))
        top = de.markers(tests, params.top_markers)
        means = de.group_means(layer, groups)
        spread = self.spark.createDataFrame([(i, float(v), float(v / (variances.sum() or 1.0))) for i, v in enumerate(variances)], "pc int, variance double, ratio double")
        out.tables = {
            "metrics": metrics, "counts": kept, "layer": layer, "variable_genes": variable, "loadings": table, "scores": scores, "neighbors": near, "clusters": labels, "tests": tests, "markers": top,
            "chart_violin": outputs.violin_data(metrics, "total", self.batch), "chart_hist": outputs.hist_data(metrics, "total", self.batch, 100), "chart_mean_variance": outputs.mean_variance(moments, variable),
            "chart_elbow": outputs.elbow(spread), "chart_embedding": outputs.embedding_scatter(layout, labels), "chart_dotplot": outputs.dotplot(means, top), "chart_heatmap": outputs.heatmap(means, top),
            "chart_volcano": outputs.volcano(tests, de.log_fc(layer, groups)), "chart_composition": outputs.composition(labels, kept_cells, self.batch),
        }
        rows = steps[0]
        for more in steps[1:]:
            rows = rows.unionByName(more)
        out.tables["provenance"] = rows
        return out
