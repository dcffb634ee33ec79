"""One query for each operator, over the driver's tables, and the same in SQL where SQL can say it.

Cells are customers, genes are parts, counts are quantities bought; text queries have
documents as cells and words as genes; graphs and embeddings come from ``embeddings``.
Doubles are rounded, as the last bits of sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cuts import shared_path, stored
from ..operators import cluster, de, norm, outputs, qc, reduce
from ..sources import canonicalize, matrix_from_events, matrix_from_text, read_long, read_matrix, read_wide, write_mtx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    items, orders = _table(spark, d, "lineitem"), _table(spark, d, "orders")
    return items.join(orders, items.l_orderkey == orders.o_orderkey)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix_from_events(_events(spark, d), "o_custkey", "l_partkey", "l_quantity")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("batch"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).select("cell_id", F.col("batch").alias("grp"))


def _genes(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_partkey").alias("gene_id"), F.col("p_name").alias("gene_name"))


def _gene_sets(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "part").select(F.col("p_type").alias("set_name"), F.col("p_partkey").alias("gene_id"))


def _layer(spark: SparkSession, d: str) -> DataFrame:
    return norm.log_norm(_counts(spark, d))


def _emb(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between embeddings and their five nearest, each pair once, weight 1."""
    near = reduce.knn(_emb(spark, d), 5)
    return near.select(F.least("cell_id", "neighbor").alias("i"), F.greatest("cell_id", "neighbor").alias("j")).distinct().withColumn("w", F.lit(1.0))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label"))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


_BASE = """WITH counts AS (SELECT o_custkey AS cell_id, l_partkey AS gene_id, CAST(sum(l_quantity) AS BIGINT) AS cnt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cells AS (SELECT c_custkey AS cell_id, c_mktsegment AS batch, c_nationkey AS nation, c_acctbal AS x FROM customer),
genes AS (SELECT p_partkey AS gene_id FROM part), sets AS (SELECT p_type AS set_name, p_partkey AS gene_id FROM part),
totals AS (SELECT cell_id, CAST(sum(cnt) AS BIGINT) AS total FROM counts GROUP BY 1),
nc AS (SELECT count(*) AS n FROM cells)"""
_LAYER = _BASE + """, layer AS (SELECT cell_id, gene_id, ln(1 + cnt * 1e4 / CAST(total AS DOUBLE)) AS v FROM counts JOIN totals USING (cell_id))"""
_METRICS = _BASE + """, own AS (SELECT cell_id, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n_genes, max(cnt) AS max_count FROM counts GROUP BY 1),
metrics AS (SELECT cell_id, coalesce(total, 0) AS total, coalesce(n_genes, 0) AS n_genes, coalesce(max_count, 0) AS max_count, batch FROM cells LEFT JOIN own USING (cell_id))"""
_MOMENTS = _LAYER + """, moments AS (SELECT gene_id, sum(v) / n AS mean, greatest(0, (sum(v * v) - sum(v) * sum(v) / n) / (n - 1)) AS variance FROM layer, nc GROUP BY gene_id, n)"""
_EMB = """WITH emb AS (SELECT vec_id AS cell_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"""
_KNN = _EMB + """, sims AS (SELECT a.cell_id, b.cell_id AS neighbor, round(list_cosine_similarity(a.vec, b.vec), 6) + 0.0 AS similarity FROM emb a, emb b WHERE a.cell_id <> b.cell_id),
near AS (SELECT * FROM (SELECT cell_id, neighbor, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY similarity DESC, neighbor) AS INTEGER) AS rank, similarity FROM sims) WHERE rank <= 5)"""
_GRAPH = _KNN + """, graph AS (SELECT DISTINCT least(cell_id, neighbor) AS i, greatest(cell_id, neighbor) AS j, 1.0::DOUBLE AS w FROM near)"""
_EDGES = _GRAPH + """, edges AS (SELECT i AS node, j AS other, w FROM graph UNION ALL SELECT j, i, w FROM graph)"""


# ---- ingest

@query("SELECT l_orderkey AS cell_id, l_partkey AS gene_id, CAST(l_quantity AS BIGINT) AS cnt FROM lineitem WHERE l_quantity <> 0")
def i1_read_long(spark, d):
    return read_long(spark, f"{d}/lineitem.parquet", "l_orderkey", "l_partkey", "l_quantity")


@query("SELECT doc_id AS cell_id, 'quality' AS gene_name, CAST(quality AS BIGINT) AS cnt FROM labels WHERE quality <> 0 UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS BIGINT) FROM labels WHERE toxic <> 0")
def i2_read_wide(spark, d):
    return read_wide(spark, f"{d}/labels.parquet", "doc_id")


@query(_BASE + " SELECT * FROM counts")
def i3_read_mtx(spark, d):
    """The matrix written as a Matrix Market folder, in parts, and read back by the data source; ids there begin at 1."""
    counts = _counts(spark, d).select((F.col("cell_id") + 1).alias("cell_id"), (F.col("gene_id") + 1).alias("gene_id"), "cnt")
    size = counts.agg(F.max("cell_id"), F.max("gene_id")).first()
    path = shared_path(spark, "matrix.mtx")
    write_mtx(counts, size[0], size[1], path)
    return read_matrix(spark, path, partition_bytes=1 << 20).select((F.col("cell_id") - 1).alias("cell_id"), (F.col("gene_id") - 1).alias("gene_id"), "cnt")


@query("SELECT l_orderkey AS cell_id, l_partkey AS gene_id, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem GROUP BY 1, 2")
def i4_canonicalize(spark, d):
    return canonicalize(read_long(spark, f"{d}/lineitem.parquet", "l_orderkey", "l_partkey", "l_quantity"))


@query(_BASE + " SELECT * FROM counts")
def i5_matrix_from_events(spark, d):
    return _counts(spark, d)


@query("SELECT doc_id AS cell_id, w AS gene_name, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2")
def i6_matrix_from_text(spark, d):
    return matrix_from_text(_table(spark, d, "documents"))


# ---- quality control

@query(_METRICS + " SELECT cell_id, total, n_genes, max_count, round(max_count / CAST(nullif(total, 0) AS DOUBLE), 6) AS top_share FROM metrics")
def q1_cell_metrics(spark, d):
    return _rounded(qc.cell_metrics(_counts(spark, d), _cells(spark, d)))


@query(_BASE + """ SELECT gene_id, coalesce(total, 0) AS total, coalesce(n_cells, 0) AS n_cells, round(coalesce(total, 0) / CAST(n AS DOUBLE), 6) AS mean, round(100 - 100 * coalesce(n_cells, 0) / CAST(n AS DOUBLE), 6) AS dropout_pct
FROM genes LEFT JOIN (SELECT gene_id, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS n_cells FROM counts GROUP BY 1) USING (gene_id), nc""")
def q2_gene_metrics(spark, d):
    return _rounded(qc.gene_metrics(_counts(spark, d), _genes(spark, d), _cells(spark, d).count()))


@query(_BASE + " SELECT cell_id, set_name, CAST(sum(cnt) AS BIGINT) AS in_set, round(sum(cnt) / CAST(max(total) AS DOUBLE), 6) AS fraction FROM counts JOIN sets USING (gene_id) JOIN totals USING (cell_id) GROUP BY 1, 2")
def q3_gene_set_fraction(spark, d):
    return _rounded(qc.gene_set_fraction(_counts(spark, d), _gene_sets(spark, d)))


@query(_BASE + " SELECT cell_id, CAST(sum(cnt) AS BIGINT) AS top, round(sum(cnt) / CAST(max(total) AS DOUBLE), 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY cnt DESC, gene_id) AS r FROM counts) JOIN totals USING (cell_id) WHERE r <= 10 GROUP BY 1")
def q4_top_k_share(spark, d):
    return _rounded(qc.top_k_share(_counts(spark, d), 10))


@query(_METRICS + " SELECT counts.* FROM counts WHERE cell_id IN (SELECT cell_id FROM metrics WHERE n_genes BETWEEN 20 AND 60)")
def q5_filter_cells(spark, d):
    counts = _counts(spark, d)
    return qc.filter_cells(counts, qc.keep_between(qc.cell_metrics(counts, _cells(spark, d)), "cell_id", "n_genes", 20, 60))


@query(_BASE + " SELECT counts.* FROM counts WHERE gene_id IN (SELECT gene_id FROM counts GROUP BY 1 HAVING count(*) >= 30)")
def q5_filter_genes(spark, d):
    counts = _counts(spark, d)
    return qc.filter_genes(counts, qc.keep_between(qc.gene_metrics(counts, _genes(spark, d), _cells(spark, d).count()), "gene_id", "n_cells", 30))


@query(_METRICS + """, c AS (SELECT batch, median(total) AS median FROM metrics GROUP BY 1), m AS (SELECT batch, median(abs(total - median)) AS mad FROM metrics JOIN c USING (batch) GROUP BY 1)
SELECT cell_id, total, CAST(median AS DOUBLE) AS median, CAST(mad AS DOUBLE) AS mad, abs(total - median) <= 3 * 1.4826::DOUBLE * mad AS keep FROM metrics JOIN c USING (batch) JOIN m USING (batch)""")
def q6_mad_outliers(spark, d):
    metrics = qc.cell_metrics(_counts(spark, d), _cells(spark, d)).join(_cells(spark, d).select("cell_id", "batch"), "cell_id")
    return _rounded(qc.mad_outliers(metrics, "total", 3, by="batch").select("cell_id", "total", "median", "mad", "keep"))


@query("SELECT c_custkey AS cell_id FROM customer WHERE substr(md5('7:' || c_custkey), 1, 8) < '40000000'")
def q7_downsample_cells(spark, d):
    return qc.downsample_cells(_cells(spark, d), 0.25, 7).select("cell_id")


@query(_METRICS + """ SELECT batch, count(*) AS n_before, CAST(sum(CASE WHEN n_genes >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_after, CAST(sum(total) AS BIGINT) AS total_before, CAST(sum(CASE WHEN n_genes >= 30 THEN total ELSE 0 END) AS BIGINT) AS total_after FROM metrics GROUP BY ROLLUP (batch)""")
def q8_qc_summary(spark, d):
    metrics = qc.cell_metrics(_counts(spark, d), _cells(spark, d)).join(_cells(spark, d).select("cell_id", "batch"), "cell_id")
    return qc.qc_summary(metrics.withColumn("keep", F.col("n_genes") >= 30), "batch")


# ---- normalization

@query(_BASE + " SELECT cell_id, round(total / (SELECT CAST(median(total) AS DOUBLE) FROM totals), 6) AS size_factor FROM totals")
def n1_size_factors(spark, d):
    return _rounded(norm.size_factors(_counts(spark, d)))


@query(_LAYER + " SELECT cell_id, gene_id, round(v, 6) AS v FROM layer")
def n2_log_norm(spark, d):
    return _rounded(_layer(spark, d))


@query(_BASE + " SELECT cell_id, gene_id, round(cnt * 1e6 / CAST(total AS DOUBLE), 4) AS v FROM counts JOIN totals USING (cell_id)")
def n3_cpm(spark, d):
    return _rounded(norm.cpm(_counts(spark, d)), 4)


@query(_MOMENTS + " SELECT gene_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM moments")
def n4_gene_moments(spark, d):
    return _rounded(norm.gene_moments(_layer(spark, d), _cells(spark, d).count()))


@query(_MOMENTS + """ SELECT cell_id, gene_id, round(least(coalesce((v - mean) / nullif(sqrt(variance), 0), 0), 10), 5) + 0.0 AS z, round(greatest(coalesce(-mean / nullif(sqrt(variance), 0), 0), -10), 5) + 0.0 AS zero_score FROM layer JOIN moments USING (gene_id)""")
def n5_scale(spark, d):
    layer = _layer(spark, d)
    return _rounded(norm.scale(layer, norm.gene_moments(layer, _cells(spark, d).count()), 10.0), 5)


_HVG = _MOMENTS + """, cand AS (SELECT gene_id, round(mean, 9) AS mean, round(variance, 9) AS variance FROM moments WHERE round(mean, 9) > 0 AND round(variance, 9) > 0),
binned AS (SELECT *, ln(variance / mean) AS dd, CAST(ntile(20) OVER (ORDER BY mean, gene_id) AS INTEGER) AS bin FROM cand),
scored AS (SELECT gene_id, mean, variance, bin, round(coalesce((dd - avg(dd) OVER (PARTITION BY bin)) / nullif(stddev_samp(dd) OVER (PARTITION BY bin), 0), 0), 6) AS dispersion FROM binned),
hvg AS (SELECT *, CAST(row_number() OVER (ORDER BY dispersion DESC, gene_id) AS INTEGER) AS rank FROM scored)"""


@query(_HVG + " SELECT gene_id, round(mean, 6) AS mean, round(variance, 6) AS variance, bin, dispersion + 0.0 AS dispersion, rank, rank <= 200 AS is_hvg FROM hvg")
def n6_hvg(spark, d):
    found = norm.hvg(norm.gene_moments(_layer(spark, d), _cells(spark, d).count()), 200)
    return _rounded(found)


@query(_LAYER + """, t AS (SELECT sum(x) AS sx, sum(x * x) AS sxx FROM cells), s AS (SELECT gene_id, sum(v) AS sy, sum(v * x) AS sxy FROM layer JOIN cells USING (cell_id) GROUP BY 1),
f AS (SELECT gene_id, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sy, sx, n FROM s, t, nc), g AS (SELECT gene_id, slope, (sy - slope * sx) / n AS intercept FROM f)
SELECT cell_id, gene_id, round(v - intercept - slope * x, 5) + 0.0 AS residual, round(slope, 5) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept FROM layer JOIN cells USING (cell_id) JOIN g USING (gene_id)""")
def n7_regress_out(spark, d):
    return _rounded(norm.regress_out(_layer(spark, d), _cells(spark, d).select("cell_id", "x"), _cells(spark, d).count()), 5)


@query(_LAYER + """, z AS (SELECT batch, count(*) AS n FROM cells GROUP BY 1), m AS (SELECT batch, gene_id, sum(v) / max(n) AS mean FROM layer JOIN cells USING (cell_id) JOIN z USING (batch) GROUP BY 1, 2)
SELECT cell_id, gene_id, round(v - mean, 5) + 0.0 AS centered FROM layer JOIN cells USING (cell_id) JOIN m USING (batch, gene_id)""")
def n8_batch_center(spark, d):
    return _rounded(norm.batch_center(_layer(spark, d), _cells(spark, d)), 5)


# ---- reduction

_N_GENES = 2_000


def _variable(spark: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    """The layer, stored once for all passes over it, and a bounded list of genes, as the pipeline chooses it: the most variable ones."""
    layer = stored(_layer(spark, d), "layer")
    found = norm.hvg(norm.gene_moments(layer, _cells(spark, d).count()), _N_GENES)
    return layer, sorted(r["gene_id"] for r in found.where("is_hvg").select("gene_id").collect())


@query()
def d1_pca(spark, d):
    layer, genes = _variable(spark, d)
    loadings, _, mean = reduce.pca(layer, genes, _cells(spark, d).count(), 10)
    return _rounded(reduce.loadings_table(layer, genes, loadings, mean))


#: A fixed stand-in for fitted loadings, so that projection can be checked by itself.
def _fixed_loadings(spark: SparkSession, d: str) -> DataFrame:
    genes = _genes(spark, d).select("gene_id").crossJoin(spark.range(3).select(F.col("id").cast("int").alias("pc")))
    return genes.select("gene_id", "pc", (((F.col("gene_id") * 7 + F.col("pc") * 13) % 11 - 5) / 10.0).alias("loading"), (F.col("gene_id") % 5 / 10.0).alias("mean"))


@query(_LAYER + """, l AS (SELECT gene_id, CAST(pc AS INTEGER) AS pc, ((gene_id * 7 + pc * 13) % 11 - 5) / 10.0::DOUBLE AS loading, (gene_id % 5) / 10.0::DOUBLE AS mean FROM genes, range(3) r(pc)),
sh AS (SELECT pc, sum(mean * loading) AS shift FROM l GROUP BY 1), st AS (SELECT cell_id, pc, sum(v * loading) AS dot FROM layer JOIN l USING (gene_id) GROUP BY 1, 2)
SELECT cell_id, pc, round(coalesce(dot, 0) - shift, 5) + 0.0 AS score FROM (SELECT cell_id, pc, shift FROM cells, sh) LEFT JOIN st USING (cell_id, pc)""")
def d2_project(spark, d):
    return _rounded(reduce.project(_layer(spark, d), _fixed_loadings(spark, d), _cells(spark, d)), 5)


@query()
def d3_explained_variance(spark, d):
    return _rounded(reduce.explained_variance(*_variable(spark, d), _cells(spark, d).count(), 10))


@query(_HVG + f" SELECT count(*) AS genes, round(sum(variance), 4) AS variance FROM hvg WHERE rank <= {_N_GENES}")
def d3_trace(spark, d):
    """The variances of all components add up to those of the genes."""
    layer, genes = _variable(spark, d)
    found = reduce.explained_variance(layer, genes, _cells(spark, d).count(), len(genes))
    return found.agg(F.count(F.lit(1)).alias("genes"), F.round(F.sum("variance"), 4).alias("variance"))


@query(_KNN + " SELECT * FROM near")
def d4_knn(spark, d):
    return reduce.knn(_emb(spark, d), 5)


@query()
def d5_knn_approx(spark, d):
    return reduce.knn_approx(_emb(spark, d), 5, radius=1.2)


@query()
def d5_knn_descent(spark, d):
    return reduce.knn_descent(_emb(spark, d), 5)


@query("SELECT 5 * count(*) AS n, TRUE AS recalled FROM embeddings")
def d5_recall(spark, d):
    """Entries that neighbour descent finds, and whether at least 0.95 of the exact ones are among them."""
    exact, near = (f(_emb(spark, d), 5).select("cell_id", "neighbor") for f in (lambda e, k: reduce.knn(e, k, "euclidean"), reduce.knn_descent))
    near = near.withColumn("found", F.lit(1))
    both = exact.withColumn("true", F.lit(1)).join(near, ["cell_id", "neighbor"], "full")
    return both.agg(F.count("found").alias("n"), (F.count(F.when(F.col("found") == F.col("true"), 1)) >= 0.95 * F.count("true")).alias("recalled"))


@query(_KNN + """, s AS (SELECT a.cell_id AS i, b.cell_id AS j, count(*) AS shared FROM near a JOIN near b USING (neighbor) WHERE a.cell_id < b.cell_id GROUP BY 1, 2)
SELECT i, j, round(shared / CAST(10 - shared AS DOUBLE), 6) AS w FROM s""")
def d6_snn(spark, d):
    return _rounded(reduce.snn(reduce.knn(_emb(spark, d), 5)))


@query(_LAYER + """, l AS (SELECT gene_id, CAST(pc AS INTEGER) AS pc, ((gene_id * 7 + pc * 13) % 11 - 5) / 10.0::DOUBLE AS loading, (gene_id % 5) / 10.0::DOUBLE AS mean FROM genes, range(3) r(pc)),
sh AS (SELECT pc, sum(mean * loading) AS shift FROM l GROUP BY 1), st AS (SELECT cell_id, pc, sum(v * loading) AS dot FROM layer JOIN l USING (gene_id) GROUP BY 1, 2),
p AS (SELECT cell_id, pc, coalesce(dot, 0) - shift AS score FROM (SELECT cell_id, pc, shift FROM cells, sh) LEFT JOIN st USING (cell_id, pc))
SELECT cell_id, round(max(CASE WHEN pc = 0 THEN score END), 5) + 0.0 AS x, round(max(CASE WHEN pc = 1 THEN score END), 5) + 0.0 AS y FROM p GROUP BY 1""")
def d7_layout_2d(spark, d):
    return _rounded(reduce.layout_2d(reduce.project(_layer(spark, d), _fixed_loadings(spark, d), _cells(spark, d))), 5)


def _laid_out(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The fifteen nearest of each embedding, and a layout of them from the vectors' first two dimensions on."""
    near = stored(reduce.knn_descent(_emb(spark, d), 15), "near")
    start = _emb(spark, d).select("cell_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return near, reduce.layout_neighbors(near, start)


@query()
def d7_layout_neighbors(spark, d):
    return _rounded(_laid_out(spark, d)[1])


@query()
def d7_layout_pull(spark, d):
    """Laid out cells, and the mean distances between listed neighbours and between cells that a hash pairs."""
    near, laid = _laid_out(spark, d)
    crowd = F.pmod(F.xxhash64("cell_id", F.lit(7)), F.lit(max(1, laid.count() // 64)))
    far = F.lead(F.struct("x", "y")).over(Window.partitionBy(crowd).orderBy(F.xxhash64("cell_id")))
    apart = lambda x, y: F.avg(F.hypot(F.col("x") - F.col(x), F.col("y") - F.col(y)))
    paired = laid.withColumn("far", far).agg(F.count(F.lit(1)).alias("cells"), F.round(apart("far.x", "far.y"), 6).alias("apart"))
    ends = near.join(laid, "cell_id").join(laid.select(F.col("cell_id").alias("neighbor"), F.col("x").alias("xj"), F.col("y").alias("yj")), "neighbor")
    return paired.crossJoin(ends.agg(F.round(apart("xj", "yj"), 6).alias("near"))).select("cells", "near", "apart")  # a row each


# ---- clustering

@query()
def c1_kmeans(spark, d):
    return cluster.kmeans(_emb(spark, d), 8, seed=3, iterations=10)


def _lloyd_sql(rounds: int) -> str:
    """Lloyd from the first six vectors, iteration by iteration."""
    near = "row_number() OVER (PARTITION BY e.cell_id ORDER BY round(list_sum(list_transform(list_zip(e.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), c.label) AS r"
    sql = _EMB + ", c0 AS (SELECT CAST(cell_id AS INTEGER) AS label, vec FROM emb WHERE cell_id < 6)"
    for k in range(rounds):
        sql += f""", a{k} AS (SELECT cell_id, vec, label FROM (SELECT e.cell_id, e.vec, c.label, {near} FROM emb e, c{k} c) WHERE r = 1),
m{k} AS (SELECT label, pos, round(avg(x), 9) AS x FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM a{k}) GROUP BY 1, 2),
c{k + 1} AS (SELECT label, list(x ORDER BY pos) AS vec FROM m{k} GROUP BY 1)"""
    return sql + f" SELECT cell_id, label FROM (SELECT e.cell_id, c.label, {near} FROM emb e, c{rounds} c) WHERE r = 1"


@query(_lloyd_sql(3))
def c1_kmeans_given(spark, d):
    """Three iterations from given centres."""
    start = [list(r["vec"]) for r in _first_centroids(spark, d).orderBy("label").collect()]  # six rows
    return cluster.kmeans(_emb(spark, d), 6, iterations=3, start=start)


def _first_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _emb(spark, d).where("cell_id < 6").select(F.col("cell_id").cast("int").alias("label"), "vec")


@query(_EMB + """, dist AS (SELECT e.cell_id, e.vec, CAST(c.cell_id AS INTEGER) AS label, row_number() OVER (PARTITION BY e.cell_id ORDER BY round(list_sum(list_transform(list_zip(e.vec, c.vec), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), c.cell_id) AS r FROM emb e, emb c WHERE c.cell_id < 6),
a AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM dist WHERE r = 1)
SELECT label, CAST(pos - 1 AS INTEGER) AS "at", count(*) AS n, round(avg(x), 6) + 0.0 AS x FROM a GROUP BY 1, 2""")
def c2_kmeans_step(spark, d):
    step = cluster.kmeans_step(_emb(spark, d), _first_centroids(spark, d))
    return _rounded(step.select("label", F.posexplode("vec").alias("at", "x"), "n"))


def _propagation_sql(rounds: int) -> str:
    sql = _EDGES + ", l0 AS (SELECT DISTINCT node, node AS label FROM edges)"
    for k in range(rounds):
        sql += f""", v{k} AS (SELECT e.node, l.label, round(sum(w), 9) AS weight FROM edges e JOIN l{k} l ON e.other = l.node GROUP BY 1, 2),
l{k + 1} AS (SELECT node, label FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, label) AS r FROM v{k}) WHERE r = 1)"""
    return sql + f" SELECT node, label FROM l{rounds}"


@query(_propagation_sql(5))
def c3_label_propagation(spark, d):
    return cluster.label_propagation(_graph(spark, d), 5)


@query(_EDGES.replace("WITH", "WITH RECURSIVE", 1) + """, reach AS (SELECT DISTINCT node, node AS seen FROM edges UNION SELECT r.node, e.other FROM reach r JOIN edges e ON r.seen = e.node)
SELECT node, min(seen) AS label FROM reach GROUP BY 1""")
def c4_connected_components(spark, d):
    return cluster.connected_components(_graph(spark, d))


@query()
def c5_louvain(spark, d):
    return cluster.louvain(_graph(spark, d))


@query()
def c5_leiden(spark, d):
    return cluster.leiden(_graph(spark, d), levels=3, rounds=4)


@query(_GRAPH + " SELECT (SELECT count(*) FROM (SELECT i FROM graph UNION SELECT j FROM graph)) AS nodes, 0::BIGINT AS disconnected, TRUE AS beats_label_propagation")
def c5_leiden_quality(spark, d):
    """Nodes with a community, communities that fall into pieces, and whether its modularity is at least that of label propagation."""
    graph = stored(_graph(spark, d), "graph")
    found = stored(cluster.leiden(graph, levels=3, rounds=4), "leiden")
    a, b = (found.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ij")
    inside = graph.join(a, "i").join(b, "j").where("li = lj").select("i", "j", "w")
    pieces = found.join(cluster.connected_components(inside).withColumnRenamed("label", "piece"), "node", "left").groupBy("label").agg(F.count_distinct(F.coalesce("piece", "node")).alias("pieces"), F.count(F.lit(1)).alias("n"))
    scores = [cluster.modularity(graph, x).first()[0] for x in (found, cluster.label_propagation(graph, 5))]
    return pieces.agg(F.sum("n").alias("nodes"), F.count(F.when(F.col("pieces") > 1, 1)).alias("disconnected")).withColumn("beats_label_propagation", F.lit(scores[0] >= scores[1]))


@query()
def c6_bisecting_kmeans(spark, d):
    return cluster.bisecting_kmeans(_emb(spark, d), 4)


@query()
def c6_gmm(spark, d):
    return cluster.gmm(_emb(spark, d), 3)


@query()
def c6_pic(spark, d):
    return cluster.pic(_graph(spark, d), 3)


@query("""WITH s AS (SELECT label, count(*) AS n, min(vec_id) AS least FROM embeddings GROUP BY 1), o AS (SELECT label, CAST(row_number() OVER (ORDER BY n DESC, least) - 1 AS INTEGER) AS cluster FROM s)
SELECT vec_id AS cell_id, cluster AS label FROM embeddings JOIN o USING (label)""")
def c7_relabel_by_size(spark, d):
    return cluster.relabel_by_size(_labels(spark, d))


@query(_GRAPH + """, g AS (SELECT i, j, w, i % 7 AS li, j % 7 AS lj FROM graph), m AS (SELECT sum(w) AS m FROM g), dg AS (SELECT l, sum(w) AS degree FROM (SELECT li AS l, w FROM g UNION ALL SELECT lj, w FROM g) GROUP BY 1),
wi AS (SELECT li AS l, sum(w) AS within FROM g WHERE li = lj GROUP BY 1)
SELECT round(sum(coalesce(within, 0) / m - (degree / (2 * m)) * (degree / (2 * m))), 6) AS modularity FROM dg LEFT JOIN wi USING (l), m""")
def c8_modularity(spark, d):
    nodes = _emb(spark, d).select(F.col("cell_id").alias("node"), (F.col("cell_id") % 7).alias("label"))
    return _rounded(cluster.modularity(_graph(spark, d), nodes))


@query("""WITH l AS (SELECT doc_id, source AS label, lang AS truth FROM documents), t AS (SELECT label, truth, count(*)::DOUBLE AS n FROM l GROUP BY 1, 2), r AS (SELECT label, sum(n) AS a, max(n) AS most FROM t GROUP BY 1), c AS (SELECT truth, sum(n) AS b FROM t GROUP BY 1),
s AS (SELECT sum(n) AS total, sum(n * (n - 1) / 2) AS both_ FROM t), x AS (SELECT sum(a * (a - 1) / 2) AS pa, sum(most) AS most, -sum(a / total * ln(a / total)) AS ha FROM r, s), y AS (SELECT sum(b * (b - 1) / 2) AS pb, -sum(b / total * ln(b / total)) AS hb FROM c, s),
mi AS (SELECT sum(n / total * ln(n * total / (a * b))) AS mi FROM t JOIN r USING (label) JOIN c USING (truth), s)
SELECT round((both_ - pa * pb / (total * (total - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (total * (total - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(most / total, 6) AS purity FROM s, x, y, mi""")
def c9_agreement(spark, d):
    docs = _table(spark, d, "documents")
    return _rounded(cluster.agreement(docs.select(F.col("doc_id").alias("cell_id"), F.col("source").alias("label")), docs.select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("truth"))))


@query(_EMB + """, m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM emb) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY pos) AS centre FROM m GROUP BY 1),
dd AS (SELECT e.cell_id, e.label, c.label AS other, list_distance(e.vec, c.centre) AS d FROM emb e, c), ab AS (SELECT cell_id, label, max(CASE WHEN label = other THEN d END) AS a, min(CASE WHEN label <> other THEN d END) AS b FROM dd GROUP BY 1, 2)
SELECT cell_id, label, round(coalesce((b - a) / nullif(greatest(a, b), 0), 0), 6) + 0.0 AS silhouette FROM ab""")
def c10_silhouette(spark, d):
    return _rounded(cluster.silhouette(_emb(spark, d), _labels(spark, d)))


# ---- differential expression

_SIZES = """, groups AS (SELECT cell_id, batch AS grp FROM cells), gs AS (SELECT grp, count(*)::DOUBLE AS n1 FROM groups GROUP BY 1), allc AS (SELECT sum(n1) AS n_all FROM gs)"""
#: Every cell has a value for every gene that occurs, most of them 0: the definition that the operators reach without the zeros.
_DENSE = _LAYER + _SIZES + """, occurs AS (SELECT DISTINCT gene_id FROM layer JOIN groups USING (cell_id)),
dense AS (SELECT grp, cell_id, gene_id, coalesce(v, 0) AS v FROM (SELECT grp, cell_id, gene_id FROM groups, occurs) LEFT JOIN layer USING (cell_id, gene_id))"""
_SUMS = _DENSE + """, own AS (SELECT grp, gene_id, sum(v) AS s, sum(v * v) AS q, sum(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END) AS a FROM dense GROUP BY 1, 2),
tot AS (SELECT gene_id, sum(s) AS ts, sum(q) AS tq, sum(a) AS ta FROM own GROUP BY 1), io AS (SELECT *, n_all - n1 AS n2 FROM own JOIN tot USING (gene_id) JOIN gs USING (grp), allc)"""


@query(_SUMS + " SELECT grp, gene_id, round(s / n1, 6) AS mean_in, round(100 * a / n1, 6) AS pct_in FROM io")
def e1_group_means(spark, d):
    return _rounded(de.group_means(_layer(spark, d), _groups(spark, d)))


@query(_SUMS + " SELECT grp, gene_id, round(s / n1, 6) AS mean_in, round((ts - s) / n2, 6) + 0.0 AS mean_out, round(s / n1 - (ts - s) / n2, 6) + 0.0 AS log_fc FROM io")
def e2_log_fc(spark, d):
    return _rounded(de.log_fc(_layer(spark, d), _groups(spark, d)))


# ln of the two-sided normal tail erfc(x), x = |z| / sqrt(2), by the trapezoidal rule for its integral over 1 / (n^2 h^2 + x^2) at h = 1 / 2; up to x = pi / h a pole adds a term.
_X = "(abs({z}) / sqrt(2.0::DOUBLE))"
_SUM = f"(0.5::DOUBLE * {_X} / pi() * (1 / ({_X} * {_X}) + 2 * list_sum(list_transform(range(1, 14), lambda n: exp(-0.25::DOUBLE * n * n) / (0.25::DOUBLE * n * n + {_X} * {_X})))))"
_LOG_P = f"(CASE WHEN abs({{z}}) < 1e-9 THEN 0.0::DOUBLE WHEN abs({{z}}) < 8.8 THEN ln({_SUM} * exp(-{_X} * {_X}) - 2 / (exp(4 * pi() * {_X}) - 1)) ELSE ln({_SUM}) - {_X} * {_X} END)"
_P = f"exp({_LOG_P})"
_RANKS = _DENSE + """, r AS (SELECT grp, gene_id, round(v, 6) AS v FROM dense),
rk AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY v) + (count(*) OVER (PARTITION BY gene_id, v) - 1) / 2.0::DOUBLE AS rnk, count(*) OVER (PARTITION BY gene_id, v)::DOUBLE AS tie FROM r),
tt AS (SELECT gene_id, sum(tie * tie - 1) AS ties FROM rk GROUP BY 1), i AS (SELECT grp, gene_id, sum(rnk) AS r FROM rk GROUP BY 1, 2),
j AS (SELECT *, n_all - n1 AS n2 FROM i JOIN tt USING (gene_id) JOIN gs USING (grp), allc),
k AS (SELECT grp, gene_id, r - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 2 AS mu, n1 * n2 / 12 * ((n_all + 1) - ties / (n_all * (n_all - 1))) AS va FROM j),
wx AS (SELECT grp, gene_id, u, CASE WHEN va > 1e-12 THEN (u - mu) / sqrt(greatest(va, 1e-12)) ELSE 0 END AS z FROM k)"""


@query(_RANKS + f" SELECT grp, gene_id, round(u, 3) AS u, round(z, 5) + 0.0 AS z, round({_P.format(z='z')}, 5) AS p FROM wx")
def e3_wilcoxon(spark, d):
    out = de.wilcoxon(_layer(spark, d), _groups(spark, d))
    return out.select("grp", "gene_id", F.round("u", 3).alias("u"), (F.round("z", 5) + 0.0).alias("z"), F.round("p", 5).alias("p"))


_WELCH = _SUMS + """, w AS (SELECT grp, gene_id, n1, n2, s / n1 - (ts - s) / n2 AS diff, greatest(0, (q - s * s / n1) / (n1 - 1)) / n1 AS v1, greatest(0, ((tq - q) - (ts - s) * (ts - s) / n2) / (n2 - 1)) / n2 AS v2 FROM io),
wt AS (SELECT grp, gene_id, CASE WHEN v1 + v2 > 1e-12 THEN diff / sqrt(v1 + v2) END AS t, CASE WHEN v1 + v2 > 1e-12 THEN (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) END AS df FROM w)"""


@query(_WELCH + " SELECT grp, gene_id, round(t, 5) + 0.0 AS t, round(df, 3) AS df FROM wt")
def e4_welch_statistic(spark, d):
    return de.welch_statistic(_layer(spark, d), _groups(spark, d)).select("grp", "gene_id", (F.round("t", 5) + 0.0).alias("t"), F.round("df", 3).alias("df"))


# The density of t, integrated by Simpson's rule in 400 steps from 0 to |t|.
@query(_WELCH + """, h AS (SELECT *, abs(t) / 400 AS step, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS scale FROM wt),
m AS (SELECT *, list_sum(list_transform(range(401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (i * step) * (i * step) / df, -(df + 1) / 2))) * step / 3 * scale AS half FROM h)
SELECT grp, gene_id, round(t, 5) + 0.0 AS t, round(df, 3) AS df, round(greatest(0, 1 - 2 * half), 5) + 0.0 AS p FROM m""")
def e4_welch_t(spark, d):
    tested = de.welch_t(_layer(spark, d), _groups(spark, d))
    return tested.select("grp", "gene_id", (F.round("t", 5) + 0.0).alias("t"), F.round("df", 3).alias("df"), (F.round("p", 5) + 0.0).alias("p"))


@query(_BASE + " SELECT nation, gene_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2")
def e5_pseudobulk(spark, d):
    return de.pseudobulk(_counts(spark, d), _cells(spark, d), "nation")


@query(f"SELECT k, round({_P.format(z='(k / 15.0::DOUBLE)')}, 9) AS p, round({_LOG_P.format(z='(k / 15.0::DOUBLE)')}, 6) + 0.0 AS log_p FROM (SELECT l_orderkey % 600 AS k FROM lineitem GROUP BY 1)")
def e6_normal_p(spark, d):
    k = _table(spark, d, "lineitem").select((F.col("l_orderkey") % 600).alias("k")).distinct()
    z = F.col("k") / 15.0
    return k.select("k", F.round(de.normal_p(z), 9).alias("p"), (F.round(de.normal_log_p(z), 6) + 0.0).alias("log_p"))


@query("""WITH t AS (SELECT p_type AS grp, p_partkey AS gene_id, ((p_partkey * 7919) % 1000) / 1000.0::DOUBLE AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY grp ORDER BY p) AS rk, count(*) OVER (PARTITION BY grp) AS m FROM t), x AS (SELECT *, p * m / rk AS raw FROM r)
SELECT grp, gene_id, p, round(least(1, min(raw) OVER (PARTITION BY grp ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM x""")
def e7_bh_adjust(spark, d):
    tests = _table(spark, d, "part").select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("gene_id"), (F.col("p_partkey") * 7919 % 1000 / 1000.0).alias("p"))
    return _rounded(de.bh_adjust(tests))


@query(_RANKS + ", s AS (SELECT grp, gene_id, round(z, 4) + 0.0 AS score FROM wx) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY score DESC, gene_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def e8_markers(spark, d):
    return de.markers(de.wilcoxon(_layer(spark, d), _groups(spark, d)), 10, digits=4)


@query(_SUMS + """, c AS (SELECT grp, gene_id, n_all, a, ta - a AS c, n1 - a AS b, n2 - (ta - a) AS d FROM io),
x AS (SELECT grp, gene_id, coalesce(n_all * (a * d - b * c) * (a * d - b * c) / nullif((a + b) * (c + d) * (a + c) * (b + d), 0), 0) AS chi2 FROM c)""" + f" SELECT grp, gene_id, round(chi2, 5) AS chi2, round({_P.format(z='sqrt(chi2)')}, 5) AS p FROM x")
def e9_chisq_pct(spark, d):
    return _rounded(de.chisq_pct(_layer(spark, d), _groups(spark, d)), 5)


# ---- outputs

@query(_METRICS + " SELECT batch, count(*) AS n, " + ", ".join(f"round(quantile_cont(total, {q}), 6) AS q{int(q * 100)}" for q in outputs.QUANTILES) + " FROM metrics GROUP BY 1")
def o1_violin_data(spark, d):
    metrics = qc.cell_metrics(_counts(spark, d), _cells(spark, d)).join(_cells(spark, d).select("cell_id", "batch"), "cell_id")
    return _rounded(outputs.violin_data(metrics, "total", "batch"))


@query(_METRICS + " SELECT batch, CAST(floor(total / 100.0::DOUBLE) * 100 AS DOUBLE) AS bin, count(*) AS n FROM metrics GROUP BY 1, 2")
def o1_hist_data(spark, d):
    metrics = qc.cell_metrics(_counts(spark, d), _cells(spark, d)).join(_cells(spark, d).select("cell_id", "batch"), "cell_id")
    return outputs.hist_data(metrics, "total", "batch", 100)


@query(_METRICS + """, f AS (SELECT cell_id, sum(cnt) AS ins FROM counts JOIN sets USING (gene_id) WHERE set_name = (SELECT min(p_type) FROM part) GROUP BY 1)
SELECT cell_id, total, n_genes, round(coalesce(ins / CAST(nullif(total, 0) AS DOUBLE), 0), 6) AS fraction FROM metrics LEFT JOIN f USING (cell_id)""")
def o2_scatter_qc(spark, d):
    counts, sets = _counts(spark, d), _gene_sets(spark, d)
    name = sets.agg(F.min("set_name")).first()[0]
    return _rounded(outputs.scatter_qc(qc.cell_metrics(counts, _cells(spark, d)), qc.gene_set_fraction(counts, sets), name))


@query(_HVG + " SELECT gene_id, round(moments.mean, 6) AS mean, round(moments.variance, 6) AS variance, dispersion + 0.0 AS dispersion, coalesce(rank <= 200, false) AS is_hvg FROM moments LEFT JOIN hvg USING (gene_id)")
def o3_mean_variance(spark, d):
    moments = norm.gene_moments(_layer(spark, d), _cells(spark, d).count())
    return _rounded(outputs.mean_variance(moments, norm.hvg(moments, 200)))


@query()
def o4_elbow(spark, d):
    return _rounded(outputs.elbow(reduce.explained_variance(*_variable(spark, d), _cells(spark, d).count(), 10)))


@query()
def o5_embedding_components(spark, d):
    """The first two components of the embeddings themselves, with the labels."""
    entries = stored(_emb(spark, d).select("cell_id", F.posexplode("vec").alias("at", "v")).select("cell_id", F.col("at").cast("long").alias("gene_id"), "v"), "entries")
    dims = sorted(r["gene_id"] for r in entries.select("gene_id").distinct().collect())  # dimensions of a vector
    cells = _emb(spark, d).select("cell_id")
    loadings, _, mean = reduce.pca(entries, dims, cells.count(), 2)
    scores = reduce.project(entries, reduce.loadings_table(entries, dims, loadings, mean), cells)
    return _rounded(outputs.embedding_scatter(reduce.layout_2d(scores), _labels(spark, d)))


@query(_EMB + " SELECT cell_id, round(vec[1], 6) AS x, round(vec[2], 6) AS y, label AS cluster FROM emb")
def o5_embedding_scatter(spark, d):
    layout = _emb(spark, d).select("cell_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return _rounded(outputs.embedding_scatter(layout, _labels(spark, d)))


@query(_SUMS + " SELECT grp, gene_id, round(s / n1, 6) AS mean_in, round(100 * a / n1, 6) AS pct_in FROM io")
def o6_dotplot(spark, d):
    return _rounded(outputs.dotplot(de.group_means(_layer(spark, d), _groups(spark, d)), _genes(spark, d)))


@query(_RANKS + """, sc AS (SELECT grp, gene_id, round(z, 4) + 0.0 AS score FROM wx), top AS (SELECT DISTINCT gene_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, gene_id) AS rank FROM sc) WHERE rank <= 10),
g AS (SELECT grp, gene_id, avg(v) AS mean_in FROM dense WHERE gene_id IN (SELECT gene_id FROM top) GROUP BY 1, 2), m AS (SELECT gene_id, avg(mean_in) AS m, stddev_samp(mean_in) AS sd FROM g GROUP BY 1)
SELECT grp, gene_id, round(coalesce((mean_in - m) / nullif(sd, 0), 0), 5) + 0.0 AS z FROM g JOIN m USING (gene_id)""")
def o7_heatmap(spark, d):
    layer, groups = stored(_layer(spark, d), "layer"), _groups(spark, d)  # tests and means read it
    return _rounded(outputs.heatmap(de.group_means(layer, groups), de.markers(de.wilcoxon(layer, groups), 10, digits=4)), 5)


@query(_RANKS + f""", own AS (SELECT grp, gene_id, sum(v) AS s FROM dense GROUP BY 1, 2), tot AS (SELECT gene_id, sum(s) AS ts FROM own GROUP BY 1),
fc AS (SELECT grp, gene_id, s / n1 - (ts - s) / (n_all - n1) AS log_fc FROM own JOIN tot USING (gene_id) JOIN gs USING (grp), allc),
pp AS (SELECT grp, gene_id, round({_LOG_P.format(z='z')}, 6) AS log_p FROM wx), rr AS (SELECT *, count(*) OVER (PARTITION BY grp ORDER BY log_p) AS rk, count(*) OVER (PARTITION BY grp) AS m FROM pp),
qq AS (SELECT grp, gene_id, least(0, min(log_p + ln(m / rk::DOUBLE)) OVER (PARTITION BY grp ORDER BY log_p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS log_q FROM rr)
SELECT grp, gene_id, round(log_fc, 5) + 0.0 AS log_fc, round(-log_q / ln(10), 3) + 0.0 AS neg_log10_q FROM qq JOIN fc USING (grp, gene_id)""")
def o8_volcano(spark, d):
    layer, groups = stored(_layer(spark, d), "layer"), _groups(spark, d)  # tests and means read it
    tests = de.bh_adjust(de.wilcoxon(layer, groups).withColumn("log_p", F.round("log_p", 6)))
    return outputs.volcano(tests, de.log_fc(layer, groups)).select("grp", "gene_id", (F.round("log_fc", 5) + 0.0).alias("log_fc"), (F.round("neg_log10_q", 3) + 0.0).alias("neg_log10_q"))


@query("WITH n AS (SELECT lang AS label, source AS batch, count(*) AS n FROM documents GROUP BY 1, 2) SELECT label, batch, n, round(n / CAST(sum(n) OVER (PARTITION BY label) AS DOUBLE), 6) AS share FROM n")
def o9_composition(spark, d):
    docs = _table(spark, d, "documents")
    return _rounded(outputs.composition(docs.select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("label")), docs.select(F.col("doc_id").alias("cell_id"), F.col("source").alias("batch")), "batch"))


@query()
def o10_provenance(spark, d):
    counts = _counts(spark, d)
    metrics = qc.cell_metrics(counts, _cells(spark, d))
    return outputs.provenance(spark, "cell_metrics", {"cells": "customer"}, counts, metrics, run_id="fixed")
