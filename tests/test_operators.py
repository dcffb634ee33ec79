"""Operators against dense brute force in numpy, hand-made cases, and planted structure."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cytoframe.functions import running
from cytoframe.functions.cuts import stored
from cytoframe.functions.quantiles import quantiles
from cytoframe.operators import cluster, de, norm, outputs, qc, reduce
from cytoframe.sources import canonicalize, matrix_from_events, read_long, read_matrix, read_mtx, read_wide, write_mtx


def long(spark, dense):
    rows = [(i, j, int(v)) for i, line in enumerate(dense) for j, v in enumerate(line) if v]
    return spark.createDataFrame(rows, "cell_id long, gene_id long, cnt long")


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(1)
    m = rng.poisson(1.0, (60, 12))
    for k in range(3):  # three planted clusters of 20 with 4 markers each
        m[20 * k : 20 * k + 20, 4 * k : 4 * k + 4] += rng.poisson(9, (20, 4))
    m[5] = 0  # a cell without counts
    m[:, 11] = 0  # a gene without counts
    m[20:40, 2] = 0  # a gene that a group lacks
    return m


@pytest.fixture(scope="module")
def matrix(spark, dense):
    counts = long(spark, dense).cache()
    cells = spark.createDataFrame([(i, f"b{i % 2}", f"g{i // 20}") for i in range(60)], "cell_id long, batch string, grp string")
    genes = spark.createDataFrame([(j,) for j in range(12)], "gene_id long")
    return counts, cells, genes


def log_dense(m):
    total = m.sum(1, keepdims=True)
    return np.log1p(np.divide(m * 1e4, total, out=np.zeros(m.shape), where=total > 0))


def test_cell_metrics_keep_empty_cells(matrix, dense):
    got = {r.cell_id: r for r in qc.cell_metrics(*matrix[:2]).collect()}
    assert len(got) == 60 and got[5].total == 0 and got[5].top_share is None
    for i in range(60):
        assert got[i].total == dense[i].sum() and got[i].n_genes == (dense[i] > 0).sum()


def test_gene_metrics_count_implicit_zeros(matrix, dense):
    got = {r.gene_id: r for r in qc.gene_metrics(matrix[0], matrix[2], 60).collect()}
    assert got[11].n_cells == 0 and got[11].dropout_pct == 100
    for j in range(12):
        assert got[j].mean == pytest.approx(dense[:, j].mean())


def test_moments_equal_dense(matrix, dense):
    v = log_dense(dense)
    got = {r.gene_id: r for r in norm.gene_moments(norm.log_norm(matrix[0]), 60).collect()}
    for j in range(11):
        assert got[j].mean == pytest.approx(v[:, j].mean()) and got[j].variance == pytest.approx(v[:, j].var(ddof=1))


def test_scale_and_regression_equal_dense(spark, matrix, dense):
    v = log_dense(dense)
    layer = norm.log_norm(matrix[0])
    got = {(r.cell_id, r.gene_id): r for r in norm.scale(layer, norm.gene_moments(layer, 60)).collect()}
    z = (v - v.mean(0)) / np.where(v.std(0, ddof=1) > 0, v.std(0, ddof=1), 1)
    assert all(r.z == pytest.approx(z[k]) for k, r in got.items())
    x = np.arange(60) % 7 + 0.5
    cov = spark.createDataFrame([(i, float(t)) for i, t in enumerate(x)], "cell_id long, x double")
    got = {(r.cell_id, r.gene_id): r for r in norm.regress_out(layer, cov, 60).collect()}
    for j in range(11):
        slope, intercept = np.polyfit(x, v[:, j], 1)
        assert all(r.residual == pytest.approx(v[i, j] - intercept - slope * x[i], abs=1e-9) for (i, g), r in got.items() if g == j)


def test_hvg_prefers_planted_genes(matrix):
    found = norm.hvg(norm.gene_moments(norm.log_norm(matrix[0]), 60), 3, n_bins=2)
    assert found.where("is_hvg").count() == 3 and found.agg(F.min("rank")).first()[0] == 1


def test_wilcoxon_equals_brute_force(matrix, dense):
    v = np.round(log_dense(dense), 6)
    groups = matrix[1].select("cell_id", "grp")
    got = {(r.grp, r.gene_id): r for r in de.wilcoxon(norm.log_norm(matrix[0]), groups).collect()}
    for g in range(3):
        inside = np.arange(60) // 20 == g
        for j in range(11):
            x, y = v[inside, j], v[~inside, j]
            u = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
            _, ties = np.unique(v[:, j], return_counts=True)
            var = 20 * 40 / 12 * (61 - (ties**3 - ties).sum() / (60 * 59))
            z = (u - 400) / math.sqrt(var)
            r = got[f"g{g}", j]
            assert r.u == pytest.approx(u) and r.z == pytest.approx(z) and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9, abs=0)


@pytest.mark.parametrize("split", [None, 3])
def test_wilcoxon_ranks_negatives_and_splits_genes(spark, monkeypatch, split):
    """Centred values of both signs, implicit and stored zeros, ties; genes in one window or in ranges."""
    if split:
        monkeypatch.setattr(running, "SPLIT", split)
    rng = np.random.default_rng(7)
    v = np.round(rng.normal(0, 1, (40, 5)), 1) * (rng.random((40, 5)) < 0.8)
    v[:, 1] = -np.abs(v[:, 1])
    v[:, 2] = np.arange(40) / 7 - 2
    rows = [(i, j, float(v[i, j])) for i in range(40) for j in range(5) if v[i, j] or i % 2] + [(41, 0, -3.0)]
    layer = spark.createDataFrame([*rows, (3, 0, None)][:-1], "cell_id long, gene_id long, v double").repartition(3)
    groups = spark.createDataFrame([(i, f"g{i % 3}") for i in range(40)], "cell_id long, grp string")
    got = {(r.grp, r.gene_id): r for r in de.wilcoxon(layer, groups).collect()}
    assert len(got) == 15
    for g in range(3):
        inside = np.arange(40) % 3 == g
        for j in range(5):
            x, y = v[inside, j], v[~inside, j]
            u = (x[:, None] > y).sum() + 0.5 * (x[:, None] == y).sum()
            _, ties = np.unique(v[:, j], return_counts=True)
            var = len(x) * len(y) / 12 * (41 - (ties**3 - ties).sum() / (40 * 39))
            assert got[f"g{g}", j].u == pytest.approx(u) and got[f"g{g}", j].z == pytest.approx((u - len(x) * len(y) / 2) / math.sqrt(var))


def test_no_gene_is_one_window(spark, monkeypatch):
    """A gene that all cells have, each with its own value: its values go to many tasks, and counts stay exact."""
    monkeypatch.setattr(running, "SPLIT", 500)
    rng = np.random.default_rng(1)
    values = np.concatenate([[1e12], rng.permutation(6000) / 7])  # an outlier doesn't crowd the others into one range
    df = spark.createDataFrame([(1, float(x), 1 + k % 3) for k, x in enumerate(values)] + [(None, 1.0, 5), (None, 2.0, 6)], "g int, v double, n long").repartition(4)
    found = running.running_counts(df, ["g"], "v", "n")
    order = np.argsort(values)
    want = dict(zip(values[order].tolist(), (np.cumsum(1 + order % 3) - (1 + order % 3)).tolist()))
    rows = found.collect()
    assert {r.v: r.before for r in rows if r.g == 1} == want and {r.v: r.before for r in rows if r.g is None} == {1.0: 0, 2.0: 5}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(key_" in plan and "range_" in plan
    bounds = [x for x in sorted(values) if x != 1e12]
    keyed = df.where("g = 1").withColumn("key_", F.struct("g"))
    chosen = sorted(r.v for r in keyed.where(F.pmod(F.xxhash64("key_", "v"), F.lit(6001 // running.RANGES)) == 0).collect())
    widest = max(b - a for a, b in zip([0, *np.searchsorted(bounds, chosen)], [*np.searchsorted(bounds, chosen), 6000]))
    assert 150 < len(chosen) < 400 and widest < 300


def test_normal_tails_are_exact(spark):
    from fractions import Fraction

    def log_p(z):
        """By the continued fraction in exact arithmetic for large z, by erfc for small."""
        if z < 5:
            return math.log(math.erfc(z / math.sqrt(2)))
        x = Fraction(z)
        rest = x
        for k in range(60, 0, -1):
            rest = (x + k / rest).limit_denominator(10**40)
        return math.log(2) - z * z / 2 - 0.5 * math.log(2 * math.pi) - math.log(rest)

    zs = [0.0, 1e-9, 0.01, 0.5, 1.0, 2.0, 2.999, 3.0, 3.001, 4.0, 6.0, 8.5, 12.0, 20.0, 30.0, 37.5, 40.0, 300.0]
    df = spark.createDataFrame([(z * s,) for z in zs for s in (1, -1)] + [(None,)], "z double")
    rows = df.select("z", de.normal_log_p(F.col("z")).alias("l"), de.normal_p(F.col("z")).alias("p")).collect()
    assert rows[-1].l is None and rows[-1].p is None
    for r in rows[:-1]:
        # A difference of logarithms is the relative error of p; rounding of z * z / 2 alone is 1e-16 of it.
        assert r.l == pytest.approx(log_p(abs(r.z)), abs=1e-9 if abs(r.z) < 50 else 1e-8, rel=0)
        assert r.p == pytest.approx(math.exp(r.l), rel=1e-12, abs=0) and r.p <= 1


def test_adjustment_in_logs_does_not_saturate(spark):
    tests = spark.createDataFrame([("a", i, z) for i, z in enumerate([45.0, 60.0, 60.0, 2.0])], "grp string, gene_id long, z double")
    tests = tests.withColumn("log_p", de.normal_log_p(F.col("z"))).withColumn("p", F.exp("log_p"))
    changes = tests.select("grp", "gene_id", F.lit(1.0).alias("log_fc"))
    y = [r.neg_log10_q for r in outputs.volcano(de.bh_adjust(tests), changes).orderBy("gene_id").collect()]
    assert y[1] == y[2] > y[0] > 400 and y[3] == pytest.approx(-math.log10(math.erfc(math.sqrt(2))), abs=1e-9)


def test_markers_find_planted_genes(matrix):
    tests = de.wilcoxon(norm.log_norm(matrix[0]), matrix[1].select("cell_id", "grp"))
    top = {(r.grp, r.gene_id) for r in de.markers(tests, 3).collect()}
    assert all(gene // 4 == int(grp[1]) for grp, gene in top) and len(top) == 9


def test_welch_and_t_tail(matrix, dense):
    v = log_dense(dense)
    got = {(r.grp, r.gene_id): r for r in de.welch_t(norm.log_norm(matrix[0]), matrix[1].select("cell_id", "grp")).collect()}
    x, y = v[:20, 0], v[20:, 0]
    t = (x.mean() - y.mean()) / math.sqrt(x.var(ddof=1) / 20 + y.var(ddof=1) / 40)
    assert got["g0", 0].t == pytest.approx(t)
    tails = de.t_tail(np.array([2.0, 1.0, 0.0, np.nan, -2.0, 40.0]), np.array([10.0, 1, 5, 5, 10, 1e6]))
    assert tails[:3] == pytest.approx([0.07338803, 0.5, 1.0], abs=1e-7) and np.isnan(tails[3]) and tails[4] == tails[0] and tails[5] < 1e-300
    assert de.log_gamma(np.array([0.5, 1.0, 7.3, 900.0])) == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 7.3, 900.0)], rel=1e-10, abs=1e-10)


def test_groups_that_lack_a_gene_have_rows(matrix, dense):
    v, groups = log_dense(dense), matrix[1].select("cell_id", "grp")
    layer = norm.log_norm(matrix[0])
    means = {(r.grp, r.gene_id): r for r in de.group_means(layer, groups).collect()}
    changes = {(r.grp, r.gene_id): r for r in de.log_fc(layer, groups).collect()}
    found = {(r.grp, r.gene_id): r for r in de.chisq_pct(layer, groups).collect()}
    tests = de.bh_adjust(de.wilcoxon(layer, groups)).collect()
    for rows in (means, changes, found, {(r.grp, r.gene_id): r for r in tests}, {(r.grp, r.gene_id): r for r in de.welch_t(layer, groups).collect()}):
        assert set(rows) == {(f"g{g}", j) for g in range(3) for j in range(11)}
    for g in range(3):
        inside = np.arange(60) // 20 == g
        for j in range(11):
            a, b, c, d = (v[inside, j] > 0).sum(), (v[inside, j] == 0).sum(), (v[~inside, j] > 0).sum(), (v[~inside, j] == 0).sum()
            chi2 = 60 * (a * d - b * c) ** 2 / max(1, (a + b) * (c + d) * (a + c) * (b + d))
            key = f"g{g}", j
            assert means[key].mean_in == pytest.approx(v[inside, j].mean()) and means[key].pct_in == pytest.approx(100 * a / 20)
            assert changes[key].log_fc == pytest.approx(v[inside, j].mean() - v[~inside, j].mean()) and found[key].chi2 == pytest.approx(chi2)
    assert means["g1", 2].mean_in == 0 and changes["g1", 2].log_fc < 0
    own = [r for r in tests if r.grp == "g1"]
    raw = {r.gene_id: r.p * 11 / sum(x.p <= r.p for x in own) for r in own}  # the family is all genes that occur
    assert all(r.q == pytest.approx(min(1, min(raw[x.gene_id] for x in own if x.p >= r.p))) for r in own)
    z = outputs.heatmap(de.group_means(layer, groups), matrix[2].where("gene_id = 2")).collect()
    assert sum(r.z for r in z) == pytest.approx(0, abs=1e-9) and len(z) == 3


def test_bh_with_ties(spark):
    p = [0.01, 0.01, 0.02, 0.04, 0.04, 0.04, 0.3, 0.9]
    rank = [sum(q <= x for q in p) for x in p]
    raw = [x * len(p) / r for x, r in zip(p, rank)]
    want = [min(1, min(r for q, r in zip(p, raw) if q >= x)) for x in p]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "grp string, gene_id long, p double")
    assert [r.q for r in de.bh_adjust(df).orderBy("gene_id").collect()] == pytest.approx(want)


def test_pca_equals_numpy(matrix, dense):
    v = log_dense(dense)[:, :11]
    loadings, values, mean = reduce.pca(norm.log_norm(matrix[0]), list(range(11)), 60, 4)
    want = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1][:4]
    assert values == pytest.approx(want) and mean == pytest.approx(v.mean(0))
    scores = reduce.project(norm.log_norm(matrix[0]), reduce.loadings_table(matrix[0], list(range(11)), loadings, mean), matrix[1])
    got = {(r.cell_id, r.pc): r.score for r in scores.collect()}
    full = (v - v.mean(0)) @ loadings
    assert len(got) == 240 and all(s == pytest.approx(full[i, k], abs=1e-9) for (i, k), s in got.items())


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(0, 0.2, (30, 4)) + 4 * np.eye(4)[k] for k in range(3)])
    emb = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "cell_id long, vec array<double>")
    truth = spark.createDataFrame([(i, i // 30) for i in range(90)], "cell_id long, truth int")
    return points, emb, truth


def test_knn_forms(blobs, monkeypatch):
    points, emb, _ = blobs
    d = np.round(np.sqrt(((points[:, None] - points) ** 2).sum(2)), 6)
    want = {(i, j) for i in range(90) for j in sorted(set(range(90)) - {i}, key=lambda j: (d[i, j], j))[:4]}
    one = {(r.cell_id, r.neighbor) for r in reduce.knn(emb, 4, "euclidean").collect()}
    monkeypatch.setattr(reduce, "BLOCK", 20)
    many = {(r.cell_id, r.neighbor) for r in reduce.knn(emb, 4, "euclidean").collect()}
    assert one == many == want


def test_approximate_neighbours(spark, blobs):
    """Recall against brute force, with outliers that have nobody within the radius; every vector gets k."""
    points = np.concatenate([blobs[0], 50 * np.eye(4), np.random.default_rng(8).normal(0, 1, (100, 4))])
    emb = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "cell_id long, vec array<double>")
    d = np.round(np.sqrt(((points[:, None] - points) ** 2).sum(2)), 6)
    n = len(points)
    want = {(i, j) for i in range(n) for j in sorted(set(range(n)) - {i}, key=lambda j: (d[i, j], j))[:4]}
    rows = reduce.knn_approx(emb, 4, radius=1.2).collect()
    got = {(r.cell_id, r.neighbor) for r in rows}
    assert len(rows) == len(got) == 4 * n and len(got & want) >= 0.9 * len(want)
    assert {(i, j) for i, j in want if 90 <= i < 94} <= got
    assert all(r.similarity == pytest.approx(-d[r.cell_id, r.neighbor], abs=2e-6) for r in rows)


def test_clusterings_find_blobs_whatever_the_partitioning(blobs):
    _, emb, truth = blobs
    seen = []
    for n in (1, 7):
        labels = cluster.kmeans(emb.repartition(n), 3, seed=2)
        seen.append(sorted(map(tuple, cluster.relabel_by_size(labels).collect())))
    assert seen[0] == seen[1]
    near = reduce.knn(emb, 5, "euclidean")
    graph = near.select(F.least("cell_id", "neighbor").alias("i"), F.greatest("cell_id", "neighbor").alias("j")).distinct().withColumn("w", F.lit(1.0))
    found = cluster.louvain(graph, levels=3, rounds=6)
    score = cluster.agreement(found.select(F.col("node").alias("cell_id"), "label"), truth).first()
    assert score.purity >= 0.95
    assert cluster.modularity(graph, found).first()[0] > 0.5
    comps = cluster.connected_components(graph)
    assert cluster.agreement(comps.select(F.col("node").alias("cell_id"), "label"), truth).first().ari >= 0.95


@pytest.fixture(scope="module")
def three(spark):
    """Three well separated blobs, as points and as a graph of neighbours in three components."""
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(0, 0.3, (40, 2)) + centre for centre in ([0, 0], [5, 0], [0, 5])])
    emb = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "cell_id long, vec array<double>").cache()
    truth = spark.createDataFrame([(i, i // 40) for i in range(120)], "cell_id long, truth int").cache()
    near = reduce.knn(emb, 5, "euclidean")
    graph = near.select(F.least("cell_id", "neighbor").alias("i"), F.greatest("cell_id", "neighbor").alias("j")).distinct().withColumn("w", F.lit(1.0)).cache()
    return emb, truth, graph


def rand_index(labels, truth=lambda i: i // 40):
    """Adjusted, of (cell, label) rows."""
    from collections import Counter

    pairs = lambda c: sum(n * (n - 1) / 2 for n in c.values())
    both, a, b = Counter((k, truth(i)) for i, k in labels), Counter(k for _, k in labels), Counter(truth(i) for i, _ in labels)
    expected = pairs(a) * pairs(b) / (len(labels) * (len(labels) - 1) / 2)
    return (pairs(both) - expected) / ((pairs(a) + pairs(b)) / 2 - expected)


def test_kmeans_finds_blobs_from_any_seed(three):
    emb, _, _ = three
    seen = {}
    for seed in range(10):
        for n in (1, 9) if not seed else (4,):
            labels = sorted(map(tuple, cluster.kmeans(emb.repartition(n), 3, seed=seed).collect()))
            assert rand_index(labels) >= 0.95
            assert seen.setdefault(seed, labels) == labels


def test_mixtures_and_bisection_find_blobs(three):
    emb, _, _ = three
    for seed, parts in ((1, (1, 5)), (2, (2,)), (3, (2,))):
        found = [sorted(map(tuple, cluster.gmm(emb.repartition(n), 3, seed=seed, iterations=5).collect())) for n in parts]
        assert found[0] == found[-1] and rand_index(found[0]) >= 0.95
    one, many = (sorted(map(tuple, cluster.bisecting_kmeans(emb.repartition(n), 3).collect())) for n in (1, 5))
    assert one == many and rand_index(one) >= 0.95


def test_power_iteration_finds_components(three):
    graph = three[2]
    one, many = (sorted(map(tuple, cluster.pic(graph.repartition(n), 3).collect())) for n in (1, 5))
    assert one == many and rand_index(one) >= 0.95


def test_seeds_of_few_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "cell_id long, vec array<double>")
    assert {r.label for r in cluster.kmeans(same, 3).collect()} == {0}
    assert cluster.kmeans(same.limit(0), 3).collect() == []
    two = spark.createDataFrame([(i, [float(i % 2)]) for i in range(9)], "cell_id long, vec array<double>")
    assert len({r.label for r in cluster.kmeans(two, 4).collect()}) == 2


def pieces(graph, labels):
    """Connected pieces of each community."""
    of = {r.node: r.label for r in labels.collect()}
    near = {}
    for r in graph.collect():
        if of[r.i] == of[r.j]:
            near.setdefault(r.i, set()).add(r.j)
            near.setdefault(r.j, set()).add(r.i)
    found, out = set(), {}
    for v in sorted(of):
        if v not in found:
            out[of[v]] = out.get(of[v], 0) + 1
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in found:
                    found.add(x)
                    todo += near.get(x, ())
    return of, out


def test_leiden_communities_are_connected(spark):
    rng = np.random.default_rng(4)
    # Eight planted groups of 20; few links between them.
    group = np.arange(160) // 20
    edges = [(i, j, 1.0) for i in range(160) for j in range(i + 1, 160) if rng.random() < (0.35 if group[i] == group[j] else 0.02)]
    planted = spark.createDataFrame(edges, "i long, j long, w double")
    # A ring of bridges: nodes between two triangles, which moves easily tear apart.
    ring = [(3 * k + a, 3 * k + b, 1.0) for k in range(12) for a, b in ((0, 1), (1, 2), (0, 2))] + [(3 * k + 2, 3 * k + 3, 1.5) for k in range(11)]
    planted, ring = planted.cache(), spark.createDataFrame(ring, "i long, j long, w double").cache()
    for graph, levels in ((planted, 3), (ring, 2)):
        found = stored(cluster.leiden(graph.repartition(3), levels=levels, rounds=4), "leiden")
        of, n = pieces(graph, found)
        assert set(n.values()) == {1} and all(label == min(v for v in of if of[v] == label) for label in n)
        if graph is planted:
            mine, theirs = (cluster.modularity(graph, x).first()[0] for x in (found, cluster.louvain(graph, levels=3, rounds=4)))
            assert mine >= theirs - 1e-9 and rand_index(list(of.items()), lambda i: i // 20) >= 0.95


def test_neighbour_descent(spark):
    """Recall against brute force on vectors without structure, with outliers, a hub and copies."""
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(0, 1, (600, 12)), 50 * np.eye(12)[:4], np.zeros((1, 12)), np.ones((30, 12))])
    n = len(points)
    emb = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "cell_id long, vec array<double>")
    for metric in ("euclidean", "cosine"):
        exact = {(r.cell_id, r.neighbor): r.similarity for r in reduce.knn(emb, 5, metric).collect()}
        rows = reduce.knn_descent(emb.repartition(5), 5, metric).collect()
        assert len(rows) == 5 * n and all(r.cell_id != r.neighbor for r in rows)
        worst = {}
        for (i, _), s in exact.items():
            worst[i] = min(worst.get(i, s), s)
        assert sum(r.similarity >= worst[r.cell_id] for r in rows) >= 0.95 * len(rows)
    few = reduce.knn_descent(emb.limit(3), 5)
    assert few.count() == 6 and reduce.knn_descent(emb.limit(0), 5).count() == 0


def trustworthiness(points, laid, k):
    """1 for a layout whose ``k`` nearest are among the ``k`` nearest of the points."""
    far, near = (((p[:, None] - p[None]) ** 2).sum(2) for p in (points, laid))
    np.fill_diagonal(far, -1)
    np.fill_diagonal(near, np.inf)
    n, rank = len(points), far.argsort(1).argsort(1)
    excess = np.maximum(0, np.take_along_axis(rank, near.argsort(1)[:, :k], 1) - k).sum()
    return 1 - 2 * excess / (n * k * (2 * n - 3 * k - 1))


def test_fuzzy_graph(spark):
    rows = [(1, 2, -1.0), (1, 3, -2.0), (1, 4, -4.0), (2, 1, -1.0), (3, 1, -2.0), (3, 2, -2.0), (4, 1, -4.0)]
    got = {(r.i, r.j): r.share for r in reduce.fuzzy_graph(spark.createDataFrame(rows, "cell_id long, neighbor long, similarity double").repartition(3)).collect()}
    lists, one = {}, {}
    for i, j, s in rows:
        lists.setdefault(i, []).append((j, s))
    for i, own in lists.items():
        nearest, usual = max(s for _, s in own), np.mean([max(s for _, s in own) - s for _, s in own])
        one |= {(i, j): np.exp(-(nearest - s) / usual) if usual else 1.0 for j, s in own}
    weight = {(a, b): one.get((a, b), 0) + one.get((b, a), 0) - one.get((a, b), 0) * one.get((b, a), 0) for p in one for a, b in (p, p[::-1])}
    for (i, j), w in weight.items():
        assert got[i, j] == pytest.approx(w / sum(v for (a, _), v in weight.items() if a == i), abs=1e-6)
    assert got.keys() == weight.keys()


def test_layout_of_neighbours(spark):
    """Four clusters are laid out apart from a start that knows nothing of them, and alike under any partitioning."""
    rng = np.random.default_rng(21)
    points = np.concatenate([c + rng.normal(0, 1, (40, 8)) for c in rng.normal(0, 4, (4, 8))])
    emb = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "cell_id long, vec array<double>")
    near = stored(reduce.knn(emb, 10, "euclidean"), "near")
    blind = rng.normal(0, 1, (160, 2))
    start = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(blind)], "cell_id long, x double, y double")
    rows = reduce.layout_neighbors(near, start).orderBy("cell_id").collect()
    laid = np.array([(r.x, r.y) for r in rows])
    assert [r.cell_id for r in rows] == list(range(160)) and np.isfinite(laid).all()
    assert trustworthiness(points, blind, 10) < 0.6 and trustworthiness(points, laid, 10) >= 0.9
    group = np.repeat(range(4), 40)
    nearest = ((laid[:, None] - laid[None]) ** 2).sum(2).argsort(1)[:, 1:6]
    assert (group[nearest] == group[:, None]).mean() >= 0.95
    short = [sorted(map(tuple, reduce.layout_neighbors(near.repartition(p), start.repartition(p, "x"), rounds=3).collect())) for p in (1, 5)]
    assert short[0] == short[1]
    # Without neighbours, at one point, alone, none.
    some = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "cell_id long, x double, y double")
    apart = reduce.layout_neighbors(near.limit(0), some, rounds=2).collect()
    assert len({(r.x, r.y) for r in apart}) == 3
    assert reduce.layout_neighbors(near.limit(0), some.limit(1), rounds=2).count() == 1
    assert reduce.layout_neighbors(near.limit(0), some.limit(0), rounds=2).count() == 0


def test_subspace_pca_equals_gram(matrix, dense, monkeypatch):
    layer, genes = norm.log_norm(matrix[0]), [3, 0, 7, 1, 2, 10, 9, 8, 4, 5, 6]
    for scaled in (False, True):
        monkeypatch.setattr(reduce, "MAX_GENES", 5_000)
        want = reduce.pca(layer, genes, 60, 3, scaled)
        monkeypatch.setattr(reduce, "MAX_GENES", 5)
        got = reduce.pca(layer, genes, 60, 3, scaled)
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got, want))
    ratios = [reduce.explained_variance(layer, genes, 60, 3).collect()]
    monkeypatch.setattr(reduce, "MAX_GENES", 5_000)
    ratios.append(reduce.explained_variance(layer, genes, 60, 3).collect())
    assert [r.ratio for r in ratios[0]] == pytest.approx([r.ratio for r in ratios[1]], abs=1e-8)
    # Fewer vectors than genes: the block must be iterated.
    got = reduce.subspace_pca(layer, genes, 60, 2, extra=2)
    assert np.allclose(got[0], want[0][:, :2] if not scaled else reduce.pca(layer, genes, 60, 2)[0], atol=1e-6)


def test_subspace_pca_of_many_genes(spark):
    """20,000 genes, two planted directions."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        for g in rng.choice(20_000, 40, replace=False):
            rows.append((i, int(g), 0.1))
        rows += [(i, 20_000 + (i % 3), 5.0)]
    layer = spark.createDataFrame(rows, "cell_id long, gene_id long, v double").groupBy("cell_id", "gene_id").agg(F.sum("v").alias("v"))
    genes = list(range(20_003))
    loadings, values, mean = reduce.pca(layer, genes, 60, 2)
    assert loadings.shape == (20_003, 2) and mean[20_000] == pytest.approx(5 / 3)
    dense = np.zeros((60, 20_003))
    for r in layer.collect():
        dense[r.cell_id, r.gene_id] = r.v
    want = np.linalg.svd(dense - dense.mean(0), compute_uv=False)[:2] ** 2 / 59
    assert values == pytest.approx(want, rel=1e-9)


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x)) for g, n in (("a", 1), ("b", 2), (None, 301), ("c", 1000)) for x in np.round(rng.exponential(3, n) ** 3, 2)] + [("d", 4.0)] * 7 + [("d", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = (0, 0.1, 0.5, 0.99, 1)
    got = {r[0]: (r.n, list(r)[2:]) for r in quantiles(df, "x", wanted, "g").collect()}
    for g in ("a", "b", None, "c", "d"):
        own = [x for k, x in rows if k == g and x is not None]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(np.quantile(own, wanted).tolist())
    assert list(quantiles(df, "x", [0.5]).first()) == pytest.approx([1311, np.median([x for _, x in rows if x is not None])])
    assert quantiles(df.limit(0), "x", [0.5], "g").count() == 0
    assert {r[0]: (r.n, list(r)[2:]) for r in quantiles(df, "x", wanted, "g", split=50).collect()} == got


def test_graph_pieces(spark):
    two = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (2, 3, 1.0)], "i long, j long, w double")
    assert {r.label for r in cluster.connected_components(two).collect()} == {0}
    halves = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, label long")
    assert cluster.modularity(two, halves).first()[0] == pytest.approx(2 * (3 / 7 - 0.25))
    assert {(r.node, r.label) for r in cluster.louvain(two).collect()} == {(i, 3 * (i // 3)) for i in range(6)}


def test_canonicalize(spark):
    bad = "cell_id long, gene_id long, cnt double"
    ok = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 2, 0.0)], bad)
    assert [tuple(r) for r in canonicalize(ok).collect()] == [(1, 1, 5)]
    for v in (-1.0, 1.5):
        with pytest.raises(PySparkException):
            canonicalize(spark.createDataFrame([(1, 1, v)], bad)).collect()


@pytest.mark.parametrize("fmt", ["parquet", "csv", "orc", "json"])
def test_readers_check_counts(spark, tmp_path, fmt):
    def stored(rows, name):
        spark.createDataFrame(rows, "`c.1` long, g long, x double").write.options(header=True).format(fmt).save(f"file://{tmp_path}/{name}")
        return f"file://{tmp_path}/{name}"

    fine = stored([(1, 1, 2.0), (1, 2, 0.0), (1, 1, 3.0)], "fine")
    assert sorted(map(tuple, read_long(spark, fine, "c.1", "g", "x", fmt).collect())) == [(1, 1, 2), (1, 1, 3)]
    assert sorted(map(tuple, read_wide(spark, fine, "c.1", fmt=fmt).collect())) == [(1, "g", 1), (1, "g", 1), (1, "g", 2), (1, "x", 2), (1, "x", 3)]
    for i, bad in enumerate((1.5, -2.0, None)):
        path = stored([(1, 1, 2.0), (1, 2, bad)], f"bad{i}")
        for read in (lambda: read_long(spark, path, "c.1", "g", "x", fmt), lambda: read_wide(spark, path, "c.1", ["x"], fmt)):
            with pytest.raises(PySparkException):
                read().collect()


def test_events_are_summed_and_checked(spark):
    schema = "a long, b long, x double"
    ok = spark.createDataFrame([(1, 1, 0.5), (1, 1, 1.5), (2, 1, None), (3, 1, 1.0), (3, 1, -1.0)], schema)
    assert [tuple(r) for r in matrix_from_events(ok, "a", "b", "x").collect()] == [(1, 1, 2)]
    for bad in (0.5, -1.0):
        with pytest.raises(PySparkException):
            matrix_from_events(spark.createDataFrame([(1, 1, bad)], schema), "a", "b", "x").collect()


_TOP = "%%MatrixMarket matrix coordinate integer general\n"


@pytest.mark.parametrize("by_text", [False, True])
def test_read_mtx(spark, tmp_path, by_text):
    (tmp_path / "matrix.mtx").write_text(_TOP + "% note\n" * 12_000 + "\n3 2 4\n1 1 5\n 3   1  2\n\n2 2 1\n3 2 4\n")
    (tmp_path / "genes.tsv").write_text("a\tx\nb\ty\nc\tz\n")
    (tmp_path / "barcodes.tsv").write_text("c1\nc2\n")
    counts, cells, genes = read_mtx(spark, f"file://{tmp_path}", by_text=by_text)
    assert sorted(map(tuple, counts.collect())) == [(1, 1, 5), (1, 3, 2), (2, 2, 1), (2, 3, 4)]
    assert sorted(map(tuple, cells.collect())) == [(1, "c1"), (2, "c2")]
    assert sorted(map(tuple, genes.collect())) == [(1, "a"), (2, "b"), (3, "c")]


@pytest.mark.parametrize("by_text", [False, True])
def test_read_matrix_checks_what_it_reads(spark, tmp_path, by_text):
    def read(text, size=1 << 20):
        path = tmp_path / "m.mtx"
        path.write_text(text)
        return sorted(map(tuple, read_matrix(spark, f"file://{path}", by_text, size).collect()))

    assert read("2 2 1\n2 1 3") == [(1, 2, 3)]
    symmetric = "%%MatrixMarket matrix coordinate real symmetric\n3 3 3\n1 1 2.0\n3 1 4e0\n3 2 0\n"
    assert read(symmetric) == [(1, 1, 2), (1, 3, 4), (3, 1, 4)]
    assert read("%%MatrixMarket matrix coordinate pattern general\n2 3 2\n1 3\n2 1\n") == [(1, 2, 1), (3, 1, 1)]
    assert read(_TOP + "2 2 2\n1 1 4\n1 1 1\n") == [(1, 1, 5)] and read(_TOP + "2 2 0\n") == []
    bad = ["2 2 1\n9 9 1\n", "2 2 1\n0 1 1\n", "2 2 3\n1 1 1\n", "2 2 1\n1 1 1\n2 2 2\n", "2 2 1\n1 1\n", "2 2 1\n1 1 -4\n", "2 2 1\n1 1 0.5\n", "2 x 1\n1 1 1\n", "", "%%MatrixMarket matrix array real general\n2 2\n1\n1\n1\n1\n", "2 2 1\n1 1 1 1\n", "2 2 1\n1 b 1\n"]
    for text in bad:
        with pytest.raises((ValueError, PySparkException)):
            read(text)


def test_matrix_source_reads_ranges_of_bytes(spark, tmp_path):
    """Every line belongs to the range in which it begins, wherever ranges end; compressed files and folders of parts are read alike."""
    import gzip

    rng = np.random.default_rng(3)
    entries = [(int(r) + 1, int(c) + 1, int(v)) for (r, c), v in zip(np.argwhere(np.ones((30, 20))), rng.integers(1, 10**6, 600))]
    text = _TOP + f"30 20 {len(entries)}\n" + "".join(f"{r} {c} {v}\n" for r, c, v in entries)
    want = sorted((c, r, v) for r, c, v in entries)
    for name, body in (("plain.mtx", text), ("open.mtx", text.rstrip("\n"))):
        (tmp_path / name).write_text(body)
        for size in (37, 1000, 1 << 20):
            assert sorted(map(tuple, read_matrix(spark, f"{tmp_path}/{name}", partition_bytes=size).collect())) == want
    with gzip.open(tmp_path / "m.mtx.gz", "wt") as out:
        out.write(text)
    for by_text in (False, True):
        assert sorted(map(tuple, read_matrix(spark, f"file://{tmp_path}/m.mtx.gz", by_text).collect())) == want
    assert spark.read.format("mtx").option("partitionBytes", 1000).load(f"{tmp_path}/plain.mtx").rdd.getNumPartitions() == -(-(len(text) - len(_TOP) - len("30 20 600\n")) // 1000)
    counts = spark.createDataFrame(want, "cell_id long, gene_id long, cnt long").repartition(3)
    write_mtx(counts, 20, 30, f"{tmp_path}/parts.mtx")
    assert sorted(map(tuple, read_matrix(spark, f"{tmp_path}/parts.mtx", partition_bytes=500).collect())) == want


def test_fingerprint_ignores_order(matrix):
    counts = matrix[0]
    assert outputs.fingerprint(counts) == outputs.fingerprint(counts.repartition(9)) == outputs.fingerprint(counts.orderBy(F.desc("cnt")))
    assert outputs.fingerprint(counts) != outputs.fingerprint(counts.where("cell_id > 0"))


def test_fingerprint_is_observed_while_a_table_is_stored(matrix):
    table, found = outputs.fingerprinted(matrix[0].repartition(3), lambda df: stored(df, "counts"))
    assert found == outputs.fingerprint(matrix[0]) == outputs.fingerprint(table) and table.columns == matrix[0].columns
    assert outputs.fingerprinted(matrix[0].limit(0), lambda df: stored(df, "counts"))[1] == outputs.fingerprint(matrix[0].limit(0)) == "0:0"


@pytest.mark.parametrize("hub", [1_024, 7])
def test_shared_neighbours_around_a_hub(spark, monkeypatch, hub):
    monkeypatch.setattr(reduce, "HUB", hub)
    rng = np.random.default_rng(5)
    lists = {i: {0 if i else 99, *map(int, rng.integers(1, 60, 3))} - {i} for i in range(60)}
    df = spark.createDataFrame([(i, j) for i, near in lists.items() for j in near], "cell_id long, neighbor long")
    want = {(i, j): len(lists[i] & lists[j]) / len(lists[i] | lists[j]) for i in lists for j in lists if i < j and lists[i] & lists[j]}
    assert {(r.i, r.j): r.w for r in reduce.snn(df).collect()} == pytest.approx(want)


def test_empty_tables(spark):
    counts = spark.createDataFrame([], "cell_id long, gene_id long, cnt long")
    cells = spark.createDataFrame([], "cell_id long, grp string")
    assert qc.cell_metrics(counts, cells).count() == 0
    assert de.wilcoxon(norm.log_norm(counts), cells).count() == 0
    assert norm.hvg(norm.gene_moments(norm.log_norm(counts), 0), 5).count() == 0


def brute_nearest(x, k, metric):
    """(cell, neighbour, similarity) by double precision over all pairs, ties by id."""
    y = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x
    out = []
    for i in range(len(y)):
        sim = np.round(y @ y[i] if metric == "cosine" else -np.sqrt(((y - y[i]) ** 2).sum(1)), 6) + 0.0
        near = sorted((-s, j) for j, s in enumerate(sim.tolist()) if j != i and math.isfinite(s))[:k] if np.isfinite(y[i]).all() else []
        out += [(i, j, -s) for s, j in near]
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_nearest_measures_few_pairs(metric, monkeypatch):
    """copies, near copies and far offsets give the brute-force neighbours, though single precision leaves out most pairs."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1_500, 16))
    x[100:160], x[200:230] = x[7], x[9] + 1e-7 * rng.normal(size=(30, 16))
    x[300] = np.nan
    measured, own = [], reduce._similarities
    monkeypatch.setattr(reduce, "_similarities", lambda a, b, i, j, *rest: (measured.append(len(i)), own(a, b, i, j, *rest))[1])
    monkeypatch.setattr(reduce, "BLOCK", 128)
    for offset in (0.0, 50.0):
        points = x + offset
        sides = [pa.table({"side": np.full(1_500, side), "cell_id": np.arange(1_500), "vec": points.tolist()}) for side in (0, 1)]
        found = reduce._nearest(pa.concat_tables(sides), 4, metric, 6).to_pydict()
        want = brute_nearest(points, 4, metric)
        assert list(zip(found["cell_id"], found["neighbor"])) == [(i, j) for i, j, _ in want]
        assert found["similarity"] == pytest.approx([s for _, _, s in want], abs=1.1e-6)
        if not offset:
            assert sum(measured) < 0.2 * 1_500**2


def test_knn_approx_of_wide_and_narrow_buckets(spark, monkeypatch):
    """buckets so wide that they tell nothing apart aren't joined; narrow ones are, and cells short of neighbours there are searched exactly."""
    x = np.random.default_rng(4).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    emb = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    keys, own = [], reduce._met
    monkeypatch.setattr(reduce, "_met", lambda of, e, by, *rest: (keys.append(tuple(by)), own(of, e, by, *rest))[1])
    want = [(i, j) for i, j, _ in brute_nearest(x, 4, "euclidean")]
    wide = reduce.knn_approx(emb, 4, radius=1.2, bucket=0.5).orderBy("cell_id", "rank").collect()
    assert [(r.cell_id, r.neighbor) for r in wide] == want and keys == [()]
    narrow = reduce.knn_approx(emb, 4, radius=0.9, bucket=0.05).collect()
    assert keys[1:] == [("table", "bucket"), ()] and len(narrow) == 1_200
    assert len({(r.cell_id, r.neighbor) for r in narrow} & set(want)) > 0.5 * len(want)


@pytest.mark.parametrize(
    "operator",
    [
        pytest.param(lambda g: cluster.connected_components(g), id="F2"),
        pytest.param(lambda g: cluster.label_propagation(g, 3), id="F4"),
        pytest.param(lambda g: reduce.snn(g.select(F.col("i").alias("cell_id"), F.col("j").alias("neighbor"))), id="F5"),
        pytest.param(lambda g: cluster.leiden(g, levels=1, rounds=2), id="F6-F14"),
        pytest.param(lambda g: cluster.louvain(g, levels=1, rounds=2), id="F9"),
        pytest.param(lambda g: cluster.pic(g, 2, iterations=2), id="F10"),
        pytest.param(lambda g: cluster.modularity(g, g.sparkSession.range(40).select(F.col("id").alias("node"), (F.col("id") % 2).alias("label"))), id="F12"),
    ],
)
def test_graphs_are_computed_once(spark, operator):
    """Graphs come from an exact search, which several passes over them must not repeat."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pairs = [(i, j, 1.0) for i in range(40) for j in range(i + 1, 40) if (i * j + i) % 5 == 0 or i // 8 == j // 8]
    graph = spark.createDataFrame(pairs, "i long, j long, w double").mapInArrow(counted, "i long, j long, w double")
    operator(graph).collect()
    assert seen.value == len(pairs)


def test_descent_is_turned_down_where_it_falls_short(spark, monkeypatch):
    """vectors without structure in many dimensions get their exact neighbours, as do those of which a descent finds too few; others are left to it."""
    descended, own = [], reduce.descent
    monkeypatch.setattr(reduce, "descent", lambda *args: (descended.append(1), own(*args))[1])
    rng = np.random.default_rng(2)
    flat, deep = rng.normal(size=(400, 3)) @ rng.normal(size=(3, 40)), rng.normal(size=(400, 40))
    table = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, vec array<double>")
    pairs = lambda rows: [(r.cell_id, r.neighbor) for r in rows.orderBy("cell_id", "rank").collect()]
    assert pairs(reduce.knn_descent(table(deep), 5)) == [(i, j) for i, j, _ in brute_nearest(deep, 5, "euclidean")] and not descended
    want = [(i, j) for i, j, _ in brute_nearest(flat, 5, "euclidean")]
    assert len({*pairs(reduce.knn_descent(table(flat), 5))} & {*want}) >= 0.95 * len(want) and len(descended) == 1
    # No rounds, so that lists stay as they were dealt.
    assert pairs(reduce.knn_descent(table(flat), 5, rounds=0)) == want and len(descended) == 2


def test_charts_compute_their_layer_once(spark, tmp_path, monkeypatch):
    """F15, F16: tests and means read one stored layer."""
    from cytoframe.plans import queries

    counts = [(i, j, float(1 + (i * j) % 3)) for i in range(12) for j in range(5) if (i + j) % 3]
    spark.createDataFrame([(i, f"g{i % 2}", 0, 0.0) for i in range(12)], "c_custkey long, c_mktsegment string, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    layer = spark.createDataFrame(counts, "cell_id long, gene_id long, v double").mapInArrow(counted, "cell_id long, gene_id long, v double")
    monkeypatch.setattr(queries, "_layer", lambda *_: layer)
    for turn, name in enumerate(("o7_heatmap", "o8_volcano")):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 10 and seen.value == (turn + 1) * len(counts)


def open_moves(edges, of, resolution=1.0):
    """Moves that would raise modularity: (node, community of a neighbour), and (community, community that it could enter as a whole)."""
    k, volume, links, between, total = {}, {}, {}, {}, 2 * sum(w for _, _, w in edges)
    for i, j, w in [*edges, *((j, i, w) for i, j, w in edges)]:
        k[i] = k.get(i, 0) + w
        links[i, of[j]] = links.get((i, of[j]), 0) + w
        between[of[i], of[j]] = between.get((of[i], of[j]), 0) + w
    for v, x in k.items():
        volume[of[v]] = volume.get(of[v], 0) + x
    gain = lambda v, c: links.get((v, c), 0) - resolution * k[v] * (volume[c] - (k[v] if of[v] == c else 0)) / total
    nodes = [(v, c) for v, c in links if c != of[v] and gain(v, c) - gain(v, of[v]) > 1e-6]
    return nodes, [(a, b) for (a, b), w in between.items() if a != b and w - resolution * volume[a] * volume[b] / total > 1e-6]


def modularity_of(edges, of, resolution=1.0):
    total, volume = sum(w for _, _, w in edges), {}
    for i, j, w in edges:
        for v in (i, j):
            volume[of[v]] = volume.get(of[v], 0) + w
    return sum(w for i, j, w in edges if of[i] == of[j]) / total - resolution * sum((v / (2 * total)) ** 2 for v in volume.values())


@pytest.mark.parametrize("held", [1 << 18, 1_024, 8])
def test_louvain_leaves_no_move(spark, monkeypatch, held):
    """wherever moves are made, on the driver only the last of them or none, no node and no community is left that gains by one."""
    monkeypatch.setattr(cluster, "_HELD", held)
    rng = np.random.default_rng(6)
    n = 300 if held > 1_024 else 60
    edges = sorted({(min(i, j), max(i, j)) for i in range(n) for j in rng.integers(0, n, 4).tolist() if i != j})
    edges = [(i, j, float(w)) for (i, j), w in zip(edges, rng.choice([0.5, 1.0, 3.0], len(edges)))]
    graph = spark.createDataFrame(edges, "i long, j long, w double")
    of = {r.node: r.label for r in cluster.louvain(graph.repartition(3), 1.2).collect()}
    assert len(of) == n and open_moves(edges, of, 1.2) == ([], [])
    assert all(label == min(v for v in of if of[v] == label) for label in of.values())
    if held == 1_024:
        assert {r.node: r.label for r in cluster.louvain(graph.repartition(7), 1.2).collect()} == of


def test_moves_of_a_round_raise_modularity_together(spark):
    """moves into and out of the same communities, and of neighbours, at once; the offers are those of brute force."""
    rng = np.random.default_rng(7)
    edges = [(i, j, float(rng.integers(1, 4))) for i in range(60) for j in range(i + 1, 60) if i == 0 or rng.random() < 0.08]
    total, both = 2 * sum(w for _, _, w in edges), edges + [(j, i, w) for i, j, w in edges]
    table = stored(spark.createDataFrame(both, "node long, other long, w double"), "edges")
    k = {v: sum(w for i, _, w in both if i == v) for v in range(60)}
    of = {v: int(rng.integers(0, 5)) for v in range(60)}
    for draw in range(4):
        state = spark.createDataFrame([(v, k[v], c) for v, c in of.items()], "node long, k double, label long")
        offers = stored(cluster._offers(table, state, total, 1.0, 0.9, draw), "offers")
        found = {r.node: r.to for r in offers.collect()}
        gaining = open_moves(edges, of, 0.9)[0]
        assert {v for v, _ in gaining} == {v for v, to in found.items() if to is not None} and {(v, to) for v, to in found.items() if to is not None} <= {*gaining}
        after = {r.node: r.label for r in cluster._taken(table, offers, total, 1.0, 0.9).collect()}
        assert all(after[v] in (of[v], found[v]) for v in of)
        moved = [v for v in of if after[v] != of[v]]
        assert moved and modularity_of(edges, after, 0.9) > modularity_of(edges, of, 0.9)
        of = after
