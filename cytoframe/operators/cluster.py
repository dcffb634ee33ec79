"""Clustering of embeddings and graphs, and measures of agreement.

Graphs are edge lists (i, j, w) with i < j. Labels are (node or cell_id, label).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.cuts import forget, freeing_shuffles, stored
from .reduce import summed


#: Vectors whose distances to all centres are held at once.
_BLOCK = 4_096
_NEAREST = "struct<label: int, d: double>"


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _assigned(x: np.ndarray, names: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of the nearest centre of each row, the first among equals, and the squared distance, rounded to nine digits.

    Each distance is summed up by itself, so it doesn't depend on the rows beside it.
    """
    label, least = np.zeros(len(x), np.int32), np.zeros(len(x))
    for lo in range(0, len(x), _BLOCK):
        part = x[lo : lo + _BLOCK]
        d = np.stack([((part - c) ** 2).sum(1) for c in centres], 1).round(9)
        best = d.argmin(1)
        label[lo : lo + _BLOCK], least[lo : lo + _BLOCK] = names[best], d[np.arange(len(part)), best]
    return label, least


def _nearest(emb: DataFrame, centroids: list[tuple[int, list[float]]]) -> DataFrame:
    """Adds label and d, the nearest of few centroids and the squared distance to it."""
    names, centres = np.array([k for k, _ in centroids], np.int32), np.array([c for _, c in centroids], np.float64)

    def found(vectors: pa.Array) -> pa.Array:
        label, d = _assigned(_matrix(vectors), names, centres)
        return pa.StructArray.from_arrays([pa.array(label), pa.array(d)], ["label", "d"])

    to = F.arrow_udf(found, _NEAREST)
    return emb.withColumn("near_", to("vec")).select(*emb.columns, "near_.label", "near_.d")


def kmeans_step(emb: DataFrame, centroids: DataFrame) -> DataFrame:
    """One Lloyd iteration from given centroids (label, vec): (label, n, vec), means rounded to nine digits.

    Tasks add up their vectors by label and send a row for each. Rounding makes the
    result independent of the order in which these sums arrive.
    """
    given = sorted((r["label"], list(r["vec"])) for r in centroids.collect())  # k rows
    names, centres = np.array([k for k, _ in given], np.int32), np.array([c for _, c in given], np.float64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), centres.shape[1] + 1))
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                at = np.searchsorted(names, _assigned(x, names, centres)[0])
                np.add.at(total, at, np.concatenate([np.ones((len(x), 1)), x], 1))
        met = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(names[met], pa.int32()), pa.array(list(total[met]), pa.list_(pa.float64()))], ["row", "values"])

    parts = emb.select("vec").mapInArrow(sums, "row int, values array<double>")
    means = F.transform(F.slice("values", 2, centres.shape[1]), lambda x: F.round(x / F.col("values")[0], 9))
    return summed(parts).select(F.col("row").alias("label"), F.col("values")[0].cast("long").alias("n"), means.alias("vec"))


def _reclustered(points: np.ndarray, weights: np.ndarray, k: int, seed: int, restarts: int = 10) -> np.ndarray:
    """``k`` centres of few weighted points: k-means++ and Lloyd on the driver, the cheapest of some restarts."""
    best, least = points[:k], np.inf
    for turn in range(restarts):
        rng = np.random.default_rng([seed % (1 << 32), turn])
        chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
        while len(chosen) < k:
            d = np.min([((points - points[c]) ** 2).sum(1) for c in chosen], 0) * weights
            if not d.sum():
                break
            chosen.append(int(rng.choice(len(points), p=d / d.sum())))
        centres = points[chosen]
        for _ in range(50):
            label, d = _assigned(points, np.arange(len(centres), dtype=np.int32), centres)
            held = np.bincount(label, weights, len(centres))
            sums = np.stack([np.bincount(label, weights * x, len(centres)) for x in points.T], 1)
            following = np.where(held[:, None] > 0, sums / np.maximum(held, 1e-300)[:, None], centres)
            if np.allclose(following, centres, rtol=0, atol=1e-9):
                break
            centres = following
        cost = float((_assigned(points, np.arange(len(centres), dtype=np.int32), centres)[1] * weights).sum())
        if cost < least - 1e-12:
            best, least = centres, cost
    return best


def kmeans_seeds(emb: DataFrame, k: int, seed: int = 0, rounds: int = 5, oversampling: float = 2.0) -> list[list[float]]:
    """At most ``k`` starting centres by k-means||: in each round every cell is drawn with a chance of ``oversampling`` * k times its share of the cost so far.

    Draws come from a hash of cell, seed and round and costs are summed as decimals, so the same cells are drawn
    under any partitioning. The candidates, about ``oversampling`` * k * ``rounds`` of them, are weighted by the cells nearest to
    them and clustered on the driver.
    """
    first = emb.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(1).collect()
    centres = [list(map(float, r["vec"])) for r in first]
    if not centres:
        return []
    for turn in range(rounds):
        scored = _nearest(emb, list(enumerate(centres)))
        cost = scored.agg(F.sum(F.col("d").cast("decimal(38,9)")).cast("double")).first()[0]
        if not cost:
            break
        drawn = F.pmod(F.xxhash64("cell_id", F.lit(seed), F.lit(turn + 1)), F.lit(1 << 52)) / float(1 << 52)
        for r in scored.where(drawn * cost < oversampling * k * F.col("d")).select("cell_id", "vec").orderBy("cell_id").collect():
            centres.append(list(map(float, r["vec"])))
    points = np.unique(np.array(centres), axis=0)
    counts = {r["label"]: r["n"] for r in _nearest(emb, [(i, list(p)) for i, p in enumerate(points)]).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([counts.get(i, 0) for i in range(len(points))], float)
    return np.round(_reclustered(points, weights, k, seed), 9).tolist()


def kmeans(emb: DataFrame, k: int, seed: int = 0, iterations: int = 20, start: list[list[float]] | None = None) -> DataFrame:
    """(cell_id, label) by Lloyd from given centres, or from those of :func:`kmeans_seeds`: the same under any partitioning.

    Each iteration is one distributed aggregation; ``k`` centroids at a time are on the driver.
    Where there are fewer than ``k`` different vectors, there are fewer labels.
    """
    spark, emb = emb.sparkSession, stored(emb.select("cell_id", "vec"), "vectors")
    now = list(enumerate(kmeans_seeds(emb, k, seed) if start is None else start))
    if not now:
        return emb.select("cell_id", F.lit(0).alias("label"))
    for _ in range(iterations):
        step = kmeans_step(emb, spark.createDataFrame(now, "label int, vec array<double>"))
        new = {r["label"]: list(r["vec"]) for r in step.collect()}
        following = [(i, new.get(i, c)) for i, c in now]  # a centroid without cells stays
        if following == now:
            break
        now = following
    return _nearest(emb, now).select("cell_id", "label")


def _both_ways(graph: DataFrame) -> DataFrame:
    """(node, other, w): each edge in both directions, the graph being computed once."""
    ends = (F.struct(F.col(a).alias("node"), F.col(b).alias("other"), "w") for a, b in ("ij", "ji"))
    return graph.select(F.explode(F.array(*ends)).alias("edge")).select("edge.*")


def label_propagation(graph: DataFrame, iterations: int = 5, digits: int = 9) -> DataFrame:
    """(node, label): each round a node takes the label with most weight around it, the smallest among equals."""
    edges = stored(_both_ways(graph), "edges")  # every round reads them
    labels = edges.select("node").distinct().withColumn("label", F.col("node"))
    for _ in range(iterations):
        votes = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.round(F.sum("w"), digits).alias("weight"))
        # The best label as an aggregate with partial sums: no node's neighbourhood is sorted.
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("weight")).alias("weight"), "label")).alias("best"))
        labels = stored(best.select("node", F.col("best.label").alias("label")), "step")
    return labels


def connected_components(graph: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by least labels and pointer jumping."""
    edges = stored(_both_ways(graph).select("node", "other").distinct(), "edges")  # every round reads them
    labels = stored(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "step")
    while True:
        around = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(around, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("target"))
        jumped = step.join(labels.select(F.col("node").alias("target"), F.col("label").alias("far")), "target", "left")
        moved = stored(jumped.select("node", "before", F.least("target", F.coalesce("far", "target")).alias("label")), "step")
        labels = moved.select("node", "label")
        if moved.where("label <> before").isEmpty():
            return labels


def _moved(edges: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int, level: int) -> tuple[DataFrame, bool]:
    """Nodes (node, k, label) after parallel moves to the neighbouring community with the largest positive gain of modularity, and whether any moved.

    In each round half of the nodes, chosen by hash, may move; halves keep neighbours from swapping for ever.
    """
    moved_any = False
    for turn in range(rounds):
        volume = state.groupBy("label").agg(F.sum("k").alias("volume"))
        near = edges.where("node <> other").join(state.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("w").alias("links"))
        own = state.select("node", "k", F.col("label").alias("own"))
        options = own.select("node", "k", "own", F.col("own").alias("label")).union(near.join(own, "node").where("label <> own").select("node", "k", "own", "label"))
        scored = options.join(near, ["node", "label"], "left").join(volume, "label")
        rest = F.col("volume") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.coalesce("links", F.lit(0.0)) - resolution * F.col("k") * rest / total, 9)
        least = F.min(F.struct((-F.col("gain")).alias("loss"), (F.col("label") != F.col("own")).alias("moves"), "label")).alias("best")
        best = scored.withColumn("gain", gain).groupBy("node").agg(least, F.first("own").alias("own"), F.first("k").alias("k"))
        turns = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(2)) == turn % 2
        after = stored(best.select("node", "k", "own", F.when(turns, F.col("best.label")).otherwise(F.col("own")).alias("label")), "step")
        changed = not after.where("label <> own").isEmpty()
        state = after.select("node", "k", "label")
        moved_any |= changed
        if not changed and turn % 2:
            break
    return state, moved_any


def _named(state: DataFrame) -> DataFrame:
    """(node, label) with communities named after their least nodes."""
    names = state.groupBy("label").agg(F.min("node").alias("name"))
    return stored(state.join(names, "label").select("node", F.col("name").alias("label")), "step")


def _aggregated(edges: DataFrame, state: DataFrame) -> DataFrame:
    """The graph whose nodes are the communities."""
    a, b = (state.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to")) for c in ("node", "other"))
    return stored(edges.join(a, "node").join(b, "other").groupBy("node_to", "other_to").agg(F.sum("w").alias("w")).toDF("node", "other", "w"), "step")


def _carried(member: DataFrame, state: DataFrame) -> DataFrame:
    return stored(member.join(state.select(F.col("node").alias("label"), F.col("label").alias("to")), "label").select("node", F.col("to").alias("label")), "step")


def _offers(edges: DataFrame, state: DataFrame, total: float, unit: float, resolution: float, draw: int) -> DataFrame:
    """(node, k, label, to, gain, turn): ``state`` with the neighbouring community to which a node's move adds most to modularity, the gain over staying in mean edges, and a draw from (0, 1]; ``to`` is null where nothing gains."""
    held = state.join(state.groupBy("label").agg(F.sum("k").alias("volume")), "label")
    around = edges.join(held.select(F.col("node").alias("other"), "label", "volume"), "other").groupBy("node", "label").agg(F.sum("w").alias("links"), F.first("volume").alias("volume"))
    own = held.select("node", "k", F.col("label").alias("own"), F.col("volume").alias("held"))
    away = F.round((F.col("links") - resolution * F.col("k") * F.col("volume") / total) / unit, 9)
    least = F.min(F.when(F.col("label") != F.col("own"), F.struct((-away).alias("loss"), "label"))).alias("best")
    within = F.max(F.when(F.col("label") == F.col("own"), F.col("links"))).alias("within")
    best = own.join(around, "node", "left").groupBy("node").agg(F.first("k").alias("k"), F.first("own").alias("label"), F.first("held").alias("held"), within, least)
    stay = (F.coalesce("within", F.lit(0.0)) - resolution * F.col("k") * (F.col("held") - F.col("k")) / total) / unit
    gain = best.select("node", "k", "label", "best", F.round(-F.col("best.loss") - stay, 9).alias("gain"))
    turn = (F.pmod(F.xxhash64("node", F.lit(draw)), F.lit(1 << 52)) + 1) / float(1 << 52)
    return gain.select("node", "k", "label", F.when(F.col("gain") > 0, F.col("best.label")).alias("to"), "gain", turn.alias("turn"))


def _taken(edges: DataFrame, offers: DataFrame, total: float, unit: float, resolution: float) -> DataFrame:
    """(node, k, label) after those moves of ``offers`` that raise modularity together.

    Moves stand in the order of their draws. One that comes later loses the links to earlier ones that leave the community it
    goes to or enter the one it leaves, and what all earlier ones of its source and of its target weigh; it is made if
    its gain is larger. What is left out of that sum can only add to modularity, so no round lowers it. Weights are summed over halves,
    quarters, eighths .. of the draws, not one by one: no community is gathered in a task.
    """
    movers = offers.where(F.col("to").isNotNull()).select("node", "k", F.col("label").alias("own"), "to", "turn")
    other = movers.select(F.col("node").alias("other"), F.col("own").alias("leaves"), F.col("to").alias("enters"), F.col("turn").alias("first"))
    met = edges.join(movers.select("node", "own", "to", "turn"), "node").join(other, "other").where("first <= turn")
    lost = met.select("node", F.col("w") / unit * ((F.col("leaves") == F.col("to")).cast("int") + (F.col("enters") == F.col("own")).cast("int")))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("own").alias("label")), F.struct(F.lit(1).alias("end"), F.col("to").alias("label")))).alias("at")
    sides = movers.select("node", "k", F.floor(-F.log2("turn")).alias("half"), ends).select("node", "k", "half", "at.*")
    earlier = Window.partitionBy("end", "label").orderBy(F.desc("half"))  # a row for each half, 53 at most
    weights = sides.groupBy("end", "label", "half").agg(F.sum("k").alias("weight")).withColumn("weight", F.sum("weight").over(earlier))
    crowd = sides.join(weights, ["end", "label", "half"]).select("node", resolution * F.col("k") * (F.col("weight") - F.col("k")) / total / unit)
    less = lost.union(crowd).toDF("node", "less").select("node", *(F.lit(None).cast(offers.schema[c].dataType).alias(c) for c in ("k", "label", "to")), (-F.col("less")).alias("gain"))
    held = (F.first(c, ignorenulls=True).alias(c) for c in ("k", "label", "to"))
    worth = offers.select("node", "k", "label", "to", "gain").union(less).groupBy("node").agg(*held, F.round(F.sum("gain"), 9).alias("worth"))
    return worth.select("node", "k", F.when(F.col("to").isNotNull() & (F.col("worth") > 0), F.col("to")).otherwise(F.col("label")).alias("label"))


#: Edges that the driver holds at most, of a small graph or around the last nodes that move.
_HELD = 262_144


def _in_turn(edges: dict, k: dict, label: dict, volume: dict, total: float, unit: float, resolution: float) -> dict:
    """The changed labels of the nodes of ``edges`` (node: [(other, w)]) once they have moved one after another until none of them gains; other nodes stay."""
    before, moved = {node: label[node] for node in edges}, True
    while moved:
        moved, todo, waiting = False, deque(sorted(edges)), set(edges)  # all once more, as volumes have changed
        while todo:
            node = todo.popleft()
            waiting.discard(node)
            own, links = label[node], {label[node]: 0.0}
            for other, w in edges[node]:
                if other != node:
                    links[label[other]] = links.get(label[other], 0.0) + w
            volume[own] -= k[node]
            worth = {c: round((x - resolution * k[node] * volume[c] / total) / unit, 9) for c, x in links.items()}
            best = min(worth, key=lambda c: (-worth[c], c != own, c))  # noqa: B023
            volume[best] += k[node]
            if best != own:
                label[node], moved = best, True
                near = [other for other, _ in edges[node] if other in edges and other not in waiting]
                todo.extend(near)
                waiting.update(near)
    return {node: label[node] for node, c in before.items() if label[node] != c}


def _lists(rows: pa.Table) -> dict:
    out: dict = {}
    for node, other, w in zip(*(rows[c].to_pylist() for c in ("node", "other", "w"))):
        out.setdefault(node, []).append((other, w))
    return {node: sorted(near) for node, near in out.items()}


def _moved_in_turn(edges: DataFrame, offers: DataFrame, total: float, unit: float, resolution: float) -> DataFrame | None:
    """(node, k, label) after the nodes of ``offers`` that gain, and those within three edges of them, have moved in turn; none if these nodes have more edges than the driver may hold."""
    spark, kind, found = offers.sparkSession, offers.schema["node"].dataType.simpleString(), None
    table = lambda values, *names: F.broadcast(spark.createDataFrame(pa.table(dict(zip(names, values)))).select(*(F.col(c).cast(kind) for c in names)))
    near = set(offers.where(F.col("to").isNotNull()).select("node").limit(_HELD).toArrow()["node"].to_pylist())
    for _ in range(4):
        rows = edges.join(table([list(near)], "node"), "node").select("node", "other", "w").limit(_HELD + 1).toArrow()
        if len(rows) > _HELD:
            break
        found = rows
        near.update(rows["other"].to_pylist())
    if found is None:
        return None
    held = offers.join(table([list(near)], "node"), "node").select("node", "k", "label").toArrow().to_pydict()
    label, k = dict(zip(held["node"], held["label"])), dict(zip(held["node"], held["k"]))
    sizes = offers.groupBy("label").agg(F.sum("k").alias("volume")).join(table([list({*held["label"]})], "label"), "label").toArrow().to_pydict()
    made = _in_turn(_lists(found), k, label, dict(zip(sizes["label"], sizes["volume"])), total, unit, resolution)
    return offers.join(table([list(made), list(made.values())], "node", "made"), "node", "left").select("node", "k", F.coalesce("made", "label").alias("label"))


def _settled(edges: DataFrame, start: DataFrame, total: float, unit: float, resolution: float, draws: Iterator[int], rounds: int | None, rough: bool) -> tuple[DataFrame, bool]:
    """(node, k, label) after rounds of moves until no node gains by one, and whether any did; ``rough``: until a twentieth of the nodes at most do."""
    edges, state, nodes, turn = edges.where("node <> other"), start, start.count(), 0
    while rounds is None or turn < rounds:
        seen = Observation()
        offers = stored(_offers(edges, state, total, unit, resolution, next(draws)).observe(seen, F.count("to").alias("movers")), "step")
        movers = seen.get["movers"]
        if not movers or (rough and turn and 20 * movers <= nodes):
            forget(offers)
            break
        after = _moved_in_turn(edges, offers, total, unit, resolution) if rounds is None and movers <= _HELD // 256 else None
        following = stored(_taken(edges, offers, total, unit, resolution) if after is None else after, "step")
        forget(offers, *([state] if turn else []))
        state, turn = following, turn + 1
    return state, turn > 0


def _climbed_in_turn(edges: dict, total: float, unit: float, resolution: float, levels: int | None) -> dict:
    """The changed labels of the nodes of a small graph after all levels above it."""
    of, level = {node: node for node in edges}, 0
    while levels is None or level < levels:
        k = {node: sum(w for _, w in near) for node, near in edges.items()}
        made = _in_turn(edges, k, {node: node for node in edges}, dict(k), total, unit, resolution)
        if not made:
            break
        least: dict = {}
        for node in sorted(edges):
            least.setdefault(made.get(node, node), node)
        to = {node: least[made.get(node, node)] for node in edges}
        sums: dict = {}
        for node, near in edges.items():
            at = sums.setdefault(to[node], {})
            for other, w in near:
                at[to[other]] = at.get(to[other], 0.0) + w
        of, edges, level = {node: to[c] for node, c in of.items()}, {node: sorted(near.items()) for node, near in sums.items()}, level + 1
    return {node: c for node, c in of.items() if node != c}


def _climbed(edges: DataFrame, state: DataFrame, total: float, unit: float, resolution: float, draws: Iterator[int], rounds: int | None, levels: int | None) -> tuple[DataFrame, bool]:
    """(node, label) after communities have moved as nodes of a smaller graph, level by level until none does, and whether any did."""
    member, level = _named(state), 0
    small = _aggregated(edges, member)
    while levels is None or level < levels:
        rows = small.limit(_HELD + 1).toArrow() if rounds is None else None
        if rows is not None and len(rows) <= _HELD:
            made = _climbed_in_turn(_lists(rows), total, unit, resolution, None if levels is None else levels - level)
            if made:
                kind = member.schema["label"].dataType.simpleString()
                to = member.sparkSession.createDataFrame(list(made.items()), f"label {kind}, to {kind}")
                member, level = stored(member.join(F.broadcast(to), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "step"), level + 1
            break
        start = stored(small.groupBy("node").agg(F.sum("w").alias("k")).withColumn("label", F.col("node")), "step")
        state, moved = _settled(small, start, total, unit, resolution, draws, rounds, True)
        if not moved:
            break
        state, below = _named(state), small
        member, small, level = _carried(member, state), _aggregated(small, state), level + 1
        forget(below)
    return member, level > 0


def louvain(graph: DataFrame, resolution: float = 1.0, levels: int | None = None, rounds: int | None = None) -> DataFrame:
    """(node, label) by Louvain with parallel moves, until neither a node nor a community gains by a move to a neighbouring community.

    Nodes move; then communities become nodes of a smaller graph and it starts again, until none of them moves. On the way
    up a level is left once few of its nodes would move, as these settle at the end: nodes move once more, from the communities
    found, until none gains, and if communities gain then, all is repeated. No move lowers modularity (see :func:`_taken`).
    Moves are distributed; the last few of a table's nodes, and graphs of communities that have become small, are
    moved in turn on the driver, which holds ``_HELD`` edges at most.
    ``levels`` and ``rounds`` bound the levels and the rounds of each for who wants less than that; there is one way up then,
    and if rounds are bounded, no move is made in turn.
    A community is named after its least node.
    """
    with freeing_shuffles(graph.sparkSession):
        edges = stored(_both_ways(graph), "edges")
        total, rows = edges.agg(F.sum("w"), F.count("w")).first()  # 2m
        alone = stored(edges.groupBy("node").agg(F.sum("w").alias("k")).withColumn("label", F.col("node")), "nodes")
        if not total:
            return alone.select("node", "label")
        rules, once, draws = (total, total / rows, resolution), levels is not None or rounds is not None, count()
        start, first = alone, True
        while True:
            state, _ = _settled(edges, start, *rules, draws, rounds, first)
            member, climbed = _climbed(edges, state, *rules, draws, rounds, None if levels is None else levels - 1)
            if once or not (first or climbed):
                return member
            start, first = stored(alone.select("node", "k").join(member, "node"), "step"), False


def _refined(edges: DataFrame, state: DataFrame, total: float, resolution: float, rounds: int, level: int) -> DataFrame:
    """(node, label): parts of the communities of ``state`` (node, k, label), each connected.

    Every node starts by itself. In each round the nodes of one half that are still by themselves, and well connected
    to the rest of their community, may join the part of a neighbour of the other half, in the same community, with the
    largest positive gain. What is joined stays as it is in that round and no part is ever left, so a part is
    connected as long as each that joins has an edge into it.
    """
    community = state.select("node", "k", F.col("label").alias("community"))
    tagged = edges.where("node <> other").join(community.select("node", "community"), "node")
    inside = stored(tagged.join(community.select(F.col("node").alias("other"), F.col("community").alias("to")), "other").where("community = to").select("node", "other", "w"), "step")
    volume = community.groupBy("community").agg(F.sum("k").alias("all"))
    within = inside.groupBy("node").agg(F.sum("w").alias("within"))
    fit = F.coalesce("within", F.lit(0.0)) >= resolution * F.col("k") * (F.col("all") - F.col("k")) / total - 1e-9
    parts = stored(community.join(volume, "community").join(within, "node", "left").select("node", "k", fit.alias("fit"), F.col("node").alias("label")), "step")
    for turn in range(rounds):
        sizes = parts.groupBy("label").agg(F.sum("k").alias("volume"), F.count(F.lit(1)).alias("members"))
        known = stored(parts.join(sizes, "label").withColumn("mover", (F.pmod(F.xxhash64("node", F.lit(level), F.lit("parts")), F.lit(2)) == turn % 2) & (F.col("members") == 1) & F.col("fit")), "step")
        movers, rest = known.where("mover").select("node", "k"), known.where("not mover").select(F.col("node").alias("other"), "label", "volume")
        links = inside.join(movers, "node").join(rest, "other").groupBy("node", "k", "label", "volume").agg(F.sum("w").alias("links"))
        gain = F.round(F.col("links") - resolution * F.col("k") * F.col("volume") / total, 9)
        chosen = links.withColumn("gain", gain).where("gain > 0").groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "label"))["label"].alias("to"))
        joined = stored(known.join(chosen, "node", "left").select("node", "k", "fit", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")), "step")
        parts = joined.select("node", "k", "fit", "label")
        if turn % 2 and joined.where("moved").isEmpty():
            break
    return _named(parts.select("node", "label"))


def leiden(graph: DataFrame, resolution: float = 1.0, levels: int = 5, rounds: int = 8) -> DataFrame:
    """(node, label) by Leiden with parallel moves, all distributed: every community is connected.

    As in :func:`louvain` nodes move between communities, but what becomes a node of the smaller graph is a
    connected part of a community (see :func:`_refined`); it starts in that community, so moves go on from there. At
    the end a community that moves have left in several pieces is split into these, which can only raise modularity.
    A community is named after its least node.
    """
    edges = whole = stored(_both_ways(graph), "step")
    total = edges.agg(F.sum("w")).first()[0] or 0.0  # 2m
    member = stored(edges.select("node").distinct().withColumn("label", F.col("node")), "step")  # the node of the smaller graph
    if not total:
        return member
    start = stored(edges.groupBy("node").agg(F.sum("w").alias("k")).withColumn("label", F.col("node")), "step")
    found = start.select("node", "label")
    for level in range(levels):
        state, moved_any = _moved(edges, start, total, resolution, rounds, level)
        found = state.select("node", "label")
        if not moved_any:
            break
        parts = _refined(edges, state, total, resolution, rounds, level)
        of = state.join(parts.select("node", F.col("label").alias("part")), "node")
        member, edges = _carried(member, parts), _aggregated(edges, parts)
        # Nodes of the smaller graph start in their communities.
        start = stored(of.groupBy("part").agg(F.sum("k").alias("k"), F.min("label").alias("label")).withColumnRenamed("part", "node"), "step")
        found = start.select("node", "label")
    labels = _carried(member, found)
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in ("node", "other"))
    same = whole.where("node <> other").join(a, "node").join(b, "other").where("lnode = lother").select(F.col("node").alias("i"), F.col("other").alias("j"), "w")
    pieces = connected_components(same)
    return labels.join(pieces.withColumnRenamed("label", "piece"), "node", "left").select("node", F.coalesce("piece", "node").alias("label"))


def bisecting_kmeans(emb: DataFrame, k: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """(cell_id, label): the largest cluster (the one with the least cell among equals) is split in two by k-means until there are ``k``."""
    now = stored(emb.select("cell_id", "vec", F.lit(0).alias("label")), "step")
    for new in range(1, k):
        sizes = now.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("least")).collect()  # a row per cluster
        widest = max(sizes, key=lambda r: (r["n"], -r["least"]), default=None)
        if widest is None or widest["n"] < 2:
            break
        halves = kmeans(now.where(F.col("label") == widest["label"]).select("cell_id", "vec"), 2, seed, iterations)
        moved = halves.where("label = 1").select("cell_id", F.lit(new).alias("to"))
        now = stored(now.join(moved, "cell_id", "left").select("cell_id", "vec", F.coalesce("to", "label").alias("label")), "step")
    return now.select("cell_id", "label")


def gmm(emb: DataFrame, k: int, seed: int = 1, iterations: int = 20, ridge: float = 1e-6) -> DataFrame:
    """(cell_id, label) by a mixture of ``k`` normal distributions with full covariances, fitted by expectation and maximisation.

    It starts from k-means. Each iteration is one pass that sums responsibilities, vectors and
    products on the executors; the driver holds k x dimensions squared. Parameters are rounded
    to nine digits, so that partitioning can't change labels.
    """
    start = emb.join(kmeans(emb, k, seed, 5), "cell_id").select("cell_id", "vec", "label")
    start = stored(start, "step")
    first = start.first()
    if first is None:
        return start.select("cell_id", "label")
    d = len(first["vec"])

    def densities(x: np.ndarray, model: list[tuple[float, np.ndarray, np.ndarray]]) -> np.ndarray:
        logs = np.full((len(x), k), -np.inf)
        for c, (weight, mean, cov) in enumerate(model):
            if weight > 0:
                chol = np.linalg.cholesky(cov)
                z = np.linalg.solve(chol, (x - mean).T)
                logs[:, c] = np.log(weight) - 0.5 * (z * z).sum(0) - np.log(np.diag(chol)).sum()
        return logs

    def sums(batches: Iterator[pd.DataFrame], model: list | None) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, d + 1, d + 1))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_list())
            if model is None:
                r = (pdf["label"].to_numpy()[:, None] == np.arange(k)).astype(float)
            else:
                logs = densities(x, model)
                r = np.exp(logs - logs.max(1, keepdims=True))
                r /= r.sum(1, keepdims=True)
            one = np.concatenate([np.ones((len(x), 1)), x], 1)
            total += np.einsum("nc,ni,nj->cij", r, one, one, optimize=True)
        yield pd.DataFrame({"row": range(k * (d + 1)), "values": list(total.reshape(-1, d + 1))})

    model = None
    for _ in range(iterations + 1):
        total = np.zeros((k * (d + 1), d + 1))
        for row in summed(start.mapInPandas(lambda it, model=model: sums(it, model), "row int, values array<double>")).toLocalIterator():
            total[row["row"]] = row["values"]
        total = total.reshape(k, d + 1, d + 1)
        n = total[:, 0, 0].sum()
        following = []
        for m in total:
            mean = m[0, 1:] / max(m[0, 0], 1e-12)
            cov = m[1:, 1:] / max(m[0, 0], 1e-12) - np.outer(mean, mean) + ridge * np.eye(d)
            following.append((round(float(m[0, 0] / n), 9) if m[0, 0] > 1e-6 * n else 0.0, np.round(mean, 9), np.round((cov + cov.T) / 2, 9)))
        if model is not None and all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for a, b in zip(model, following)):
            break
        model = following

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"cell_id": pdf["cell_id"], "label": densities(np.stack(pdf["vec"].to_list()), model).round(9).argmax(1).astype(np.int32)})

    return start.select("cell_id", "vec").mapInPandas(labelled, "cell_id long, label int")


def pic(graph: DataFrame, k: int, iterations: int = 40, seed: int = 1, vectors: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """(node, label) by power iteration clustering: vectors are spread along the edges by joins, then their values are clustered by k-means.

    There are several vectors (2 k of them), as one tells clusters apart only where its start does. After each step they are
    centred and scaled, so that what is left of them are the directions that fade slowest, and a quarter of a node's value
    stays, so that values can't swing. It stops once a step changes values by no more than the one before did (its acceleration is below ``tolerance``).
    """
    edges = stored(_both_ways(graph), "step")
    degree = edges.groupBy("node").agg(F.sum("w").alias("degree"))
    names = [f"x{i}" for i in range(vectors or max(2, 2 * k))]
    unit = lambda i: F.pmod(F.xxhash64("node", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20)
    now = stored(degree.select("node", "degree", *(unit(i).alias(x) for i, x in enumerate(names))), "step")
    before = None
    for _ in range(iterations):
        near = edges.join(now.select(F.col("node").alias("other"), *names), "other").groupBy("node").agg(*(F.sum(F.col("w") * F.col(x)).alias(f"s{x}") for x in names))
        step = near.join(now, "node").select("node", "degree", *(F.col(x).alias(f"old{x}") for x in names), *((0.25 * F.col(x) + 0.75 * F.coalesce(F.try_divide(f"s{x}", "degree"), F.lit(0.0))).alias(x) for x in names))
        step = stored(step, "step")
        # One row: by degree, the mean and the spread of each vector.
        moments = step.agg(F.sum("degree").alias("all"), *(f(x) for x in names for f in (lambda x: F.sum(F.col("degree") * F.col(x)), lambda x: F.sum(F.col("degree") * F.col(x) * F.col(x))))).first()
        if not moments["all"]:
            break
        mean = [moments[1 + 2 * i] / moments["all"] for i in range(len(names))]
        sd = [max(moments[2 + 2 * i] / moments["all"] - m * m, 0.0) ** 0.5 for i, m in enumerate(mean)]
        scaled = [F.round((F.col(x) - round(m, 12)) / round(s, 12), 9).alias(x) if s > 1e-9 else F.lit(0.0).alias(x) for x, m, s in zip(names, mean, sd)]
        now = stored(step.select("node", "degree", *(F.col(f"old{x}") for x in names), *scaled), "step")
        change = now.agg(F.max(F.greatest(*(F.abs(F.col(x) - F.col(f"old{x}")) for x in names)))).first()[0]
        now = now.select("node", "degree", *names)
        if before is not None and abs(before - change) < tolerance:
            break
        before = change
    values = now.select(F.col("node").alias("cell_id"), F.array(*(F.round(x, 6) for x in names)).alias("vec"))
    return kmeans(values, k, seed).select(F.col("cell_id").alias("node"), "label")


def relabel_by_size(labels: DataFrame, node: str = "cell_id") -> DataFrame:
    """Labels 0, 1, .. from the largest cluster on, ties by least member."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(node).alias("least"))
    order = sizes.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).alias("cluster"))  # a row per cluster
    return labels.join(order, "label").select(node, F.col("cluster").alias("label"))


def modularity(graph: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: sum over clusters of within / m - resolution * (degree / 2m) ** 2."""
    graph = stored(graph, "graph")  # three passes follow
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ij")
    tagged = graph.join(a, "i").join(b, "j")
    degree = tagged.select(F.col("li").alias("label"), "w").union(tagged.select("lj", "w")).groupBy("label").agg(F.sum("w").alias("degree"))
    within = tagged.where("li = lj").groupBy(F.col("li").alias("label")).agg(F.sum("w").alias("within"))
    m = graph.agg(F.sum("w").alias("m"))  # one row
    terms = degree.join(within, "label", "left").crossJoin(m)
    part = F.coalesce("within", F.lit(0.0)) / F.col("m") - resolution * (F.col("degree") / (2 * F.col("m"))) * (F.col("degree") / (2 * F.col("m")))
    return terms.agg(F.sum(part).alias("modularity"))


def agreement(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: ari, nmi (arithmetic mean) and purity of (cell_id, label) against (cell_id, truth)."""
    table = labels.join(truth, "cell_id").groupBy("label", "truth").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows, columns = table.groupBy("label").agg(F.sum("n").alias("a"), F.max("n").alias("most")), table.groupBy("truth").agg(F.sum("n").alias("b"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = table.agg(F.sum("n").alias("total"), pairs("n").alias("both"))  # one row, like those below
    left = rows.crossJoin(total.select("total")).agg(pairs("a").alias("pa"), F.sum("most").alias("most"), -F.sum(F.col("a") / F.col("total") * F.log(F.col("a") / F.col("total"))).alias("_"))
    left = left.toDF("pa", "most", "ha")
    right = columns.crossJoin(total.select("total")).agg(pairs("b").alias("pb"), -F.sum(F.col("b") / F.col("total") * F.log(F.col("b") / F.col("total")))).toDF("pb", "hb")
    shared = table.join(rows, "label").join(columns, "truth").crossJoin(total.select("total")).agg(F.sum(F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("a") * F.col("b"))))).toDF("mi")
    one = total.crossJoin(left).crossJoin(right).crossJoin(shared)
    expected = F.try_divide(F.col("pa") * F.col("pb"), F.col("total") * (F.col("total") - 1) / 2)
    ari = F.coalesce(F.try_divide(F.col("both") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0))
    nmi = F.coalesce(F.try_divide(2 * F.col("mi"), F.col("ha") + F.col("hb")), F.lit(1.0))
    return one.select(ari.alias("ari"), nmi.alias("nmi"), (F.col("most") / F.col("total")).alias("purity"))


def silhouette(emb: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, label, silhouette): simplified, by distances to the clusters' means."""
    tagged = emb.join(labels, "cell_id")
    means = tagged.select("label", F.posexplode("vec").alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    centroid = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("centre"))
    near = tagged.crossJoin(F.broadcast(centroid.select(F.col("label").alias("to"), "centre")))  # a row per cluster
    d = F.sqrt(F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    both = near.withColumn("d", d).groupBy("cell_id", "label").agg(F.max(F.when(F.col("to") == F.col("label"), F.col("d"))).alias("a"), F.min(F.when(F.col("to") != F.col("label"), F.col("d"))).alias("b"))
    return both.select("cell_id", "label", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))
