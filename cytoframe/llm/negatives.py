"""Hard negatives for contrastive training, by a full sort of each anchor's scores.

Vectors become integers, so scores are exact and ties are ties. Anchors and rows are dealt into
stripes that meet two by two. In a cell every anchor's scores are sorted by score and id; a first
pass reads its best rows of the same label, its positives. In a second pass each positive's score
is an upper limit: a binary search among the sorted rows of other labels finds where it begins,
and entries are read from there while they reach the lower limit. Cells give a few rows for each
anchor and limit, which are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut
from .words import batch_of

#: Anchors and rows of a cell at most (about, as they are dealt by hash), and anchors whose scores are sorted at once.
ANCHORS, ROWS, BLOCK = 1_024, 16_384, 128
#: Of a component in size: a score of vectors of up to 2 ** 15 components fits a long.
LIMIT = 1 << 24
_NO_KEY = -(1 << 63)
_POSITIVE = pa.schema([("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("anchor", pa.int64()), ("limit", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of floats, shorter ones filled up with zeros."""
    array = column.combine_chunks()
    offsets, values = array.offsets.to_numpy(), array.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(array), width))
    row = np.repeat(np.arange(len(array)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values[offsets[0] : offsets[-1]]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats where no sum can pass 2 ** 53, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a @ b.T).astype(np.int64) if most < 1 << 53 else a.astype(np.int64) @ b.astype(np.int64).T


def _sorted_scores(table: pa.Table):
    """For blocks of a cell's anchors: (their places, order of the rows, sorted scores), best first, ties by id; and the columns of both sides."""
    sides = []
    width = max([1, *(len(x) for x in table.column("vec"))])
    for side in (0, 1):
        own = table.filter(pa.compute.equal(table.column("side"), side))
        sides.append({c: own.column(c).to_numpy() for c in ("anchor", "id", "label")} | {"vec": _matrix(own.column("vec"), width), "limits": own.column("limits").to_pylist()})
    mine, rows = sides
    by_id = np.argsort(rows["id"], kind="stable")
    rows = {c: rows[c][by_id] for c in ("id", "label", "vec")}

    def blocks():
        for lo in range(0, len(mine["id"]), BLOCK):
            own = np.arange(lo, min(lo + BLOCK, len(mine["id"])))
            scores = _products(mine["vec"][own], rows["vec"])
            order = np.argsort(-scores, axis=1, kind="stable")
            yield own, order, np.take_along_axis(scores, order, 1)

    return mine, rows, blocks()


def _positives(table: pa.Table, k: int) -> pa.Table:
    mine, rows, blocks = _sorted_scores(table)
    out = [batch_of(_POSITIVE, [], [], [])]
    for own, order, scores in blocks:
        fits = (rows["label"][order] == mine["label"][own][:, None]) & (rows["id"][order] != mine["id"][own][:, None])
        i, at = np.nonzero(fits & (np.cumsum(fits, 1) <= k))
        out.append(batch_of(_POSITIVE, mine["anchor"][own][i], rows["id"][order[i, at]], scores[i, at]))
    return pa.Table.from_batches(out)


def lower_limit(limit: int, per_hundred: int) -> int:
    """The least integer of which a hundred times reaches ``per_hundred`` times the limit."""
    return -(-per_hundred * limit // 100)


def _negatives(table: pa.Table, k: int, per_hundred: int) -> pa.Table:
    mine, rows, blocks = _sorted_scores(table)
    found = []
    for own, order, scores in blocks:
        differs = (rows["label"][order] != mine["label"][own][:, None]) & (rows["id"][order] != mine["id"][own][:, None])
        for i, place in enumerate(own.tolist()):
            at = np.flatnonzero(differs[i])
            falling = -scores[i, at]
            for limit in mine["limits"][place]:
                begin = int(np.searchsorted(falling, -limit, "left"))
                end = min(begin + k, int(np.searchsorted(falling, -lower_limit(limit, per_hundred), "right")))
                found += [(int(mine["anchor"][place]), limit, int(rows["id"][order[i, j]]), int(scores[i, j])) for j in at[begin:end].tolist()]
    return pa.Table.from_batches([batch_of(_NEGATIVE, *(map(list, zip(*found)) if found else ([], [], [], [])))])


def _cells(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int):
    """Anchors (with limits) and rows grouped by cells, each side copied to all stripes of the other."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS), min(cores, -(-n_rows // 1_024)))
    # By a row's place, as any number of rows may be equal.
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["anchor", "id", "label", "vec", "limits"]
    left = anchors.withColumn("a", dealt(stripes[0])).withColumn("b", every(stripes[1])).select("a", "b", F.lit(0).alias("side"), *columns)
    right = rows.withColumn("b", dealt(stripes[1])).withColumn("a", every(stripes[0])).select("a", "b", F.lit(1).alias("side"), F.lit(0).cast("long").alias("anchor"), "id", "label", "vec", F.array().cast("array<long>").alias("limits"))
    return left.unionByName(right).groupBy("a", "b")


def hard_negatives(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, per_hundred: int = 80, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchors`` selects.

    A component x counts as floor(scale * x), held within 2 ** 24, and a score is the inner
    product of these integers, of vectors of different lengths over the shorter one's. Higher
    scores come first, ties by smaller id, a null id before all others. An anchor's positives are
    its first ``positives`` other rows of the same (integer) label, and a positive's negatives the
    first ``negatives`` rows of other labels whose scores are at most the positive's and at least
    ``per_hundred`` hundredths of it. Rows with a null label or vector, or with a component
    that is null or not finite, take no part. Rows that share the anchor's id are neither its
    positives nor its negatives; otherwise rows with repeated ids are rows of their own, and a repeated
    anchor has its results as often. Other columns are not read; an empty table gives no rows.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    small = F.transform(vector, lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(F.greatest(F.lit(-1e18), F.least(F.lit(1e18), x.cast("double") * scale))))).cast("int"))
    used = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    rows = used.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("id"), F.col(label).cast("long").alias("label"), small.alias("vec"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    rows = cut(rows, "vectors")
    chosen = cut(rows.where("is_anchor").withColumn("anchor", F.monotonically_increasing_id()).withColumn("limits", F.array().cast("array<long>")), "anchors")
    sizes = chosen.count(), rows.count()
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))

    near = _cells(chosen, rows, *sizes).applyInArrow(lambda t: _positives(t, positives), "anchor long, id long, score long")
    near = cut(near.withColumn("place", best("anchor")).where(F.col("place") <= positives), "positives")
    limits = near.groupBy("anchor").agg(F.collect_set("score").alias("limits"))  # at most as many as positives
    limited = chosen.drop("limits").join(limits, "anchor")
    far = _cells(limited, rows, *sizes).applyInArrow(lambda t: _negatives(t, negatives, per_hundred), "anchor long, limit long, id long, score long")
    far = far.withColumn("rank", best("anchor", "limit")).where(F.col("rank") <= negatives)

    named = near.join(chosen.select("anchor", F.col("id").alias("anchor_id")), "anchor").select("anchor", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("limit"))
    out = named.join(far, ["anchor", "limit"])
    shown = lambda c: F.expr(f"nullif({c}, {_NO_KEY + 1}L - 1L)")
    return out.select(shown("anchor_id").alias("anchor_id"), shown("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), shown("id").alias("negative_id"), F.col("limit").alias("positive_score"), F.col("score").alias("negative_score"))
