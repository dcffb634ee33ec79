"""Hard negatives against a plain form."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cytoframe.llm import negatives


def plain(rows, k=5, m=5, per_hundred=80):
    used = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    low = lambda i: (i is not None, i or 0)
    out = []
    for a, label, v in (r for r in used if r[0] is not None and r[0] % 4 == 0):
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), low(b), b, other) for b, other, w in used if b != a), key=lambda s: s[:2])
        for s, _, p, _ in [x for x in scored if x[3] == label][:k]:
            fits = [x for x in scored if x[3] != label and per_hundred * -s <= 100 * -x[0] <= 100 * -s][:m]
            out += [(a, p, rank, x[2], -s, -x[0]) for rank, x in enumerate(fits, 1)]
    return sorted(map(repr, out))


def mined(df, **more):
    out = negatives.hard_negatives(df, F.col("vec_id") % 4 == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(repr(tuple(r)) for r in out.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, label int, embedding array<float>, anchor int, score string, rank int").repartition(3)


@pytest.mark.parametrize("stripes", [None, 7])
def test_equals_the_plain_form(spark, monkeypatch, stripes):
    """Ties, repeated rows, null and repeated ids, unusable vectors, negative scores, vectors of other lengths."""
    if stripes:
        monkeypatch.setattr(negatives, "ANCHORS", 4)
        monkeypatch.setattr(negatives, "ROWS", stripes)
    rng = random.Random(6)
    vector = lambda: [rng.randrange(-2, 5) / 8 for _ in range(4)]
    rows = [(i, rng.randrange(3), vector()) for i in range(60)]
    rows += [(i, 1, rows[7][2]) for i in range(60, 80)]
    rows += rows[5:9] + [(8, 2, vector()), (None, 0, vector()), (None, 1, vector())]
    rows += [(90, None, vector()), (91, 1, None), (92, 1, [0.5, None]), (96, 1, [float("nan"), 1.0]), (100, 1, [float("inf")]), (104, 0, [0.5, 0.25]), (108, 2, []), (112, 7, vector())]
    want = plain(rows)
    assert len(want) > 150
    assert mined(table(spark, rows)) == want
    assert mined(table(spark, rows), positives=2, negatives=3, per_hundred=35) == plain(rows, 2, 3, 35)


def test_empty_tables(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, 1, [0.5])])) == []
    assert mined(table(spark, [(4, 1, [0.5]), (5, 1, [0.5])])) == []


def test_large_components_stay_exact(spark):
    """Products past 2 ** 53 are summed in integers; components are held within 2 ** 24."""
    big = 65_535.99
    rows = [(0, 1, [big, big]), (1, 1, [big, 65_535.5]), (2, 0, [big, 65_535.25]), (3, 0, [65_535.5, 60_000.0]), (5, 0, [1e30, 0.0])]
    out = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), F.col("vec_id") == 0).collect()
    floor = lambda v: [min(math.floor(256 * x), 1 << 24) for x in v]
    score = lambda v: sum(x * y for x, y in zip(floor(rows[0][2]), floor(v)))
    assert [(r.positive_id, r.negative_id, r.negative_score) for r in sorted(out, key=lambda r: r["rank"])] == [(1, 2, score(rows[2][2])), (1, 3, score(rows[3][2]))]


def test_lower_limit():
    for s in range(-40, 40):
        assert negatives.lower_limit(s, 80) == min(n for n in range(-100, 100) if 80 * s <= 100 * n)
