"""SimHash against a plain form; the Gray-order index against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cytoframe.llm import simhash
from cytoframe.llm.components import components
from cytoframe.llm.words import U


def fingerprint(text, size=3):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, apart=3):
    """Least member of each value's component, by all pairs."""
    least = {v: v for v in values}

    def root(v):
        while least[v] != v:
            v = least[v]
        return v

    values = sorted(set(values))
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= apart:
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


def planted(seed=1):
    """Chains of fingerprints few bits apart, some under one quarter, beside ones at distance four and more."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 7, 15 << 60}
    for _ in range(25):
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(v)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4, 5])):
                v ^= 1 << b
    hot = rng.getrandbits(16) << 48
    out |= {hot | rng.getrandbits(48) for _ in range(150)} | {hot | sum(1 << b for b in rng.sample(range(14), 5)) for _ in range(150)}
    return sorted(out)


def signed(values):
    return [int(v) for v in np.array(values, U).view(np.int64)]


@pytest.mark.parametrize(("leaf", "fan"), [(4096, 16), (5, 3), (1, 2)])
def test_index_links_what_all_pairs_link(spark, leaf, fan):
    values = planted()
    df = spark.createDataFrame([(v,) for v in signed(values)], "fingerprint long").repartition(3)
    links = simhash.near_links(df, leaf=leaf, fan=fan)
    rows = np.array([(r.a, r.b) for r in links.collect()], np.int64).view(U).tolist()
    assert all((a ^ b).bit_count() > 0 for a, b in rows)
    found = {r.node: r.component for r in components(links).collect()}
    of = {v: found.get(s, s) for v, s in zip(values, signed(values))}
    want = groups(values)
    assert len({(of[v], want[v]) for v in values}) == len(set(of.values())) == len(set(want.values()))


def test_upper_nodes_drop_pairs_of_leaves(spark):
    """Under one quarter, leaves whose shared bits differ in more than three never meet."""
    rng = random.Random(2)
    values = [0xABCD << 48 | (p * 0x1111111) << 20 | rng.getrandbits(16) for p in range(16) for _ in range(40)]
    different = spark.createDataFrame([(v,) for v in sorted(set(signed(values)))], "fingerprint long")
    turn = different.select(F.lit(0).alias("turn"), F.col("fingerprint").alias("value")).withColumn("rank", simhash.gray_rank(F.col("value")))
    leaves = turn.repartition(1).sortWithinPartitions("rank").mapInArrow(lambda it: simhash._leaves(it, 16), simhash._LEAVES)
    n = leaves.count()
    met = simhash.leaf_pairs(leaves, fan=4).count()
    assert n >= 40 and n <= met < n * (n + 1) // 4


def test_search_within_a_task():
    values = np.array(planted(5), U)
    order = values[np.argsort(simhash_rank(values), kind="stable")]
    rng = np.random.default_rng(1)
    for x, y in ((order, None), (order[:200], order[200:]), (order[:1], order[5:9]), (rng.permutation(order), None)):
        got = [(int(x[i]), int((x if y is None else y)[j])) for a, b in simhash.followed(x, y) for i, j in zip(a, b)]
        other = x if y is None else y
        want = {(int(a), int(b)) for k, a in enumerate(x) for b in (other[k + 1 :] if y is None else other) if int(a ^ b).bit_count() <= 3}
        assert len(got) == len(set(got)) and set(got) == want


def simhash_rank(values):
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(shift)
    return rank


def test_gray_rank_is_the_place_in_the_gray_code(spark):
    codes = [i ^ i >> 1 for i in range(300)] + [i ^ i >> 1 for i in range((1 << 64) - 50, 1 << 64)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(signed(codes))], "k int, v long")
    assert [r.k for r in df.orderBy(simhash.gray_rank(F.col("v"))).collect()] == list(range(350))


def test_components_of_texts(spark):
    """Copies, near copies, null and repeated ids, no words, one very long text, clashing columns."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", " \n", "One", "ONE", "two words", "É x\x0by  z", " ".join(word() for _ in range(30_000))]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(3, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(len(base))] = word()
            texts.append("\n".join(base).upper())
    texts += texts[8:20]
    keys = [None if k == 30 else k // 2 if k < 20 else k for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(keys, texts, texts, keys)), "doc_id long, text string, fingerprint string, component long").repartition(3)
    values = [fingerprint(t) for t in texts]
    of = groups(values)
    low = lambda k: (k is not None, k)
    least = {}
    for k, v in zip(keys, values):
        least[of[v]] = min(least.get(of[v], k), k, key=low)
    want = sorted(map(repr, ((k, f"{v:016x}", least[of[v]]) for k, v in zip(keys, values))))
    assert len(set(of.values())) < len(set(values)) < len(texts)
    assert sorted(repr(tuple(r)) for r in simhash.simhash_components(df).collect()) == want


def test_empty_table_and_one_row(spark):
    for rows in ([], [(3, None)]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert [tuple(r) for r in simhash.simhash_components(df).collect()] == [(k, "0" * 16, k) for k, _ in rows]
