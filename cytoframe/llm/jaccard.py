"""Exact Jaccard join of word-shingle sets by PartEnum signatures.

Sizes are dealt into overlapping bands such that two sets that can link share a band.
In a band, linked sets differ in k features at most. Features are partitioned by their
hash into more than k / 2 parts and each part again into three: one part at least has one
difference or none, so one of its subsets of two second-level parts is equal in both sets.
The sum of the feature hashes of each such subset is a signature. For large k, and for sets
with too few parts that have a feature in each subset, features are partitioned into more
than k parts, each of which is a signature by itself; if more than k parts hold a feature
of either set, one of them must be equal in both and not empty. A set with too few such
parts also takes part at the next finer partitioning, and so on: no pair is lost.

Rows that share a signature are joined as stars, not pairs; stars are verified on the
whole sets; components follow. Then only signatures that still span several components are
looked at again: first for each class's closest one in another component, at last for all
pairs across components. Sketches of parity bits, about one for each
feature, discard pairs that provably differ too much before whole sets are fetched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, temporary
from .words import Slice, U, batch_of, lean, mix, rolling, slices

SHINGLE = 5
#: Two sets link if PER_HUNDRED * union <= 100 * intersection.
PER_HUNDRED = 80
#: Ratio of a band's start to the one before.
BAND_RATIO = 1.3
#: Parts of a band, as a multiple of the differences that linked sets may have.
PARTS = 1.16
#: Bands with at most this many differences enumerate subsets of second-level parts; beyond it their extra signatures cost more than they spare.
ENUMERATED = 24
#: Second-level parts of a part, of which one may differ (k2 = 1), and parts as a multiple of the least number.
SECOND, FIRST = 3, 1.25
_NO_KEY = -(1 << 63)
_A, _B, _C = U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def bands(largest: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, k) of bands up to one that holds ``largest``."""
    out, low = [], 1
    while low <= largest:
        following = max(low + 1, int(low * BAND_RATIO))
        high = (following - 1) * 100 // PER_HUNDRED
        # |A| + |B| - 2 |A & B| where |A & B| >= t (|A| + |B|) / (1 + t) and both sizes are at most high.
        out.append((low, high, 2 * high * (100 - PER_HUNDRED) // (100 + PER_HUNDRED)))
        low = following
    return out


_bands: list[tuple[int, int, int]] = []


def bands_of(size: int) -> list[tuple[int, tuple[int, int, int]]]:
    global _bands
    if not _bands or _bands[-1][0] <= size:
        _bands = bands(max(1 << 16, 2 * size))
    return [(j, b) for j, b in enumerate(_bands) if b[0] <= size <= b[1]]


def subset_signatures(features: np.ndarray, mixed: np.ndarray, band: int, k: int) -> tuple[np.ndarray, bool]:
    """Signatures of all subsets but one second-level part of each part, and whether there are enough for ``k`` differences.

    At most k // 2 parts have more than one difference. Where more parts than that have a
    feature in each of their subsets, one such part has one difference or none, and the
    subset without it is equal in both sets.
    """
    parts = -int(-(k // 2 + 1) * FIRST // 1)
    cell = ((features >> U(32)) * U(parts) >> U(32)) * U(SECOND) + ((features & U(0xFFFFFFFF)) * U(SECOND) >> U(32))
    order = np.argsort(cell, kind="stable")
    at = cell[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sums, count = np.zeros(parts * SECOND, U), np.zeros(parts * SECOND, np.int64)
    sums[at[first]] = np.add.reduceat(mixed[order], first)
    count[at[first]] = np.diff(np.append(first, len(at)))
    sums, count = sums.reshape(parts, SECOND), count.reshape(parts, SECOND)
    rest, held = sums.sum(1, dtype=U)[:, None] - sums, count.sum(1)[:, None] - count
    which = np.arange(parts * SECOND, dtype=U).reshape(parts, SECOND)
    found = mix(rest + mix(which * _A + U(band * 0xD1342543DE82EF95 % (1 << 64))))
    return found[held > 0], int((held > 0).all(1).sum()) > k // 2


def signatures(features: np.ndarray) -> np.ndarray:
    """All signatures of a set of 64-bit features, sorted and without repeats."""
    size, out = len(features), []
    mixed = mix(features ^ _B)
    high = features >> U(32)
    for j, (_, _, k) in bands_of(size):
        if 0 < k <= ENUMERATED:
            found, enough = subset_signatures(features, mixed, j, k)
            out.append(found)
            if enough:
                continue
        parts = max(1, int((k + 1) * PARTS)) if k else 1
        while True:
            # Beyond 2 ** 32 parts, parts are single features.
            part = high * U(parts) >> U(32) if parts < 1 << 32 else np.arange(size, dtype=U)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            tag = U((j * 64 + parts.bit_length()) * 0x9E3779B97F4A7C15 % (1 << 64))
            key = features if parts >= 1 << 32 else np.add.reduceat(mixed, first) + mix(part[first] * _A + U(parts))
            out.append(mix(key + tag))
            if len(first) > k:
                break
            parts *= 2
    return np.unique(np.concatenate(out))


def shingle_sets(s: Slice, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row of the slice the sorted hashes of its different shingles; fewer words than ``size`` make one shingle."""
    h = s.hashes(lower=True)
    rolled = mix(rolling(h, size))
    for lo, hi in zip(s.words[:-1].tolist(), s.words[1:].tolist()):
        n = hi - lo
        if n >= size:
            yield np.unique(rolled[lo : hi - size + 1])
        elif n:
            yield mix(mix(rolling(h[lo:hi], n)) + U(n) * _C)
        else:
            yield np.zeros(0, U)


def sketch_words(size: int) -> int:
    """64-bit words of the sketch of a set of this size: a power of two."""
    return 1 << max(0, size - 1 >> 6).bit_length()


def sketch(features: np.ndarray) -> bytes:
    """Parity bits: two sets differ in at least as many features as their sketches in bits."""
    bits = 64 * sketch_words(len(features))
    odd = np.bincount((mix(features ^ _A) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketch words as sketches of fewer bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_link(n_a: np.ndarray, n_b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes that differ in ``apart`` features at least can link."""
    sizes = 100 * np.minimum(n_a, n_b) >= PER_HUNDRED * np.maximum(n_a, n_b)
    return sizes & (apart * (100 + PER_HUNDRED) <= (n_a + n_b) * (100 - PER_HUNDRED))


_SETS = "key long, id long, n long, set1 long, set2 long, signatures binary, sketch binary"


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("set1", pa.int64()), ("set2", pa.int64()), ("signatures", pa.binary()), ("sketch", pa.binary())])
    for batch in batches:
        for s in slices(batch.column(2)):
            rows = []
            for x in shingle_sets(s, size):
                if not len(x):
                    rows.append((0, 0, 0, b"", b""))
                    continue
                sums = np.array([np.add.reduce(mix(x ^ _C)), np.add.reduce(mix(x + _A))], U)
                a, b = mix(sums + U(len(x))).view(np.int64).tolist()
                rows.append((len(x), a, b, signatures(x).tobytes(), sketch(x)))
            yield batch_of(schema, *(batch.column(i).slice(s.first, s.n) for i in range(2)), *(list(c) for c in zip(*rows)))


_BLOBS = "bucket int, signatures binary, classes binary"
_BLOB_SCHEMA = pa.schema([("bucket", pa.int32()), ("signatures", pa.binary()), ("classes", pa.binary())])
#: Signatures gathered by a task before they are dealt to buckets.
_DEAL = 1 << 18


def _cut_by_bucket(sig: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """An order that brings buckets together, the buckets, and where each one's part begins and ends."""
    bucket = (sig % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    return order, bucket[first], list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)]))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows, the last column as signatures, in lists of about _DEAL signatures."""
    kept, held = [], 0
    for batch in batches:
        for *row, x in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.columns[-1]):
            kept.append((*row, np.frombuffer(x.as_buffer(), U)))
            held += len(kept[-1][-1])
            if held >= _DEAL:
                yield kept
                kept, held = [], 0
    if held:
        yield kept


def _deal(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (class, signatures) to one row per bucket with many signatures: few, compact rows to shuffle."""
    for kept in _gathered(batches):
        sig = np.concatenate([x[-1] for x in kept])
        cls = np.repeat(np.array([x[0] for x in kept], np.int64), [len(x[-1]) for x in kept])
        order, bucket, parts = _cut_by_bucket(sig, buckets)
        sig, cls = sig[order], cls[order]
        yield batch_of(_BLOB_SCHEMA, bucket, *([x[a:b].tobytes() for a, b in parts] for x in (sig, cls)))


#: Stars of a class that are verified at first; later rounds see all others.
STARS = 8
#: Least open signatures of a class that its rows carry, so that a pair is met once and not at each signature it shares.
LEAST = 8
#: Members of a signature that meet in one task; more are dealt into blocks, and blocks meet two by two.
MEET = 2048
#: Rounds in which each class meets its closest one in another component, before all meet.
CLOSEST = 1
_STARS = "signature long, a long, b long"
_STAR_SCHEMA = pa.schema([(c, pa.int64()) for c in ("signature", "a", "b")])
_COMPACT = 1 << 19


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(signature, least class met so far, class) for the other classes of each signature. Holds one class per signature, however many rows share it."""
    sig, cls, fresh = np.zeros(0, U), np.zeros(0, np.int64), []

    def compact() -> pa.RecordBatch:
        nonlocal sig, cls, fresh
        s = np.concatenate([sig, *(x[0] for x in fresh)])
        c = np.concatenate([cls, *(x[1] for x in fresh)])
        order = np.lexsort((c, s))
        s, c, fresh = s[order], c[order], []
        new = np.concatenate([[True], s[1:] != s[:-1]])
        first = np.flatnonzero(new)
        centre = c[first][np.cumsum(new) - 1]
        other = (centre != c) & np.concatenate([[True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])])
        sig, cls = s[first], c[first]
        return batch_of(_STAR_SCHEMA, s[other].view(np.int64), centre[other], c[other])

    held = 0
    for batch in batches:
        for s, c in zip(batch.column(1), batch.column(2)):
            fresh.append((np.frombuffer(s.as_buffer(), U), np.frombuffer(c.as_buffer(), np.int64)))
            held += len(fresh[-1][0])
            if held >= _COMPACT:
                yield compact()
                held = 0
    if held:
        yield compact()


def _across(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of classes of different components that share a signature and that sizes and sketches don't rule out: every one, or each class's closest.

    Members of different blocks of a signature meet where their blocks do, those of one block in its own cell.
    A pair that shares a lesser signature among the ones that its rows carry is met there, and not here.
    """

    def written() -> pa.RecordBatch:
        a, b = (np.concatenate([x[j] for x in held]) for j in (1, 2))
        return batch_of(_STAR_SCHEMA, np.concatenate([np.full(len(x[1]), x[0]) for x in held]), np.minimum(a, b), np.maximum(a, b))

    numbers, sketches, lists = [], [], []
    for batch in batches:
        numbers.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]))
        sketches += [np.frombuffer(v.as_py(), U) for v in batch.column(7)]
        lists += batch.column(8).to_pylist()
    if not sketches:
        return
    sig, cls, comp, size, block, low, high = np.concatenate(numbers, axis=1)
    # Signatures as signed numbers; a list shorter than LEAST is filled up with a number that is below none.
    least = np.array([x + [(1 << 63) - 1] * (LEAST - len(x)) for x in lists], np.int64)
    place = np.lexsort((high, low, sig))
    sig, low, high = sig[place], low[place], high[place]
    edges = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), [True]]))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    n = 0
    for lo, hi in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
        own = place[lo:hi]
        groups, which, count = np.unique(comp[own], return_inverse=True, return_counts=True)
        if len(groups) == 1:
            continue
        # Components from the smallest to the largest: members of one meet all members of later ones, so the largest one's are never looped over.
        rank = np.empty(len(groups), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(groups))
        own = own[np.argsort(rank[which], kind="stable")]
        ends = np.cumsum(np.sort(count, kind="stable"))
        words = min(len(sketches[i]) for i in own)
        matrix = np.concatenate([folded(sketches[i][None, :], words) for i in own])
        sizes, classes, listed, blocks = size[own], cls[own], least[own], block[own]
        for i, end in zip(range(int(ends[-2])), np.repeat(ends[:-1], np.diff(ends[:-1], prepend=0)).tolist()):
            apart = np.bitwise_count(matrix[end:] ^ matrix[i]).sum(1, dtype=np.int64)
            meets = may_link(sizes[end:], sizes[i], apart)
            if low[lo] != high[lo]:
                meets &= blocks[end:] != blocks[i]
            rest = end + np.flatnonzero(meets)
            lesser = listed[i][listed[i] < sig[lo]]
            rest = rest[~np.isin(listed[rest], lesser).any(1)]
            if not every and len(rest) > 1:
                rest = rest[apart[rest - end].argmin()][None]
            if len(rest):
                held.append((sig[lo], np.full(len(rest), classes[i]), classes[rest]))
                n += len(rest)
        if n >= _COMPACT:
            yield written()
            held, n = [], 0
    if held:
        yield written()


_NEAR = "a long, b long"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and sketches don't rule a link out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        x, y = ([np.frombuffer(v.as_buffer(), U)[None, :] for v in batch.column(i)] for i in (4, 5))
        apart = np.array([np.bitwise_count(folded(p, q.shape[1]) ^ folded(q, p.shape[1])).sum() for p, q in zip(x, y)], np.int32)
        ok = may_link(n_a, n_b, apart)
        yield batch_of(schema, a[ok], b[ok])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, set of a, set of b) that link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        ok = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            ok[i] = 100 * common >= PER_HUNDRED * (len(x) + len(y) - common)
        yield batch_of(schema, *(batch.column(i).to_numpy(zero_copy_only=False)[ok] for i in range(2)))


_SET = "class long, features binary"


def _features(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("class", pa.int64()), ("features", pa.binary())])
    for batch in batches:
        for s in slices(batch.column(1)):
            yield batch_of(schema, batch.column(0).slice(s.first, s.n), [x.tobytes() for x in shingle_sets(s, size)])


def _source(df: DataFrame, text: str, key: str) -> DataFrame:
    """Rows (key, id, text); key and id tell rows apart but for those that share a key and their text."""
    return df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("key"), F.xxhash64(F.col(text)).alias("id"), F.col(text).alias("text"))


def _components(source: DataFrame, shingle: int, keys: bool) -> tuple[DataFrame, DataFrame]:
    """Described rows, and (set1, set2, n, rep, component) of classes: rep their least key, component a class of theirs or null if they link with none.

    Rows link by their texts, and with ``keys`` those that share a key do as well.
    """
    spark = source.sparkSession
    described = cut(source.mapInArrow(lambda it: lean(_describe(it, shingle)), _SETS), "shingle-sets")
    classes = cut(described.where("n > 0").groupBy("set1", "set2", "n").agg(F.min("key").alias("rep")), "set-classes")

    # Buckets of about half a million signatures, at least as many as shuffle partitions.
    amount = described.agg(F.sum(F.octet_length("signatures"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), amount // 4_000_000)

    wanted = described.where("n > 0").select("set1", "signatures")
    blobs = wanted.mapInArrow(lambda it: lean(_deal(it, buckets)), _BLOBS).repartition(buckets, "bucket")
    shared = cut(blobs.mapInArrow(lambda it: lean(_stars(it)), _STARS), "shared-signatures")
    profile = classes.join(described.select("key", "id", "set1", "set2", "sketch"), (F.col("key") == F.col("rep")) & (classes.set1 == described.set1) & (classes.set2 == described.set2))
    profile = profile.select(classes.set1.alias("class"), "n", "rep", "id", "sketch").dropDuplicates(["class", "rep", "n"])
    touched = shared.select(F.col("a").alias("class")).union(shared.select("b")).distinct()
    profile = cut(profile.join(touched, "class"), "profiles")

    def near(pairs: DataFrame) -> DataFrame:
        a, b = (profile.select(*(F.col(c).alias(f"{c}_{side}") for c in ("class", "n", "sketch"))) for side in "ab")
        both = pairs.join(a, pairs.a == a.class_a).join(b, pairs.b == b.class_b)
        return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lambda it: lean(_near(it)), _NEAR)

    # The text of any one row with the class's set under its least key.
    reps = profile.select("class", "rep", F.col("id").alias("rep_id"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of the pairs of classes those that link, judged on whole sets."""
        ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct().join(reps, "class")
        members = source.join(ends, (source.key == ends.rep) & (source.id == ends.rep_id)).select("class", "text")
        sets = cut(members.mapInArrow(lambda it: lean(_features(it, shingle)), _SET).dropDuplicates(["class"]), "sets")
        a, b = (sets.select(F.col("class").alias(f"class_{side}"), F.col("features").alias(f"features_{side}")) for side in "ab")
        both = pairs.join(a, pairs.a == a.class_a).join(b, pairs.b == b.class_b)
        found = both.select("a", "b", "features_a", "features_b").mapInArrow(lambda it: lean(_verify(it)), _NEAR)
        return cut(found, "links")

    # First the stars with which a class shares most signatures.
    weight = shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    ranked = weight.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("common", "a")), asc=False), 1, STARS).alias("to"))
    links = verified(cut(near(ranked.select(F.explode("to.a").alias("a"), "b")), "stars"))
    if keys:
        worded = described.where("n > 0").select("key", "set1")
        several = worded.groupBy("key").agg(F.min("set1").alias("least"), F.max("set1").alias("most")).where("least < most").select("key", "least")
        links = links.union(cut(worded.join(several, "key").where("least < set1").select("least", "set1").distinct(), "same-keys"))
    found = components(links)

    members = shared.select("signature", F.col("b").alias("class")).union(shared.select("signature", "a")).distinct()
    for turn in range(CLOSEST + 1):
        labelled = profile.join(found, profile["class"] == found.node, "left").groupBy("class").agg(F.min(F.coalesce("component", "class")).alias("group"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        tagged = cut(members.join(labelled.select("class", "group"), "class").select("signature", "class", "group"), "members")
        spans = tagged.groupBy("signature").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.ceil(F.count(F.lit(1)) / MEET).alias("blocks")).where("low < high").select("signature", "blocks")
        open_ = tagged.join(spans, "signature")
        own = open_.groupBy("class").agg(F.slice(F.sort_array(F.collect_list("signature")), 1, LEAST).alias("least"))
        open_ = open_.join(labelled.select("class", "n", "sketch").join(own, "class"), "class").withColumn("block", F.pmod("class", "blocks"))
        met = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
        cells = open_.select("signature", "class", "group", "n", "block", "sketch", "least", met)
        cells = cells.select("signature", "class", "group", "n", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "sketch", "least")
        every = turn == CLOSEST
        pairs = cut(cells.repartition(buckets, "signature", "low", "high").mapInArrow(lambda it, every=every: lean(_across(it, every)), _STARS), "pairs")
        links = links.union(verified(pairs.select("a", "b").distinct()))
        found = components(links)
        # A signature of which no pair is left to judge is done with.
        members = tagged.join(pairs.select("signature").distinct(), "signature", "left_semi").select("signature", "class")

    return described, classes.join(found, classes.set1 == found.node, "left").select("set1", "set2", "n", "rep", "component")


def similarity_components(df: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Components of the graph that links rows whose shingle sets have a Jaccard similarity of 0.8 or more.

    Returns doc_id, n_shingles, component_id (the least doc_id of the component). Words are
    as in :mod:`.words`, A-Z lower-cased. Rows without words, null texts too, link with
    nothing. Equal sets form one class, which takes part once. A null key sorts before all
    others and a component that has one reports null. Rows that share a key are one node.
    Other columns are not read; an empty table gives no rows.
    """
    described, classes = _components(_source(df, text, key), shingle, keys=True)
    least = classes.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    to = classes.join(least, "component", "left").select("set1", "set2", "n", F.coalesce("least", "rep").alias("to"))
    out = described.select("key", "n", "set1", "set2").join(to, ["set1", "set2", "n"], "left")
    null = f"nullif({{}}, {_NO_KEY + 1}L - 1L)"
    return out.select(F.expr(null.format("key")).alias("doc_id"), F.col("n").alias("n_shingles"), F.expr(null.format("coalesce(to, key)")).alias("component_id"))


def _judged(source: DataFrame, shingle: int) -> DataFrame:
    """(key_, id_, stays_, rows) of rows of a component that go, or that stay once though they are several."""
    described, classes = _components(source, shingle, keys=False)
    group = classes.select("set1", "set2", "n", F.coalesce("component", "set1").alias("group"))
    rows = cut(described.where("n > 0").select("key", "id", "set1", "set2", "n").join(group, ["set1", "set2", "n"]).groupBy("group", "key", "id").agg(F.count(F.lit(1)).alias("rows")), "grouped")
    stays = rows.groupBy("group").agg(F.min(F.struct("key", "id")).alias("stays"))
    return cut(rows.join(stays, "group").select(F.col("key").alias("key_"), F.col("id").alias("id_"), F.expr("stays = struct(key, id)").alias("stays_"), "rows").where("not stays_ or rows > 1"), "judged")


def keep_one(df: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``df`` with one row of each component of linked rows: one with the least key, a null one before all others.

    Keys link nothing here: rows with a null or repeated key are rows of their own, judged on
    their texts. Rows without words all stay, and so do all columns. What moves of the table
    besides is the text of kept rows that repeat a row's key and text.
    """
    source = _source(df, text, key)
    with temporary(df.sparkSession) as kept:
        judged = _judged(source, shingle)
        kept.append(judged)
    own = [f"in{i}_" for i in range(len(df.columns))]
    at, of = own[df.columns.index(text)], own[df.columns.index(key)]
    marked = df.toDF(*own).withColumns({"key_": F.coalesce(F.col(of).cast("long"), F.lit(_NO_KEY)), "id_": F.xxhash64(at)})
    alone = marked.join(judged, ["key_", "id_"], "left_anti").select(*own)
    repeated = marked.join(judged.where("stays_"), ["key_", "id_"], "left_semi").dropDuplicates(["key_", "id_"]).select(*own)
    return alone.union(repeated).toDF(*df.columns)
