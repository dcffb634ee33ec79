"""SimHash near-duplicates by a hierarchical index in Gray order.

Different fingerprints (copies are one) are sorted by Gray rank, in which neighbours differ in
one bit wherever both occur, and consecutive ones make a leaf. A node knows the bits that all
below it share: those set in all (``both``) and those set in none (not in ``any``). Nodes of FAN
consecutive children are factored into upper nodes until one is left. Two nodes differ at least
in the bits that one shares as set and the other as not set; a pair of nodes with more such
differences than allowed is dropped with all pairs below it, others are followed to their
children, down to fingerprints, where the bound is the distance itself.

Of two fingerprints with at most three different bits one of four quarters is equal. So four
rotations of all fingerprints are indexed, and only nodes under an equal leading quarter meet.
Spark sorts the rotations by range, which splits a quarter that very many fingerprints share, follows
pairs of upper nodes by joins, and hands pairs of leaves to tasks, which go on within
them. A task returns links that connect what it has found linked, not each linked pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, temporary
from .words import _LOWER, _SPACE, Slice, U, batch_of, lean, slices

SHINGLE, SEED = 3, 42
#: Bits that linked fingerprints may differ in. Quarters are one more than that.
APART = 3
TURNS, QUARTER = APART + 1, 64 // (APART + 1)
#: Fingerprints of a leaf, children of a node, node pairs followed at once, and shingles hashed at once.
LEAF, FAN, FRONTIER, AT_ONCE = 4_096, 16, 2_048, 1 << 16
_ONES = U(0x0101010101010101)
_NO_KEY = -(1 << 63)


# ---- fingerprints

def joined(s: Slice) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The slice's words, A-Z lower-cased, one space between words; and where each begins and ends."""
    word = ~_SPACE[s.data]
    keep = word.copy()
    after = s.ends[s.ends < len(word)]
    keep[after] = True
    place = np.cumsum(keep) - keep
    data = np.where(word, _LOWER[s.data], np.uint8(0x20))[keep]
    starts = place[s.starts] if len(s.starts) else s.starts
    return data.tobytes(), starts, starts + (s.ends - s.starts)


def _bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of hashes that begins at ``first``, in how many of them each bit is set."""
    lengths = np.diff(np.append(first, len(hashes)))
    # Bytes count one bit each, so at most 255 hashes are summed at a time.
    pieces = -(-lengths // 255)
    owner = np.repeat(np.arange(len(first)), pieces)
    starts = first[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    out = np.zeros((len(first), 64), np.int64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> U(bit)) & _ONES, starts)
        np.add.at(out[:, bit::8], owner, sums.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64))
    return out


def fingerprints(s: Slice, size: int = SHINGLE) -> np.ndarray:
    """A fingerprint for each row: bits set in over half the hashes of its shingles, repeats included; 0 without words."""
    data, starts, ends = joined(s)
    n = np.diff(s.words)
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(s.n), shingles)
    first = s.words[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(first + size, s.words[1:][row]) - 1
    counts = np.zeros((s.n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(row), AT_ONCE):
        part = slice(lo, lo + AT_ONCE)
        a, b = starts[first[part]].tolist(), ends[last[part]].tolist()
        hashes = np.fromiter((digest(data[i:j], SEED) for i, j in zip(a, b)), U, len(a))
        own = row[part]
        begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[begins]] += _bit_counts(hashes, begins)
    bits = 2 * counts > shingles[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(U)


_FINGERPRINTS = pa.schema([("key", pa.int64()), ("fingerprint", pa.int64())])


def _fingerprinted(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slices(batch.column(1)):
            yield batch_of(_FINGERPRINTS, batch.column(0).slice(s.first, s.n), fingerprints(s, size).view(np.int64))


# ---- the index within a task

def levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(both, any) of fingerprints in order, of nodes of FAN of them, and so on up to one node."""
    out = [(x, x)]
    while len(out[-1][0]) > 1:
        at = np.arange(0, len(out[-1][0]), FAN)
        out.append((np.bitwise_and.reduceat(out[-1][0], at), np.bitwise_or.reduceat(out[-1][1], at)))
    return out


def followed(x: np.ndarray, y: np.ndarray | None, apart: int = APART) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs (i, j) of fingerprints with at most ``apart`` different bits, i of ``x`` and j of ``y`` (or of ``x``, i < j)."""
    left, right = levels(x), levels(x if y is None else y)
    height = max(len(left), len(right))
    for side in (left, right):
        side += [side[-1]] * (height - len(side))
    open_ = [(height - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while open_:
        level, i, j = open_.pop()
        if len(i) > FRONTIER:
            open_ += [(level, i[k : k + FRONTIER], j[k : k + FRONTIER]) for k in range(0, len(i), FRONTIER)]
            continue
        (both_i, any_i), (both_j, any_j) = left[level], right[level]
        near = np.bitwise_count((both_i[i] & ~any_j[j]) | (both_j[j] & ~any_i[i])) <= apart
        i, j = i[near], j[near]
        if not level:
            if y is None:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        a, b = (_children(k, len(side[level - 1][0]), len(side[level][0])) for k, side in ((i, left), (j, right)))
        i, j = np.broadcast_arrays(a[:, :, None], b[:, None, :])
        real = (i >= 0) & (j >= 0)
        if y is None:
            real &= i <= j
        if real.any():
            open_.append((level - 1, i[real], j[real]))


def _children(nodes: np.ndarray, below: int, here: int) -> np.ndarray:
    """The children of each node, -1 where there are less than FAN; a level that was repeated has each node as its own child."""
    if below == here:
        return nodes[:, None]
    child = nodes[:, None] * FAN + np.arange(FAN)
    return np.where(child < below, child, -1)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs connect: each of ``n`` nodes to the least one that it is connected to."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label != label[label]).any():
                label = label[label]
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


# ---- the index in Spark

def rotated(value: Column, bits: int) -> Column:
    return F.shiftleft(value, bits).bitwiseOR(F.shiftrightunsigned(value, 64 - bits)) if bits else value


def gray_rank(value: Column) -> Column:
    """The place of a 64-bit number in the Gray code, as a signed long in the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        value = value.bitwiseXOR(F.shiftrightunsigned(value, shift))
    return value.bitwiseXOR(F.lit(_NO_KEY))


_LEAVES = "turn int, quarter long, leaf long, n int, both long, any long, members binary"
_LEAF_SCHEMA = pa.schema([("turn", pa.int32()), ("quarter", pa.int64()), ("leaf", pa.int64()), ("n", pa.int32()), ("both", pa.int64()), ("any", pa.int64()), ("members", pa.binary())])


def _leaves(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (turn, value, rank) to leaves of consecutive values under one leading quarter."""

    def made(turn: np.ndarray, value: np.ndarray, rank: np.ndarray, first: np.ndarray, end: int) -> pa.RecordBatch:
        bounds = [*first.tolist(), end]
        both, any_ = (f.reduceat(value[:end], first).view(np.int64) for f in (np.bitwise_and, np.bitwise_or))
        members = [value[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        return batch_of(_LEAF_SCHEMA, turn[first], (value[first] >> U(64 - QUARTER)).astype(np.int64), rank[first], np.diff(bounds).astype(np.int32), both, any_, members)

    held = [np.zeros(0, np.int32), np.zeros(0, U), np.zeros(0, np.int64)]
    for batch in batches:
        fresh = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        turn, value, rank = (np.concatenate([a, b.view(a.dtype)]) for a, b in zip(held, fresh))
        if not len(turn):
            continue
        quarter = value >> U(64 - QUARTER)
        group = np.flatnonzero(np.concatenate([[True], (turn[1:] != turn[:-1]) | (quarter[1:] != quarter[:-1])]))
        counts = -(-np.diff(np.append(group, len(turn))) // size)
        first = np.repeat(group, counts) + size * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        # The last leaf may go on in the next batch.
        end = int(first[-1])
        if len(first) > 1:
            yield made(turn, value, rank, first[:-1], end)
        held = [turn[end:], value[end:], rank[end:]]
    if len(held[0]):
        yield made(*held, np.zeros(1, np.int64), len(held[0]))


_LINKS = "a long, b long"
_LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(batches: Iterator[pa.RecordBatch], apart: int) -> Iterator[pa.RecordBatch]:
    """Pairs of leaves (turn, members, other members or null for a leaf with itself) to links between fingerprints."""
    for batch in batches:
        ends = [(np.zeros(0, U), np.zeros(0, U))]
        for turn, one, other in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            x, y = np.frombuffer(one.as_buffer(), U), None if not other.is_valid else np.frombuffer(other.as_buffer(), U)
            both = x if y is None else np.concatenate([x, y])
            shift = 0 if y is None else len(x)
            i, j = forest(len(both), ((i, j + shift) for i, j in followed(x, y, apart)))
            if len(i):
                back = U(QUARTER * turn)
                both = (both >> back) | (both << (U(64) - back)) if turn else both
                ends.append((both[i], both[j]))
        a, b = (np.concatenate([e[k] for e in ends]).view(np.int64) for k in (0, 1))
        yield batch_of(_LINK_SCHEMA, a, b)


def _differences(a: str, b: str) -> Column:
    """Bits that all below one node have set and none below the other."""
    one = lambda x, y: F.col(f"both_{x}").bitwiseAND(F.bitwise_not(F.col(f"any_{y}")))
    return F.bit_count(one(a, b).bitwiseOR(one(b, a)))


def leaf_pairs(leaves: DataFrame, apart: int = APART, fan: int = FAN) -> DataFrame:
    """(turn, a, b) of leaves of quarters that have several, a <= b, that the index can't rule out."""
    place = ["turn", "quarter"]
    several = leaves.groupBy(*place).agg(F.count(F.lit(1)).alias("leaves")).where("leaves > 1")
    several = cut(several, "large-quarters")
    most = several.agg(F.max("leaves")).first()[0] or 1
    # A row for each leaf, not for its members.
    order = F.row_number().over(Window.partitionBy(*place).orderBy("leaf")) - 1
    nodes = [cut(leaves.select(*place, "leaf", "both", "any").join(several.select(*place), place).withColumn("node", order.cast("long")), "nodes")]
    while most > 1:
        up = nodes[-1].groupBy(*place, F.floor(F.col("node") / fan).alias("node")).agg(F.bit_and("both").alias("both"), F.bit_or("any").alias("any"))
        nodes.append(cut(up, "nodes"))
        most = -(-most // fan)
    pairs = nodes[-1].select(*place, F.col("node").alias("up_a"), F.col("node").alias("up_b"))
    for level in nodes[-2::-1]:
        a, b = (level.select(*place, F.floor(F.col("node") / fan).alias(f"up_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in level.columns if c not in place)) for s in "ab")
        met = pairs.join(a, [*place, "up_a"]).join(b, [*place, "up_b"]).where("node_a <= node_b").where(_differences("a", "b") <= apart)
        keep = [F.col(f"leaf_{s}").alias(s) for s in "ab"] if level is nodes[0] else []
        pairs = cut(met.select(*place, F.col("node_a").alias("up_a"), F.col("node_b").alias("up_b"), *keep), "node-pairs")
    return pairs.select("turn", "a", "b") if "a" in pairs.columns else pairs.select("turn", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")).limit(0)


def near_links(different: DataFrame, apart: int = APART, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """(a, b): links that connect fingerprints as all pairs with at most ``apart`` different bits do, of a table of different ones."""
    turns = F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), rotated(F.col("fingerprint"), QUARTER * t).alias("value")) for t in range(TURNS)))).alias("to")
    rows = different.select(turns).select("to.turn", "to.value").withColumn("rank", gray_rank(F.col("value")))
    parts = int(different.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "turn", "rank").sortWithinPartitions("turn", "rank")
    leaves = cut(ordered.mapInArrow(lambda it: lean(_leaves(it, leaf)), _LEAVES), "leaves")
    pairs = leaf_pairs(leaves, apart, fan)
    members = lambda s: leaves.select("turn", F.col("leaf").alias(s), F.col("members").alias(f"members_{s}"))
    alone = leaves.join(pairs.select("turn", F.col("a").alias("leaf")).distinct(), ["turn", "leaf"], "left_anti").where("n > 1").select("turn", "members", F.lit(None).cast("binary").alias("others"))
    met = pairs.join(members("a"), ["turn", "a"]).join(members("b"), ["turn", "b"])
    met = met.select("turn", F.col("members_a").alias("members"), F.when(F.col("a") != F.col("b"), F.col("members_b")).alias("others"))
    return alone.unionByName(met).mapInArrow(lambda it: lean(_linked(it, apart)), _LINKS).distinct()


def simhash_components(df: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id): 64-bit SimHash, as 16 hex digits, and the least id of what links with it directly or by others.

    Words are as in :mod:`.words`, A-Z lower-cased; a text of fewer words than a shingle has one shingle, and
    one without words (null and empty texts too) has fingerprint 0, which links like any other.
    A null id sorts before all others, so a component that has one reports null. Rows link by
    their fingerprints alone: rows with repeated ids are rows of their own. Texts of any length
    are taken whole, other columns are not read, and an empty table gives no rows.
    """
    source = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("key"), F.col(text).alias("text"))
    with temporary(df.sparkSession) as kept:
        described = cut(source.mapInArrow(lambda it: lean(_fingerprinted(it, shingle)), "key long, fingerprint long"), "fingerprints")
        kept.append(described)
        classes = cut(described.groupBy("fingerprint").agg(F.min("key").alias("least")), "fingerprint-classes")
        kept.append(classes)
        found = components(near_links(classes))
        kept.append(found)
    group = classes.join(found, classes.fingerprint == found.node, "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    to = group.join(group.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fingerprint", "component_id")
    shown = lambda c: F.expr(f"nullif({c}, {_NO_KEY + 1}L - 1L)").alias("doc_id" if c == "key" else c)
    return described.join(to, "fingerprint").select(shown("key"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), shown("component_id"))
