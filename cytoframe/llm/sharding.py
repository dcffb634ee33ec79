"""Shards by a Feistel permutation over global row numbers, in DataFrame functions only.

Rows get dense numbers 0..n-1 by (bucket of the id's hash, id, size, checksum); a keyed
permutation of 0..n-1 shuffles them, and shard and slot are the permuted number's
remainder and quotient. The shuffle is a function of the ids and the seed alone: it
doesn't depend on partitioning, and any row's place can be computed, or inverted,
without the others once its number is known.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Of the numbering; a bucket is one sort, its count one row of the offsets.
BUCKETS = 4096
ROUNDS = 6
#: Steps of the cycle walk that are unrolled. The domain exceeds n by less than its square root, so a
#: longer walk has a chance below n ** (1 - WALK / 2); such a row would raise an error, never get a wrong place.
WALK = 32


def permuted(df: DataFrame, number: str, n: int, seed: int, out: str, invert: bool = False) -> DataFrame:
    """``df`` with column ``out``: the place of ``number`` (0 <= number < n) in a permutation of 0..n-1.

    An alternating Feistel network over Z_a x Z_b with a * b >= n permutes a domain a
    little larger than n; walking its cycle until the value is below n restricts it to n.
    ``invert`` goes the other way, from place to number.
    """
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))
    keys, sign = (f"sequence({ROUNDS - 1}, 0, -1)", "-") if invert else (f"sequence(0, {ROUNDS - 1})", "+")

    def network(x: str) -> str:
        left = f"named_struct('l', pmod(s.l {sign} pmod(xxhash64(s.r, k, {seed}L), {a}L), {a}L), 'r', s.r)"
        right = f"named_struct('l', s.l, 'r', pmod(s.r {sign} pmod(xxhash64(s.l, k, {seed}L), {b}L), {b}L))"
        return f"aggregate({keys}, named_struct('l', {x} div {b}L, 'r', {x} % {b}L), (s, k) -> if(k % 2 = 0, {left}, {right}), s -> s.l * {b}L + s.r)"

    walk = f"aggregate(sequence(1, {WALK}), {network(number)}, (p, i) -> if(p < {n}L, p, {network('p')}))"
    walked = df.withColumn(out, F.expr(walk))
    return walked.withColumn(out, F.expr(f"if({out} < {n}L, {out}, cast(raise_error('the cycle walk did not end') as bigint))"))


def numbered(df: DataFrame, key: str, *ties: str) -> DataFrame:
    """``df`` with ``row_number_`` from 0 without gaps, over all rows, whatever the partitioning.

    No range sampling and no single sort: a row's number is its rank in its hash bucket
    plus the count of the buckets before. Buckets hash the key with the ties, so that rows
    without a key spread; rows equal in all of them are interchangeable. ``df`` is read
    twice and should be a stored table.
    """
    bucketed = df.withColumn("bucket_", F.pmod(F.xxhash64(key, *ties), F.lit(BUCKETS)).cast("int"))
    counts = bucketed.groupBy("bucket_").agg(F.count(F.lit(1)).alias("count_"))
    before = counts.select("bucket_", (F.sum("count_").over(Window.orderBy("bucket_")) - F.col("count_")).alias("before_"))
    rank = F.row_number().over(Window.partitionBy("bucket_").orderBy(key, *ties))
    # The broadcast side has BUCKETS rows at most, whatever the input.
    return bucketed.withColumn("rank_", rank).join(F.broadcast(before), "bucket_").withColumn("row_number_", F.col("before_") + F.col("rank_") - 1).drop("bucket_", "rank_", "before_")


def shards(df: DataFrame, n_shards: int = 40, seed: int = 20261, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every row's shard and slot under the law ``rows``: counts of shards differ by one at most.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard
    (null: a row's place under another shard count isn't bound by this law). Null text
    counts as no bytes; null keys are numbered like others; repeated rows all get places
    of their own; an empty table gives no rows. Other columns are not read.
    """
    utf8 = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    narrow = df.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(utf8) + 16).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    narrow = cut(narrow, "shards")
    n = narrow.count()
    rows = permuted(numbered(narrow, "doc_id", "size", "text_crc32"), "row_number_", n, seed, "place_")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place_") % n_shards).cast("int").alias("shard"), F.expr(f"place_ div {n_shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
