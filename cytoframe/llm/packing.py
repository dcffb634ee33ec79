"""Best-fit packing by large-item matching, planned on the histogram of lengths.

Lengths are at most the capacity, so the plan depends on one count per length, whatever
the number of pieces. Lengths above a third of the capacity go two to a sequence at most:
each, from the longest, is matched with the longest that still fits. Shorter lengths,
from the longest, go to the gaps that they fit best, then to new sequences. The plan is
a list of intervals: the pieces of one length with ranks from .. to lie at one offset of
consecutive sequences. A piece's rank among those of its length is counted in salted
groups, so that a length that many pieces share is no single task's work.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut
from .words import batch_of, lean

CAPACITY, END_ID = 4096, 1
SALTS = 256
#: Pieces of a salted group, on average, of a length that all pieces share.
GROUP = 1_000_000
#: Chunks of each of a worker's two generations of cache; a full young one replaces the old one, which costs time only.
CACHE = 400_000
_ENDINGS = frozenset(b".,!?;:")
_LETTERS = bytes(b for b in range(256) if bytes([b]).decode("latin-1").isalpha())
_WORD_BYTES = frozenset(_LETTERS + b"0123456789")


class ChunkEncoder:
    """Ids of whole texts by a tokenizer that drops white space, from cached ids of the chunks between it.

    Exact where chunks are independent: in texts of Latin-1 characters, which the tokenizer's
    normaliser maps one by one, without its special tokens. Other texts are encoded whole.
    """

    #: No Latin-1 text holds this character, nor the token of its first byte.
    MARK = "☃"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        #: For lower-case words of letters alone, which neither normaliser nor word pattern changes: the model without them.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Encode chunks many at a time and cut the ids: runs of letters at word ends, others at marks put between them."""
        out: dict[bytes, bytes] = {}
        words = [c for c in chunks if not c.translate(None, _LETTERS)]
        others = [c for c in chunks if c.translate(None, _LETTERS)]
        size = 256
        for model, own, between in ((self.plain, words, " "), (self.tokenizer, others, f" {self.MARK} ")):
            groups = [own[i : i + size] for i in range(0, len(own), size)]
            texts = [between.join([c.decode("latin-1") for c in g]) for g in groups]
            for group, found in zip(groups, model.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                if between == " ":
                    end = np.flatnonzero(self.ends_word[ids]) + 1
                    begin = np.append(0, end[:-1])
                else:
                    at = np.flatnonzero(ids == self.mark[0])
                    begin, end = np.append(0, at + len(self.mark)), np.append(at, len(ids))
                if len(begin) != len(group):
                    out.update((c, self.whole(c.decode("latin-1"))) for c in group)
                    continue
                raw = ids.tobytes()
                out.update((c, raw[4 * b : 4 * e]) for c, b, e in zip(group, begin.tolist(), end.tolist()))
        return out

    def remember(self, chunks: dict[bytes, bytes]) -> None:
        if len(self.young) + len(chunks) > CACHE:
            self.old, self.young = self.young, {}
        self.young.update(chunks)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        pending: list[tuple[int, list[bytes], list[bytes | None], list[int]]] = []
        missing: dict[bytes, bytes] = {}
        young, old = self.young.get, self.old.get
        for text in texts:
            text = text or ""
            try:
                chunks = None if "<|" in text else text.lower().encode("latin-1").split()
            except UnicodeEncodeError:
                chunks = None
            if chunks is None:
                out.append(self.whole(text))
                continue
            parts = list(map(young, chunks))
            holes = [i for i, p in enumerate(parts) if p is None]
            waiting = []
            for i in holes:
                c = chunks[i]
                found = old(c)
                if found is not None:
                    self.young[c] = parts[i] = found
                else:
                    waiting.append(i)
                    for own in self._parted(c):
                        if own and young(own) is None and old(own) is None:
                            missing[own] = b""
            if waiting:
                pending.append((len(out), chunks, parts, waiting))
                out.append(b"")
                continue
            out.append(b"".join(parts))
        if pending:
            learned = self.learn(list(missing))
            fresh: dict[bytes, bytes] = dict(learned)
            ids = lambda c: learned.get(c) or young(c) or old(c) or b""
            for i, chunks, parts, waiting in pending:
                for k in waiting:
                    c = chunks[k]
                    stem, last = self._parted(c)
                    parts[k] = fresh[c] = ids(stem) + ids(last) if last else ids(stem)
                out[i] = b"".join(parts)
            self.remember(fresh)
        return out

    @staticmethod
    def _parted(chunk: bytes) -> tuple[bytes, bytes]:
        """A chunk without its last mark, and that mark if it follows a letter or digit: it is then a token of its own."""
        if chunk[-1] in _ENDINGS and len(chunk) > 1 and chunk[-2] in _WORD_BYTES:
            return chunk[:-1], chunk[-1:]
        return chunk, b""


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    model = chunk_encoder(path)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        for lo in range(0, batch.num_rows, 100):
            part, rows = batch.slice(lo, 100), []
            keys = part.column(0).to_pylist()
            for key, ids in zip(keys, model.encode(part.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(own) // 4, zlib.crc32(own)) + (np.frombuffer(own, "<i4").tolist(),) * with_ids)
            yield batch_of(schema, *(list(c) for c in zip(*rows)))


def token_pieces(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each row's ids, ``end_id`` after them, in pieces of ``capacity`` tokens, the last one shorter.

    Returns doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids. Null and
    empty texts make one piece of the end id alone. Rows with null or repeated keys are rows of
    their own, a text of any length is cut into as many pieces as it needs, other columns are not read, and
    an empty table gives no rows.
    """
    out = _PIECES + ", ids array<int>" * with_ids
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: lean(_pieces(it, tokenizer, capacity, end_id, with_ids)), out)


class Plan:
    """Intervals (length, rank from, count, sequence from, offset) that place the counted lengths."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.done = dict.fromkeys(counts, 0)
        self.left = {k: n for k, n in counts.items() if n}
        if self.left and not 0 < min(self.left) <= max(self.left) <= capacity:
            raise ValueError(f"lengths must be 1 to {capacity}")
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # room left: ranges (first sequence, count)
        self.rooms: list[int] = []  # the keys of gaps, in order
        self._match_large()
        for length in sorted(self.left, reverse=True):
            self._fit(length)

    def _put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.done[length], count, sequence, offset))
        self.done[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _gap(self, room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in self.gaps:
                insort(self.rooms, room)
            self.gaps.setdefault(room, []).append((sequence, count))

    def _match_large(self) -> None:
        large = sorted(k for k in self.left if 3 * k > self.capacity)
        while large:
            a = large[-1]
            if a not in self.left:
                large.pop()
                continue
            i = bisect_left(large, self.capacity - a + 1) - 1
            while i >= 0 and (large[i] not in self.left or large[i] == a and self.left[a] < 2):
                i -= 1
            if i < 0:
                n = self.left[a]
                self._put(a, n, self.sequences, 0)
                self._gap(self.capacity - a, self.sequences, n)
            else:
                b = large[i]
                n = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                self._put(a, n, self.sequences, 0)
                self._put(b, n, self.sequences, a)
                self._gap(self.capacity - a - b, self.sequences, n)
            self.sequences += n

    def _fit(self, length: int) -> None:
        while length in self.left:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                n = -(-self.left[length] // (self.capacity // length))
                self._gap(self.capacity, self.sequences, n)
                self.sequences += n
                continue
            room = self.rooms[i]
            sequence, count = self.gaps[room].pop()
            if not self.gaps[room]:
                del self.gaps[room]
                self.rooms.pop(i)
            each = room // length
            used = min(count, self.left[length] // each)
            if used:
                for k in range(each):
                    self._put(length, used, sequence, self.capacity - room + k * length)
                self._gap(room - each * length, sequence, used)
            else:
                each, used = self.left[length], 1
                for k in range(each):
                    self._put(length, 1, sequence, self.capacity - room + k * length)
                self._gap(room - each * length, sequence, 1)
            self._gap(room, sequence + used, count - used)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Intervals in order of (length, rank), as columns."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return tuple(rows.T.copy())


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
_PLACED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _place(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    lengths, ranks, _, sequences, offsets = shared.value
    low = np.searchsorted(lengths, np.arange(int(lengths.max(initial=0)) + 2))
    for batch in batches:
        length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
        at = np.empty(len(length), np.int64)
        order = np.lexsort((rank, length))
        edges = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0, [True]])) if len(order) else []
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            k = int(length[own[0]])
            at[own] = low[k] + np.searchsorted(ranks[low[k] : low[k + 1]], rank[own], "right") - 1
        yield batch_of(_PLACED_SCHEMA, batch.column(0), batch.column(1), batch.column(2), length, batch.column(4), sequences[at] + rank - ranks[at], offsets[at])


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences of at most ``capacity`` tokens for the rows of :func:`token_pieces` (its first five columns).

    Adds sequence_id (from 0) and offset; a sequence's pieces lie without gaps from 0.
    Rows equal in all columns are placed like others; an empty table gives no rows.

    What reaches the driver: a count for each length, ``capacity`` rows at most. What is
    broadcast: the plan, whose size depends on the lengths that occur, not on the pieces
    (fewer than ``capacity`` squared intervals at worst, a few tens of thousands in practice).
    """
    spark = pieces.sparkSession
    stored = cut(pieces.select("doc_id", "piece", "start", "length", "ids_crc32"), "pieces")
    salts = max(SALTS, stored.count() // GROUP)
    salted = stored.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity).arrays())
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("rank", rank).join(before, ["length", "salt"])
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before") - 1).alias("rank"))
    return placed.mapInArrow(lambda it: lean(_place(it, plan)), _PLACED)
