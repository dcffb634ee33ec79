"""Fill-in-the-middle transformation by a parallel automaton scan.

An :class:`Automaton` reads bytes and says where units (lines, code points) begin and whether
a marker occurs. Texts are divided into lanes; a lane doesn't know the state in which it is
entered, so it yields a function from entry to exit states and a count of units for each entry
state. These compose associatively: a prefix scan over the lanes of a text, in logarithmically
many steps, gives each lane's entry state and the units before it. A cut is then looked for in
the one lane that holds it.

Texts over ``GIANT`` bytes are stored and dealt out as chunks: tasks scan chunks, a group of
chunk functions (a few numbers for each chunk) is composed for each text, and only the chunks
that hold a cut are scanned again. All other texts are scanned where they are read, and stay
in the JVM meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .words import batch_of, lean, text_buffers

#: Bytes of a lane, of a chunk of a giant text, and of a text that counts as giant.
LANE, CHUNK, GIANT = 512, 1 << 14, 1 << 16
SENTINELS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Automaton:
    """Next state and units that begin, by state and class of byte; state 0 is entered at a text's start."""

    classes: np.ndarray
    to: np.ndarray
    begins: np.ndarray

    @property
    def states(self) -> int:
        return len(self.to)


def _line_automaton() -> Automaton:
    """A line begins at a byte that follows a line feed or nothing."""
    classes = np.zeros(256, np.int64)
    classes[ord("\n")] = 1
    return Automaton(classes, np.array([[1, 0], [1, 0]]), np.array([[1, 1], [0, 0]]))


def _character_automaton() -> Automaton:
    """A code point begins at a byte that continues no other."""
    classes = np.zeros(256, np.int64)
    classes[0x80:0xC0] = 1
    return Automaton(classes, np.array([[0, 0]]), np.array([[1, 0]]))


LINES, CHARACTERS = _line_automaton(), _character_automaton()


def finder(markers: tuple[str, ...]) -> Automaton:
    """The automaton whose last state is entered, and never left, once a marker has occurred; a unit begins there."""
    patterns = [m.encode() for m in markers]
    prefixes = sorted({p[:k] for p in patterns for k in range(len(p))} | {b""}, key=lambda p: (len(p), p))
    bytes_ = sorted({b for p in patterns for b in p})
    classes = np.zeros(256, np.int64)
    classes[bytes_] = range(1, len(bytes_) + 1)
    found = len(prefixes)
    to = np.zeros((found + 1, len(bytes_) + 1), np.int64)
    for i, prefix in enumerate(prefixes):
        for c, byte in enumerate(bytes_, 1):
            seen = prefix + bytes([byte])
            tails = [seen[k:] for k in range(len(seen) + 1)]
            to[i, c] = found if any(t in patterns for t in tails) else prefixes.index(next(t for t in tails if t in prefixes))
    to[found] = found
    begins = (to == found).astype(np.int64)
    begins[found] = 0
    return Automaton(classes, to, begins)


def _tables(a: Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Flat tables with one more class, that of bytes past a lane's end, which changes nothing; states are multiplied by the width."""
    width = a.to.shape[1] + 1
    to = np.concatenate([a.to, np.arange(a.states)[:, None]], 1) * width
    return a.classes, to.ravel(), np.concatenate([a.begins, np.zeros((a.states, 1), np.int64)], 1).ravel(), width


def lane_functions(data: np.ndarray, first: np.ndarray, last: np.ndarray, a: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """For each lane ``first <= byte < last`` and each entry state: the exit state, and the units that begin."""
    classes, to, begins, width = _tables(a)
    state = np.repeat(np.arange(a.states)[:, None] * width, len(first), 1)
    count = np.zeros(state.shape, np.int64)
    end = len(data) - 1
    for t in range(int((last - first).max(initial=0))):
        at = first + t
        kind = classes[data[np.minimum(at, end)]]
        kind[at >= last] = width - 1
        step = state + kind
        count += begins[step]
        state = to[step]
    return (state // width).T, count.T


def composed(exits: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Functions of lanes to functions of all lanes of their text up to and with them; ``place`` numbers the lanes of a text from 0."""
    exits, counts, step = exits.copy(), counts.copy(), 1
    while step <= place.max(initial=0):
        i = np.flatnonzero(place >= step)
        earlier, before = exits[i - step], counts[i - step]
        counts[i] = before + np.take_along_axis(counts[i], earlier, 1)
        exits[i] = np.take_along_axis(exits[i], earlier, 1)
        step *= 2
    return exits, counts


def entries(exits: np.ndarray, counts: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state in which each lane is entered from state 0 of its text, and the units before it, of composed functions."""
    state, before = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    later = np.flatnonzero(place > 0)
    state[later], before[later] = exits[later - 1, 0], counts[later - 1, 0]
    return state, before


def lanes(at: np.ndarray, size: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, first, last) of the lanes of texts with these offsets; an empty text has one empty lane."""
    count = np.maximum(-(-np.diff(at) // size), 1)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = at[:-1][text] + place * size
    return text, place, first, np.minimum(first + size, at[1:][text])


def locate(data: np.ndarray, first: np.ndarray, last: np.ndarray, state: np.ndarray, skip: np.ndarray, a: Automaton) -> np.ndarray:
    """The code points of each lane, entered in ``state``, before the unit that follows ``skip`` others."""
    classes, to, begins, width = _tables(a)
    now, seen, characters = state * width, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    starts = CHARACTERS.classes == 0
    for t in range(int((last - first).max(initial=0))):
        at = np.minimum(first + t, len(data) - 1)
        kind = classes[data[at]]
        past = first + t >= last
        kind[past] = width - 1
        step = now + kind
        seen += begins[step]
        now = to[step]
        # The byte at which the unit begins is no longer before it.
        characters += (seen <= skip) & ~past & starts[data[at]]
    return characters


@dataclass
class Scan:
    """Lanes of some texts (or chunks, as texts of their own), composed under each automaton."""

    data: np.ndarray
    at: np.ndarray
    units: Automaton
    marks: Automaton

    def __post_init__(self) -> None:
        self.text, self.place, self.first, self.last = lanes(self.at)
        self.ends = np.append(np.flatnonzero(self.place[1:] == 0), len(self.place) - 1) if len(self.place) else np.zeros(0, np.int64)
        self.by = [composed(*lane_functions(self.data, self.first, self.last, a), self.place) for a in (self.units, CHARACTERS, self.marks)]

    def whole(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(exits, counts) of each text by entry state, for units, code points and markers."""
        return [(exits[self.ends], counts[self.ends]) for exits, counts in self.by]

    def positions(self, units: np.ndarray, state: np.ndarray | int = 0) -> np.ndarray:
        """The code points of each text, entered in ``state``, before its unit with this number; all of them if there is none."""
        exits, counts = self.by[0]
        start = np.broadcast_to(np.asarray(state, np.int64), (len(self.at) - 1,))
        running = counts[np.arange(len(self.text)), start[self.text]]
        total = running[self.ends]
        base = np.cumsum(total) - total
        out = self.by[1][1][self.ends, 0].copy()
        held = np.flatnonzero(units < total)
        lane = np.searchsorted(running + base[self.text], (base + units)[held], "right")
        before, characters, now = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64), start[held].copy()
        later = self.place[lane] > 0
        to = lane[later] - 1
        now[later], before[later], characters[later] = exits[to, start[held][later]], running[to], self.by[1][1][to, 0]
        out[held] = characters + locate(self.data, self.first[lane], self.last[lane], now, units[held] - before, self.units)
        return out


def drawn(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units after which prefix and middle end."""
    a, b = first % (n + 1), second % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


_FOUND = "struct<n: long, low: long, high: long, marked: boolean>"


def _scanned(text: pa.Array, first: pa.Array, second: pa.Array, units: Automaton, marks: Automaton) -> pa.Array:
    data, at = text_buffers(text)
    scan = Scan(data, at, units, marks)
    (_, n), _, (_, marked) = ((exits, counts[:, 0]) for exits, counts in scan.whole())
    low, high = drawn(first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False), n)
    columns = [pa.array(n, pa.int64()), pa.array(scan.positions(low), pa.int64()), pa.array(scan.positions(high), pa.int64()), pa.array(marked > 0)]
    return pa.StructArray.from_arrays(columns, ["n", "low", "high", "marked"])


# ---- giant texts

_CHUNKS = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("bytes", pa.binary())])
_FUNCTIONS = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("exits", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_TARGETS = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("side", pa.int32()), ("chunk", pa.int64()), ("state", pa.int64()), ("skip", pa.int64()), ("before", pa.int64())])
_HITS = pa.schema([("row", pa.int64()), ("n", pa.int64()), ("marked", pa.bool_()), ("side", pa.int32()), ("position", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _chunked(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) to chunks of their bytes, which may split a character."""
    for batch in batches:
        data, at = text_buffers(batch.column(1))
        for row, lo, hi in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
            raw = data[lo:hi]
            yield batch_of(_CHUNKS, *map(list, zip(*((row, k, raw[k * size : (k + 1) * size].tobytes()) for k in range(max(1, -(-len(raw) // size)))))))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def _chunk_functions(batches: Iterator[pa.RecordBatch], units: Automaton, marks: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            whole = Scan(*_bytes(batch.column(2)), units, marks).whole()
            exits, counts = (np.concatenate([x[i] for x in whole], 1) for i in (0, 1))
            yield batch_of(_FUNCTIONS, batch.column(0), batch.column(1), list(exits), list(counts))


def _targets(table: pa.Table, units: Automaton, marks: Automaton) -> pa.Table:
    """The chunks of one text in which its cuts lie, from the chunks' functions: a row for each side."""
    table = table.combine_chunks().sort_by("chunk")
    exits, counts = (np.stack(table.column(c).to_numpy()) for c in ("exits", "counts"))
    place, split = np.arange(table.num_rows), np.cumsum([units.states, CHARACTERS.states])
    by = [composed(e, c, place) for e, c in zip(np.split(exits, split, 1), np.split(counts, split, 1))]
    (state, before), (_, characters) = entries(*by[0], place), entries(*by[1], place)
    n, total, marked = (int(c[-1, 0]) for _, c in by)
    first, second = (table.column(c)[0].as_py() for c in ("first", "second"))
    low, high = (int(x) for x in drawn(np.int64(first), np.int64(second), np.int64(n)))
    rows = []
    for side, unit in enumerate((low, high)):
        if unit == n:
            rows.append((None, 0, 0, total))
            continue
        k = int(np.searchsorted(by[0][1][:, 0], unit, "right"))
        rows.append((k, int(state[k]), unit - int(before[k]), int(characters[k])))
    columns = [[table.column("row")[0].as_py()] * 2, [n] * 2, [marked > 0] * 2, [0, 1], *map(list, zip(*rows))]
    return pa.Table.from_batches([batch_of(_TARGETS, *columns)])


def _hits(batches: Iterator[pa.RecordBatch], units: Automaton) -> Iterator[pa.RecordBatch]:
    """Positions of cuts in the chunks that hold them."""
    for batch in batches:
        data, at = _bytes(batch.column(0))
        state, skip, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("state", "skip", "before"))
        found = Scan(data, at, units, CHARACTERS).positions(skip, state) + before if batch.num_rows else []
        yield batch_of(_HITS, *(batch.column(c) for c in ("row", "n", "marked", "side")), found)


def _giant_cuts(giants: DataFrame, units: Automaton, marks: Automaton, chunk: int) -> DataFrame:
    """(row, found) of giant texts (row, text, first, second)."""
    parts = max(1, int(giants.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def chunks() -> DataFrame:
        return giants.select("row", "text").mapInArrow(lambda it: lean(_chunked(it, chunk)), _ddl(_CHUNKS)).repartition(parts, "row", "chunk")

    functions = chunks().mapInArrow(lambda it: lean(_chunk_functions(it, units, marks)), _ddl(_FUNCTIONS))
    known = functions.join(giants.select("row", "first", "second"), "row")
    targets = cut(known.groupBy("row").applyInArrow(lambda t: _targets(t, units, marks), _ddl(_TARGETS)), "infill-targets")
    inside = chunks().join(targets.where("chunk is not null"), ["row", "chunk"]).select("bytes", "row", "n", "marked", "side", "state", "skip", "before")
    hits = inside.mapInArrow(lambda it: lean(_hits(it, units)), _ddl(_HITS))
    hits = hits.unionByName(targets.where("chunk is null").select("row", "n", "marked", "side", F.col("before").alias("position")))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("position")))
    return hits.groupBy("row").agg(F.struct(F.max("n").alias("n"), side(0).alias("low"), side(1).alias("high"), F.bool_or("marked").alias("marked")).alias("found"))


# ---- the transformation

def restored(output: Column, form: Column) -> Column:
    """The text of which ``output`` was made: each sentinel occurs once in it, and none can arise where parts meet."""
    p, s, m = SENTINELS
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    # The halves before the middle, each after its own sentinel.
    halves = lambda second: (F.substring(F.substring_index(head, second, 1), len(p) + 1, 1 << 30), F.substring_index(head, second, -1))
    (prefix, suffix), (suffix_first, prefix_second) = halves(s), halves(p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_second, middle, suffix_first))


def _draws(key: str, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 by the hash of seed and key."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(df: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, units: Automaton = LINES, text: str = "text", key: str = "doc_id", giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): texts cut at two of their ``n`` + 1 unit borders and rearranged.

    ``rate`` of a hundred texts are rearranged, ``spm`` of a hundred of these with the suffix first; all draws come
    from a hash of ``seed`` and the id, in decimal (a null id: nothing). A null text counts as
    empty. Texts that are empty or hold a sentinel stay as they are (``plain``, with null lengths),
    and so do those not drawn. Rows with null or repeated ids are rows of their own, equal rows
    have equal results, texts of any length are taken whole, other columns are not read, and an
    empty table gives no rows.
    """
    marks = finder(SENTINELS)
    draws = _draws(key, seed)
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(d.alias(name) for d, name in zip(draws, ("first", "second", "third", "fourth"))))
    large = F.octet_length("text") > giant
    # A function made here, so that workers get it with its automata.
    scan = F.arrow_udf(lambda t, a, b: _scanned(t, a, b, units, marks), _FOUND)
    near = rows.where(~large).withColumn("found", scan("text", "first", "second"))
    giants = cut(rows.where(large).withColumn("row", F.monotonically_increasing_id()), "giant-texts")
    far = giants.join(_giant_cuts(giants, units, marks, chunk), "row").select(*near.columns)
    known = near.unionByName(far).select("doc_id", "text", "fourth", "third", "found.*")
    form = F.when((F.col("text") == "") | F.col("marked") | (F.col("third") % 100 >= rate), "plain").when(F.col("fourth") % 100 < spm, "spm").otherwise("psm")
    p, s, m = map(F.lit, SENTINELS)
    prefix, suffix = F.substring("text", F.lit(1), F.col("low").cast("int")), F.substring("text", (F.col("high") + 1).cast("int"), F.lit((1 << 31) - 1))
    middle = F.substring("text", (F.col("low") + 1).cast("int"), (F.col("high") - F.col("low")).cast("int"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    moved = F.col("form") != "plain"
    return known.withColumn("form", form).select("doc_id", "n", "form", F.when(moved, F.col("low")).alias("prefix_chars"), F.when(moved, F.col("high") - F.col("low")).alias("middle_chars"), output.alias("output"))
