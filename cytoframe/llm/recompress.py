"""Repeated passages by recompression.

Runs of one word, then again and again pairs of neighbours, are replaced by new symbols. A
symbol's name is a hash of what it stands for and a pair is merged on the strength of its
two names alone, so names are global without being sent, and equal substrings anywhere in
the corpus get equal symbols, but for those at their ends whose neighbours may differ.
Following a window of words through the levels, minus what its neighbours could have taken
part in, leaves a core of symbols that the window's words alone decide.

Spark rounds, one for each level of ``LEVELS``, count the names over the whole corpus and
tell each row which of its own some other row has. A window goes on to the next round only
if every symbol of its core is shared: low levels drop most of what is unique, symbols of
high levels, several words long, reveal what repeats. Windows that outlast all rounds are
verified by 96 bits of their words. A document's whole sequence has a name, too, by which
copies are found at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, forget, temporary
from .words import Slice, U, batch_of, lean, mix, rolling, slices, windows

WINDOW = 20
#: Levels whose names a Spark round counts. A symbol of level n is about 1.33 ** n words long; a core of 20 words is rarely empty before the seventh.
LEVELS = (5, 6)
_NO_KEY = -(1 << 63)
_LEFT, _RIGHT, _RUN = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3)


def window_hashes(s: Slice, h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits, independent of each other, of the words of each window."""
    return mix(rolling(h, k)[at]), (mix(rolling(mix(h ^ _RUN), k)[at]) >> U(32)).astype(np.uint32)


def listed_in(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted ones. Most of those that aren't are told by their low bits, before any search."""
    bits = min(22, len(listed).bit_length() + 3)
    mask = U((1 << bits) - 1)
    table = np.zeros(1 << bits, bool)
    table[(listed & mask).astype(np.int64)] = True
    out = table[(x & mask).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at):
        out[at] = listed[np.minimum(np.searchsorted(listed, x[at]), len(listed) - 1)] == x[at]
    return out


@dataclass
class Cores:
    """A level's names with the row of each, the range of names that is each window's core, and the name of a window whose core is empty."""

    names: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rest: np.ndarray

    def outlast(self, wanted: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which windows have nothing but names in their core that are wanted by their row; rows want ``sizes`` names each, in order."""
        salt = mix(np.arange(1, len(sizes) + 1, dtype=U) * _RIGHT)
        asked = np.sort(wanted ^ np.repeat(salt, sizes))
        missing = np.concatenate([[0], np.cumsum(~listed_in(self.names ^ salt[self.rows], asked))])
        whole = self.lo < self.hi
        at = np.minimum(self.lo, max(0, len(self.rows) - 1))
        return np.where(whole, missing[self.hi] == missing[self.lo], listed_in(self.rest ^ salt[self.rows[at]], asked)) if len(whole) else whole

    def found_in(self, windows_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The names, with their rows, that cores of these windows hold."""
        lo, hi, whole = self.lo[windows_], self.hi[windows_], self.lo[windows_] < self.hi[windows_]
        edge = np.zeros(len(self.names) + 1, np.int32)
        np.add.at(edge, lo[whole], 1)
        np.add.at(edge, hi[whole], -1)
        held = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        # Neighbouring windows with empty cores often have the same name.
        rest, at = self.rest[windows_][~whole], self.rows[lo[~whole]]
        new = np.ones(len(rest), bool)
        new[1:] = (rest[1:] != rest[:-1]) | (at[1:] != at[:-1])
        return np.concatenate([self.names[held], rest[new]]), np.concatenate([self.rows[held], at[new]])


def cores(h: np.ndarray, owner: np.ndarray, at: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS) -> list[Cores]:
    """The cores, after each of ``levels``, of the windows of ``k`` words that start at ``at``: functions of their words alone."""
    # Level 0: runs of one word become one symbol. A core's outer runs may go on outside it.
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(h)))
    sym, own = np.where(length > 1, mix(h[first] + _RUN * length.astype(U)), h[first]), owner[first]
    lo, hi = run[at] + 1, run[at + k - 1]
    rest = np.zeros(len(at), U)
    over = lo >= hi
    rest[over] = mix(h[at[over]] + h[at[over] + k - 1] * _LEFT)
    live = np.flatnonzero(~over)
    # Where a core is empty, lo and hi only tell the row.
    place_of, lo, hi = run[at], lo[live], hi[live]
    out = []
    for level in range(1, max(levels) + 1):
        left = mix(sym ^ U(level * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(63) == 1
        pair = np.zeros(len(sym), bool)
        pair[:-1] = left[:-1] & ~left[1:] & (own[:-1] == own[1:])
        keep = np.ones(len(sym), bool)
        keep[1:] = ~pair[:-1]
        place = np.cumsum(keep) - 1
        merged = sym.copy()
        taken = np.flatnonzero(pair)
        merged[taken] = mix(sym[taken] * _LEFT + sym[taken + 1] * _RIGHT + U(level))
        # A right symbol that begins a core may belong to a pair that began before it, a left one that ends it to one that goes on.
        new_lo = place[lo] + ~left[lo]
        new_hi = place[hi - 1] + ~left[hi - 1]
        over = new_lo >= new_hi
        rest[live[over]] = mix(sym[lo[over]] + U(level))
        live, lo, hi = live[~over], new_lo[~over], new_hi[~over]
        place_of = place[place_of]
        sym, own = merged[keep], own[keep]
        if level in levels:
            full_lo, full_hi = place_of.copy(), place_of.copy()
            full_lo[live], full_hi[live] = lo, hi
            out.append(Cores(mix(sym ^ U(level * int(_RUN) % (1 << 64))), own, full_lo, full_hi, mix(rest ^ _RUN)))
    return out


def first_met(code: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Which of the pairs are the first that are equal to them in both numbers."""
    out = np.ones(len(code), bool)
    order = np.argsort(code)
    twin = code[order[1:]] == code[order[:-1]]
    # Only numbers that occur twice need an order that keeps the first in front.
    alike = np.zeros(len(code), bool)
    alike[order[1:][twin]] = alike[order[:-1][twin]] = True
    at = np.flatnonzero(alike)
    at = at[np.lexsort((check[at], code[at]))]
    out[at[1:]] = (code[at[1:]] != code[at[:-1]]) | (check[at[1:]] != check[at[:-1]])
    return out


def among(code: np.ndarray, check: np.ndarray, listed: np.ndarray, listed_check: np.ndarray) -> np.ndarray:
    """Which of the pairs are listed, equal in both numbers."""
    out = listed_in(code, np.sort(listed))
    at = np.flatnonzero(out)
    # Listed ones stand first, so a pair is listed if it isn't the first of its kind, or repeats one that is.
    both, checks = np.concatenate([listed, code[at]]), np.concatenate([listed_check, check[at]])
    order = np.lexsort((checks, both))
    new = np.concatenate([[True], (both[order[1:]] != both[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])]) if len(both) else np.zeros(0, bool)
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    found = np.zeros(len(both), bool)
    found[order] = head < len(listed)
    out[at] = found[len(listed) :]
    return out


def document_names(h: np.ndarray, s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits that name the whole word sequence of each row."""
    place = np.arange(len(h), dtype=np.int64) - np.repeat(s.words[:-1], np.diff(s.words))
    out = []
    for salt in (_LEFT, _RIGHT):
        total = np.zeros(len(h) + 1, U)
        np.cumsum(mix(h ^ mix(place.astype(U) * salt + salt)), out=total[1:])
        out.append(mix(total[s.words[1:]] - total[s.words[:-1]] + np.diff(s.words).astype(U) * salt))
    return out[0], (out[1] >> U(32)).astype(np.uint32)


def _signed(x: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(x).view(kind)


#: Columns that tell rows apart: a key that one row has, or else the key and a hash of the text.
_ONE, _SEVERAL = ["key"], ["key", "sub"]


def _schema(*columns: tuple[str, pa.DataType], by: list[str]) -> pa.Schema:
    return pa.schema([*columns, *((c, pa.int64()) for c in by)])


def _ddl(columns: str, by: list[str]) -> str:
    return ", ".join([columns, *(f"{c} long" for c in by)])


def _lists(column: pa.Array, lo: int, n: int) -> tuple[pa.Array, np.ndarray]:
    """The values of some rows' lists, one after another, and how many each row has (null: none)."""
    own = column.slice(lo, n)
    return own.flatten(), pa.compute.fill_null(pa.compute.list_value_length(own), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _names(batches: Iterator[pa.RecordBatch], k: int, levels: tuple[int, ...], by: list[str]) -> Iterator[pa.RecordBatch]:
    """(name, 0, key) for each name of the last level in a core of a row's windows that outlast the level before it; in the first round for all windows, and (name, check, key) for the row as a whole."""
    schema = _schema(("name", pa.int64()), ("check", pa.int32()), by=by)
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        for s in slices(batch.column("text")):
            h, owner, at = s.hashes(), s.owner(), windows(s, k)
            if not len(at):
                continue
            *before, last = cores(h, owner, at, k, levels[-2:])
            if before:
                asked, sizes = _lists(batch.column("names"), s.first, s.n)
                names, who = last.found_in(np.flatnonzero(before[0].outlast(asked.to_numpy(zero_copy_only=False).view(U), sizes)))
                yield batch_of(schema, _signed(names, np.int64), np.zeros(len(names), np.int32), *(c[s.first + who] for c in keys))
                continue
            names, who = last.found_in(np.arange(len(at)))
            whole, check = document_names(h, s)
            long = np.flatnonzero(np.diff(s.words) >= k)
            yield batch_of(
                schema,
                np.concatenate([_signed(names, np.int64), _signed(whole[long], np.int64)]),
                np.concatenate([np.zeros(len(names), np.int32), _signed(check[long], np.int32) | 1]),
                *(np.concatenate([c[s.first + who], c[s.first + long]]) for c in keys),
            )


def _windows(batches: Iterator[pa.RecordBatch], k: int, level: int, by: list[str]) -> Iterator[pa.RecordBatch]:
    """(hash, check, key) of each different window of a row whose core at this level has names only that are among the row's."""
    schema = _schema(("hash", pa.int64()), ("check", pa.int32()), by=by)
    for batch in batches:
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        for s in slices(batch.column("text")):
            h, owner, at = s.hashes(), s.owner(), windows(s, k)
            asked, sizes = _lists(batch.column("names"), s.first, s.n)
            at = at[cores(h, owner, at, k, (level,))[0].outlast(asked.to_numpy(zero_copy_only=False).view(U), sizes)]
            who = owner[at]
            code, check = window_hashes(s, h, at, k)
            first = first_met(code ^ mix((who + 1).astype(U) * _RIGHT), check)
            yield batch_of(schema, _signed(code[first], np.int64), _signed(check[first], np.int32), *(c[s.first + who[first]] for c in keys))


def _copied(h: np.ndarray, s: Slice, copies: pa.Array) -> np.ndarray:
    """Which rows of a slice bear one of the document names listed for them."""
    out, listed = np.zeros(s.n, bool), copies.to_pylist()
    if any(listed):
        name, check = document_names(h, s)
        name, check = _signed(name, np.int64).tolist(), (_signed(check, np.int32) | 1).tolist()
        for i, x in enumerate(listed):
            out[i] = any(y["name"] == name[i] and y["check"] == check[i] for y in x or ())
    return out


_OUT = "key long, n_words long, n_removed long, kept_text string"


def _kept(s: Slice, copies: pa.Array, seen: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, removed words and kept text of a slice's rows: windows go that are listed as seen in an earlier row, all of a row whose name is among its copies, or that the row itself repeats."""
    h, owner, at = s.hashes(), s.owner(), windows(s, k)
    who = owner[at]
    code, check = window_hashes(s, h, at, k)
    salt = mix(np.arange(1, s.n + 1, dtype=U) * _RIGHT)
    mine, check = code ^ salt[who], _signed(check, np.int32)
    later = ~first_met(mine, check)
    listed, sizes = _lists(seen, 0, s.n)
    if len(listed):
        hashes, checks = (listed.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        later |= among(mine, check, hashes.view(U) ^ np.repeat(salt, sizes), checks)
    later |= _copied(h, s, copies)[who]
    edge = np.zeros(len(h) + 1, np.int32)
    np.add.at(edge, at[later], 1)
    np.add.at(edge, at[later] + k, -1)
    gone = np.cumsum(edge[:-1]) > 0
    n_words, n_removed = np.diff(s.words), np.bincount(owner[gone], minlength=s.n)
    texts = []
    for i in range(s.n):
        lo, hi = s.words[i], s.words[i + 1]
        if n_removed[i] == hi - lo:
            texts.append("")
            continue
        words = s.data[s.rows[i] : s.rows[i + 1]].tobytes().split()
        if n_removed[i]:
            words = [w for w, x in zip(words, gone[lo:hi].tolist()) if not x]
        texts.append(b" ".join(words).decode())
    return n_words, n_removed, texts


def _remove(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for batch in batches:
        for s in slices(batch.column(1)):
            yield batch_of(schema, batch.column(0).slice(s.first, s.n), *_kept(s, batch.column(2).slice(s.first, s.n), batch.column(3).slice(s.first, s.n), k))


def _rewrite(batches: Iterator[pa.RecordBatch], k: int, at: int, chars: int) -> Iterator[pa.RecordBatch]:
    """The last two columns are copies and seen; the others come back, the text without what goes, rows of which nothing stays left out."""
    for batch in batches:
        schema = pa.schema(list(batch.schema)[:-2])
        copies = batch.column(batch.num_columns - 2)
        seen = batch.column(batch.num_columns - 1)
        for s in slices(batch.column(at)):
            n_words, n_removed, kept = _kept(s, copies.slice(s.first, s.n), seen.slice(s.first, s.n), k)
            columns = [batch.column(i).slice(s.first, s.n) for i in range(len(schema))]
            texts = [new if gone else old for new, gone, old in zip(kept, n_removed.tolist(), columns[at].to_pylist())]
            columns[at] = pa.array(texts, schema.field(at).type)
            if chars >= 0:
                columns[chars] = pa.array([len(t or "") for t in texts], schema.field(chars).type)
            stays = pa.array((n_removed == 0) | (n_removed < n_words))
            yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(stays)


def _told_apart(source: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows (key, text) with columns that tell rows apart, and these: keys where each is one row's, else keys and hashes of texts.

    Rows that share both are equal, and so is what is found for them.
    """
    if source.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").isEmpty():
        return source.select("key", "text"), _ONE
    return source.select("key", "text", F.xxhash64("text").alias("sub")), _SEVERAL


def repeats(source: DataFrame, by: list[str], window: int = WINDOW, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """For rows (key, text, and what else tells them apart, ``by``): copies (a row's name, if as a whole it repeats an earlier one), seen (hash and check of its windows that an earlier row has).

    What moves: in each round a name for each symbol still in question, one hash for each window
    that outlasts the rounds, and the text of rows that hear of shared names. A frequent name or
    window is one row of each document that has it; minima taken before the exchange and
    splittable joins take it. Lists are of one row's names or windows, however many rows share its key.
    """
    gathered = F.collect_list if by == _ONE else F.collect_set  # equal rows have each name several times
    with temporary(source.sparkSession) as kept:
        asking, copies = source, None
        for turn in range(len(levels)):
            names = cut(asking.mapInArrow(lambda it, turn=turn: lean(_names(it, window, levels[: turn + 1], by)), _ddl("name long, check int", by)), "names")
            shared = names.groupBy("name", "check").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("last > first").drop("last")
            met = names.join(shared, ["name", "check"])
            told = cut(met.groupBy(*by).agg(gathered(F.expr("if(check = 0, name, null)")).alias("names"), F.collect_set(F.expr("if(check <> 0 and key > first, struct(name, check), null)")).alias("copies")), "shared-names")
            forget(names)
            told_of = told.where("size(names) > 0")
            if copies is None:
                copies = told.where("size(copies) > 0").select(*by, "copies")
                told_of = told_of.where("size(copies) = 0")  # a copy has no window of its own
            asking = source.join(told_of.select(*by, "names"), by).select(*by, "text", "names")
        found = cut(asking.mapInArrow(lambda it: lean(_windows(it, window, levels[-1], by)), _ddl("hash long, check int", by)), "windows")
        first = found.groupBy("hash", "check").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("last > first")
        seen = found.join(first, ["hash", "check"]).where("key > first").groupBy(*by).agg(gathered(F.struct("hash", "check")).alias("seen"))
        marks = cut(seen.join(copies, by, "full_outer").select(*by, "copies", "seen"), "repeats")
        forget(found)
        kept.append(marks)
    return marks


def _key(key: str):
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NO_KEY))


def remove_repeats(df: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row without the words of windows that start earlier: under a smaller key, or before in the row.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space). Null
    texts count as empty. A null key sorts before all others. Rows that share a key
    are one identity: neither is earlier than the other, and each gets the removals of
    both; a row as a whole goes only if it is itself a copy. Other columns are not read; an empty table gives no rows. The text moves once
    more, to meet its marks.
    """
    source, by = _told_apart(df.select(_key(key).alias("key"), F.col(text).alias("text")))
    marked = source.join(repeats(source, by, window), by, "left").select("key", "text", "copies", "seen")
    removed = marked.mapInArrow(lambda it: lean(_remove(it, window)), _OUT)
    return removed.select(F.expr(f"nullif(key, {_NO_KEY + 1}L - 1L)").alias("doc_id"), "n_words", "n_removed", "kept_text")


def rewrite_documents(df: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id", chars: str | None = None) -> DataFrame:
    """``df`` with the removals of :func:`remove_repeats` made in its text; ``chars`` names a column of its length.

    All columns stay. A text of which nothing is removed stays as it is, one of which
    nothing is left goes with its row.
    """
    source, by = _told_apart(df.select(_key(key).alias("key"), F.col(f"`{text}`").alias("text")))
    marks = repeats(source, by, window)
    own = [f"in{i}_" for i in range(len(df.columns))]
    rows = df.toDF(*own).withColumns({"key": _key(own[df.columns.index(key)]), "sub": F.xxhash64(own[df.columns.index(text)])})
    marked = rows.join(marks, by, "left").select(*own, F.col("copies").alias("copies_"), F.col("seen").alias("seen_"))
    at, length = df.columns.index(text), df.columns.index(chars) if chars else -1
    out = marked.select(*own).schema
    return marked.mapInArrow(lambda it: lean(_rewrite(it, window, at, length)), out).toDF(*df.columns)
