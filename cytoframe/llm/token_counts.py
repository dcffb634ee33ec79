"""Token counts of a document's fields and sections, from one encoding of the whole document.

Fields are written one after another with a separator; the document is encoded once, as a
model would see it. Tokens are byte strings, so running sums of their lengths map each to
its span. An interval join of token spans with section spans then attributes tokens. A
token that crosses section boundaries goes to one section by the rule named.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batch_of

RULES = ("majority", "first", "last")


class ByteEncoder:
    """A byte-level BPE from a file of ranks, with the length in bytes of each token."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte at which each token of the text ends."""
        return np.cumsum(self.sizes[self.encoding.encode_to_numpy(text, disallowed_special=())])


@lru_cache(maxsize=2)
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to, and crossing tokens that touch, each section.

    ``ends``: where tokens end; ``starts``: where sections start, the first at 0, not decreasing;
    a section reaches to the next one's start. ``majority``: the section with most of the
    token's bytes, the earliest among equals. ``first``, ``last``: the first, last section it
    touches. Sections without bytes get nothing.
    """
    given = np.zeros(len(starts), np.int64)
    touched = np.zeros(len(starts), np.int64)
    if not len(ends):
        return given, touched
    begin = np.concatenate([[0], ends[:-1]])
    # The last section that starts at or before a byte is the one that holds it.
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    to = last.copy() if rule == "last" else first.copy()
    # A row for each section that a crossing token reaches into, in order.
    crossing = np.flatnonzero(first != last)
    reach = last[crossing] - first[crossing] + 1
    token = np.repeat(crossing, reach)
    held = first[token] + np.arange(len(token)) - np.repeat(np.cumsum(reach) - reach, reach)
    upper = np.append(starts, ends[-1])[held + 1]
    size = np.minimum(upper, ends[token]) - np.maximum(starts[held], begin[token])
    np.add.at(touched, held[size > 0], 1)
    if rule == "majority":
        best = np.lexsort((held, -size, token))
        head = np.concatenate([[True], token[best][1:] != token[best][:-1]])[: len(best)]
        to[token[best][head]] = held[best][head]
    np.add.at(given, to, 1)
    return given, touched


_OUT = "doc_id long, field string, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), *((c, pa.int64()) for c in ("char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"))])


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str, fields: tuple[str, ...], separator: str, rule: str) -> Iterator[pa.RecordBatch]:
    model = byte_encoder(path, pattern)
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part, out = batch.slice(lo, 200), []
            for key, *values in zip(*(c.to_pylist() for c in part.columns)):
                text = separator.join(v or "" for v in values)
                raw = np.frombuffer(text.encode(), np.uint8)
                chars = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
                starts, names, at = [], [], 0
                for name, value in zip(fields, values):
                    field_bytes = (value or "").encode()
                    breaks = np.flatnonzero(np.frombuffer(field_bytes, np.uint8) == 10) + 1
                    breaks = breaks[breaks < len(field_bytes)]
                    starts += [at, *(at + breaks).tolist()]
                    names += [(name, k) for k in range(len(breaks) + 1)]
                    at += len(field_bytes) + len(separator.encode())
                begin = np.array(starts, np.int64)
                ends = model.ends(text)
                given, touched = attribute(ends, begin, rule)
                places = chars[np.append(begin, len(raw))].tolist()
                out += [(key, *name, places[k], places[k + 1], g, t, len(ends)) for k, (name, g, t) in enumerate(zip(names, given.tolist(), touched.tolist()))]
            yield batch_of(_SCHEMA, *(list(c) for c in zip(*out)))


def section_token_counts(df: DataFrame, ranks: str, pattern: str, fields: tuple[str, ...] = ("text",), separator: str = "\n", rule: str = "majority", key: str = "doc_id") -> DataFrame:
    """A row for each section of each field: its span in characters and its tokens.

    A section is a line with its line feed (a field's last line with the separator after
    it), so sections cover the document and their n_tokens add up to doc_tokens. n_crossing
    counts tokens that touch the section and another. Null and empty fields are one empty
    section, without tokens. Repeated and null keys each keep their rows; other columns
    are not read, a document of any length is encoded as a whole, and an empty table gives no rows. Nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(key).cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f"field_{i}") for i, f in enumerate(fields))]
    return df.select(*columns).mapInArrow(lambda it: _count(it, ranks, pattern, tuple(fields), separator, rule), _OUT)
