"""SentencePiece BPE by prefix tables: exact encoding in one pass over a segment, and decoding.

For each prefix of a segment one token ends it in the segment's encoding of that prefix.
The table holds that token: of the vocabulary's pieces that end there (an Aho-Corasick
automaton gives them), the one that is compatible with the token before it, where a pair
is compatible if BPE leaves the two, written together, as that pair. Ids are recovered
backwards from the last entry. Segments begin at word boundaries, which no piece of the
model crosses, and are independent, so each distinct one is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batch_of, lean

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Entries of a worker's segment cache and of its pair cache; a full one is emptied, which costs time only.
CACHE = 600_000


class UnsupportedModel(ValueError):
    """A model whose pieces cross word boundaries, or that normalises text."""


class PieceEncoder:
    """Encodes as ``SentencePieceProcessor.encode`` and decodes as its ``decode``, for BPE models with byte fallback."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(size)]
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        if any(not s and SPACE in p.lstrip(SPACE) for p, s in zip(self.pieces, special)) or any(not s and p.startswith(SPACE * 2) and p.strip(SPACE) for p, s in zip(self.pieces, special)):
            raise UnsupportedModel("a piece crosses a word boundary")
        if sp.decode(sp.encode("ﬁ  x ")) != "ﬁ  x ":
            raise UnsupportedModel("the model normalises its input")
        self.score = {p: sp.get_score(i) for i, (p, s) in enumerate(zip(self.pieces, special)) if not s}
        self.ids = {p: i for i, (p, s) in enumerate(zip(self.pieces, special)) if not s}
        self.byte_id = {int(self.pieces[i][1:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.mark_sizes = sorted((len(p) for p in self.ids if not p.strip(SPACE)), reverse=True)
        #: Characters that some piece has side by side; between any others a text falls into independent segments.
        self.joined = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.length = [len(p) for p in self.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.merged(p) == [p]:  # others BPE never makes
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.segments: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE by repeated best merge, leftmost first among equals; for strings of one or two pieces."""
        parts, score = list(text), self.score.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        pieces = [self.pieces[left], self.pieces[right]]
        found = self.pairs[left << 20 | right] = self.merged(pieces[0] + pieces[1]) == pieces
        return found

    def last_tokens(self, text: str) -> list[int]:
        """The prefix table: entry i is the last token of the encoding of text[:i + 1], -1 a character that falls back to bytes."""
        table: list[int] = []
        have, length, known = 0, self.length, self.pairs.get
        for end, token in self.automaton.iter(text):  # by end, the longest first
            if end < have:
                continue
            while have < end:
                table.append(-1)
                have += 1
            before = end - length[token]
            if before >= 0 and (left := table[before]) >= 0:
                fits = known(left << 20 | token)
                if fits is None:
                    fits = self.compatible(left, token)
                if not fits:
                    continue
            table.append(token)
            have += 1
        return table + [-1] * (len(text) - have)

    def spaces(self, n: int) -> list[str]:
        """Marks alone: the longest piece of marks that fits, again and again."""
        out = []
        while n:
            size = next(k for k in self.mark_sizes if k <= n)
            out.append(SPACE * size)
            n -= size
        return out

    def tokens(self, segment: str) -> list[int]:
        """The ids of a segment: marks, then characters other than marks."""
        body = segment.lstrip(SPACE)
        marks = len(segment) - len(body)
        if not body:
            return [self.ids[p] for p in self.spaces(marks)]
        text = SPACE * (marks > 0) + body
        table, out, at = self.last_tokens(text), [], len(text)
        while at:
            token = table[at - 1]
            if token < 0:
                at -= 1
                out += [self.byte_id[b] for b in reversed(text[at].encode())]
            else:
                at -= self.length[token]
                out.append(token)
        out.reverse()
        if marks > 1:  # marks merge among themselves after all other merges
            alone = out[0] == self.ids[SPACE]
            out = [self.ids[p] for p in self.spaces(marks if alone else marks - 1)] + out[alone:]
        return out

    def decode_ids(self, ids: list[int]) -> str:
        """Pieces joined, byte runs as UTF-8, marks as spaces; the mark put before a text is the caller's to drop."""
        if any(i in self.byte_of for i in ids):
            out = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids).decode("utf-8", "replace")
        else:
            out = "".join([self.pieces[i] for i in ids])
        return out.replace(SPACE, " ")

    def segment(self, segment: str, key: str) -> tuple[str, str]:
        """Ids of a segment as decimal text, and their decoding; remembered under ``key``."""
        ids = self.tokens(segment)
        found = (",".join(map(str, ids)), self.decode_ids(ids))
        if len(segment) <= 64:
            if len(self.segments) >= CACHE:
                self.segments.clear()
            self.segments[key] = found
        return found

    def word(self, word: str) -> tuple[str, str]:
        """Ids and decoding of what stands between two spaces; a mark goes before it unless it begins with a line feed.

        A last mark of punctuation that no piece joins to what is before it is looked up by itself.
        """
        full = word if word[0] == "\n" else SPACE + word
        if len(word) > 1 and not word[-1].isalnum() and word[-1] != SPACE and full[-2:] not in self.joined:
            stem = self.segments.get(word[:-1]) or self.segment(full[:-1], word[:-1])
            tail = self.segments.get("\0" + word[-1]) or self.segment(word[-1], "\0" + word[-1])
            return stem[0] + "," + tail[0], stem[1] + tail[1]
        return self.segment(full, word)

    def words(self, text: str) -> list[str] | None:
        """What stands between single spaces, line feeds (no part of a longer piece) beginning words of their own; None if marks or spaces meet."""
        if not text or SPACE in text or "  " in text or text[0] in " \n" or text[-1] == " " or " \n" in text or "\0" in text or "\n" in self.ids:
            return None
        return text.replace("\n", " \n").split(" ")

    def parts(self, text: str) -> list[tuple[str, str]]:
        """Ids and decoding of the text's segments, in order, with the mark that the model puts before a text."""
        words = self.words(text)
        if words is None:
            return [self.segment(s, "\0" + s) for s in _SEGMENT.findall(SPACE + text.replace(" ", SPACE))] if text else []
        found = list(map(self.segments.get, words))
        if None in found:
            found = [self.word(w) if f is None else f for w, f in zip(words, found)]
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return self.decode_ids(ids).removeprefix(" ")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


_OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encode(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    model = encoder(path)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part, out = batch.slice(lo, 500), []
            for text in part.column(1):
                parts = model.parts(text.as_py() or "")
                ids = ",".join([p[0] for p in parts])
                decoded = "".join([p[1] for p in parts])[1:]
                row = (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append(row + ([int(i) for i in ids.split(",") if i], decoded) * with_ids)
            yield batch_of(schema, part.column(0), *(list(c) for c in zip(*out)))


def encode_pieces(df: DataFrame, model: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Ids of each row's text and their decoding, as digests and, with ``with_ids``, in full.

    Returns doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256
    and, if asked for, ids and decoded. Null and empty texts have no ids and decode to the
    empty text. One row out for each row in, null and repeated keys and equal rows too; texts of any
    length are taken whole, other columns are not read, and an empty table gives no rows. ``model``
    is a path that every executor can open.
    """
    out = _OUT + ", ids array<int>, decoded string" * with_ids
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: lean(_encode(it, model, with_ids)), out)
