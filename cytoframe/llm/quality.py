"""Quality rules, line first: failing lines go, then documents that lost too much of their text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Slice, batch_of, lean, mix, rolling, slices, windows

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30


@dataclass(frozen=True)
class Rules:
    """Thresholds of the line rules. Lines of fewer than ``short`` words are judged by boilerplate and navigation alone."""

    short: int = 5
    #: Navigation: this share of a line's words are separators.
    separators: tuple[str, ...] = ("|", "»", "›", ">", "•", "·", "::", "/")
    max_separators: float = 0.2
    #: Punctuation: this share of words end in two or more marks, or carry no letter or digit at their end but a symbol.
    max_marked: float = 0.5
    #: An unfinished line (no ending punctuation) this long is a list or a menu, not prose.
    max_unfinished: int = 12
    endings: str = ".!?…\"'”’»)]:;"
    #: Repetition: this share of words equal the word before.
    max_stutter: float = 0.4
    #: Boilerplate: phrases of English, German, French and Spanish, lower case.
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled", "licensed under", "lorem ipsum",
        "privacy policy", "released under the", "subscribe to our newsletter", "terms of service", "terms of use", "this work is licensed",
        "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "datenschutzerklärung", "javascript aktivieren", "javascript ist deaktiviert",
        "newsletter abonnieren", "nutzungsbedingungen", "diese website verwendet cookies",
        "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "activer javascript",
        "javascript est désactivé", "abonnez-vous à notre newsletter", "ce site utilise des cookies",
        "todos los derechos reservados", "política de privacidad", "condiciones de uso", "aviso legal", "habilitar javascript",
        "javascript está desactivado", "suscríbete a nuestro boletín", "este sitio utiliza cookies",
    )
    #: A document goes if its failing lines hold more than this share of its words.
    max_lost: float = 0.5
    marks: str = field(default="#*$%&|<>!?~^=+_{}\\", repr=False)


def line_failure(line: str, rules: Rules) -> str | None:
    """The rule that a line with words fails, or None."""
    words = [w for w in line.encode().split()]
    n = len(words)
    low = line.lower()
    if any(p in low for p in rules.boilerplate):
        return "boilerplate"
    if sum(w.decode() in rules.separators for w in words) > rules.max_separators * n:
        return "navigation"
    if n < rules.short:
        return None
    marks = rules.marks.encode()
    if sum(len(w) > 2 and w[-1] in marks and w[-2] in marks for w in words) > rules.max_marked * n:
        return "punctuation"
    if sum(a == b for a, b in zip(words, words[1:])) > rules.max_stutter * n:
        return "repetition"
    if n > rules.max_unfinished and line.rstrip(SPACES)[-1] not in rules.endings and not any(w[-1:] in b".!?" for w in words):
        return "punctuation"
    return None


#: Lines learned as boilerplate are at most this many: each has its share of all (document, line) pairs.
MAX_LEARNED = 65_536


def frequent_lines(df: DataFrame, text: str = "text", least: int = 20, share: float = 0.001, top: float = 0.1) -> DataFrame:
    """(line_hash, documents, bodies, most): lines that documents with different bodies share, as boilerplate is shared.

    A document's body is its longest line, by hash. Copies and near copies of a document share it, so a line is counted by the
    different bodies it stands beside: ``bodies`` of them, in ``documents`` documents, ``most`` beside one. It is frequent with
    ``least`` bodies or more, at least ``share`` of the documents and a 65,536th of all pairs of a document and a line of
    it, while no body has more than ``top`` of its documents. A line that is its documents' longest is never frequent. A hot line is counted in
    parts, by body, before its parts meet. Lines are trimmed of white space and hashed by XXH64; blank lines, null and empty
    texts have no part. A row counts once for each of its different lines; rows of one id, or of null ids, are documents of
    their own. No row is capped or sampled. An empty table gives no rows.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")
    hashed = df.select(F.transform(lines, lambda x: F.struct(F.length(x).alias("chars"), F.xxhash64(x).alias("hash"))).alias("lines"))
    different = F.array_distinct("lines.hash")
    sizes = hashed.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("lines").isNotNull(), F.size(different))).alias("pairs")).first()
    enough = max(least, share * sizes["rows"], (sizes["pairs"] or 0) / MAX_LEARNED)
    # The body comes in a step of its own: beside the explode it would be found again for each line. An outer explode, as
    # for another one Spark filters by the list's size first, for which each text is split once more.
    worded = hashed.select(F.array_max("lines").getField("hash").alias("body"), different.alias("hashes"))
    pairs = worded.select("body", F.explode_outer("hashes").alias("line_hash")).where("line_hash IS NOT NULL")
    parts = pairs.groupBy("line_hash", "body").agg(F.count(F.lit(1)).alias("n"))
    counted = parts.groupBy("line_hash").agg(F.sum("n").alias("documents"), F.count(F.lit(1)).alias("bodies"), F.max("n").alias("most"))
    return counted.where((F.col("bodies") >= enough) & (F.col("most") <= top * F.col("documents")))


def learned_lines(df: DataFrame, text: str = "text", **limits: float) -> frozenset[int]:
    """The hashes of :func:`frequent_lines`, 65,536 at most, for :func:`judge`."""
    return frozenset(r["line_hash"] for r in frequent_lines(df, text, **limits).select("line_hash").toLocalIterator())


def _line_hash(line: str) -> int:
    """As Spark's xxhash64 of the trimmed line."""
    h = xxhash.xxh64_intdigest(line.strip(SPACES).encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def repeated_words(s: Slice, window: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of ``window`` words found twice or more in that row."""
    at = windows(s, window)
    owner = s.owner()
    code = mix(rolling(s.hashes(), window)[at] + mix(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(s.starts) + 1, np.int32)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    return np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=s.n)


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lost_words long, n_lost_lines long, clean_text string"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lost_words", pa.int64()), ("n_lost_lines", pa.int64()), ("clean_text", pa.string())])


def _judge(batches: Iterator[pa.RecordBatch], rules: Rules, learned: frozenset[int] = frozenset()) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        for s in slices(texts):
            repeated, counts = repeated_words(s), np.diff(s.words)
            out = []
            for i in range(s.n):
                text = s.data[s.rows[i] : s.rows[i + 1]].tobytes().decode()
                n, again = int(counts[i]), int(repeated[i])
                lines = text.split("\n")
                worded = [x for x in lines if x.strip(SPACES)]
                lost = lost_lines = 0
                clean = text
                failing = {x for x in set(worded) if line_failure(x, rules) or (learned and _line_hash(x) in learned)}
                if failing:
                    gone = [x for x in worded if x in failing]
                    lost, lost_lines = sum(len(x.encode().split()) for x in gone), len(gone)
                    clean = "\n".join(x for x in lines if x not in failing)
                failed = n < MIN_WORDS or 100 * again > MAX_REPEATED_PERCENT * n
                kept = not failed and lost <= rules.max_lost * n
                out.append((n, len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(worded) - len(set(worded)), again, failed, kept, lost, lost_lines, clean))
            yield batch_of(_SCHEMA, batch.column(0).slice(s.first, s.n), *(list(c) for c in zip(*out)))


def judge(df: DataFrame, rules: Rules = Rules(), text: str = "text", key: str = "doc_id", learned: frozenset[int] = frozenset()) -> DataFrame:
    """Base counts, the verdict and the text without its failing lines, for each row.

    ``learned`` are hashes of lines that fail as boilerplate besides those with a phrase of ``rules``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, n_lost_words, n_lost_lines, clean_text (an untouched text comes
    back unchanged). Null and empty texts: no words, so base_failed. One row out for
    each row in, null and repeated keys too; texts of any length are judged whole, other columns
    are not read, and an empty table gives no rows. Nothing is shuffled.
    """
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda it: lean(_judge(it, rules, learned)), _OUT)


def _clean(batches: Iterator[pa.RecordBatch], rules: Rules, learned: frozenset[int], at: int, chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inner = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
        judged = pa.Table.from_batches(_judge(iter([inner]), rules, learned), _SCHEMA)
        text = judged["clean_text"].combine_chunks().cast(batch.schema.field(at).type)
        columns = list(batch.columns)
        columns[at] = text
        if chars >= 0:
            columns[chars] = pa.compute.utf8_length(text).cast(batch.schema.field(chars).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(judged["kept"].combine_chunks())


def clean_documents(df: DataFrame, rules: Rules = Rules(), text: str = "text", chars: str | None = None, learned: frozenset[int] = frozenset()) -> DataFrame:
    """The rows of ``df`` that pass :func:`judge`, with their text cleaned; ``chars`` names a column of its length.

    All columns stay; a row with a null text goes, having no words. Nothing is shuffled.
    """
    at, length = df.columns.index(text), df.columns.index(chars) if chars else -1
    return df.mapInArrow(lambda it: lean(_clean(it, rules, learned, at, length)), df.schema)
