"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read in windows of WIDTH bytes. In each, one recurrent layer runs forward and one
backward from a zero state; at every byte both states give probabilities of the languages.
A document's probabilities are the mean over all its bytes. The network is trained here,
by backpropagation through time and Adam, on a bounded sample of labelled windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import batch_of, lean, text_buffers

WIDTH = 128
HIDDEN = 8
UNDETERMINED = "und"


@dataclass(frozen=True)
class Sample:
    """Bounds of what training sees, whatever the corpus: the bound is languages * documents * windows."""

    documents: int = 512
    windows: int = 4
    width: int = 64
    languages: int = 128


@dataclass(frozen=True)
class Training:
    updates: int = 400
    batch: int = 192
    rate: float = 0.02
    seed: int = 7


class Network:
    """Weights, with axis 0 the direction: bytes to gates, states to gates, biases are in the byte tables."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n = len(languages)
        self.languages = languages
        self.w = {
            "bytes": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            "state": (rng.normal(0, 1, (2, hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32),
            "out": (rng.normal(0, 1, (2, hidden, n)) / np.sqrt(2 * hidden)).astype(np.float32),
            "bias": np.zeros(n, np.float32),
        }

    def _states(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (2, T, B, H) for bytes (T, B), the backward ones in reading order; what backpropagation needs."""
        t, b = x.shape
        table, state = self.w["bytes"], self.w["state"]
        h3 = state.shape[2]
        h1 = h3 // 3
        out = np.empty((2, t, b, h1), np.float32)
        h = np.zeros((2, b, h1), np.float32)
        trace = []
        for k in range(t):
            g = np.stack([table[0].take(x[k], axis=0), table[1].take(x[t - 1 - k], axis=0)])
            u = np.matmul(h, state)
            zr = g[:, :, : 2 * h1]
            zr += u[:, :, : 2 * h1]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:, :, :h1], zr[:, :, h1:]
            un = u[:, :, 2 * h1 :]
            new = r * un
            new += g[:, :, 2 * h1 :]
            np.tanh(new, out=new)
            if keep:
                trace.append((h, z, r, un, new))
            h = new + z * (h - new)
            out[0, k] = h[0]
            out[1, t - 1 - k] = h[1]
        return out, trace

    def _probabilities(self, states: np.ndarray) -> np.ndarray:
        """(T, B, languages)"""
        y = states[0] @ self.w["out"][0]
        y += states[1] @ self.w["out"][1]
        y += self.w["bias"]
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, languages) at every byte of windows (T, B)."""
        return self._probabilities(self._states(x, False)[0])

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes in ``mask`` (T, B) and its gradients."""
        t, b = x.shape
        states, trace = self._states(x, True)
        p = self._probabilities(states)
        weight = (mask / max(1, mask.sum())).astype(np.float32)
        at = np.arange(b)
        loss = float(-(np.log(p[:, at, label] + 1e-9) * weight).sum())
        dy = p
        dy[:, at, label] -= 1
        dy *= weight[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["bias"] = dy.sum((0, 1))
        for d in (0, 1):
            grad["out"][d] = np.tensordot(states[d], dy, ((0, 1), (0, 1)))
        dh_out = np.stack([dy @ self.w["out"][0].T, dy @ self.w["out"][1].T])
        state = self.w["state"]
        h1 = state.shape[1]
        dh = np.zeros((2, b, h1), np.float32)
        for k in range(t - 1, -1, -1):
            h, z, r, un, new = trace[k]
            dh = dh + np.stack([dh_out[0, k], dh_out[1, t - 1 - k]])
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            du = np.concatenate([dz, dr, dn * r], 2)
            dg = np.concatenate([dz, dr, dn], 2)
            grad["state"] += np.matmul(h.transpose(0, 2, 1), du)
            for d, row in ((0, x[k]), (1, x[t - 1 - k])):
                np.add.at(grad["bytes"][d], row, dg[d])
            dh = dh * z + np.matmul(du, state.transpose(0, 2, 1))
        return loss, grad


def train(texts: list[bytes], labels: list[str], training: Training = Training(), width: int = 64, hidden: int = HIDDEN) -> Network:
    """Fit a network to labelled windows (longer ones are cut to ``width`` bytes)."""
    languages = sorted(set(labels))
    net = Network(languages, hidden, training.seed)
    rng = np.random.default_rng(training.seed)
    x = np.zeros((width, len(texts)), np.uint8)
    size = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        t = t[:width]
        x[: len(t), i], size[i] = np.frombuffer(t, np.uint8), len(t)
    mask = np.arange(width)[:, None] < size
    label = np.array([languages.index(v) for v in labels], np.int64)
    mean, square, order = {}, {}, np.zeros(0, np.int64)
    for step in range(1, training.updates + 1):
        if len(order) < min(training.batch, len(texts)):
            order = np.concatenate([order, rng.permutation(len(texts))])
        own, order = order[: training.batch], order[training.batch :]
        _, grad = net.gradients(x[:, own], mask[:, own], label[own])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = training.rate * (1 - (step - 1) / training.updates)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
            square[k] = 0.999 * square.get(k, 0) + 0.001 * g * g
            net.w[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: str = "doc_id"):
    """True where crc32 of the id as text is 2 modulo 4; rows without an id are held out, too."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(True))


def labelled_windows(df: DataFrame, sample: Sample, text: str = "text", label: str = "lang", key: str = "doc_id") -> list[tuple[str, str]]:
    """(language, window) of a sample spread over the rows that may be learned from.

    For each language and each of ``sample.documents`` hash buckets one document, found by
    maxima that are taken before the exchange; of it, windows at hashed places. The
    driver gets at most languages * documents * windows short strings; of more languages
    than ``sample.languages`` the most frequent ones are learned.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(text).alias("text")).where(~held_out("key") & F.col("label").isNotNull())
    languages = [r["label"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(sample.languages).collect()]
    rank = F.xxhash64("key", F.lit(11))
    chosen = rows.where(F.col("label").isin(languages)).groupBy("label", F.pmod(F.xxhash64("key"), F.lit(sample.documents)).alias("salt")).agg(F.max_by("key", rank).alias("key"))
    # Bounded: one key for each language and bucket.
    found = rows.join(F.broadcast(chosen.select("label", "key")), ["label", "key"]).where("length(text) > 0")
    places = F.array(*(F.expr(f"substring(text, 1 + cast(pmod(xxhash64(key, {w}), greatest(1, length(text) - {sample.width})) as int), {sample.width})") for w in range(sample.windows)))
    return sorted((r["label"], r["window"]) for r in found.select("label", F.explode(places).alias("window")).collect())


_OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
#: Bytes read together; bounds a worker's arrays.
_GROUP = 1 << 17


def _has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode()))


def _identify(batches: Iterator[pa.RecordBatch], net: Network | None, spans: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_SCHEMA, ("spans", pa.list_(_SPAN))]) if spans else _SCHEMA
    for batch in batches:
        raw, at = text_buffers(batch.column(2))
        n = len(at) - 1
        scores = np.zeros((n, len(net.languages) if net else 1))
        found: list[list[dict]] = [[] for _ in range(n)]
        # Windows of all rows of the batch, a group at a time.
        count = -(-np.diff(at) // WIDTH)
        owner = np.repeat(np.arange(n), count)
        begin = at[owner] + WIDTH * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
        size = np.minimum(WIDTH, at[owner + 1] - begin)
        for lo in range(0, len(owner) if net else 0, _GROUP // WIDTH):
            own, b, s = (v[lo : lo + _GROUP // WIDTH] for v in (owner, begin, size))
            place = b + np.arange(WIDTH)[:, None]
            mask = np.arange(WIDTH)[:, None] < s
            x = np.where(mask, raw[np.minimum(place, len(raw) - 1)], 0).astype(np.uint8)
            p = net.predict(x)
            np.add.at(scores, own, np.einsum("tbk,tb->bk", p, mask.astype(np.float32)))
            if spans:
                best = p.argmax(2)
                for i in range(len(own)):
                    line, start = best[: s[i], i], int(b[i] - at[own[i]])
                    for q in np.split(np.arange(len(line)), np.flatnonzero(np.diff(line)) + 1):
                        tag = net.languages[line[q[0]]]
                        last = found[own[i]][-1] if found[own[i]] else None
                        if last and last["lang"] == tag:
                            last["end"] = start + int(q[-1]) + 1
                        else:
                            found[own[i]].append({"start": start + int(q[0]), "end": start + int(q[-1]) + 1, "lang": tag})
        total = scores.sum(1)
        best = scores.argmax(1)
        lettered = [total[i] > 0 and _has_letter(raw[at[i] : at[i + 1]].tobytes()) for i in range(n)]
        names = [net.languages[best[i]] if lettered[i] else UNDETERMINED for i in range(n)]
        score = [float(min(1.0, scores[i, best[i]] / total[i])) if lettered[i] else 0.0 for i in range(n)]
        extra = [[f if ok else [] for f, ok in zip(found, lettered)]] if spans else []
        yield batch_of(schema, batch.column(0), batch.column(1), names, score, *extra)


def identify(df: DataFrame, sample: Sample = Sample(), training: Training = Training(), text: str = "text", label: str = "lang", key: str = "doc_id", spans: bool = False) -> DataFrame:
    """Train on the rows that are not held out, and predict the language of every row from its text alone.

    Returns doc_id, held_out, lang_pred (a learned label), score (its mean probability over
    the text's bytes) and, with ``spans``, the labels of all positions as byte spans. Null
    texts and texts without a letter, or all rows if there is nothing to learn from, are
    ``und`` with score 0. Null labels are not learned. One row out for each row in;
    rows with null or repeated keys are rows of their own (one without a key is held out), texts of
    any length are read whole, other columns are not read, and an empty table gives no rows.
    """
    windows = labelled_windows(df, sample, text, label, key)
    net = train([w.encode() for _, w in windows], [v for v, _ in windows], training, sample.width) if windows else None
    out = _OUT + ", spans array<struct<start: long, end: long, lang: string>>" * spans
    rows = df.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: lean(_identify(it, net, spans)), out)
