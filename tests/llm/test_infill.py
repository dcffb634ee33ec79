"""Fill-in-the-middle against a plain form; the automaton scan against Python's own searches."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoframe.llm import infill

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def plain(key, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = UNITS.findall(text)
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in infill.SENTINELS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made():
    rng = random.Random(3)
    out = [None, "", "\n", "\n\n\n", "one line", "one\n", "a<P>b\nc", "<S", "x<M>", "<<S>>\n", "<P\n>", "é\nü\r\n€\n", "no end\nhere", "<\nP>\n<", "S>\n<S"]
    for _ in range(60):
        out.append("".join(rng.choice(["\n", "a", "bc ", "é", "漢", "<", "P", ">", "S", "🙂"]) for _ in range(rng.randrange(400))))
    out.append("".join(f"line {k} é{'x' * (k % 90)}\n" for k in range(4000)))
    out.append("漢" * 50_000)
    return out


def test_equals_the_plain_form_however_texts_are_cut(spark):
    """Null and repeated ids, equal rows, clashing columns; all texts scanned where they are, or in chunks that split characters."""
    rows = [(None if k % 9 == 4 else k // 2, t, 1, "f", "g", 2, "o") for k, t in enumerate(made())]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, form string, found string, row int, output string").repartition(3)
    want = sorted(map(repr, ((r[0], *plain(r[0], r[1])) for r in rows)))
    for giant, chunk in ((infill.GIANT, infill.CHUNK), (40, 7), (-1, 600)):
        out = infill.fill_in_middle(df, giant=giant, chunk=chunk)
        assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        assert sorted(repr(tuple(r)) for r in out.collect()) == want
    back = infill.fill_in_middle(df).select("doc_id", infill.restored(F.col("output"), F.col("form")).alias("t"))
    assert sorted(map(repr, ((r.doc_id, r.t) for r in back.collect()))) == sorted(map(repr, ((r[0], r[1] or "") for r in rows)))


def test_rates_and_units(spark):
    rows = [(k, f"some text {k}\nand more\n") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = infill.fill_in_middle(df, rate=40, spm=90, seed=11)
    assert {(r.doc_id, *tuple(r)[1:]) for r in out.collect()} == {(k, *plain(k, t, 40, 90, 11)) for k, t in rows}
    assert 0 < out.where("form <> 'plain'").count() < 200
    # Code points as units: cuts fall anywhere.
    assert infill.fill_in_middle(df, units=infill.CHARACTERS).where("n <> length(output) - 9 or prefix_chars + middle_chars > n").isEmpty()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(df).collect() == []


@given(st.lists(st.text(alphabet="ab\n<PSM>é", max_size=60), min_size=1, max_size=6), st.integers(1, 9), st.data())
@settings(max_examples=120, deadline=None)
def test_lanes_compose_to_whole_texts(texts, size, data):
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    before, infill.LANE = infill.LANE, size
    try:
        infill.lanes.__defaults__ = (size,)
        scan = infill.Scan(np.frombuffer(b"".join(raw), np.uint8), at, infill.LINES, infill.finder(infill.SENTINELS))
        units = [UNITS.findall(t) for t in texts]
        (_, n), (_, chars), (_, marked) = ((e[:, 0], c[:, 0]) for e, c in scan.whole())
        assert n.tolist() == [len(u) for u in units] and chars.tolist() == [len(t) for t in texts]
        assert (marked > 0).tolist() == [any(m in t for m in infill.SENTINELS) for t in texts]
        cut = [data.draw(st.integers(0, len(u))) for u in units]
        assert scan.positions(np.array(cut)).tolist() == [len("".join(u[:k])) for u, k in zip(units, cut)]
    finally:
        infill.LANE, infill.lanes.__defaults__ = before, (before,)


def test_counts_depend_on_the_entry_state():
    """A chunk that begins inside a line has one line fewer than one that begins a line."""
    data = np.frombuffer(b"ab\ncd", np.uint8)
    exits, counts = infill.lane_functions(data, np.array([0, 3]), np.array([3, 5]), infill.LINES)
    assert exits.tolist() == [[0, 0], [1, 1]] and counts.tolist() == [[1, 0], [1, 0]]
