"""Secret scans: patterns, and a battery of randomness tests, in DataFrame functions only.

Candidates of the battery are long runs of encoding characters. Each run's encoding is
inferred (the smallest alphabet that holds its characters) and three tests are made of it,
each against two hypotheses.

Random: chi-squared for uniform use of the alphabet, the runs test about its middle, and
serial correlation. A run that one of them rejects is not random.

Written language: chi-squared of the shares of vowels, common and other consonants (the
language's own shares are counted over all texts of the table), runs of letters and
digits, and serial correlation of vowels. The three p-values, combined by Fisher's method,
say how well language explains the run, given its length. Over all runs of the table in a
band of lengths, Benjamini-Hochberg on them bounds the share of language among discoveries.

Discoveries that are random are added to the spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the base kinds are, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
# A run of these characters from its first place on fails or passes as a whole, so a least length in the pattern drops what a check afterwards would.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

RUN = "[A-Za-z0-9+/_=-]{20,}"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Alphabets, the first that a run matches is its own. Marks that pad, and those between the groups of a UUID, are not read.
ENCODINGS = (
    ("^[0-9]+$", _DIGITS),
    ("^[0-9a-f]+$|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", "0123456789abcdef"),
    ("^[0-9A-F]+$|^[0-9A-F]{8}(-[0-9A-F]{4}){3}-[0-9A-F]{12}$", "0123456789ABCDEF"),
    ("^[a-z]+$", _LOWER),
    ("^[A-Z]+$", _UPPER),
    ("^[A-Za-z]+$", _UPPER + _LOWER),
    ("^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("^[a-z0-9]+$", _LOWER + _DIGITS),
    ("^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    (".", _UPPER + _LOWER + _DIGITS + "-_"),
)
VOWELS, COMMON, OTHERS = "aeiou", "cdhlnrst", "bfgjkmpqvwxyz"
#: Spans that a running sum appends to one array, and code points of a piece of text that is cut by position.
BLOCK, PIECE = 256, 4096


@dataclass(frozen=True)
class Battery:
    #: Share of language among discoveries.
    fdr: float = 0.01
    #: A test rejects randomness below this.
    reject: float = 0.001
    #: Shares of vowels, common and other consonants in language, which count as much as ``prior`` letters of the table; the last at least.
    shares: tuple[float, float, float] = (0.40, 0.43, 0.17)
    prior: int = 10_000
    #: By how much shares in language vary more than independent letters would.
    dispersion: float = 1.3
    #: In language, changes between letters and digits per pair of neighbours, at most.
    changes: float = 0.08
    #: In language, pairs of neighbouring letters that are both vowels or both not, at most.
    alike: float = 0.45
    #: Symbols that a run must have.
    symbols: int = 10


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to the value of an expression, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _tail(z: str) -> str:
    """P(Z > z) of the normal distribution, by Abramowitz and Stegun 26.2.17."""
    poly = "t * (0.319381530D + t * (-0.356563782D + t * (1.781477937D + t * (-1.821255978D + t * 1.330274429D))))"
    upper = _let("1D / (1D + 0.2316419D * abs(zz))", "t", f"0.3989422804014327D * exp(-zz * zz / 2D) * {poly}")
    return _let(f"cast({z} as double)", "zz", f"if(zz >= 0D, {upper}, 1D - {upper})")


def _excess(count: str, of: str, share: float) -> str:
    """Chernoff's bound of the probability that ``count`` or more of ``of`` events with this probability occur."""
    least = f"x * ln(x / (m * {share}D)) + if(x < m, (m - x) * ln((m - x) / (m * {1 - share}D)), 0D)"
    return _let(f"cast({of} as double)", "m", _let(f"cast({count} as double)", "x", f"if(x <= m * {share}D, 1D, exp(-({least})))"))


def _unlike_language(run: str, battery: Battery) -> str:
    """How well language explains a run: Fisher's combination of three p-values."""
    v, c, o = battery.shares
    terms = " + ".join(f"pow({count} - n * {p}D, 2) / (n * {p}D)" for count, p in (("a", v), ("b", c), ("(n - a - b)", o)))
    # Three shares have two degrees of freedom, where the tail of chi-squared is exp(-x / 2).
    shares = _let("cast(length(low) as double)", "n", _let(f"cast(regexp_count(low, '[{VOWELS}]') as double)", "a", _let(f"cast(regexp_count(low, '[{COMMON}]') as double)", "b", f"if(n - a - b <= n * {o}D, 1D, exp(-({terms}) / {2 * battery.dispersion}D))")))
    alike = _excess(f"length(low) - regexp_count(low, '[{VOWELS}]+|[^{VOWELS}]+')", "greatest(1, length(low) - 1)", battery.alike)
    of_letters = _let(f"lower(regexp_replace({run}, '[^A-Za-z]', ''))", "low", f"if(low = '', 1D, greatest(1e-150D, {shares}) * greatest(1e-150D, {alike}))")
    of_runs = _let(f"regexp_replace({run}, '[^A-Za-z0-9]', '')", "an", f"if(an = '', 1D, {_excess("regexp_count(an, '[A-Za-z]+|[0-9]+') - 1", 'greatest(1, length(an) - 1)', battery.changes)})")
    # The tail of chi-squared at -2 ln of the product, with two degrees of freedom for each test; a run of letters alone has no third one.
    return _let(f"-ln({of_letters}) - ln(greatest(1e-300D, {of_runs}))", "y", f"exp(-y) * (1D + y + if({run} rlike '^[A-Za-z]+$', 0D, y * y / 2D))")


def _measured(run: str, battery: Battery) -> str:
    """Struct of the run's length band, the level of its p-value as language (-10 log10, whole) and whether it is random."""
    alphabet = "case " + " ".join(f"when {run} rlike '{pattern}' then '{letters}'" for pattern, letters in ENCODINGS) + " end"
    numbers = f"filter(transform(filter(split({run}, ''), ch -> ch <> ''), ch -> instr(al, ch) - 1), x -> x >= 0)"
    # Bins with five expected numbers each, two to sixteen.
    bins = "least(16, greatest(2, size(xs) div 5))"
    share = "(ceil((bin + 1) * a / bn) - ceil(bin * a / bn)) / a"
    chi = f"aggregate(sequence(0, cast(bn as int) - 1), 0D, (sum, bin) -> sum + {_let(f'size(xs) * {share}', 'e', 'pow(size(filter(xs, x -> floor(x * bn / a) = bin)) - e, 2) / e')})"
    uniform = _tail(_let("2D / (9D * (bn - 1))", "v", f"(pow({chi} / (bn - 1), 1D / 3D) - (1D - v)) / sqrt(v)"))
    high = "size(filter(xs, x -> 2 * x >= a))"
    neighbours = "sequence(1, size(xs) - 1)"
    changes = f"size(filter({neighbours}, i -> (2 * xs[i] >= a) <> (2 * xs[i - 1] >= a)))"
    mean = "(2D * hi * (n - hi) / n + 1D)"
    spread = "sqrt(greatest(1e-9D, 2D * hi * (n - hi) * (2D * hi * (n - hi) - n) / (n * n * (n - 1))))"
    runs = "2D * " + _tail(_let("cast(size(xs) as double)", "n", _let(f"cast({high} as double)", "hi", f"abs({changes} + 1D - {mean}) / {spread}")))
    serial = "2D * " + _tail(f"abs(aggregate({neighbours}, 0D, (sum, i) -> sum + (xs[i] - (a - 1) / 2D) * (xs[i - 1] - (a - 1) / 2D)) / ((a * a - 1) / 12D * sqrt(size(xs) - 1D)))")
    least = _let("cast(length(al) as double)", "a", _let(f"cast({bins} as double)", "bn", f"least({uniform}, {runs}, {serial})"))
    passes = _let(alphabet, "al", _let(numbers, "xs", f"size(xs) >= {battery.symbols} and 3D * {least} >= {battery.reject}D"))
    level = _let(_unlike_language(run, battery), "p", "cast(if(p <= 1e-300D, 3000, greatest(0D, floor(-10D * log10(p)))) as int)")
    return f"named_struct('band', cast(floor(log2(length({run}))) as int), 'level', {level}, 'random', {passes})"


def _blocked(items: str, state: str, kind: str, step: str) -> str:
    """Array of what ``step`` appends for each item, by a fold over blocks, so that appending stays cheap for very many items.

    ``step`` turns state x and item r into a struct of the state's fields and ``out``, an
    array<``kind``>; ``state`` lists the state's fields and first values.
    """
    fields = [f.split(" as ")[1] for f in state.split(", ")]
    given = ", ".join(f"'{f}', {{}}.{f}" for f in fields)
    first = ", ".join(f"'{f.split(' as ')[1]}', {f.split(' as ')[0]}" for f in state.split(", "))
    none = f"cast(array() as array<{kind}>)"
    # No array is bound by _let within the fold, as Spark would copy it whole.
    block = f"aggregate(sequence(b * {BLOCK}, least(size(all_), b * {BLOCK} + {BLOCK}) - 1), named_struct({given.replace('{}', 'acc')}, 'out', {none}), (x, i) -> {re.sub(r'\br\b', 'all_[i]', step)})"
    joined = f"aggregate(array({block}), acc, (y, done) -> named_struct({given.replace('{}', 'done')}, 'out', concat(y.out, array(done.out))))"
    fold = f"aggregate(sequence(0, (size(all_) - 1) div {BLOCK}), named_struct({first}, 'out', cast(array() as array<array<{kind}>>)), (acc, b) -> {joined}, acc -> flatten(acc.out))"
    return _let(items, "all_", f"if(size(all_) = 0, {none}, {fold})")


def _found(df: DataFrame, text: str, kind: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds f_<kind>: the matches' start and end in code points with the text of ``group``."""
    matches, groups, rest, at = f"m_{kind}", f"g_{kind}", f"s_{kind}", f"p_{kind}"
    lit = F.lit(pattern)
    df = df.withColumn(matches, F.regexp_extract_all(text, lit, 0))
    some = F.size(matches) > 0
    df = df.withColumn(rest, F.when(some, F.split(text, pattern, -1)))
    df = df.withColumn(groups, F.when(some, F.regexp_extract_all(text, lit, group)) if group else F.col(matches))
    # Zipped, as a lambda that indexed a column of an earlier step could make Spark compute that step for each item.
    start = f"x.at + length(r.{rest})"
    end = f"{start} + length(r.{matches})"
    step = f"named_struct('at', {end}, 'out', concat(x.out, array(named_struct('start', {start}, 'end', {end}, 'value', r.{groups}))))"
    df = df.withColumn(at, F.when(some, F.slice(F.arrays_zip(rest, matches, groups), F.lit(1), F.size(matches))).otherwise(F.array()))
    df = df.withColumn(f"f_{kind}", F.expr(_blocked(at, "0 as at", "struct<start: int, end: int, value: string>", step)))
    return df.drop(matches, groups, rest, at)


def _scanned(df: DataFrame, text: str, battery: Battery) -> DataFrame:
    """Adds base_, an array of (start, kind, end) in order with kind by its place in KINDS, and f_run: the measured runs that meet none of them."""
    for kind, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0)):
        df = _found(df, text, kind, pattern, group)
    spans = [f"transform({f}, r -> named_struct('start', r.start, 'kind', {k}, 'end', r.end))" for k, f in enumerate((f"filter(f_assign, r -> length(r.value) >= {ASSIGN_LEAST})", "f_access", "f_hex"))]
    df = _found(df.withColumn("base_", F.expr(f"sort_array(concat({', '.join(spans)}))")), text, "run", RUN)
    # In order, a run is met by a span before it that reaches into it, or by the next span, which is known by the number seen.
    every = "sort_array(concat(transform(base_, r -> named_struct('start', r.start, 'kind', r.kind, 'end', r.end, 'value', '')), transform(f_run, r -> named_struct('start', r.start, 'kind', 3, 'end', r.end, 'value', r.value))))"
    free = "r.kind = 3 and x.reach <= r.start and (x.seen >= size(base_) or base_[x.seen].start >= r.end)"
    step = f"named_struct('reach', if(r.kind < 3, greatest(x.reach, r.end), x.reach), 'seen', x.seen + if(r.kind < 3, 1, 0), 'out', if({free}, concat(x.out, array(r)), x.out))"
    left = _let("base_", "own", _blocked(every.replace("base_", "own"), "0 as reach, 0 as seen", "struct<start: int, kind: int, end: int, value: string>", step.replace("base_", "own")))
    df = df.withColumn("f_free", F.expr(f"if(size(base_) = 0 or size(f_run) = 0, transform(f_run, r -> named_struct('start', r.start, 'kind', 3, 'end', r.end, 'value', r.value)), {left})"))
    measured = f"transform(f_free, r -> named_struct('start', r.start, 'kind', r.kind, 'end', r.end, 'is', {_measured('r.value', battery)}))"
    return df.withColumn("f_run", F.expr(measured)).drop("f_assign", "f_access", "f_hex", "f_free")


def fitted(df: DataFrame, battery: Battery, text: str = "text") -> Battery:
    """The battery with the table's own shares of letters, counted over all texts; one row comes to the driver."""
    counts = [F.sum(F.regexp_count(text, F.lit(f"[{s}{s.upper()}]"))) for s in (VOWELS, COMMON, OTHERS)]
    v, c, o = ((n or 0) + battery.prior * p for n, p in zip(df.agg(*counts).first(), battery.shares))
    rare = max(battery.shares[2], o / (v + c + o))
    return replace(battery, shares=((1 - rare) * v / (v + c), (1 - rare) * c / (v + c), rare))


def discovery_levels(df: DataFrame, battery: Battery, text: str) -> dict[int, int]:
    """For each band of lengths the least level that Benjamini-Hochberg accepts, over all runs of ``df`` that no pattern reports.

    P-values count at the upper end of their level, which errs to fewer discoveries. What
    comes to the driver is a row per band (fewer than 32).
    """
    runs = _scanned(df.select(F.coalesce(F.col(text), F.lit("")).alias("t_")), "t_", battery).select(F.explode("f_run.is").alias("is"))
    levels = runs.groupBy(F.col("is.band").alias("band"), F.col("is.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    band = Window.partitionBy("band")
    ranked = levels.select("band", "level", F.sum("n").over(band.orderBy(F.desc("level"))).alias("rank"), F.sum("n").over(band).alias("all"))
    accepted = ranked.where(F.pow(F.lit(10.0), -F.col("level") / 10.0) * F.col("all") <= battery.fdr * F.col("rank"))
    return {r["band"]: r["level"] for r in accepted.groupBy("band").agg(F.min("level").alias("level")).collect()}


def _with_spans(df: DataFrame, text: str, battery: Battery) -> DataFrame:
    """``df`` with t_ (the text, null as empty), base_ and spans_: arrays of (start, kind, end) in order, kind by its place in KINDS."""
    battery = fitted(df, battery, text)
    levels = discovery_levels(df, battery, text)
    df = _scanned(df.withColumn("t_", F.coalesce(F.col(text), F.lit(""))), "t_", battery)
    accepted = " or ".join(f"r.is.band = {b} and r.is.level >= {v}" for b, v in sorted(levels.items())) or "false"
    added = f"transform(filter(f_run, r -> r.is.random and ({accepted})), r -> named_struct('start', r.start, 'kind', r.kind, 'end', r.end))"
    return df.withColumn("spans_", F.expr(f"sort_array(concat(base_, {added}))")).drop("f_run")


def _written(spans: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({kinds})[s.kind], ':', s.start, ':', s.end)), ',')")


def secret_spans(df: DataFrame, battery: Battery = Battery(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """The secrets of each row's text.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random. Spans are
    kind:start:end in code points, end exclusive, by start, then kind, joined by commas.
    Null texts count as empty: no spans. One row out for each row in; null and repeated
    keys stay; an empty table gives no rows; other columns, whatever their names, are not
    read. A long text takes time in proportion to its length and its matches. Texts are
    read three times (letters are counted, then all runs, before any is accepted) and never
    shuffled.
    """
    rows = _with_spans(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text_in_")), "text_in_", battery)
    count = lambda k: F.expr(f"cast(size(filter(spans_, s -> s.kind = {k})) as long)")
    return rows.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_written("base_"), 256).alias("base_sha256"), _written("spans_").alias("spans"), count(3).alias("n_random"))


def redact_secrets(df: DataFrame, battery: Battery = Battery(), text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``df`` with each secret of its text column replaced by ``mask``, spans that meet by one.

    Rows and columns stay, null and repeated keys and clashing names too; a null text stays
    null, a text without secrets is unchanged, an empty table stays empty.
    """
    columns = df.columns
    own = [f"in{i}_" for i in range(len(columns))]
    at = own[columns.index(text)]
    rows = _with_spans(df.toDF(*own), at, battery)
    # What stays of the text lies between where spans end and the next one starts: (from, to).
    step = "named_struct('reach', greatest(x.reach, r.end), 'out', if(r.start < x.reach, x.out, concat(x.out, array(named_struct('from', x.reach, 'to', r.start)))))"
    rows = rows.withColumn("gaps_", F.expr(_blocked("spans_", "0 as reach", "struct<from: int, to: int>", step)))
    # Positions are found within pieces, as a position in a long string costs a walk through it.
    rows = rows.withColumn("pieces_", F.when(F.size("spans_") > 0, F.regexp_extract_all("t_", F.lit(f"(?s).{{1,{PIECE}}}"), 0)))
    part = lambda i, a, n: f"substring(coalesce(get(pieces_, {i}), ''), {a} + 1, {n})"
    inner = _let(f"g.to div {PIECE}", "j", f"if(i = j, {part('i', f'g.from % {PIECE}', 'g.to - g.from')}, concat({part('i', f'g.from % {PIECE}', PIECE)}, array_join(slice(pieces_, i + 2, j - i - 1), ''), {part('j', '0', f'g.to % {PIECE}')}))")
    kept = f"transform(gaps_, g -> concat({_let(f'g.from div {PIECE}', 'i', inner)}, '{mask}'))"
    last = "aggregate(spans_, 0, (e, s) -> greatest(e, s.end))"
    rest = _let(last, "e", f"concat({part(f'e div {PIECE}', f'e % {PIECE}', PIECE)}, array_join(slice(pieces_, e div {PIECE} + 2, size(pieces_)), ''))")
    clean = F.expr(f"if(size(spans_) = 0, {at}, concat(array_join({kept}, ''), {rest}))")
    return rows.select(*(clean if c == at else F.col(c) for c in own)).toDF(*columns)
