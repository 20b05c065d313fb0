"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Spans are in code points, end exclusive. Three base kinds are found by patterns (``assign``, ``access``,
``hex``). The fourth, ``entropy``, looks at candidate strings of one character class (hex digits, or
the base64 alphabet): a window of ``WINDOW`` characters slides over the candidate. The counts of its
characters stand in a few integers, ``FIELD`` bits each; one character leaves, one enters, and what that
does to the sum of c log2 c, from which the Shannon entropy follows, is looked up. A candidate with a window that
reaches its class's threshold is a span, unless an allow-list suppresses it (words, identifiers that are public by
form) or base spans leave no ``WINDOW`` of its characters in a row. Base spans are never suppressed.

Candidates are cut into stretches of ``STRETCH`` windows. A stretch of too few different characters for the threshold is
left out, which loses nothing: k of them have an entropy of log2 k at most. The first window that
passes ends the search. All steps take time in proportion to the text, whatever it holds: no pattern repeats a group,
positions are summed up in blocks, and slices are cut from blocks of ``BLOCK`` characters.

All expressions are built-in; rows are scanned where they are, without a shuffle. Each pattern first
tells the few rows that have it at all; only those pay for positions.

Defined cases: a null text is empty and has no spans; a null doc_id is kept; very long texts are scanned
whole; repeated rows give repeated results; an empty table gives no rows; other columns, whatever their names, are kept by
``scan`` and ``redact``, but a column named ``spans`` is replaced by ``scan``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

WINDOW = 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: A row without such a place has no candidate that the thresholds could pass: digits beside letters.
CANDIDATE_HINT = r"(?=[A-Za-z+/_=-]{0,40}+[0-9])[A-Za-z0-9+/_=-]{20}"
#: Bits, for each character class, of the highest window.
THRESHOLDS = {"hex": 3.0, "base64": 3.7}
#: Candidates that are no secrets: letters alone (words run together), digits alone, words joined by
#: hyphens, underlines or slashes, and UUIDs.
ALLOW = (
    r"^[A-Za-z+/_=-]+$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z]+([-_/][A-Za-z]+)+([-_/][0-9]{1,4})*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: The third of them without a repeated group, in which Java's matcher recurses once a word: what it starts with, and
#: what it can't have (another character, an empty part, a mixed part, a long number, a word after a number).
JOINED = r"^[A-Za-z]+[-_/][A-Za-z]"
NOT_JOINED = r"[^A-Za-z0-9_/-]|[-_/][-_/]|[-_/]$|[A-Za-z][0-9]|[0-9][A-Za-z]|[0-9]{5}|[0-9][-_/][A-Za-z]"
SPAN = "struct<s: int, k: int, e: int>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
#: Elements of an array that are folded at once; characters of a slice's block; windows of a stretch.
FOLD, BLOCK, STRETCH = 256, 256, 100
#: Bits of a count of up to WINDOW, counts in a long, and the code of the first character of the alphabet.
FIELD, FIELDS, FIRST = 5, 12, 43
LONGS = (ord("z") - FIRST) // FIELDS + 1


def _quoted(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with a name for a value, which is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _fold(items: str, zero: str, state: str, out: str, kind: str) -> str:
    """SQL for what a fold over an array puts out, in order: ``out`` (an array of ``kind``) and the next ``state`` from the state
    ``a.z`` and the element ``r``. By blocks, since each addition to an array copies it."""
    none = f"cast(array() as array<{kind}>)"
    inner = f"aggregate(slice(its, blk * {FOLD} + 1, {FOLD}), named_struct('z', acc.z, 'out', {none}), (a, r) -> named_struct('z', {state}, 'out', concat(a.out, {out})))"
    outer = f"""flatten(aggregate(sequence(0, cast(size(its) div {FOLD} as int)), named_struct('z', {zero}, 'outs', cast(array() as array<array<{kind}>>)),
        (acc, blk) -> {_let(inner, 'one', "named_struct('z', one.z, 'outs', concat(acc.outs, array(one.out)))")}, acc -> acc.outs))"""
    return _let(items, "its", outer)


def _positions(text: str, pattern: str, kind: int, keep: str = "true", found: str = "") -> str:
    """SQL for the spans of a pattern's matches: what stands between matches and the matches add up. With ``found``, the
    type of a span with its match as ``x``."""
    p = _quoted(pattern)
    end = "a.z + r.gap + r.n"
    span = f"named_struct('s', a.z + r.gap, 'k', {kind}, 'e', {end}{', ' + repr('x') + ', r.x' if found else ''})"
    none = f"cast(array() as array<{found or SPAN}>)"
    items = "transform(q.m, (x, i) -> struct(length(x) as n, length(q.b[i]) as gap, x as x))"
    return _let(f"struct(regexp_extract_all({text}, {p}, 0) as m, split({text}, {p}, -1) as b)", "q", _fold(items, "0", end, f"if({keep}, array({span}), {none})", found or SPAN))


def _assign(text: str) -> str:
    p = _quoted(ASSIGN)
    return _positions(text, ASSIGN, 0, keep=f"length(regexp_extract(r.x, {p}, 2)) >= {ASSIGN_LEAST}")


def _allowed(x: str) -> str:
    """SQL for whether a candidate is on the allow-list."""
    joined = f"if(rlike({x}, {_quoted(JOINED)}), not rlike({x}, {_quoted(NOT_JOINED)}), false)"
    return " or ".join([*(f"rlike({x}, {_quoted(a)})" for k, a in enumerate(ALLOW) if k != 2), joined])


def reaches(candidate: str, bits: float) -> str:
    """SQL for whether some window of a candidate (a column or lambda variable) has an entropy of ``bits``.

    Less of the sum of c log2 c is more entropy. The state of the fold over a stretch: the counts, the sum, the verdict.
    """
    f = lambda c: c * math.log2(c) if c else 0.0
    # what the sum grows by when a count of c becomes c + 1
    grows = "array(" + ", ".join(f"{f(c + 1) - f(c)!r}D" for c in range(WINDOW)) + ")"
    most = WINDOW * (math.log2(WINDOW) - bits)
    count = lambda c, of: f"cast(shiftright(get({c}, {of}.w), {of}.b) & {(1 << FIELD) - 1} as int)"
    # y leaves, x enters; the counts are those without y and before x
    moved = f"transform(a.c, (z, k) -> z + if(k = m.x.w, shiftleft(1L, m.x.b), 0L) - if(k = m.y.w, shiftleft(1L, m.y.b), 0L))"
    first = f"transform(a.c, (z, k) -> z + if(k = m.x.w, shiftleft(1L, m.x.b), 0L))"
    entered = f"get({grows}, {count('a.c', 'm.x')} - if(i >= {WINDOW} and m.x = m.y, 1, 0))"
    left = f"if(i >= {WINDOW}, get({grows}, {count('a.c', 'm.y')} - 1), 0D)"
    total = f"a.s + {entered} - {left}"
    step = _let(
        f"struct(get(v, i) as x, get(v, i - {WINDOW}) as y)",
        "m",
        f"named_struct('c', if(i >= {WINDOW}, {moved}, {first}), 's', {total}, 'ok', i >= {WINDOW - 1} and {total} <= {most!r}D)",
    )
    zero = f"named_struct('c', array_repeat(0L, {LONGS}), 's', 0D, 'ok', false)"
    fold = f"aggregate(sequence(0, size(v) - 1), {zero}, (a, i) -> if(a.ok, a, {step}), a -> a.ok)"
    codes = f"transform(split(w, ''), c -> struct(cast((ascii(c) - {FIRST}) div {FIELDS} as int) as w, cast((ascii(c) - {FIRST}) % {FIELDS} * {FIELD} as int) as b))"
    enough = f"size(array_distinct(split(w, ''))) >= {math.ceil(2**bits - 1e-9)}"
    stretches = _let(f"regexp_extract_all({candidate}, '.{{1,{STRETCH}}}', 0)", "p", f"transform(p, (s, j) -> concat(s, left(coalesce(get(p, j + 1), ''), {WINDOW - 1})))")
    return f"exists({stretches}, w -> if(length(w) >= {WINDOW} and {enough}, {_let(codes, 'v', fold)}, false))"


def _entropy_spans(text: str, base: str) -> str:
    """SQL for the spans of candidates that are neither allowed nor in base spans and pass a threshold."""
    kind = "struct<s: int, k: int, e: int, x: string>"
    none = f"cast(array() as array<{kind}>)"
    candidates = _positions(text, CANDIDATE, 3, keep=f"not ({_allowed('r.x')})", found=kind)
    # base spans and candidates by their starts, and an end: w is the longest part of the open candidate o outside base
    # spans up to p, and reach the last end of a base span so far
    events = f"array_sort(concat(transform({base}, b -> named_struct('s', b.s, 'k', b.k, 'e', b.e, 'x', cast(null as string))), cs, array(named_struct('s', {2**31 - 1}, 'k', 3, 'e', {2**31 - 1}, 'x', cast(null as string)))))"
    zero = f"named_struct('o', cast(null as {kind}), 'p', 0, 'w', 0, 'reach', 0)"
    opened = "named_struct('o', r, 'p', greatest(r.s, least(a.z.reach, r.e)), 'w', 0, 'reach', a.z.reach)"
    covers = "named_struct('o', a.z.o, 'p', greatest(a.z.p, least(r.e, a.z.o.e)), 'w', greatest(a.z.w, least(r.s, a.z.o.e) - a.z.p), 'reach', greatest(a.z.reach, r.e))"
    closes = f"if(r.k = 3 and a.z.o is not null and greatest(a.z.w, a.z.o.e - a.z.p) >= {WINDOW}, array(a.z.o), {none})"
    alone = "named_struct('o', a.z.o, 'p', a.z.p, 'w', a.z.w, 'reach', greatest(a.z.reach, r.e))"
    over = _fold(events, zero, f"if(r.k = 3, {opened}, if(a.z.o is null, {alone}, {covers}))", closes, kind)
    passes = f"if(rlike(c.x, '^[0-9A-Fa-f]+$'), {reaches('c.x', THRESHOLDS['hex'])}, {reaches('c.x', THRESHOLDS['base64'])})"
    found = f"transform(filter(if(size(cs) = 0 or size({base}) = 0, cs, {over}), c -> {passes}), c -> named_struct('s', c.s, 'k', c.k, 'e', c.e))"
    return _let(candidates, "cs", found)


def _found(docs: DataFrame, text: str) -> DataFrame:
    """(row, t, hint, spans of each kind, base, every): the input's columns are inside ``row``, so no name clashes."""
    out = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    out = out.withColumn("hint", F.struct(*(F.expr(f"rlike(t, {_quoted(p)})").alias(n) for n, p in (("a", ASSIGN_HINT), ("c", ACCESS), ("h", HEX), ("e", CANDIDATE_HINT)))))
    for name, hint, found in (("assign", "a", _assign("t")), ("access", "c", _positions("t", ACCESS, 1)), ("hex", "h", _positions("t", HEX, 2))):
        out = out.withColumn(name, F.expr(f"if(hint.{hint}, {found}, {NO_SPANS})"))
    out = out.withColumn("base", F.expr("array_sort(concat(assign, access, hex))"))
    return out.withColumn("every", F.expr(f"if(hint.e, array_sort(concat(base, {_entropy_spans('t', 'base')})), base)"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: array of (s, k, e), by start, then kind (its place in KINDS), then end."""
    own = [F.col(f"row.`{c}`") for c in docs.columns if c != "spans"]
    return _found(docs, text).select(*own, F.col("every").alias("spans"))


def _slice(s: str, e: str) -> str:
    """SQL for the characters from s to e of a text of which ``bl`` are the blocks."""
    first, last = f"cast({s} div {BLOCK} as int)", f"cast(({e} - 1) div {BLOCK} as int)"
    parts = f"concat(substring(get(bl, {first}), {s} % {BLOCK} + 1), array_join(slice(bl, {first} + 2, {last} - {first} - 1), ''), left(get(bl, {last}), ({e} - 1) % {BLOCK} + 1))"
    return f"if({e} <= {s}, '', if({first} = {last}, substring(get(bl, {first}), {s} % {BLOCK} + 1, {e} - {s}), {parts}))"


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same columns, with every secret in the text replaced; overlapping spans are one. A null text stays null."""
    kind = "struct<s: int, e: int>"
    # runs of overlapping spans; the element at the end closes the last one and is itself the end of the text
    ends = "concat(transform(every, x -> named_struct('s', x.s, 'e', x.e)), array(named_struct('s', length(t), 'e', length(t))))"
    grown = "if(a.z is not null and r.s < a.z.e, named_struct('s', a.z.s, 'e', greatest(a.z.e, r.e)), r)"
    closed = f"if(a.z is null or r.s < a.z.e, cast(array() as array<{kind}>), array(a.z))"
    runs = F.expr(f"if(size(every) = 0, cast(array() as array<{kind}>), {_fold(ends, f'cast(null as {kind})', grown, closed, kind)})")
    before = _let("if(i = 0, 0, get(runs, i - 1).e)", "at", f"concat({_slice('at', 'x.s')}, {_quoted(mask)})")
    after = _let("get(runs, size(runs) - 1).e", "at", _slice("at", "length(t)"))
    clean = _let(f"regexp_extract_all(t, '(?s).{{1,{BLOCK}}}', 0)", "bl", f"concat(array_join(transform(runs, (x, i) -> {before}), ''), {after})")
    found = _found(docs, text).withColumn("runs", runs)
    masked = F.when(F.col(f"row.`{text}`").isNotNull(), F.expr(f"if(size(runs) = 0, t, {clean})"))
    return found.select(*(masked.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns))


def _joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.expr(f"array({kinds})"), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document; no shuffle, no Python."""
    found = _found(common.documents(spark, sf_dir).select("doc_id", "text"), "text")
    return found.select(
        F.col("row.doc_id"), *(F.size(c).cast("long").alias(n) for c, n in (("assign", "n_assign"), ("access", "n_access"), ("hex", "n_hex"))), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans")
    )


QUERIES = {"op9_secret_scan": op9_secret_scan}
ORACLE: dict[str, str] = {}
