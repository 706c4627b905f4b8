"""Secret scans with multipart credential linking, in SQL functions only.

Strong kinds are reported wherever they match. Weak kinds (an account name, a short or loosely named secret,
an endpoint) are ordinary text by themselves: they are interval-joined with the parts that would complete a
credential, and reported only when those lie within the same scope, `scope` code points on either side. A
document's candidates are joined inside its row, so nothing is shuffled and no group is gathered.

The interval join is a sort and two scans: a part touches a span if the furthest end before it reaches the span or
if the next start after it does. Scans run block by block, so a text takes time in proportion to its length and spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "(?:" + "|".join(_either(w) for w in words) + ")"


_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, pattern, group whose length counts, least length. In the order in which spans at one place are listed.
STRONG = (
    ("assign", _names("password", "passwd", "secret", "token", "api_?key") + _SET + "([A-Za-z0-9+/_.=-]+)", 1, 6),
    ("access", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "([0-9a-f]{24,})", 1, 24),
)
WEAK = (
    ("user", _names("user_?name", "user", "login", "account_?id", "client_?id", "access_?key_?id", "access_?key", "key_?id") + _SET + "([A-Za-z0-9@._-]+)", 1, 3),
    ("pass", _names("passphrase", "pass", "pwd", "secret_?key", "secret_?access_?key", "client_?secret", "private_?key", "credentials?") + _SET + "([A-Za-z0-9+/_.=!$%^*-]+)", 1, 4),
    ("endpoint", "((?:https?|ftps?|ssh|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._:@/-]+)", 1, 10),
)
KINDS = tuple(k[0] for k in STRONG + WEAK)
IDENTIFIERS, SECRETS = ("access", "user"), ("assign", "hex", "pass")
#: Code points between two parts of a credential at most.
SCOPE = 200

_SPAN = "struct<start:bigint,ord:int,end:bigint>"
_LOW, _HIGH = -(1 << 62), 1 << 62
#: Elements of a block of a scan, and code points of a piece of a text.
_BLOCK, _CHUNK = 256, 1024


def _scans(found: DataFrame, scans: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Adds columns by name: for each element of an array of bigints, the values before it joined by an expression of a
    and b, from a first value on.

    Each block is scanned by itself from what the blocks before it come to, since an array that grows by single
    elements is copied each time. Steps are columns, which are computed once, and SQL text, which is soon parsed.
    """
    kept = [f"`{c}`" for c in found.columns]

    def plain(xs: str, first: str, join: str) -> str:
        start = f"named_struct('a', {first}, 'out', cast(array() as array<bigint>))"
        return f"aggregate({xs}, {start}, (s, x) -> named_struct('a', {join.format(a='s.a', b='x')}, 'out', concat(s.out, array(s.a)))).out"

    def cut(xs: str) -> str:
        return f"CASE WHEN size({xs}) > 0 THEN transform(sequence(0, (size({xs}) - 1) div {_BLOCK}), k -> slice({xs}, cast(k * {_BLOCK} + 1 as int), {_BLOCK})) END"

    def firsts(xs: str, join: str, zero: str) -> str:
        return plain(f"transform({xs}, y -> aggregate(y, {zero}, (s, x) -> {join.format(a='s', b='x')}))", zero, join)

    found = found.selectExpr(*kept, *[f"{values} as {n}" for n, (values, _, _) in scans.items()])
    found = found.selectExpr(*kept, *[f"{cut(n)} as {n}" for n in scans])
    found = found.selectExpr(*kept, *scans, *[f"{firsts(n, join, f'{zero}L')} as {n}_from" for n, (_, join, zero) in scans.items()])
    return found.selectExpr(*kept, *[f"coalesce(flatten(zip_with({n}, {n}_from, (y, f) -> {plain('y', 'f', join)})), cast(array() as array<bigint>)) as {n}" for n, (_, join, _) in scans.items()])


_SUM, _LARGER, _SMALLER = "{a} + {b}", "greatest({a}, {b})", "least({a}, {b})"


def _in(kinds: tuple[str, ...]) -> str:
    """Whether a span s is of one of the kinds."""
    return f"s.ord in ({', '.join(str(KINDS.index(k)) for k in kinds)})"


_STRONG = _in(tuple(k[0] for k in STRONG))


def _touches(found: DataFrame, asked: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds a column by name to rows with sorted `spans`, computed where `weak` holds: for each span, whether another s
    that is a part, by the condition given, lies within so many code points of it."""
    kept, scans = found.columns, {}

    def edge(part: str, field: str, other: int) -> str:
        return f"transform(spans, s -> CASE WHEN {part} THEN s.{field} ELSE {other}L END)"

    for name, (part, _) in asked.items():
        scans[f"{name}_e"] = (f"CASE WHEN weak THEN {edge(part, 'end', _LOW)} END", _LARGER, _LOW)
        scans[f"{name}_s"] = (f"CASE WHEN weak THEN reverse({edge(part, 'start', _HIGH)}) END", _SMALLER, _HIGH)
    near = "CASE WHEN weak THEN zip_with(spans, zip_with({n}_e, reverse({n}_s), (e, s) -> struct(e, s)), (x, y) -> y.e >= x.start - {d} or y.s <= x.end + {d}) END as {n}"
    return _scans(found, scans).selectExpr(*kept, *[near.format(n=name, d=f"({scope})") for name, (_, scope) in asked.items()])


def _where(keep: str) -> str:
    """The spans of a row for whose element s, with the marks m beside it, a condition holds."""
    return f"CASE WHEN weak THEN transform(filter(zip_with(spans, marks, (s, m) -> struct(s, {keep} as k)), x -> x.k), x -> x.s) ELSE spans END as spans"


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["ord"].isin([KINDS.index(k) for k in kinds]))


def _scanned(documents: DataFrame, scope: int, text: str) -> tuple[DataFrame, list[str]]:
    """The rows with their columns renamed, which are listed, then `t` (the text, null as empty) and `spans`."""
    own = [f"c{i}" for i in range(len(documents.columns))]
    found = documents.toDF(*own)
    found = found.select(*own, F.coalesce(F.col(own[documents.columns.index(text)]), F.lit("")).alias("t"))
    kinds = list(enumerate(STRONG + WEAK))
    found = found.select("*", *[F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias(f"m{i}") for i, (_, p, _, _) in kinds])
    # Of the texts with a match: the gaps between matches, and what counts of each.
    found = found.select("*", *[F.when(F.size(f"m{i}") > 0, F.split("t", p, -1)).alias(f"g{i}") for i, (_, p, _, _) in kinds], *[F.when(F.size(f"m{i}") > 0, F.regexp_extract_all("t", F.lit(p), F.lit(g))).alias(f"v{i}") for i, (_, p, g, _) in kinds])
    sized = "zip_with(slice(g{i}, 1, size(m{i})), zip_with(m{i}, v{i}, (m, v) -> struct(cast(length(m) as bigint) as m, length(v) as v)), (g, x) -> named_struct('g', cast(length(g) as bigint), 'm', x.m, 'v', x.v)) as z{i}"
    found = found.selectExpr(*own, "t", *[sized.format(i=i) for i, _ in kinds])
    found = _scans(found, {f"p{i}": (f"transform(z{i}, x -> x.g + x.m)", _SUM, 0) for i, _ in kinds})
    placed = "coalesce(transform(filter(zip_with(z{i}, p{i}, (x, y) -> struct(y + x.g as start, y + x.g + x.m as end, x.v as v)), s -> s.v >= {n}), s -> named_struct('start', s.start, 'ord', {i}, 'end', s.end)), cast(array() as array<" + _SPAN + ">)) as s{i}"
    found = found.selectExpr(*own, "t", *[placed.format(i=i, n=n) for i, (_, _, _, n) in kinds])
    weak = " + ".join(f"size(s{i})" for i in range(len(STRONG), len(kinds)))
    found = found.selectExpr(*own, "t", f"sort_array(concat({', '.join(f's{i}' for i, _ in kinds)})) as spans", f"{weak} > 0 as weak")
    # A weak part that overlaps a strong one is none.
    found = _touches(found, {"marks": (_STRONG, -1)}).selectExpr(*own, "t", "weak", _where(f"{_STRONG} or not m"))
    found = _touches(found, {"near_id": (_in(IDENTIFIERS), scope), "near_key": (_in(SECRETS), scope)})
    found = found.selectExpr(*own, "t", "weak", "spans", "CASE WHEN weak THEN zip_with(near_id, near_key, (i, k) -> struct(i, k)) END as marks")
    complete = f"CASE WHEN {_STRONG} THEN true WHEN {_in(('user',))} THEN m.k WHEN {_in(('pass',))} THEN m.i ELSE m.i and m.k END"
    return found.selectExpr(*own, "t", _where(complete)), own


def scan(documents: DataFrame, scope: int = SCOPE, text: str = "text") -> DataFrame:
    """Adds `secret_spans`, an array of (start, ord, end) by start, then kind; ord is the place in KINDS.

    Places are code points, end exclusive. Null and empty texts have none; repeated rows are scanned each; a very long
    text takes time in proportion to its length and spans. All rows and columns stay, whatever the columns' names,
    except that a column named secret_spans is replaced.
    """
    documents = documents.drop("secret_spans")
    found, own = _scanned(documents, scope, text)
    return found.select(*own, "spans").toDF(*documents.columns, "secret_spans")


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(of_kinds(spans, kinds), lambda s: F.concat_ws(":", F.element_at(name, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(documents: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """documents with each run of overlapping spans replaced by `mask`; n_chars follows the text.

    All rows and columns stay; null, empty and clean texts stay as they are; repeated rows are masked each.
    """
    cols = documents.columns
    found, own = _scanned(documents, scope, "text")
    found = _scans(found.selectExpr("*", "size(spans) > 0 as hit"), {"reach": ("transform(spans, s -> s.end)", _LARGER, 0)})
    # What stays lies between the furthest end so far and the next start; it is put together from pieces of the text.
    between = "filter(zip_with(spans, reach, (s, r) -> struct(r as a, s.start as b)), x -> x.b >= x.a)"
    rest = "array(struct(array_max(transform(spans, s -> s.end)) as a, cast(length(t) as bigint) as b))"
    chunks = f"regexp_extract_all(t, '(?s).{{1,{_CHUNK}}}', 0)"
    found = found.selectExpr(*own, "hit", f"CASE WHEN hit THEN concat({between}, {rest}) END as stays", f"CASE WHEN hit THEN {chunks} END as chunks")
    first, last, at, to = [f"cast(x.{k} {op} {_CHUNK} as int)" for op in ("div", "%") for k in ("a", "b")]
    begin, end = [f"coalesce(get(chunks, {k}), '')" for k in (first, last)]
    whole = f"array_join(slice(chunks, {first} + 2, greatest({last} - {first} - 1, 0)), '')"
    piece = f"CASE WHEN {first} = {last} THEN substring({begin}, {at} + 1, {to} - {at}) ELSE concat(substring({begin}, {at} + 1), {whole}, substring({end}, 1, {to})) END"
    text = own[cols.index("text")]
    new = F.when(F.col("hit"), F.array_join(F.expr(f"transform(stays, x -> {piece})"), mask)).otherwise(F.col(text))
    found = found.select("hit", *[new.alias(c) if c == text else F.col(c) for c in own])
    if "n_chars" in cols:
        n = own[cols.index("n_chars")]
        found = found.withColumn(n, F.when(F.col("hit"), F.length(text).cast(documents.schema[cols.index("n_chars")].dataType)).otherwise(F.col(n)))
    return found.select(*own).toDF(*cols)
