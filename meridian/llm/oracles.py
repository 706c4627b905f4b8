"""DuckDB SQL that must give the rows of the queries that SQL can express."""

from __future__ import annotations

from meridian.llm import licenses, quality, secrets
from meridian.llm.urls import _LOWER, _UPPER

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secret_spans() -> str:
    kinds = ", ".join(f"({i}, {_str(k)}, {_str(p)}, {n})" for i, (k, p, _, n) in enumerate(secrets.STRONG + secrets.WEAK))
    ord_of = secrets.KINDS.index
    ids = ", ".join(str(ord_of(k)) for k in secrets.IDENTIFIERS)
    keys = ", ".join(str(ord_of(k)) for k in secrets.SECRETS)
    n = len(secrets.STRONG)
    near = f"EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.ord IN ({{}}) AND p.s <= w.e + {secrets.SCOPE} AND p.e >= w.s - {secrets.SCOPE})"
    return f"""
WITH k(ord, kind, pat, least) AS (VALUES {kinds}),
m AS (SELECT doc_id, ord, least, regexp_extract_all(t, pat) AS ms, regexp_extract_all(t, pat, 1) AS vs, string_split_regex(t, pat) AS gs
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), k WHERE regexp_matches(t, pat)),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
found AS (SELECT doc_id, ord, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
                 length(ms[i]) AS n FROM e WHERE length(vs[i]) >= least),
spans AS (SELECT doc_id, ord, s, s + n AS e FROM found),
strong AS (SELECT * FROM spans WHERE ord < {n}),
weak AS (SELECT * FROM spans w WHERE ord >= {n} AND NOT EXISTS (SELECT 1 FROM strong x WHERE x.doc_id = w.doc_id AND x.s < w.e AND x.e > w.s)),
parts AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak w WHERE CASE WHEN ord = {ord_of("user")} THEN {near.format(keys)} WHEN ord = {ord_of("pass")} THEN {near.format(ids)}
           ELSE {near.format(ids)} AND {near.format(keys)} END),
shown AS (SELECT *, kind || ':' || s || ':' || e AS name FROM (SELECT * FROM strong UNION ALL SELECT * FROM linked) JOIN k USING (ord)),
g AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
             coalesce(string_agg(name, ',' ORDER BY s, ord) FILTER (ord < {n}), '') AS base, string_agg(name, ',' ORDER BY s, ord) AS spans FROM shown GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)
"""


def near_dup_groups(words: int = 3, percent: int = 85) -> str:
    shingle = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(words))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: {shingle})) END AS sh FROM d),
s AS (SELECT doc_id, unnest(sh) AS h FROM x),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN x p ON p.doc_id = a JOIN x q ON q.doc_id = b WHERE 100 * n >= {percent} * (len(p.sh) + len(q.sh) - n)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT x.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(x.doc_id, coalesce(c.least, x.doc_id)) AS component_id, x.doc_id = least(x.doc_id, coalesce(c.least, x.doc_id)) AS kept
FROM x LEFT JOIN c USING (doc_id)
"""


def quality_rules() -> str:
    k, long, some = quality.REPEAT_WORDS, quality.LONGEST_REPEAT + 1, quality.LONG_WORDS
    least, most = quality.LEAST_WORDS, quality.MOST_REPEATED
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - {k} + 2)) AS i, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS x FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM g, range({k}) AS o(j) WHERE n > 1 GROUP BY 1),
q AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {long} + 2), lambda i: array_to_string(w[i:i + {long - 1}], ' '))) AS x FROM w JOIN r USING (doc_id) WHERE n_repeat >= {long}),
v AS (SELECT doc_id, unnest(range(1, len(w) - {some} + 2)) AS i, unnest(list_transform(range(1, len(w) - {some} + 2), lambda i: array_to_string(w[i:i + {some - 1}], ' '))) AS x FROM w JOIN r USING (doc_id) WHERE n_repeat >= {some}),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_long FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM v), range({some}) AS o(j) WHERE n > 1 GROUP BY 1),
z AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM q GROUP BY doc_id, x HAVING count(*) > 1)),
y AS (SELECT doc_id, count(*) - count(DISTINCT x) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, z.doc_id IS NOT NULL OR 100 * coalesce(n_long, 0) > {quality.COVERED} * len(w) AS long
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {least} OR 100 * n_repeat_words > {most} * n_words AS base_failed,
       NOT (n_words < {least} OR 100 * n_repeat_words > {most} * n_words OR long) AS kept FROM f
"""


def license_rules() -> str:
    """Sentences as arrays and rules as steps, one for each rule and reading, that take matches away."""
    known = ", ".join(f"{_str(x)}: {_str(k)}" for x, k in licenses.PIECES.items())
    sign = ", ".join(f"{_str(k)}: {_str(x)}" for k, x in licenses._SIGN.items())
    blank = r"[\x09-\x0D\x20]"
    plain = "lower(trim(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g')))"
    ids = f"list_filter(list_transform(string_split(regexp_replace({{}}, '([.!?:]){blank}+', '\\1' || chr(10), 'g'), chr(10)), lambda s: map_extract(m, {plain})[1]), lambda k: k IS NOT NULL)"
    thin = r"regexp_replace(t, '[\x20\x09\x0D]+', ' ', 'g')"
    across = f"replace(regexp_replace(regexp_replace({thin}, '\\n ?\\n', '.' || chr(133), 'g'), ' ?\\n ?', ' ', 'g'), chr(133), chr(10))"
    steps, at = [], "s"
    for i, (_, _, x) in enumerate(licenses.SIGNED):
        take = f"regexp_replace({{0}}, {_str(licenses.pattern(x))}, {_str(licenses.kept_groups(x, chr(92)))}, 'g')"
        steps.append(f"s{i} AS (SELECT * EXCLUDE (a, b), {take.format('a')} AS a, {take.format('b')} AS b, regexp_matches(a, {_str(licenses.pattern(x))}) AS a{i}, regexp_matches(b, {_str(licenses.pattern(x))}) AS b{i} FROM {at})")
        at = f"s{i}"
    rows = []
    for i, others in licenses.longer().items():
        more = [" OR ".join(f"{r}{j}" for j in others) or "false" for r in "ab"]
        rows.append(f"SELECT doc_id, {i} AS i, {_str(licenses.SIGNED[i][0])} AS l, {_str(licenses.SIGNED[i][1])} AS c FROM {at} WHERE a{i} AND (b{i} OR NOT ({more[1]})) OR b{i} AND (a{i} OR NOT ({more[0]}))")
    once = "SELECT doc_id, string_agg({0}, ',' ORDER BY i) AS {0}s FROM (SELECT doc_id, {0}, min(i) AS i FROM hits GROUP BY ALL) GROUP BY 1"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, MAP {{{known}}} AS m FROM documents),
i AS (SELECT doc_id, CASE WHEN regexp_matches(t, {_str(licenses.TRIGGER)}) THEN {ids.format("t")} ELSE [] END AS p, CASE WHEN regexp_matches(t, {_str(licenses.TRIGGER)}) THEN {ids.format(across)} ELSE [] END AS q FROM t),
n AS (SELECT doc_id, CASE WHEN len(q) > len(p) THEN q ELSE p END AS ids, p, q FROM i),
s AS (SELECT doc_id, array_to_string(list_transform(p, lambda k: map_extract(MAP {{{sign}}}, k)[1]), '') AS a, array_to_string(list_transform(q, lambda k: map_extract(MAP {{{sign}}}, k)[1]), '') AS b FROM n WHERE len(ids) > 0),
{", ".join(steps)},
hits AS ({" UNION ALL ".join(rows)}),
ls AS ({once.format("l")}), cs AS ({once.format("c")})
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, coalesce(ls, '') AS licenses, coalesce(cs, '') AS classes FROM n LEFT JOIN ls USING (doc_id) LEFT JOIN cs USING (doc_id)
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

ORACLES = {"op2_secrets": secret_spans(), "op3_warc": WARC, "op4_near_dups": near_dup_groups(), "op5_quality": quality_rules(), "op10_licenses": license_rules()}
