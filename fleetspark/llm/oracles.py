"""DuckDB twins of the queries that SQL can express, by brute force on whole tables."""

from __future__ import annotations

from . import rules

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, link.b FROM reach r JOIN link ON link.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN (SELECT d, min(c) AS component_id FROM reach GROUP BY d) c ON c.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS p FROM t)),
f AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
c AS (SELECT win.doc_id, p FROM win JOIN f USING (s) WHERE first < win.doc_id),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true)::INT AS fresh FROM c)),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS e FROM g GROUP BY doc_id, run),
k AS (SELECT r.doc_id, a, e, substr(h, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (a - coalesce(lag(e) OVER w, 0))) AS part, h FROM r JOIN t USING (doc_id) WINDOW w AS (PARTITION BY r.doc_id ORDER BY a)),
j AS (SELECT doc_id, sum(e - a) AS n, count(*) AS spans, string_agg(part, '' ORDER BY a) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM k GROUP BY doc_id)
SELECT t.doc_id, len(t.h) // 2 AS n_bytes, coalesce(j.n, 0)::BIGINT AS n_removed, coalesce(j.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(j.kept, t.h))) AS kept_sha256
FROM t LEFT JOIN j USING (doc_id)"""



_STEP = "CASE WHEN {c} & 1 = 1 THEN xor({c} >> 1, 3988292384) ELSE {c} >> 1 END"
_BYTES = "SELECT i, 0 AS k, i AS c FROM range(0, 256) t(i) UNION ALL SELECT i, k + 1, " + _STEP.format(c="c") + " FROM byte WHERE k < 8"
#: crc32 of the text of column ``key``, with the table ``crc`` joined in.
_HEX = "hex(encode(key))"
_CRC = (f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len({_HEX}), 2), lambda i: ('0x' || ({_HEX})[i:i + 1])::BIGINT)), "
        "lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295)")


def shards(draw: str) -> str:
    rows = _BYTES
    return f"""
WITH RECURSIVE byte AS ({rows}),
crc AS (SELECT list(c ORDER BY i) AS tab FROM byte WHERE k = 8),
one AS (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, source, len(h) // 2 + 1 AS size, h, {draw} AS u FROM one),
b AS (SELECT doc_id, list_transform(range(1, len(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT) AS bytes FROM one),
x AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, tab[xor(c & 255, y) + 1])), 4294967295) AS text_crc32 FROM b, crc),
f AS (SELECT d.*, text_crc32, (row_number() OVER w - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM d JOIN x USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY u, doc_id)),
p AS (SELECT *, row_number() OVER (ORDER BY f, u, doc_id) - 1 AS position, count(*) OVER () AS n FROM f),
s AS (SELECT *, (position * 8) // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, position - (shard * n + 7) // 8 AS slot, NULL::INT AS grown_shard, position FROM s"""


def secrets() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    keys = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    kinds = [("assign", f"""({keys})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
             ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1)]
    parts = []
    for k, (kind, pattern, group, least) in enumerate(kinds):
        parts.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': list_sum(list_transform(r[1:i], lambda x: len(x))) +
  coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0), 'size': len(m[i]), 'part': len(regexp_extract(m[i], '{pattern}', {group}))}}), lambda s: s.part >= {least})) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS r FROM docs)""")
    text = "kind || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(parts)}),
j AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg({text}, ',' ORDER BY s.start, k) FILTER (k < 3) AS base, string_agg({text}, ',' ORDER BY s.start, k) AS every FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN j USING (doc_id)"""


def quality() -> str:
    measure = {"symbols_per_word": "n_symbols / greatest(n_words, 1)", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "repeat_share": "n_repeat_words / greatest(n_words, 1)",
               "short_words": "word_chars / greatest(n_words, 1)", "long_words": "word_chars / greatest(n_words, 1)"}
    fails = lambda r, cut: f"{measure[r]} {'>' if rules.GRID[r][0] == 'above' else '<'} {cut}"
    tests = " UNION ALL ".join(f"SELECT s, '{r}' AS rule, {i} AS i, {c}::DOUBLE AS cutoff, count(*) AS n, count(*) FILTER ({fails(r, c)}) AS k FROM good GROUP BY s"
                               for r, (_, cuts) in rules.GRID.items() for i, c in enumerate(cuts))
    tail = f"""list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rules.RISK}) + (n - i) * ln({1 - rules.RISK}))))"""
    failed = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {fails(r, f'max(cutoff) FILTER (rule = {chr(39)}{r}{chr(39)})')} THEN '{r}' END" for r in rules.GRID) + "], lambda x: x IS NOT NULL), ',')"
    return f"""
WITH t AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'n' ELSE 's' || lang END AS s, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM t WHERE len(w) >= 5)),
hit AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(j - i, 5))) AS n FROM hit GROUP BY doc_id),
st AS (SELECT t.doc_id, s, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM t LEFT JOIN rep USING (doc_id)),
fl AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM st),
good AS (SELECT fl.* FROM fl JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min((quality = 1)::INT) = 1) USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT *, count(*) OVER () AS m FROM ({tests})),
proven AS (SELECT s, rule, arg_min(cutoff, i) AS cutoff FROM tests WHERE k < {rules.RISK} * n AND {tail} <= {rules.ERROR} / m GROUP BY s, rule),
v AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {failed} AS failed FROM fl LEFT JOIN proven USING (s)
  GROUP BY doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed)
SELECT *, NOT base_failed AND failed = '' AS kept FROM v"""


def conversations() -> str:
    """Cells are strings: six digits of cost, then the audit, so that ``least`` takes the cheapest and of these the ASCII-least."""
    add = lambda cell, cost, letter: f"lpad((left({cell}, 6)::INT + {cost})::VARCHAR, 6, '0') || '{letter}' || substr({cell}, 7)"
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    free = {0: 2, 1: 2, 2: 3, 3: 2}
    plain = []
    for state, following in legal.items():
        keep = " ".join(f"WHEN ini = '{i}' THEN {add(f'c{n}', 'extra', 'K')}" for i, n in following.items())
        plain.append(f"""least({add(f'c{state}', 4, 'D')}, CASE WHEN fault IN (1, 2) THEN '900000' {keep} ELSE '900000' END,
  CASE WHEN fault IN (1, 2) THEN '900000' ELSE {add(f'c{free[state]}', '3 + extra', 'R')} END) AS p{state}""")
    role = "CASE state WHEN 2 THEN 'assistant' ELSE 'user' END"
    after = "CASE WHEN ini = 's' THEN 1 WHEN ini = 'u' THEN 2 ELSE 3 END"
    return f"""
WITH RECURSIVE byte AS ({_BYTES}), crc AS (SELECT list(c ORDER BY i) AS tab FROM byte WHERE k = 8),
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS h FROM k, crc),
d AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS (SELECT conv_id, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE WHEN NOT regexp_matches(text, '{_WORD}') THEN 1 WHEN seen > 1 THEN 2
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM d)),
x AS (SELECT *, CASE fault WHEN 3 THEN 3 ELSE 0 END AS extra, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM o),
r AS (SELECT DISTINCT conv_id, n + 1 AS i, '000000' AS c0, '000006II' AS c1, '000003I' AS c2, '000000' AS c3 FROM x
  UNION ALL SELECT conv_id, i, least(p0, {add(f"least(p2, {add('p3', 3, 'I')})", 3, 'I')}), least(p1, {add(f"least(p2, {add('p3', 3, 'I')})", 3, 'I')}),
    least(p2, {add('p3', 3, 'I')}), least(p3, {add('p2', 3, 'I')})
  FROM (SELECT x.conv_id, x.i, {', '.join(plain)} FROM r JOIN x ON x.conv_id IS NOT DISTINCT FROM r.conv_id AND x.i = r.i - 1)),
best AS (SELECT conv_id, left(c0, 6)::BIGINT AS cost, substr(c0, 7) AS audit FROM r WHERE i = 1),
f AS (SELECT conv_id, audit, 1 AS spot, 1 AS i, 0 AS state, []::VARCHAR[] AS lines FROM best
  UNION ALL SELECT f.conv_id, audit, spot + 1, CASE e WHEN 'I' THEN f.i ELSE f.i + 1 END,
    CASE e WHEN 'D' THEN state WHEN 'K' THEN {after} ELSE CASE state WHEN 2 THEN 3 ELSE 2 END END,
    CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, {role} || ':') WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, {role} || ':' || text) END
  FROM (SELECT *, substr(audit, spot, 1) AS e FROM f WHERE spot <= len(audit)) f LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND spot = len(f.audit) + 1"""


SPELLING = f"""
WITH RECURSIVE byte AS ({_BYTES}), crc AS (SELECT list(c ORDER BY i) AS tab FROM byte WHERE k = 8),
g AS (SELECT doc_id, run, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY doc_id, run),
h AS (SELECT run, c, {_CRC} AS h FROM g, crc),
e AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM e WHERE len(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v)),
pairs AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.rest UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM pairs GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f last ON last.word = r.root AND last.form IS NULL"""
