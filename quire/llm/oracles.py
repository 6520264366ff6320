"""DuckDB SQL with the rows of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from quire.llm import licenses, merkle

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _tree(text: str) -> str:
    """The written tree of a text expression, in steps that nest."""
    blank = r"trim(p, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = ''"
    leaf = f"CASE WHEN {blank} THEN md5(p)[1:12] ELSE array_to_string(list_transform(regexp_extract_all(p, '{merkle.PIECE}'), lambda x: md5(x)[1:12]), '.') END"
    nodes = f"list_transform(string_split({text}, chr(10)), lambda p: {leaf})"
    marked = f"list_transform({nodes}, lambda n: n || CASE WHEN contains('{merkle.ENDS}', md5(n)[1]) THEN ';' ELSE ',' END)"
    joined = f"regexp_replace(array_to_string({marked}, ''), '[,;]$', '')"
    sections = f"array_to_string(list_transform(string_split({joined}, ';'), lambda s: sha256(s)[1:16] || '=' || s), ';')"
    return f"list_transform([{sections}], lambda s: sha256(regexp_replace(s, '=[^;]*', '', 'g')) || ':' || s)[1]"


_LEAVES = "list_distinct(string_split_regex(regexp_replace({}[66:], '[0-9a-f]{{16}}=', '', 'g'), '[.,;]'))"
_NEAR = "CASE WHEN fingerprint[1:64] = {0}[1:64] THEN 1.0 ELSE 2.0 * len(list_intersect(own, {1})) / (len(own) + len({1})) END::DOUBLE"

OP1 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following FROM t WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, length(text) AS n_chars, text, following, substr(text, 1, length(text) - length(text) // 2) || substr(following, 1, length(text) // 2) AS edited FROM f),
p AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_tree("text")} AS fingerprint, {_tree("edited")} AS edited_fingerprint, {_tree("following")} AS next_fingerprint FROM e),
l AS (SELECT *, {_LEAVES.format("fingerprint")} AS own, {_LEAVES.format("edited_fingerprint")} AS of_edited, {_LEAVES.format("next_fingerprint")} AS of_next FROM p)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_NEAR.format("edited_fingerprint", "of_edited")} AS near_edited, {_NEAR.format("next_fingerprint", "of_next")} AS near_next FROM l
"""

_TEMPLATES = ", ".join(f"({n}, '{label}', '{text}', {str(n < len(licenses.BASE)).lower()})" for n, (label, text) in enumerate([*licenses.BASE, *licenses.TEMPLATES]))
_K = licenses.K

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
tt AS (SELECT t, label, string_split(x, ' ') AS w, base FROM (VALUES {_TEMPLATES}) v(t, label, x, base)),
tg AS (SELECT t, label, base, len(w) AS size, len(w) - {_K - 1} AS grams, i AS pos0, array_to_string(w[i + 1:i + {_K}], ' ') AS g FROM (SELECT *, unnest(range(len(w) - {_K - 1})) AS i FROM tt)),
dg AS (SELECT r, i AS pos, array_to_string(w[i + 1:i + {_K}], ' ') AS g FROM (SELECT r, w, unnest(range(greatest(len(w) - {_K - 1}, 0))) AS i FROM d)),
votes AS (SELECT r, t, label, base, size, grams, pos - pos0 AS diagonal, list(DISTINCT pos0) AS ats FROM dg JOIN tg USING (g) GROUP BY ALL),
marked AS (SELECT *, CASE WHEN base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > {licenses.NEAR}, true) THEN 1 ELSE 0 END AS apart FROM votes),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM marked),
spans AS (SELECT r, t, label, base, size, grams, min(diagonal + list_min(ats)) AS start, sum(len(ats)) AS n_ats,
  len(list_distinct(flatten(list(flatten(list_transform(ats, lambda a: range(a, a + {_K}))))))) / size AS share FROM numbered GROUP BY r, t, label, base, size, grams, span),
best AS (SELECT *, max(CASE WHEN NOT base THEN share END) OVER (PARTITION BY r, start) AS best FROM spans),
found AS (SELECT r, label, start, share, base FROM best WHERE base AND n_ats = grams OR NOT base AND share >= {licenses.LEAST_SHARE} AND share = best)
SELECT doc_id, len(w) AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(CASE WHEN base THEN 1.0 ELSE share END), 0.0)::DOUBLE AS score
FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id, w
"""

#: Texts in hexadecimal, cut into overlapping pieces before every 100-byte string is taken from them.
OP5 = """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
pieces AS (SELECT doc_id, b * 500 AS pos0, substr(x, 1000 * b + 1, 1198) AS x FROM (SELECT *, unnest(range(length(x) // 1000 + 1)) AS b FROM t)),
strings AS (SELECT doc_id, pos0 + i AS start, substr(x, 2 * i + 1, 200) AS s FROM (SELECT *, unnest(range(least(500, greatest(0, length(x) // 2 - 99)))) AS i FROM pieces)),
firsts AS (SELECT s, min((doc_id, start)) AS f FROM strings GROUP BY s HAVING count(*) > 1),
later AS (SELECT doc_id, start FROM strings JOIN firsts USING (s) WHERE (doc_id, start) <> f),
islands AS (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS n FROM (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 100 THEN 0 ELSE 1 END AS new FROM later)),
gone AS (SELECT doc_id, min(start) AS a, max(start) + 100 AS b FROM islands GROUP BY doc_id, n),
edges AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, g.a AS b FROM gone g WINDOW w AS (PARTITION BY doc_id ORDER BY g.a) UNION ALL SELECT doc_id, max(b), 1000000000000 FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (least(b, length(x) // 2) - a)), '' ORDER BY a) AS k FROM edges JOIN t USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS g FROM (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, len(w) - 3) END)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) c USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k + 1:k + size], ' ') AS s FROM (SELECT *, unnest(range(len(w) - size + 1)) AS k FROM i)),
places AS (SELECT r, k, size, array_to_string(w[k + 1:k + size], ' ') AS s FROM (SELECT r, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS k FROM d, (SELECT DISTINCT size FROM i))),
hits AS (SELECT r, k, size, item_id FROM places JOIN windows USING (size, s)),
covered AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS x FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

_SAID = "'<|im_end|><|im_start|>assistant ok'"

#: A turn's formatted length: 12 and 10 code points of control strings, two line ends, and a backslash each ``<|``.
OP12 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', {_SAID}), (-1, 1, 'assistant', {_SAID})),
f AS (SELECT *, 24 + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS chars,
  CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(length(loss))::BIGINT AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

_CRC = "(xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.'), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295))"

#: Pairs of equal grams of 16 words at one distance, in stretches, give every stretch of that period.
OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
c AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
e AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM c),
x AS (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(w, lambda v, i: CASE WHEN i - 1 < a THEN v ELSE w[a + (i - 1 - a) % p + 1] END) ELSE w END AS w FROM e),
grams AS (SELECT r, i, array_to_string(w[i + 1:i + 16], ' ') AS s FROM (SELECT r, w, unnest(range(greatest(0, len(w) - 15))) AS i FROM x)),
pairs AS (SELECT y.r, y.i, z.i - y.i AS q FROM grams y JOIN grams z ON y.r = z.r AND y.s = z.s AND y.i < z.i),
apart AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
stretches AS (SELECT r, q, min(i) AS start, max(i) - min(i) + 16 + q AS length FROM apart GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) = 1),
texts AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t, list_distinct(flatten(list(range(start + period, start + length)))) AS gone FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(t, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i - 1)) END, ' ')) AS collapsed_sha256
FROM x LEFT JOIN best b USING (r) LEFT JOIN texts USING (r)
"""

ORACLES = {"op1_fingerprints": OP1, "op3_licenses": OP3, "op5_repeats": OP5, "op6_near_duplicates": OP6, "op9_decontamination": OP9, "op11_hard_negatives": OP11, "op12_chat_format": OP12, "op13_periodic_runs": OP13}
