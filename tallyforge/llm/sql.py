"""The contract queries in SQL, where SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"
_ROOTS = """
reach AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e UNION SELECT r.x, f.y FROM reach r JOIN (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e) f ON r.y = f.x)"""

# Bytes as hex digits; texts are cut into overlapping pieces first, since cutting a window from a long text reads all of it.
OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, o, substr(h, 2 * o + 1, 2 * 2099) AS x FROM (SELECT *, unnest(range(0, n, 2000)) AS o FROM d)),
w AS (SELECT doc_id, o + j AS s, substr(x, 2 * j + 1, 200) AS x FROM (SELECT *, unnest(range(0, least(2000, n - o - 99))) AS j FROM p)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM (SELECT *, (s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) > 100)::INT AS fresh FROM r)),
i AS (SELECT doc_id, i, min(s) AS a, max(s) + 100 AS b FROM g GROUP BY 1, 2),
k AS (SELECT doc_id, coalesce(lag(b) OVER q, 0) AS f, a AS t FROM i WINDOW q AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT d.doc_id, coalesce(m.b, 0), n FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM i GROUP BY 1) m USING (doc_id)),
t AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS x FROM k JOIN d USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM i GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM m),
b AS (SELECT *, ((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (100 * n_symbols > 10 * n_words)::INT
  + 8 * (100 * n_dup_lines > 30 * len(l))::INT + 16 * (word_chars > 25 * n_words)::INT + 32 * (100 * n_upper > 50 * word_chars)::INT)::BIGINT AS fail_bits FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n p1 ON p1.doc_id = a JOIN n p2 ON p2.doc_id = b WHERE 100 * c >= 85 * (p1.n + p2.n - c)),{_ROOTS}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = d.doc_id), d.doc_id))::BIGINT AS component_id FROM d LEFT JOIN n USING (doc_id)
"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ([1.0, 2.0, 3.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s0),
s2 AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN share <= ratio THEN first_value(share) OVER (ORDER BY share > ratio, ratio, k) * w ELSE cap END AS target FROM s3),
q0 AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r,
  (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
q1 AS (SELECT *, floor(r) AS whole, r - floor(r) AS f FROM q0),
q2 AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS q FROM q1),
q3 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM q2)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (whole * size + CASE WHEN q IS NULL THEN 0 ELSE greatest(0, least(size, round(target - whole * source_size)::BIGINT - upto)) END)::BIGINT AS taken FROM q3
"""

OP5 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.98),{_ROOTS},
n AS (SELECT x, count(*) AS n FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e) GROUP BY x), c AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.c, vec_id))::BIGINT AS component_id, vec_id = least(vec_id, coalesce(c.c, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id
"""

OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM p
"""

OP7 = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + 12 + CASE WHEN regexp_matches(text, '<\||\[/?INST\]|</?s>') THEN 4 + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<\||\[/?INST\]|</?s>')) ELSE 0 END)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

#: Kind, pattern, group whose length counts, least length, side. The key kind is a run whose characters are checked after.
_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("ident", r"""(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}|(?i:client_?id|access_?id|user_?name|account)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._-]{4,}""", 0, 0),
    ("key", "[A-Za-z0-9+/_=-]+", 0, 24),
    ("endpoint", r"""(?:https?|s3|postgres|mysql|mongodb|redis)://[^\x20\x09-\x0D"''<>]{4,}""", 0, 0),
)
_FOUND = "\nUNION ALL ".join(
    f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, e - length(m) AS s, e, m FROM (
  SELECT doc_id, m, g, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (
  SELECT doc_id, i, p[i] AS gap, ms[i] AS m, gs[i] AS g FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (
  SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS gs FROM d WHERE regexp_matches(t, '{pattern}'))))) WHERE length(g) >= {least}"""
    for rank, (kind, pattern, group, least) in enumerate(_KINDS)
)
_LISTED = "kind || ':' || s::BIGINT || ':' || e::BIGINT"

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED (SELECT * FROM ({_FOUND}) WHERE kind <> 'key' OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]'))),
o AS (SELECT *, CASE WHEN kind IN ('access', 'ident') THEN 'id' WHEN kind IN ('assign', 'hex', 'key') THEN 'key' END AS side FROM f),
weak AS (SELECT doc_id, rank, kind, s, e, unnest(CASE kind WHEN 'ident' THEN ['key'] WHEN 'key' THEN ['id'] ELSE ['id', 'key'] END) AS need FROM f WHERE kind IN ('ident', 'key', 'endpoint')),
met AS (SELECT doc_id, rank, kind, s, e, bool_and(EXISTS (SELECT 1 FROM o WHERE o.doc_id = weak.doc_id AND o.side = need AND abs(o.s - weak.s) <= 200)) AS ok FROM weak GROUP BY ALL),
linked AS (SELECT doc_id, rank, kind, s, e FROM met GROUP BY ALL HAVING bool_and(ok)),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, string_agg({_LISTED}, ',' ORDER BY s, rank) AS l FROM f WHERE rank < 3 GROUP BY doc_id),
x AS (SELECT doc_id, string_agg({_LISTED}, ',' ORDER BY s, rank, e) AS l FROM (SELECT doc_id, rank, kind, s, e FROM f WHERE rank < 3 UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(b.l, '')) AS base_sha256, coalesce(x.l, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
hit AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT word.doc_id, count(gone.p) AS removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

#: The byte table of CRC-32.
_CRC = """tab AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i))"""


def _crc(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, from the byte table of ``_CRC``."""
    return f"""xor(list_reduce(list_transform(range(strlen({text})), lambda j: ('0x' || substr(hex({text}), 2 * j + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""

def _low(text: str) -> str:
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP11 = f"""
WITH RECURSIVE {_CRC},
r AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_low('text')}, '[A-Za-zÀ-ÿ]+')) AS x FROM documents) WHERE length(x) >= 6 GROUP BY ALL),
h AS (SELECT x, c, {_crc('s')} AS h FROM (SELECT *, concat(doc_id, ':', x) AS s FROM r), tab),
t AS (SELECT CASE WHEN h % 199 = 0 THEN substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
k AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT *, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT a.word AS a, b.word AS b, b.n FROM k a JOIN k b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.s = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.s = w.word),
m AS (SELECT a AS word, count(*) AS n_near, max(n) AS most, arg_min(b, struct_pack(x := -n, y := b)) AS best FROM e GROUP BY a),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 5 * n THEN best END AS form, CASE WHEN most >= 5 * n THEN most END::BIGINT AS form_n FROM w LEFT JOIN m USING (word)),
z AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON z.nxt = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word AND z.nxt IS NULL
"""

OP12 = f"""
WITH {_CRC},
d AS (SELECT doc_id, regexp_extract_all({_low('text')}, '[^\\x00-/:-`{{-\\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_low('text')}, '[^\\x00-/:-`{{-\\x7F]+') AS w FROM benchmark),
f AS MATERIALIZED (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d) GROUP BY ALL),
g AS (SELECT g, count(*) AS c FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM b) GROUP BY g),
k AS MATERIALIZED (SELECT g, {_crc('g')} % 10000 AS k FROM (SELECT DISTINCT g FROM (SELECT g FROM f UNION ALL SELECT g FROM g)), tab),
s AS (SELECT k, sum(c) AS s FROM f JOIN k USING (g) GROUP BY k),
t AS (SELECT k, sum(c) AS t FROM g JOIN k USING (g) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (k)),
w AS (SELECT doc_id, sum(c)::BIGINT AS n, sum(c * gain)::BIGINT AS x FROM f JOIN k USING (g) JOIN gain USING (k) GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (x - (x % n + n) % n) // n ELSE 0 END AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
x AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE)))::BIGINT AS score FROM m),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 39)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""

ORACLE_SQL = {"op1_suffix_dedup": OP1, "op2_quality_rules": OP2, "op3_jaccard_join": OP3, "op4_source_mix": OP4, "op5_embedding_dedup": OP5, "op6_warc": OP6, "op7_chat_format": OP7, "op8_secret_scan": OP8, "op9_substring_dedup": OP9, "op11_spelling_variants": OP11, "op12_importance_resampling": OP12}
