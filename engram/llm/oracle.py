"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .quality_rules import POLICIES, RULES, mask

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) n FROM shingles GROUP BY 1
), shared AS (
  SELECT a.doc_id a, b.doc_id b, count(*) c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id other FROM sizes UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), lowest AS (SELECT doc_id, min(other) m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) n_shingles, coalesce(m, d.doc_id) component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.doc_id = d.doc_id
"""

_BITS = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(RULES))
_BOOK = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') t, {_WORDS} w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) i FROM words WHERE len(w) >= 5)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) c FROM windows) WHERE c > 1
), covered AS (SELECT doc_id, count(DISTINCT i + k) n FROM twice, (VALUES (0), (1), (2), (3), (4)) v(k) GROUP BY 1
), lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM words
), dups AS (
  SELECT doc_id, sum(c - 1) n FROM (SELECT doc_id, x, count(*) c FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1, 2) GROUP BY 1
), measured AS (
  SELECT w.doc_id, len(w) n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) n_dup_lines, coalesce(c.n, 0) n_repeat_words,
    len(string_split(t, chr(10))) n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) n_lower,
    length(regexp_replace(t, '[^!]', '', 'g')) n_bangs
  FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN dups d ON d.doc_id = w.doc_id
), book AS (SELECT *, CAST({_BITS} AS BIGINT) failed FROM measured)
"""
OP4 = rf"""{_BOOK}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
  failed & {mask(("too_few_words", "repeats_windows"))} <> 0 base_failed, failed & {mask(POLICIES["v3"])} = 0 kept
FROM book
"""
_WANT = mask(POLICIES["v3"])
ABLATION = rf"""{_BOOK}
SELECT rule, count(*) FILTER (WHERE (failed & bit) <> 0) n_failed, count(*) FILTER (WHERE (failed & {_WANT}) = bit) n_only,
  count(*) FILTER (WHERE (failed & {_WANT} & ~bit) = 0) n_kept_without
FROM book, (VALUES {", ".join(f"('{r.name}', CAST({1 << i} AS BIGINT))" for i, r in enumerate(RULES))}) v(rule, bit) GROUP BY 1
"""

OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i FROM documents
), keyed AS (SELECT *, {_LOWER.format(f"trim(x, {_SPACE})")} k FROM lines
), shared AS (SELECT k, min(doc_id) first FROM keyed WHERE length(k) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2
), marked AS (SELECT l.*, s.first IS NOT NULL AND l.doc_id <> s.first gone FROM keyed l LEFT JOIN shared s ON s.k = l.k)
SELECT doc_id, count(*) n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) kept_sha256
FROM marked GROUP BY 1
"""

_HASH = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
OP6 = rf"""
WITH n AS (SELECT greatest(64, count(*) // 50000) salts FROM documents
), graded AS (
  SELECT doc_id, source, len({_WORDS}) size, {_HASH.format("'0 ' || coalesce(CAST(doc_id AS VARCHAR), '')")} % (SELECT salts FROM n) salt FROM documents
), sized AS (
  SELECT *, CASE WHEN salt % 2 = 1 THEN 9999 - g ELSE g END class, CASE WHEN salt % 2 = 1 THEN -size ELSE size END rising
  FROM (SELECT *, length(bin(size)) * 16 + CAST('0b' || substr(bin(size), 1, 4) AS INTEGER) g FROM graded)
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM sized GROUP BY 1
), weighed AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS BIGINT) weight, source_size * 3 cap FROM sizes
), levels AS (
  SELECT *, row_number() OVER up turn, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS BIGINT) rest,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) shares
  FROM weighed
  WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source),
    before AS (ORDER BY CAST(cap AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (SELECT * FROM levels WHERE cap * shares >= weight * rest ORDER BY turn LIMIT 1
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.turn < c.turn THEN CAST(l.cap AS DOUBLE)
    ELSE least(CAST(l.cap AS DOUBLE), CAST(c.rest AS DOUBLE) * l.weight / c.shares) END target,
    {_HASH.format("'0 offset ' || coalesce(l.source, 'null source')")} / 4294967296.0::DOUBLE o
  FROM levels l, chosen c
), ranked AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.o, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END rate,
    row_number() OVER (PARTITION BY d.source ORDER BY class, salt, rising, doc_id) r
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(o + r * rate) - floor(o + (r - 1) * rate) AS BIGINT) * size taken FROM ranked
"""

OP7 = rf"""
WITH words AS (SELECT doc_id, {_WORDS} w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) i FROM words WHERE len(w) >= 20)
), late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) r FROM windows) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(20) v(k)
), places AS (SELECT doc_id, unnest(w) x, generate_subscripts(w, 1) i FROM words
), kept AS (
  SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL) t, count(g.i) n
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY 1
)
SELECT w.doc_id, len(w) n_words, coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

OP9 = f"""
WITH plain AS (
  SELECT doc_id, length(coalesce(text, '')) n, sha256(translate(coalesce(text, ''), {_SPACE}, '')) text_sha256 FROM documents
), best AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) keep_id, count(*) OVER (PARTITION BY text_sha256) group_size
  FROM plain
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 FROM best
"""

OP10 = """
SELECT conv_id, turn, CAST(0 AS INTEGER) part, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) rendered
FROM conversations
"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard": OP2,
    "op4_quality_rules": OP4,
    "ablation_of_rules": ABLATION,
    "op5_line_dedup": OP5,
    "op6_mixing": OP6,
    "op7_substring_dedup": OP7,
    "op9_exact_dedup": OP9,
    "op10_chat_format": OP10,
}
