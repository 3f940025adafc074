"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from .functions.stopwords import ENGLISH
from .functions.text import VISIBLE
from .queries import ALL, TERM, TEXT

_STOP = ", ".join(f"'{w}'" for w in ENGLISH)
_WORD = r"[a-zA-Z0-9]+(?:\.[0-9]+)?%?"
_ENDS, _CLOSE = "。！？.!?;；\n", "\"”''’)）.。！？"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(12288)"


def _tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '{_WORD}'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ({_STOP}))"


def _scores(counts: str, keys: str) -> str:
    """The 16 best terms of each key with weights."""
    return f"""
      SELECT {keys}, term, raw / max(raw) OVER (PARTITION BY {keys}) weight, r FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY raw DESC, term) r FROM (
          SELECT *, (1 + ln(CAST(tf AS DOUBLE))) * (1 + 0.12::DOUBLE * least(greatest(length(term) - 2, 0), 6)) raw FROM {counts}))
      WHERE r <= 16"""


MEM = """mem AS (
  SELECT CASE WHEN lang = 'en' THEN 'main' ELSE lang END db, doc_id + 1 id, text content, source, [lang, source] tags,
    CAST(CASE WHEN l.doc_id IS NULL THEN 0.5 ELSE 0.2::DOUBLE + 0.6::DOUBLE * quality - 0.1::DOUBLE * toxic END AS FLOAT) importance,
    1704067200000 + d.doc_id * 60000 created_at
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY 1) l USING (doc_id)
)"""
TF = f"""{MEM}, tf AS (
  SELECT db, id, term, count(*) tf FROM (SELECT db, id, unnest({_tokens("content")}) term FROM mem) GROUP BY 1, 2, 3
), kw AS (SELECT db, id, term, CAST(weight AS FLOAT) weight, weight full_weight, r FROM ({_scores("tf", "db, id")}))"""
INDEX = f"""{TF}, dl AS (SELECT m.db, m.id, CAST(coalesce(sum(tf), 0) AS BIGINT) dl FROM mem m LEFT JOIN tf t ON t.db = m.db AND t.id = m.id GROUP BY 1, 2
), stats AS (SELECT db, count(*) n, greatest(avg(dl), 1.1920929e-07) avgdl FROM dl GROUP BY 1
), df AS (SELECT db, term, count(*) df FROM tf GROUP BY 1, 2
), idf AS (SELECT d.db, term, df, greatest(0, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)) idf FROM df d JOIN stats s ON s.db = d.db
), cooc AS (SELECT a.db, a.term, b.term other, count(*) cnt FROM kw a JOIN kw b ON a.db = b.db AND a.id = b.id AND a.term <> b.term GROUP BY 1, 2, 3)"""


def _text_seeds(text: str) -> str:
    return f"""seeds AS (SELECT term, weight FROM ({_scores("(SELECT 0 q, term, count(*) tf FROM (SELECT unnest(" + _tokens(f"'{text}'") + ") term) GROUP BY 2)", "q")}))"""


_ID = "(SELECT min(id) FROM mem WHERE db = 'main')"
_ID_SEEDS = f"seeds AS (SELECT term, CAST(weight AS DOUBLE) weight FROM kw WHERE db = 'main' AND id = {_ID})"


def _expanded(seeds: str, dbs: tuple[str, ...], hops: int = 1) -> str:
    inside = "db IN (" + ", ".join(f"'{x}'" for x in dbs) + ")"
    hop = lambda source, factor: f"""
      SELECT c.db, c.other term, sum(f.weight * c.cnt / greatest(coalesce(d.df, 1), 1) * {factor}::DOUBLE) weight
      FROM {source} f JOIN cooc c ON c.db = f.db AND c.term = f.term LEFT JOIN df d ON d.db = c.db AND d.term = c.term
      WHERE c.other NOT IN (SELECT term FROM seeds) GROUP BY 1, 2"""  # noqa: E731
    steps = f"hop1 AS ({hop('per_db', 0.5)})" + (f", hop2 AS ({hop('hop1', 0.25)})" if hops == 2 else "")
    both = "SELECT * FROM hop1" + (" UNION ALL SELECT * FROM hop2" if hops == 2 else "")
    return f"""WITH {INDEX}, {seeds}, per_db AS (SELECT db, term, weight FROM stats, seeds WHERE {inside}), {steps}, wide AS (
      SELECT db, term, weight FROM (
        SELECT db, term, weight, row_number() OVER (PARTITION BY db ORDER BY weight DESC, term) r
        FROM (SELECT db, term, sum(weight) weight FROM ({both}) GROUP BY 1, 2))
      WHERE r <= 8)"""


_BM25 = """SELECT t.db, t.id, sum(q.weight * i.idf * t.tf * 2.2::DOUBLE / (t.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * greatest(l.dl, 1) / s.avgdl))) bm25
  FROM tf t JOIN query q ON q.db = t.db AND q.term = t.term JOIN idf i ON i.db = t.db AND i.term = t.term
  JOIN dl l ON l.db = t.db AND l.id = t.id JOIN stats s ON s.db = t.db GROUP BY 1, 2"""
_COSINE = """SELECT k.db, k.id, least(greatest(sum(CAST(k.weight AS DOUBLE) * coalesce(s.weight, 0)) / (sqrt(sum(CAST(k.weight AS DOUBLE) * CAST(k.weight AS DOUBLE))) * (SELECT sqrt(sum(weight * weight)) FROM seeds)), 0), 1) cosine
  FROM kw k LEFT JOIN seeds s ON s.term = k.term GROUP BY 1, 2"""


def _ranked(seeds: str, dbs: tuple[str, ...], hops: int = 1, without: str = "true") -> str:
    return f"""{_expanded(seeds, dbs, hops)}, query AS (SELECT * FROM per_db UNION ALL SELECT * FROM wide
    ), bm25 AS ({_BM25}), near AS ({_COSINE}), ranked AS (
      SELECT b.db, b.id, round(bm25 + 0.5::DOUBLE * coalesce(cosine, 0), 4) score FROM bm25 b LEFT JOIN near n ON n.db = b.db AND n.id = b.id
      WHERE {without} ORDER BY score DESC, b.db, b.id LIMIT 10)"""


_NOT_SEED = f"NOT (b.db = 'main' AND b.id = {_ID})"
_SENTENCES = f"list_filter(list_transform(regexp_extract_all(content, '[^{_ENDS}]*(?:[{_ENDS}][{_CLOSE}]*|$)'), lambda x: trim(x, {_SPACE})), lambda x: x <> '')"


def _bigrams(x: str) -> str:
    chars = f"regexp_extract_all({x}, '{VISIBLE}')"
    return f"CASE WHEN len({chars}) < 2 THEN {chars} ELSE list_transform(list_zip({chars}[1:-2], {chars}[2:]), lambda z: z[1] || z[2]) END"


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({_bigrams(a)})", f"list_distinct({_bigrams(b)})"
    return f"coalesce(CAST(len(list_intersect({x}, {y})) AS DOUBLE) / nullif(len(list_distinct(list_concat({x}, {y}))), 0), 0)"


_POINTS = f"""WITH {TF}, sentences AS (
  SELECT db, id, unnest({_SENTENCES}) s, generate_subscripts({_SENTENCES}, 1) - 1 place FROM mem
), totals AS (SELECT db, id, sum(full_weight) total FROM kw GROUP BY 1, 2
), hits AS (
  SELECT s.db, s.id, s.place, s.s, sum(full_weight ORDER BY r) hit FROM sentences s JOIN kw k ON k.db = s.db AND k.id = s.id AND contains(s.s, k.term) GROUP BY 1, 2, 3, 4
), scored AS (
  SELECT h.*, 0.60::DOUBLE * least(hit / total, 1) + 0.25::DOUBLE / (1 + 0.08::DOUBLE * place) + 0.15::DOUBLE * exp(-(length(s) - 40) * (length(s) - 40) / 1250.0::DOUBLE) score
  FROM hits h JOIN totals t ON t.db = h.db AND t.id = h.id
), sorted AS (SELECT db, id, list({{'place': place, 's': s}} ORDER BY score DESC, place) c FROM scored GROUP BY 1, 2
), chosen AS (
  SELECT db, id, list_reduce(list_transform(c, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 3 AND len(list_filter(acc, lambda a: {_jaccard("a.s", "x[1].s")} > 0.75)) = 0
    THEN list_concat(acc, x) ELSE acc END) c FROM sorted
), points AS (
  SELECT m.db, m.id, coalesce(list_transform(list_sort(c), lambda x: left(x.s, 140)), []) p FROM mem m LEFT JOIN chosen c ON c.db = m.db AND c.id = m.id)"""


def _mem(select: str, rest: str = "") -> str:
    return f"WITH {MEM} SELECT {select} FROM mem {rest}"


#: Rows as the store numbers them.
STORED = f"{MEM}, stored AS (SELECT * EXCLUDE (id), row_number() OVER (PARTITION BY db ORDER BY created_at, content) id FROM mem), own AS (SELECT * FROM stored WHERE db = 'main'), top AS (SELECT max(id) n FROM own)"


def _own(select: str, where: str = "true", more: str = "") -> str:
    """Rows of main in the store, and further ones."""
    return f"WITH {STORED} SELECT {select} FROM own WHERE {where} {more}"


def _main(select: str, where: str = "true", tail: str = "") -> str:
    return _mem(select, f"WHERE db = 'main' AND ({where}) {tail}")


_HAS = f"id IN (SELECT id FROM kw WHERE db = 'main' AND term = '{TERM}')"
_TIME = "strftime(epoch_ms(created_at), '%Y-%m-%d %H:%M:%S')"

ORACLES: dict[str, str] = {
    "scan_all": _mem("db, id, content, source, importance, created_at"),
    "point_lookup": _main("id, content, source", "id = 2"),
    "project_star": _main(f"CAST(id AS VARCHAR) id, content, array_to_string(tags, ', ') tags, source, printf('%.2f', importance) importance, {_TIME} created_at"),
    "project_columns": _main("id, source, importance, created_at updated_at"),
    "render_keywords": f"""WITH {TF} SELECT CAST(m.id AS VARCHAR) id, coalesce(string_agg(term || '(' || printf('%.2f', round(CAST(weight AS DOUBLE), 2)) || ')', ', ' ORDER BY r), '') keywords,
      coalesce(string_agg(term, ', ' ORDER BY r), '') keywords_inline FROM mem m LEFT JOIN kw k ON k.db = m.db AND k.id = m.id WHERE m.db = 'main' GROUP BY m.id""",
    "render_tags": _mem("CAST(id AS VARCHAR) id, array_to_string(tags, ', ') tags"),
    "render_time": _mem(f"CAST(id AS VARCHAR) id, {_TIME} created_at, '-' updated_at"),
    "render_key_points": f"{_POINTS} SELECT CAST(id AS VARCHAR) id, array_to_string(list_transform(p, lambda x: '• ' || x), chr(10)) key_points FROM points WHERE db = 'main'",
    "filter_keyword": f"WITH {TF} SELECT id FROM mem WHERE db = 'main' AND {_HAS}",
    "filter_tag": _main("id", "list_contains(tags, 'src7')"),
    "filter_source": _main("id, source", "source = 'src3'"),
    "filter_like": _main("id", "contains(content, 'thing')"),
    "filter_importance_ge": _main("id, importance", "importance >= CAST(0.7 AS FLOAT)"),
    "filter_and": _main("id", "list_contains(tags, 'src7') AND importance > CAST(0.5 AS FLOAT)"),
    "filter_or": _main("id", "source IN ('src1', 'src2')"),
    "filter_not": _main("id", "NOT list_contains(tags, 'src7')"),
    "filter_mixed_index_scan": f"WITH {TF} SELECT id FROM mem WHERE db = 'main' AND {_HAS} AND (contains(content, 'the') OR source <> 'src1')",
    "order_importance_desc_limit": _main("id, importance", tail="ORDER BY importance DESC, id DESC LIMIT 20"),
    "order_created_asc": _main("id, created_at, row_number() OVER (ORDER BY created_at, id) - 1 place"),
    "keyword_weight_order": f"WITH {TF} SELECT id, row_number() OVER (ORDER BY weight DESC, id) - 1 place FROM kw WHERE db = 'main' AND term = '{TERM}'",
    "insert_parse_tags": _mem("db, id, array_to_string(tags, '|') tags"),
    "id_per_db": f"WITH {STORED} SELECT db, created_at, id FROM stored",
    "insert_rows": _own("id, content, source, importance, array_to_string(tags, '|') tags", more="""
      UNION ALL SELECT n + 1, 'a new note', 'me', CAST(1 AS FLOAT), 'x|y' FROM top UNION ALL SELECT n + 2, 'and one more', 'sql', CAST(0.5 AS FLOAT), '' FROM top"""),
    "update_importance": _own("id, CASE WHEN source = 'src7' THEN CAST(1 AS FLOAT) ELSE importance END importance"),
    "update_tags": _own("id, CASE WHEN importance >= CAST(0.7 AS FLOAT) THEN 'good|kept' ELSE array_to_string(tags, '|') END tags"),
    "delete_by_keyword": f"""WITH {TF}, stored AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY created_at, content) rid FROM mem)
      SELECT rid id FROM stored WHERE db = 'main' AND NOT ({_HAS})""",
    "create_database": _mem("DISTINCT db AS database", "UNION SELECT 'fresh'"),
    "drop_database_survivors": f"WITH {STORED} SELECT db, id FROM stored WHERE db <> 'fr'",
    "commit_of_two": _own("id, source", more="UNION ALL SELECT n + 1, 'a' FROM top UNION ALL SELECT n + 2, 'b' FROM top"),
    "rollback_survivors": _own("id, source", more="UNION ALL SELECT n + 3, 'last' FROM top"),
    "script_until_error": _own("id", more="UNION ALL SELECT n + 1 FROM top UNION ALL SELECT n + 2 FROM top"),
    "show_tables": "SELECT 'memories' AS \"table\"",
    "grants_of_user": "SELECT 'GRANT READ, WRITE ON main TO ann' AS \"grant\"",
    "session_search": f"""{_ranked(_text_seeds(TEXT), ALL)}, stored AS (SELECT db, id, row_number() OVER (PARTITION BY db ORDER BY created_at, content) rid FROM mem)
      SELECT r.db, s.rid id, r.score FROM ranked r JOIN stored s ON s.db = r.db AND s.id = r.id""",
    "tokenize": _mem(f"db, id, coalesce(array_to_string({_tokens('content')}, ' '), '') tokens"),
    "term_counts": f"WITH {TF} SELECT * FROM tf",
    "keywords_top16": f"WITH {TF} SELECT db, id, term, round(CAST(weight AS DOUBLE), 4) weight FROM kw",
    "sentences": _mem(f"db, id, CAST(generate_subscripts({_SENTENCES}, 1) - 1 AS INTEGER) place, unnest({_SENTENCES}) sentence"),
    "bigrams": _mem(f"db, id, coalesce(array_to_string({_bigrams('content')}, '|'), '') bigrams"),
    "jaccard": f"""WITH {MEM}, grams AS (SELECT db, id, list_transform({_SENTENCES}, lambda x: list_distinct({_bigrams('x')})) g FROM mem
      ), pairs AS (SELECT db, id, i, g[i] a, g[least(i + 1, len(g))] b FROM (SELECT db, id, g, unnest(range(1, greatest(len(g), 2))) i FROM grams WHERE len(g) > 0))
      SELECT db, id, CAST(i - 1 AS INTEGER) place, round(coalesce(CAST(len(list_intersect(a, b)) AS DOUBLE) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 4) jaccard FROM pairs""",
    "key_points": f"{_POINTS} SELECT db, id, coalesce(array_to_string(p, chr(10)), '') key_points FROM points",
    "tag_index": _mem("DISTINCT db, unnest(tags) tag, id"),
    "corpus_stats": f"WITH {INDEX} SELECT db, n, round(avgdl, 4) avgdl FROM stats",
    "doc_lengths": f"WITH {INDEX} SELECT * FROM dl",
    "doc_freq": f"WITH {INDEX} SELECT * FROM df",
    "idf": f"WITH {INDEX} SELECT db, term, round(idf, 4) idf FROM idf",
    "bm25": f"WITH {INDEX}, {_text_seeds(TEXT)}, query AS (SELECT db, term, weight FROM stats, seeds), bm25 AS ({_BM25}) SELECT db, id, round(bm25, 4) bm25 FROM bm25",
    "cooc_edges": f"WITH {INDEX} SELECT * FROM cooc",
    "expand_hop1": f"{_expanded(_text_seeds(TEXT), ALL)} SELECT db, term, round(weight, 4) weight FROM wide",
    "expand_hop2": f"{_expanded(_text_seeds(TEXT), ALL, 2)} SELECT db, term, round(weight, 4) weight FROM wide",
    "candidates": f"{_expanded(_text_seeds(TEXT), ALL)} SELECT DISTINCT t.db, t.id FROM tf t JOIN (SELECT db, term FROM per_db UNION SELECT db, term FROM wide) q ON q.db = t.db AND q.term = t.term",
    "cosine": f"WITH {INDEX}, {_text_seeds(TEXT)}, near AS ({_COSINE}) SELECT db, id, round(cosine, 4) cosine FROM near WHERE cosine > 0",
    "search_one_db": f"{_ranked(_text_seeds(TEXT), ('main',))} SELECT * FROM ranked",
    "search_multi_db": f"{_ranked(_text_seeds(TEXT), ALL)} SELECT * FROM ranked",
    "related_by_id": f"{_ranked(_ID_SEEDS, ('main',), without=_NOT_SEED)} SELECT * FROM ranked",
    "related_by_text": f"{_ranked(_text_seeds(TEXT + ' moron'), ('main',))} SELECT * FROM ranked",
    "related_cross_db": f"{_ranked(_ID_SEEDS, ALL, without=_NOT_SEED)} SELECT * FROM ranked",
    "related_two_hops": f"{_ranked(_ID_SEEDS, ('main',), 2, _NOT_SEED)} SELECT * FROM ranked",
    "search_materialized": f"""{_ranked(_text_seeds(TEXT), ('main',))} SELECT r.db, r.id, printf('%.4f', score) score, content, array_to_string(tags, ', ') tags,
      printf('%.2f', importance) importance FROM ranked r JOIN mem m ON m.db = r.db AND m.id = r.id""",
    "all_terms": f"WITH {TF} SELECT term, count(*) n FROM kw WHERE db = 'main' GROUP BY 1",
    "search_by_keyword": f"WITH {TF} SELECT id, term, round(CAST(weight AS DOUBLE), 4) weight FROM kw WHERE db = 'main' AND term = '{TERM}' ORDER BY kw.weight DESC, id LIMIT 10",
    "hot_top_n": "SELECT user_id id, count(*) heat FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "show_databases": _mem("DISTINCT db AS database"),
}
