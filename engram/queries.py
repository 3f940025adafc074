"""Registered queries: each runs one operator of the engine over the whole memories table made of documents."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import render, text
from .operators import index as ix
from .operators import rank as rk
from .operators.predicates import reads_keywords, selected
from .plans import dialect as d
from .schema import EngineError
from .session import Engine
from .sources import documents
from .sources.store import Version
from .streaming.upkeep import read_heat

TEXT = "idiot clown stupid trash"
TERM = "clown"
ALL = ("main", "de", "es", "fr")
#: Scripts of registered queries.
INSERTS = "INSERT INTO memories (content, tags, source, importance) VALUES ('a new note', ' x , y,, ', 'me', 1.5); INSERT INTO memories (content) VALUES ('and one more')"
ROLLED_BACK = f"BEGIN; {INSERTS}; UPDATE memories SET source = 'changed'; DELETE FROM memories WHERE id = 1; ROLLBACK; INSERT INTO memories (content, source) VALUES ('after all', 'last')"
_INDEXES: dict[tuple[str, str], ix.Index] = {}
_ENGINES: dict[tuple[str, str], Engine] = {}


def _shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="engram-index-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def materialized(df: DataFrame) -> DataFrame:
    """A table in the shared folder: it survives lost executors."""
    path = f"{_shared(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def index_of(spark: SparkSession, sf_dir: str) -> ix.StoredIndex:
    """The index tables of a data set, each written once in an application, when a query first needs it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        _INDEXES[key] = ix.StoredIndex(documents.read(spark, sf_dir), f"{_shared(spark)}/index-{uuid.uuid4().hex}")
    return _INDEXES[key]


def _rows(s: SparkSession, p: str) -> DataFrame:
    return documents.read(s, p)


def _sql(statement: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A SELECT of the dialect over database main; it has the index only if it asks for keywords."""
    parsed = d.parse(statement)
    indexed = reads_keywords(parsed)

    def run(s: SparkSession, p: str) -> DataFrame:
        memories = index_of(s, p).memories if indexed else _rows(s, p)
        found = selected(memories.where("db = 'main'"), parsed, index_of(s, p).postings.where("db = 'main'") if indexed else None)
        return found.select(*columns) if columns else found

    return run


def _placed(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    """A SELECT without a limit, and the place of each row in its order: ranges of the order are counted one by one."""

    def run(s: SparkSession, p: str) -> DataFrame:
        rows = _sql(statement)(s, p).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
        rows = materialized(rows)  # a total order is written by ranges; numbers in a range rise with it
        starts = rows.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("low"))  # a row for each range
        before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = starts.select("range", "low", before.alias("before"))
        return rows.join(F.broadcast(starts), "range").withColumn("place", F.col("before") + F.col("at") - F.col("low")).drop("range", "at", "low", "before")

    return run


def _seed(index: ix.Index) -> int:
    return index.memories.where("db = 'main'").agg(F.min("id")).first()[0] or 0


def _weight(c: str = "weight") -> Column:
    return F.round(F.col(c).cast("double"), 4).alias(c)


def sentence_rows(s: SparkSession, p: str) -> DataFrame:
    return _rows(s, p).select("db", "id", F.posexplode(text.sentences(F.col("content"))).alias("place", "sentence"))


def jaccard_rows(s: SparkSession, p: str) -> DataFrame:
    """Each sentence of a memory against the next one; a memory's only sentence against itself."""

    def pairs(g: Column) -> Column:
        n = F.size(g)
        return F.transform(F.slice(g, F.lit(1), F.greatest(n - 1, F.lit(1))), lambda a, i: F.round(text.jaccard(a, F.get(g, F.least(i + 1, n - 1))), 4))

    grams = F.transform(text.sentences(F.col("content")), lambda x: F.array_distinct(text.char_bigrams(x)))
    found = F.flatten(F.transform(F.array(grams), pairs))  # the outer transform binds the bigrams once
    return _rows(s, p).select("db", "id", F.posexplode(found).alias("place", "jaccard"))


def parsed_tags(s: SparkSession, p: str) -> DataFrame:
    made = _rows(s, p).select("db", "id", F.concat(F.lit(" "), F.array_join("tags", " , "), F.lit(",, ")).alias("raw"))
    return made.select("db", "id", F.array_join(text.split_list(F.col("raw"), ","), "|").alias("tags"))


def engine_of(spark: SparkSession, sf_dir: str) -> Engine:
    """A store with a database for each language, loaded in bulk; made once in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENGINES:
        made = Engine(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}")
        store, rows = made.store, documents.read(spark, sf_dir).where("db IS NOT NULL AND content IS NOT NULL")
        v = store.current
        for name in sorted(r.db for r in rows.select("db").distinct().collect()):  # a row for each database
            v = v if name in v.dbs else store.create(v, name)
            v, _, _ = store.append(v, name, rows.where(F.col("db") == name).select("content", "source", "importance", "tags", "created_at"))
        store.publish(v)
        _ENGINES[key] = made
    return _ENGINES[key]


def scratch(spark: SparkSession, sf_dir: str, password: str | None = None) -> Engine:
    """Another store over the same parts, for statements that write."""
    base = engine_of(spark, sf_dir)
    made = Engine(spark, f"{_shared(spark)}/store-{uuid.uuid4().hex}", admin_password=password)
    made.store.current = made.store._write_version(Version(made.store.current.number, base.store.current.dbs))
    return made


def id_per_db(s: SparkSession, p: str) -> DataFrame:
    store = engine_of(s, p).store
    return store.read(store.current).select("db", "created_at", "id")


def _after(script: str, select: str, *columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """What a session sees after a script, of a store that holds all documents. A statement that fails ends the script."""

    def run(s: SparkSession, p: str) -> DataFrame:
        session = scratch(s, p).session()
        with contextlib.suppress(EngineError):
            session.script(script)
        rows = session.sql(select).rows
        return rows.selectExpr(*columns) if columns else rows

    return run


def drop_survivors(s: SparkSession, p: str) -> DataFrame:
    e = scratch(s, p)
    e.session().script("DROP DATABASE fr; DROP DATABASE IF EXISTS nowhere")
    return e.store.read(e.store.current).select("db", "id")


def commit_of_two(s: SparkSession, p: str) -> DataFrame:
    """One session commits after another has written: both rows stay, with ids of their own."""
    e = scratch(s, p)
    a, b = e.session(), e.session()
    a.script("BEGIN; INSERT INTO memories (content, source) VALUES ('of a transaction', 'a')")
    b.sql("INSERT INTO memories (content, source) VALUES ('at once', 'b')")
    a.sql("COMMIT")
    return b.sql("SELECT id, source FROM memories").rows


def grants_of_user(s: SparkSession, p: str) -> DataFrame:
    admin = scratch(s, p, "a long password").session()
    admin.script("CREATE USER ann IDENTIFIED BY 'another long one'; GRANT WRITE, READ ON main TO ann; GRANT ADMIN ON de TO ann; REVOKE ADMIN ON de FROM ann")
    return admin.sql("SHOW GRANTS FOR ann").rows


def session_search(s: SparkSession, p: str) -> DataFrame:
    """SEARCH over the index that the store keeps."""
    return engine_of(s, p).session().sql(f"SEARCH '{TEXT}' IN main, de, es, fr").rows.select("db", "id", "score")


def heat_rows(s: SparkSession, p: str) -> DataFrame:
    log = s.read.parquet(f"{p}/events.parquet").select("ts", F.col("user_id").alias("id"))
    total = read_heat(log).groupBy("id").agg(F.sum("heat").alias("heat"))
    return rk.hottest(total, 10)


def key_points_rows(s: SparkSession, p: str) -> DataFrame:
    return index_of(s, p).memories.select("db", "id", F.array_join("key_points", "\n").alias("key_points"))


def _expand(hops: int):
    def run(s: SparkSession, p: str) -> DataFrame:
        index = index_of(s, p)
        return rk.expand(index, rk.text_vector(s, TEXT), rk.Ranking(hops=hops)).select("db", "term", F.round("weight", 4).alias("weight"))

    return run


def bm25_rows(s: SparkSession, p: str) -> DataFrame:
    index = index_of(s, p)
    found = rk.bm25(index, rk._per_db(index, rk.text_vector(s, TEXT), None))
    return found.select("db", "id", F.round("bm25", 4).alias("bm25"))


def cosine_rows(s: SparkSession, p: str) -> DataFrame:
    index = index_of(s, p)
    found = rk.cosine(index.postings, rk.text_vector(s, TEXT))
    return found.where("cosine > 0").select("db", "id", F.round("cosine", 4).alias("cosine"))


def candidates(s: SparkSession, p: str) -> DataFrame:
    index = index_of(s, p)
    vector = rk.text_vector(s, TEXT)
    words = rk._per_db(index, vector, None).unionByName(rk.expand(index, vector)).select("db", "term").distinct()
    return index.tf.join(F.broadcast(words), ["db", "term"], "left_semi").select("db", "id").distinct()


def search_multi_db(s: SparkSession, p: str) -> DataFrame:
    return rk.search(index_of(s, p), TEXT)


def search_one_db(s: SparkSession, p: str) -> DataFrame:
    return rk.search(index_of(s, p), TEXT, dbs=["main"])


def search_materialized(s: SparkSession, p: str) -> DataFrame:
    index = index_of(s, p)
    found = rk.materialized(index, rk.search(index, TEXT, dbs=["main"]))
    return found.select("db", "id", F.format_string("%.4f", "score").alias("score"), "content", render.tags(F.col("tags")).alias("tags"), render.importance(F.col("importance")).alias("importance"))


def related_by_id(s: SparkSession, p: str) -> DataFrame:
    index = index_of(s, p)
    return rk.related(index, "main", _seed(index))


def related_cross_db(s: SparkSession, p: str) -> DataFrame:
    index = index_of(s, p)
    return rk.related(index, "main", _seed(index), dbs=[r.db for r in index.stats.select("db").collect()])


def related_two_hops(s: SparkSession, p: str) -> DataFrame:
    index = index_of(s, p)
    return rk.related(index, "main", _seed(index), rk.Ranking(hops=2), dbs=["main"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_all": lambda s, p: _rows(s, p).select("db", "id", "content", "source", "importance", "created_at"),
    "point_lookup": _sql("SELECT id, content, source FROM memories WHERE id = 2"),
    "project_star": lambda s, p: render.rendered(_rows(s, p).where("db = 'main'"), ["id", "content", "tags", "source", "importance", "created_at"]),
    "project_columns": _sql("SELECT id, source, importance, updated_at FROM memories"),
    "render_keywords": lambda s, p: render.rendered(index_of(s, p).memories.where("db = 'main'"), ["id", "keywords", "keywords_inline"]),
    "render_tags": lambda s, p: render.rendered(_rows(s, p), ["id", "tags"]),
    "render_time": lambda s, p: render.rendered(_rows(s, p).withColumn("updated_at", F.lit(-5).cast("long")), ["id", "created_at", "updated_at"]),
    "render_key_points": lambda s, p: render.rendered(index_of(s, p).memories.where("db = 'main'"), ["id", "key_points"]),
    "filter_keyword": _sql(f"SELECT id FROM memories WHERE keyword = '{TERM}'"),
    "filter_tag": _sql("SELECT id FROM memories WHERE tag = 'src7'"),
    "filter_source": _sql("SELECT id, source FROM memories WHERE source = 'src3'"),
    "filter_like": _sql("SELECT id FROM memories WHERE content LIKE '%thing%'"),
    "filter_importance_ge": _sql("SELECT id, importance FROM memories WHERE importance >= 0.7"),
    "filter_and": _sql("SELECT id FROM memories WHERE tag = 'src7' AND importance > 0.5"),
    "filter_or": _sql("SELECT id FROM memories WHERE source = 'src1' OR source = 'src2'"),
    "filter_not": _sql("SELECT id FROM memories WHERE NOT tag = 'src7'"),
    "filter_mixed_index_scan": _sql(f"SELECT id FROM memories WHERE keyword = '{TERM}' AND (content LIKE '%the%' OR NOT source = 'src1')"),
    "order_importance_desc_limit": _sql("SELECT id, importance FROM memories ORDER BY importance DESC LIMIT 20"),
    "order_created_asc": _placed("SELECT id, created_at FROM memories ORDER BY created_at"),
    "keyword_weight_order": _placed(f"SELECT id FROM memories WHERE keyword = '{TERM}'"),
    "insert_parse_tags": parsed_tags,
    "id_per_db": id_per_db,
    "insert_rows": _after(INSERTS, "SELECT id, content, source, importance, tags FROM memories", "id", "content", "source", "importance", "array_join(tags, '|') tags"),
    "update_importance": _after("UPDATE memories SET importance = 1.5 WHERE source = 'src7'", "SELECT id, importance FROM memories"),
    "update_tags": _after("UPDATE memories SET tags = 'good, kept' WHERE importance >= 0.7", "SELECT id, tags FROM memories", "id", "array_join(tags, '|') tags"),
    "delete_by_keyword": _after(f"DELETE FROM memories WHERE keyword = '{TERM}'", "SELECT id FROM memories"),
    "create_database": _after("CREATE DATABASE fresh; CREATE DATABASE IF NOT EXISTS main", "SHOW DATABASES"),
    "drop_database_survivors": drop_survivors,
    "commit_of_two": commit_of_two,
    "rollback_survivors": _after(ROLLED_BACK, "SELECT id, source FROM memories"),
    "script_until_error": _after(f"{INSERTS}; USE nowhere; DELETE FROM memories WHERE id = 1", "SELECT id FROM memories"),
    "show_tables": lambda s, p: engine_of(s, p).session().sql("SHOW TABLES").rows,
    "grants_of_user": grants_of_user,
    "session_search": session_search,
    "tokenize": lambda s, p: _rows(s, p).select("db", "id", F.array_join(text.tokens(F.col("content")), " ").alias("tokens")),
    "term_counts": lambda s, p: text.term_counts(_rows(s, p), ["db", "id"]),
    "keywords_top16": lambda s, p: ix.postings(index_of(s, p).memories).select("db", "id", "term", _weight()),
    "sentences": sentence_rows,
    "bigrams": lambda s, p: _rows(s, p).select("db", "id", F.array_join(text.char_bigrams(F.col("content")), "|").alias("bigrams")),
    "jaccard": jaccard_rows,
    "key_points": key_points_rows,
    "tag_index": lambda s, p: ix.tag_index(index_of(s, p).memories),
    "corpus_stats": lambda s, p: index_of(s, p).stats.select("db", "n", F.round("avgdl", 4).alias("avgdl")),
    "doc_lengths": lambda s, p: index_of(s, p).lengths,
    "doc_freq": lambda s, p: index_of(s, p).df,
    "idf": lambda s, p: ix.idf(index_of(s, p).df, index_of(s, p).stats).select("db", "term", F.round("idf", 4).alias("idf")),
    "bm25": bm25_rows,
    "cooc_edges": lambda s, p: ix.cooccurrence(index_of(s, p).postings),
    "expand_hop1": _expand(1),
    "expand_hop2": _expand(2),
    "candidates": candidates,
    "cosine": cosine_rows,
    "search_one_db": search_one_db,
    "search_multi_db": search_multi_db,
    "related_by_id": related_by_id,
    "related_by_text": lambda s, p: rk.search(index_of(s, p), TEXT + " moron", dbs=["main"]),
    "related_cross_db": related_cross_db,
    "related_two_hops": related_two_hops,
    "search_materialized": search_materialized,
    "all_terms": lambda s, p: rk.all_terms(index_of(s, p), "main"),
    "search_by_keyword": lambda s, p: rk.by_keyword(index_of(s, p), "main", TERM, 10).select("id", "term", _weight()),
    "hot_top_n": heat_rows,
    "show_databases": lambda s, p: engine_of(s, p).session().sql("SHOW DATABASES").rows,
}
