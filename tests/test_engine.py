import math
import re

import pytest
from pyspark.sql import functions as F

from engram.config import from_toml
from engram.functions import render, text
from engram.operators import index as ix
from engram.operators import rank as rk
from engram.schema import EngineError
from engram.session import Engine

CONTENTS = [
    ("Rust 的所有权与借用检查在编译期保证内存安全", "rust, lang", 0.9),
    ("今天学习了 Rust 的生命周期标注,理解了借用检查如何防止悬垂引用", "rust, study", 0.5),
    ("MySQL 使用 B+ 树作为索引结构,页是存储的基本单位", "db, mysql", 0.7),
]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", admin_password="long enough")
    with e.session() as s:
        for content, tags, importance in CONTENTS:
            s.sql(f"INSERT INTO memories (content, tags, importance) VALUES ('{content}', '{tags}', {importance})")
    return e


def ids(result):
    return [r[0] for r in result.rows.select("id").collect()]


def test_filters_and_order(engine):
    s = engine.session()
    assert sorted(ids(s.sql("SELECT id FROM memories WHERE keyword = 'rust'"))) == [1, 2]
    assert ids(s.sql("SELECT id FROM memories WHERE keyword = 'Rust'")) == []
    assert ids(s.sql("SELECT id FROM memories WHERE tag = 'mysql'")) == [3]
    assert ids(s.sql("SELECT id FROM memories WHERE content LIKE '%生命周期%' AND importance >= 0.5")) == [2]
    top = s.sql("SELECT importance FROM memories ORDER BY importance DESC LIMIT 1")
    assert [r[0] for r in top.rendered().collect()] == ["0.90"]


def test_search_related_and_heat(engine):
    s = engine.session()
    found = [(r.db, r.id) for r in s.sql("SEARCH 'rust' LIMIT 5").rows.collect()]
    assert {("main", 1), ("main", 2)} == set(found)
    assert 1 not in ids(s.sql("RELATED TO 1"))
    assert s.sql("SEARCH 'the of and'").affected == 0
    with pytest.raises(EngineError):
        s.sql("RELATED TO 99")
    with pytest.raises(EngineError):
        s.sql("SEARCH 'rust' IN nowhere")
    assert s.sql("SHOW HOT LIMIT 1").rows.count() == 1


def test_heat_counts_what_was_read(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    s = e.session()
    for i in range(4):
        s.sql(f"INSERT INTO memories (content, tags, importance) VALUES ('note number {i} about kettles', 'kettle', 0.{i})")
    hot = lambda: {int(r.id): int(r.heat) for r in s.sql("SHOW HOT").rows.collect()}
    assert hot() == {}
    s.sql("SELECT id FROM memories WHERE tag = 'kettle' LIMIT 1")  # the index answers: all that meet it, before LIMIT
    assert hot() == {1: 1, 2: 1, 3: 1, 4: 1}
    s.sql("SELECT id FROM memories WHERE importance >= 0.2")  # all rows are read, then those that meet it
    assert hot() == {1: 2, 2: 2, 3: 3, 4: 3}
    s.sql("DELETE FROM memories WHERE id = 4")
    s.sql("INSERT INTO memories (content) VALUES ('a later one')")
    assert hot() == {1: 2, 2: 2, 3: 3}
    assert s.sql("SEARCH 'kettles' LIMIT 1").affected == 1
    assert sum(hot().values()) == 8
    rows = {r.id: r.cached for r in s.sql("SHOW HOT").rows.collect()}
    assert list(rows.values()).count("true") == 1
    s.sql("SEARCH 'kettles' LIMIT 1")
    cache = {r.variable: int(r.value) for r in s.sql("SHOW CACHE").rows.collect()}
    assert (cache["query_cache_hits"], cache["doc_cache_hits"], cache["hot_tracked"]) == (1, 1, 3)
    s.sql("CHECKPOINT")
    again = Engine(spark, f"file://{tmp_path}/store")  # counts are kept, and the hottest are loaded
    assert len(again.docs.data) == 3 and {int(r.id) for r in again.session().sql("SHOW HOT").rows.collect()} == {1, 2, 3}


def test_transaction_update_delete(engine):
    s = engine.session()
    s.sql("BEGIN")
    s.sql("INSERT INTO memories VALUES ('a note that goes away', 'x', 'me', 0.1)")
    assert s.sql("UPDATE memories SET importance = 2.0, tags = 'a, b' WHERE id = 1").affected == 1
    assert s.sql("DELETE FROM memories WHERE id = 2").affected == 1
    assert ids(s.sql("SELECT id FROM memories")) == [1, 3, 4]
    with pytest.raises(EngineError):
        s.sql("BEGIN")
    with pytest.raises(EngineError):
        s.sql("CHECKPOINT")
    s.sql("ROLLBACK")
    assert ids(s.sql("SELECT id FROM memories")) == [1, 2, 3]
    with pytest.raises(EngineError):
        s.sql("COMMIT")
    with pytest.raises(EngineError):
        s.sql("DELETE FROM memories")
    s.sql("INSERT INTO memories (content) VALUES ('the id of the lost note is not used again')")
    assert ids(s.sql("SELECT id FROM memories")) == [1, 2, 3, 5]
    s.sql("DELETE FROM memories WHERE id = 5")
    s.sql("CHECKPOINT")
    again = Engine(engine.spark, engine.store.path)
    assert ids(again.session().sql("SELECT id FROM memories")) == [1, 2, 3]
    with pytest.raises(EngineError):
        s.sql("INSERT INTO memories (content) VALUES ('  ')")


def test_databases_users_and_grants(engine):
    admin = engine.session()
    admin.script("CREATE DATABASE work; USE work; INSERT INTO memories (content) VALUES ('rust at work'); CREATE USER bob IDENTIFIED BY 'password1'")
    bob = engine.session("bob")
    with pytest.raises(EngineError):
        bob.sql("USE work")
    admin.sql("GRANT READ ON work TO bob")
    bob.sql("USE work")
    assert ids(bob.sql("SELECT id FROM memories")) == [1]
    with pytest.raises(EngineError):
        bob.sql("INSERT INTO memories (content) VALUES ('x y z')")
    admin.sql("GRANT WRITE ON work TO bob")
    bob.sql("UPDATE memories SET source = 'bob'")
    admin.sql("REVOKE WRITE ON work FROM bob")
    with pytest.raises(EngineError):
        bob.sql("UPDATE memories SET source = 'bob'")
    assert [r[0] for r in bob.sql("SHOW GRANTS").rows.collect()] == ["GRANT READ ON work TO bob"]
    with pytest.raises(EngineError):
        bob.sql("SHOW USERS")
    assert engine.users.verify("bob", "password1") and not engine.users.verify("bob", "password2") and not engine.users.verify("eve", "x")
    both = {r.db for r in admin.sql("SEARCH 'rust' IN main, work").rows.collect()}
    assert both == {"main", "work"}
    with pytest.raises(EngineError):
        admin.sql("DROP DATABASE main")
    admin.sql("DROP DATABASE work")
    assert [r[0] for r in admin.sql("SHOW DATABASES").rows.collect()] == ["main"]
    admin.sql("SET CACHE query 1")
    assert admin.sql("SHOW CACHE").rows.count() == 12 and admin.sql("SHOW STATUS").rows.count() == 8


def test_attach(engine, tmp_path):
    other = Engine(engine.spark, f"file://{tmp_path}/other")
    other.session().script("CREATE DATABASE notes; USE notes; INSERT INTO memories (content) VALUES ('from elsewhere')")
    s = engine.session()
    s.script(f"ATTACH FILE 'file://{tmp_path}/other' AS notes; USE notes")
    assert ids(s.sql("SELECT id FROM memories")) == [1]
    with pytest.raises(EngineError):
        s.sql("DROP DATABASE notes")
    s.sql("DETACH notes")


def test_sessions_keep_each_others_writes(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    a, b = e.session(), e.session()
    a.sql("BEGIN")
    a.sql("INSERT INTO memories (content) VALUES ('from a, in a transaction')")
    b.sql("INSERT INTO memories (content) VALUES ('from b, at once')")
    assert ids(b.sql("SELECT id FROM memories")) == [2] and ids(a.sql("SELECT id FROM memories")) == [1]
    a.sql("COMMIT")
    found = {r.id: r.content for r in b.sql("SELECT id, content FROM memories").rows.collect()}
    assert found == {1: "from a, in a transaction", 2: "from b, at once"}
    # rows that another session has changed in the meantime are not changed over it
    a.sql("BEGIN")
    a.sql("UPDATE memories SET source = 'a' WHERE id = 1")
    b.sql("UPDATE memories SET source = 'b' WHERE id = 1")
    with pytest.raises(EngineError, match="conflict"):
        a.sql("COMMIT")
    a.sql("ROLLBACK")
    assert [r.source for r in a.sql("SELECT source FROM memories WHERE id = 1").rows.collect()] == ["b"]


def test_processes_keep_each_others_writes(spark, tmp_path):
    """Two engines over one directory, as two processes would have them: ids of one move up."""
    a, b = (Engine(spark, f"file://{tmp_path}/store").session() for _ in range(2))
    a.sql("BEGIN")
    a.sql("INSERT INTO memories (content, tags) VALUES ('kettle of a', 'x')")
    b.sql("INSERT INTO memories (content, tags) VALUES ('kettle of b', 'x')")
    a.sql("COMMIT")
    for s in (a, b):
        found = {r.id: r.content for r in s.sql("SELECT id, content FROM memories").rows.collect()}
        assert found == {1: "kettle of b", 2: "kettle of a"}
        assert sorted(r.id for r in s.sql("SEARCH 'kettle'").rows.collect()) == [1, 2]
    a.sql("UPDATE memories SET source = 'moved' WHERE id = 2")
    a.sql("DELETE FROM memories WHERE id = 1")
    b.sql("CHECKPOINT")
    assert [(r.id, r.source) for r in b.sql("SELECT id, source FROM memories").rows.collect()] == [(2, "moved")]


def test_threads_keep_all_rows(spark, tmp_path):
    import threading

    e = Engine(spark, f"file://{tmp_path}/store")

    def work(k):
        with e.session() as s:
            for i in range(3):
                s.sql(f"INSERT INTO memories (content) VALUES ('thread {k} row {i}')")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = e.session().sql("SELECT id, content FROM memories").rows.collect()
    assert sorted(r.id for r in rows) == list(range(1, 10)) and len({r.content for r in rows}) == 9


def test_a_checkpoint_frees_what_it_replaced(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    s = e.session()
    for i in range(3):
        s.sql(f"INSERT INTO memories (content) VALUES ('row {i}')")
    s.sql("UPDATE memories SET source = 'x' WHERE id = 2")  # one part of three is written anew
    parts = [p["memories"] for p in e.store.current.dbs["main"]["parts"]]
    assert len(parts) == 3 and len({p for p in (tmp_path / "store" / "data" / "main").iterdir()}) == 10
    e.store.publish(e.store.compact(e.store.current, "main"))
    assert e.store.vacuum(keep=1, grace=0) == 10 and len(list((tmp_path / "store" / "data" / "main").iterdir())) == 3
    assert ids(e.session().sql("SELECT id FROM memories")) == [1, 2, 3]


def test_a_search_tokenizes_no_content(engine):
    s = engine.session()
    index = engine.store.index(s.version, ["main"])
    assert "content" not in index.tf.columns and "content" not in index.postings.columns
    plan = rk.bm25(index, rk._per_db(index, [("rust", 1.0)], None))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "PushedFilters: [In(term" in plan or "EqualTo(term,rust)" in plan


def test_bulk_append_numbers_rows(engine, spark):
    rows = spark.range(500).selectExpr("concat('bulk note number ', id) content", "'load' source", "0.5F importance", "array('t') tags", "id created_at")
    store = engine.store
    v = store.create(store.current, "bulk")
    v, first, n = store.append(v, "bulk", rows)
    v, second, _ = store.append(v, "bulk", rows.limit(1))
    got = [r[0] for r in store.read(v, ["bulk"]).select("id").orderBy("id").collect()]
    assert (first, n, second) == (1, 500, 501) and got == list(range(1, 502))


@pytest.fixture
def tiny(spark):
    tf = [(1, "rust", 2), (1, "所有权", 1), (1, "内存", 1), (2, "rust", 1), (2, "借用", 2), (3, "数据库", 2), (3, "索引", 1)]
    kw = {1: [("rust", 1.0), ("所有权", 0.5)], 2: [("rust", 0.8), ("借用", 0.4)], 3: [("数据库", 1.0), ("索引", 0.6)]}
    memories = spark.createDataFrame([("main", i, "", k) for i, k in kw.items()], "db string, id long, content string, keywords array<struct<term:string,weight:float>>")
    length = {i: sum(n for j, _, n in tf if j == i) for i in kw}
    counts = spark.createDataFrame([("main", *t, length[t[0]]) for t in tf], "db string, id long, term string, tf long, dl long")
    return ix.Index(memories, ix.postings(memories), counts, ix.corpus_stats(memories, counts))


def test_hand_computed_ranking(tiny, spark):
    vector = [("rust", 1.0)]
    assert {(r.term, r.weight) for r in rk.expand(tiny, vector).collect()} == {("所有权", 0.25), ("借用", 0.25)}
    idf = math.log(1.6)
    norm = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (10 / 3)))
    query = spark.createDataFrame([("main", "rust", 1.0)], "db string, term string, weight double")
    got = {r.id: r.bm25 for r in rk.bm25(tiny, query).collect()}
    assert got == pytest.approx({1: idf * norm(2, 4), 2: idf * norm(1, 3)})
    own = rk.seed_vector(tiny, "main", 1)
    cos = {r.id: r.cosine for r in rk.cosine(tiny.postings, own).collect()}
    assert cos[1] == pytest.approx(1) and 3 not in cos and 0 < cos[2] < 1
    best = rk.rank(tiny, vector).collect()
    assert [r.id for r in best] == [1, 2] and best[0].score == pytest.approx(1.0, abs=1)
    assert rk.rank(tiny, []).count() == 0


def test_text_functions(spark):
    row = spark.createDataFrame([('他说:"今天天气不错。" 然后离开了。下一句', "It is 3.14% OF Rust's 所有权")], "a string, b string")
    s, t, raw = row.select(text.sentences(F.col("a")), text.tokens(F.col("b")), text.raw_tokens(F.lit("Étion 50%"))).first()
    assert len(s) == 3 and t == ["3.14%", "rust", "所有", "有权"] and raw == ["tion", "50%"]
    times = spark.createDataFrame([(x,) for x in (0, 946684800000, 1709164800000, 2147483647000, -5)], "t long").select(render.time(F.col("t"))).collect()
    assert [r[0] for r in times] == ["1970-01-01 00:00:00", "2000-01-01 00:00:00", "2024-02-29 00:00:00", "2038-01-19 03:14:07", "-"]
    pairs = spark.sql("SELECT 'a b' x, '' y, 'z' z").select(text.char_bigrams(F.col("x")), text.char_bigrams(F.col("y")), text.char_bigrams(F.col("z"))).first()
    assert list(pairs) == [["ab"], [], ["z"]]


def test_near_copies_among_key_points(spark):
    body = "alpha beta gamma delta epsilon. alpha beta gamma delta epsilon! zeta alpha eta theta words here. Nothing at all."
    rows = spark.createDataFrame([("main", 1, body)], "db string, id long, content string")
    points = ix.extract(rows).first().key_points
    assert points == ["alpha beta gamma delta epsilon.", "zeta alpha eta theta words here."]  # stop words alone are no hit


def test_key_points_of_a_sentence_of_any_length(spark):
    long = "alpha " * 10_000  # 59 999 characters: the square of that is over 32 bits
    rows = spark.createDataFrame([("main", 1, f"{long}. beta alpha gamma.")], "db string, id long, content string")
    assert ix.extract(rows).first().key_points == [long[:140], "beta alpha gamma."]


def test_sentences_end_at_marks_and_closers(spark):
    """As the SQL cuts them: a run that ends in no mark is one, and only the very end of a text ends without a mark."""
    ends, closers = text.ENDS, text.CLOSERS
    odd = ["a.)b!!c", "a\n)b", "x”。y", ")\"a", "a\r", "a\u2028", "a\u2028\n", "no end", "", "😀。’😀;；", "a\r\nb\u0085", "?" * 3]
    want = [[t for x in re.findall(f"[^{ends}]*(?:[{ends}][{closers}]*|\\Z)", o) if (t := x.strip(text.SPACE))] for o in odd]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, c string").select("i", text.sentences(F.col("c")).alias("s"))
    assert [r.s for r in rows.orderBy("i").collect()] == want


def test_empty_memories(spark):
    rows = spark.createDataFrame([], "db string, id long, content string")
    made = ix.extract(rows)
    assert made.count() == 0 and rk.search(ix.Index.build(made), "rust").count() == 0


def test_config():
    c = from_toml("[engine.search]\nhops = 2\nexpansion_decay = 0.25\n[tokenizer]\nmax_keywords = 4\nwhatever = 1\n[engine.cache]\nquery = 0\n")
    assert (c.ranking.hops, c.ranking.decay, c.extraction.max_keywords, c.query_cache, c.ranking.k1) == (2, 0.25, 4, 0, 1.2)
    with pytest.raises(EngineError):
        from_toml("[engine.search]\nhops = 3\n")


def test_streams(engine, spark, tmp_path):
    from engram.streaming.upkeep import append_stream, read_heat

    rows = spark.range(5).selectExpr("concat('streamed note ', id) content", "'s' source", "0.5F importance", "array('t') tags", "id created_at")
    rows.write.parquet(f"{tmp_path}/in")
    store = engine.store
    store.publish(store.create(store.current, "streamed"))
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    append_stream(stream, store, "streamed", f"{tmp_path}/ck").awaitTermination()
    assert store.read(store.current, ["streamed"]).count() == 5
    # the same batch once more, as after a failure before its offsets were written
    import shutil

    shutil.rmtree(f"{tmp_path}/ck/commits")
    again = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    append_stream(again, store, "streamed", f"{tmp_path}/ck").awaitTermination()
    assert store.read(store.current, ["streamed"]).count() == 5
    log = spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 1 id UNION ALL SELECT timestamp'2024-01-01 00:20:00', 1")
    assert [(r.id, r.heat) for r in read_heat(log).collect()] == [(1, 2)]


def test_ties_follow_the_order_of_candidates(spark, tmp_path):
    s = Engine(spark, f"file://{tmp_path}/store").session()
    for i, content in enumerate(["kettle kettle kettle shines", "kettle", "kettle boils and boils and boils"]):
        s.sql(f"INSERT INTO memories (content, importance) VALUES ('{content}', {0.5 if i < 2 else 0.9})")
    weights = {r.id: dict(r.keywords)["kettle"] for r in s.sql("SELECT id, keywords FROM memories").rows.collect()}
    best = sorted(weights, key=lambda i: (-weights[i], i))
    assert ids(s.sql("SELECT id FROM memories WHERE keyword = 'kettle'")) == best
    falling = ids(s.sql("SELECT id FROM memories WHERE keyword = 'kettle' ORDER BY importance DESC"))
    assert falling == [3, *[i for i in reversed(best) if i != 3]]
    assert ids(s.sql("SELECT id FROM memories ORDER BY importance DESC")) == [3, 2, 1]


def test_chinese_stop_words(spark):
    found = spark.createDataFrame([("我们可以学习",)], "a string").select(text.tokens(F.col("a"))).first()[0]
    assert "我们" not in found and "可以" not in found and "学习" in found


def test_caches_show_no_other_version(spark, tmp_path):
    one, two = (Engine(spark, f"file://{tmp_path}/store") for _ in range(2))
    a, b = one.session(), one.session()
    a.sql("INSERT INTO memories (content, tags) VALUES ('a kettle', 'old')")
    tags = lambda s: [list(r.tags) for r in s.sql("SEARCH 'kettle'").rows.collect()]
    assert tags(a) == tags(b) == [["old"]]
    a.script("BEGIN; UPDATE memories SET tags = 'new' WHERE id = 1")
    assert tags(a) == [["new"]] and tags(b) == [["old"]]
    a.sql("COMMIT")
    assert tags(a) == tags(b) == [["new"]]
    two.session().sql("UPDATE memories SET tags = 'newest' WHERE id = 1")  # as another process would
    assert tags(a) == tags(b) == [["newest"]]


def test_a_store_of_the_first_layout_is_brought_up(spark, tmp_path):
    import json

    e = Engine(spark, f"file://{tmp_path}/new", admin_password="long enough")
    e.session().script("INSERT INTO memories (content) VALUES ('a kettle'); INSERT INTO memories (content) VALUES ('a teapot'); CREATE USER ann IDENTIFIED BY 'another one'")
    old = tmp_path / "old"
    (old / "versions").mkdir(parents=True)
    state = e.store.current.dbs["main"]
    dbs = {"main": {"parts": [p["memories"] for p in state["parts"]], "next_id": 7, "attached": None}, "none": {"parts": [], "next_id": 1, "attached": None}}
    (old / "versions" / "000000000005.json").write_text(json.dumps({"number": 5, "dbs": dbs}))
    (old / "users.json").write_text(e.store.get_text("users.json"))
    again = Engine(spark, f"file://{old}", admin_password="long enough")
    s = again.session()
    assert again.users.verify("ann", "another one") and again.store.current.number == 6
    assert ids(s.sql("SEARCH 'kettle'")) == [1] and ids(s.sql("SELECT id FROM memories")) == [1, 2]
    s.sql("INSERT INTO memories (content) VALUES ('a cup')")
    assert ids(Engine(spark, f"file://{old}", admin_password="long enough").session().sql("SELECT id FROM memories")) == [1, 2, 7]
