import json
import threading

import pytest

from engram import log
from engram.config import from_toml
from engram.schema import EngineError
from engram.server import Client, Server, answer
from engram.session import Engine
from engram.sources.store import Store


@pytest.fixture
def served(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", admin_password="long enough")
    server = Server(engine, "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield engine, server.server_address
    server.shutdown()
    server.server_close()


def test_statements_over_tcp(served):
    client = Client(served[1], "admin", "long enough")
    client.sql("INSERT INTO memories (content, tags) VALUES ('sorted runs are kept', 'spark')")
    found = client.sql("SELECT id, tags, importance FROM memories")
    assert (found["columns"], found["rows"]) == (["id", "tags", "importance"], [["1", "spark", "0.50"]])
    with pytest.raises(EngineError):
        client.sql("SELECT nothing FROM memories")
    assert len(client.sql("SHOW TABLES; SHOW DATABASES")["script"]) == 2
    client.close()


def test_login_and_privileges(served):
    for user, password in (("admin", "not this one"), ("nobody", "long enough")):
        with pytest.raises(EngineError, match="wrong user"):
            Client(served[1], user, password)
    admin = Client(served[1], "admin", "long enough")
    admin.sql("CREATE USER ann IDENTIFIED BY 'another one'")
    ann = Client(served[1], "ann", "another one")
    with pytest.raises(EngineError, match="READ"):
        ann.sql("SELECT id FROM memories")
    admin.sql("GRANT READ ON main TO ann")
    assert ann.sql("SELECT id FROM memories")["rows"] == []


def test_closed_connection_rolls_back(served):
    client = Client(served[1], "admin", "long enough")
    client.sql("BEGIN; INSERT INTO memories (content) VALUES ('never committed')")
    client.close()
    assert Client(served[1], "admin", "long enough").sql("SELECT id FROM memories")["rows"] == []


def test_answers_without_a_socket(spark, tmp_path):
    with Engine(spark, f"file://{tmp_path}/store").session() as s:
        assert answer(s, {"type": "ping"}) == {"ok": True, "message": "pong"}
        assert not answer(s, {"type": "other"})["ok"]
        assert not answer(s, {"type": "sql", "sql": "SELECT"})["ok"]


def test_users_are_kept(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with Engine(spark, path, admin_password="long enough").session() as s:
        s.script("CREATE USER ann IDENTIFIED BY 'another one'; GRANT READ, WRITE ON main TO ann")
    again = Engine(spark, path, admin_password="long enough")
    assert again.users.verify("ann", "another one") and again.users.shown("ann") == ["GRANT READ, WRITE ON main TO ann"]
    with pytest.raises(EngineError):
        Engine(spark, path, admin_password="not this one")
    with pytest.raises(EngineError, match="has users"):
        Server(Engine(spark, path), "127.0.0.1:0")


def test_sealed_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with Engine(spark, path, store_password="a store's password").session() as s:
        s.sql("INSERT INTO memories (content, tags, importance) VALUES ('nobody reads zanzibar here', 'a, b', 0.7)")
        rows = spark.createDataFrame([(f"zanzibar {i}", "bulk", 0.5, ["x"], i) for i in range(5)], "content string, source string, importance float, tags array<string>, created_at long")
        store = s.engine.store
        store.publish(store.append(store.current, "main", rows)[0])
    assert not [p for p in (tmp_path / "store").rglob("*") if p.is_file() and b"zanzibar" in p.read_bytes()]
    assert not list((tmp_path / "store").rglob("numbering-*"))
    with Engine(spark, path, store_password="a store's password").session() as s:
        assert s.sql("SELECT id FROM memories WHERE importance >= 0.7 AND tag = 'b'").rows.collect()[0].id == 1
        assert s.sql("SELECT id FROM memories").rows.count() == 6
        assert s.sql("SEARCH 'zanzibar reads' LIMIT 1").rows.collect()[0].id == 1
    for wrong in (None, "another"):
        with pytest.raises(EngineError):
            Store(spark, path, password=wrong)
    Store(spark, f"file://{tmp_path}/plain")
    with pytest.raises(EngineError, match="not sealed"):
        Store(spark, f"file://{tmp_path}/plain", password="late")


def test_log_file_rotates(spark, tmp_path):
    file = tmp_path / "engram.log"
    config = from_toml(f"[logging]\nfile = {json.dumps(str(file))}\nlevel = 'info'\nmax_size = 200\n[server]\ndefault_addr = '127.0.0.1:0'")
    handler = log.start(config)
    try:
        with Engine(spark, f"file://{tmp_path}/store", config).session() as s:
            for _ in range(20):
                s.sql("SHOW TABLES")
    finally:
        log.logging.getLogger("engram").removeHandler(handler)
        handler.close()
    assert file.stat().st_size <= 200 and (tmp_path / "engram.log.1").exists()
    assert log.start(from_toml("[logging]\nenabled = false")) is None
    with pytest.raises(EngineError):
        from_toml("[logging]\nlevel = 'loud'")


def test_clients_keep_each_others_rows(served):
    """Two connections write at the same time, one of them in a transaction."""
    one, two = (Client(served[1], "admin", "long enough") for _ in range(2))
    one.sql("BEGIN; INSERT INTO memories (content) VALUES ('first of one')")
    failed = []

    def insert(client, text):
        try:
            client.sql(f"INSERT INTO memories (content) VALUES ('{text}')")
        except EngineError as error:
            failed.append(error)

    threads = [threading.Thread(target=insert, args=x) for x in ((one, "second of one"), (two, "of two"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    one.sql("COMMIT")
    rows = two.sql("SELECT id, content FROM memories")["rows"]
    assert not failed and sorted(r[0] for r in rows) == ["1", "2", "3"] and {r[1] for r in rows} == {"first of one", "second of one", "of two"}
