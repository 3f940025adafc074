import threading

import pytest

from engram.__main__ import arguments, main
from engram.schema import EngineError
from engram.server import Server
from engram.session import Engine


def ids(result):
    return [r[0] for r in result.rows.select("id").collect()]


def databases(session):
    return [r[0] for r in session.sql("SHOW DATABASES").rows.collect()]


def test_a_directory_of_stores(spark, tmp_path):
    path = f"file://{tmp_path}/all"
    e = Engine(spark, path, admin_password="long enough", directory=True)
    s = e.session()
    s.script("CREATE DATABASE work; CREATE USER dana IDENTIFIED BY 'password1'; GRANT WRITE ON work TO dana; USE work; INSERT INTO memories (content) VALUES ('kettles at work')")
    assert (tmp_path / "all" / "work" / "versions").is_dir()
    with pytest.raises(EngineError):
        s.sql("CREATE DATABASE work")
    s.script("USE main; INSERT INTO memories (content) VALUES ('kettles at home')")
    # stores that lie in the directory are mounted when it is opened; others, and those with an underscore, are not
    other = Engine(spark, f"{path}/notes-2024")
    other.session().script("CREATE DATABASE notes; USE notes; INSERT INTO memories (content) VALUES ('kettles in notes')")
    Engine(spark, f"{path}/_hidden").session().sql("CREATE DATABASE hidden")
    (tmp_path / "all" / "plain").mkdir()
    again = Engine(spark, path, admin_password="long enough", directory=True)
    s = again.session()
    assert databases(s) == ["main", "notes", "work"]
    assert again.users.verify("dana", "password1") and again.users.allowed("dana", "write", "work")
    assert {r.db for r in s.sql("SEARCH 'kettles' IN main, work, notes").rows.collect()} == {"main", "work", "notes"}
    s.script("USE notes; BEGIN; INSERT INTO memories (content) VALUES ('written through the directory'); COMMIT")
    assert ids(other.session().sql("SELECT id FROM memories")) == []
    theirs = other.session()
    theirs.sql("USE notes")
    assert ids(theirs.sql("SELECT id FROM memories")) == [1, 2]  # in the store that it belongs to
    theirs.sql("DELETE FROM memories WHERE id = 1")
    assert ids(s.sql("SELECT id FROM memories")) == [2]
    status = {r.variable: r.value for r in s.sql("SHOW STATUS").rows.collect()}
    assert (status["databases"], status["files_open"], status["users"], status[f"file:{path}/notes-2024"]) == ("3", "3", "2", "1")
    with pytest.raises(EngineError):
        s.sql("DETACH notes")
    s.sql("DROP DATABASE work")
    assert databases(s) == ["main", "notes"] and databases(Engine(spark, path, admin_password="long enough", directory=True).session()) == ["main", "notes"]


def test_one_name_in_two_stores_is_an_error(spark, tmp_path):
    for store in ("a", "b"):
        Engine(spark, f"file://{tmp_path}/{store}").session().sql("CREATE DATABASE same")
    with pytest.raises(EngineError, match="several stores"):
        Engine(spark, f"file://{tmp_path}", directory=True)


def test_attached_databases_are_their_stores_own(spark, tmp_path):
    other = Engine(spark, f"file://{tmp_path}/other").session()
    other.script("CREATE DATABASE notes; USE notes; INSERT INTO memories (content) VALUES ('from elsewhere')")
    s = Engine(spark, f"file://{tmp_path}/own").session()
    s.script(f"ATTACH FILE 'file://{tmp_path}/other' AS notes; USE notes; INSERT INTO memories (content) VALUES ('from here')")
    assert ids(other.sql("SELECT id FROM memories")) == [1, 2]
    other.sql("UPDATE memories SET source = 'there' WHERE id = 2")
    assert [r.source for r in s.sql("SELECT source FROM memories WHERE id = 2").rows.collect()] == ["there"]
    again = Engine(spark, f"file://{tmp_path}/own").session()
    again.sql("USE notes")
    assert ids(again.sql("SELECT id FROM memories")) == [1, 2]
    s.sql("DETACH notes")
    assert databases(s) == ["main"] and ids(other.sql("SELECT id FROM memories")) == [1, 2]


def typed(*lines):
    rest = iter(lines)
    said = []

    def ask(_):
        try:
            return next(rest)
        except StopIteration:
            raise EOFError from None

    return ask, said.append, said


def test_commands_of_the_terminal(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    ask, say, said = typed()
    assert main(["open", "--db", path], ask, say) == 1 and "no store" in said[0]
    assert main(["create", "--db", path], ask, say) == 0 and said[1] == f"created {path}"
    ask, say, said = typed("help", "INSERT INTO memories (content) VALUES ('typed\nhere')", "SELECT id, content FROM memories", "SELECT", "BEGIN", "INSERT INTO memories (content) VALUES ('gone')", "exit")
    assert main(["open", "--db", path], ask, say) == 0
    assert "SEARCH" in said[0] and "inserted id 1" in said[1] and "typed⏎here" in said[2] and said[3].startswith("error: ")
    ask, say, said = typed("SELECT content FROM memories")
    assert main(["open", "--db", path], ask, say) == 0 and "gone" not in said[0]
    assert main(["create", "--dir", f"file://{tmp_path}/many"], ask, say) == 0 and (tmp_path / "many" / "main" / "versions").is_dir()
    for wrong in (["connect"], ["open"], ["connect", "--db", path], ["other"]):
        with pytest.raises(SystemExit):
            arguments(wrong)


def test_connect_to_a_server(spark, tmp_path, monkeypatch):
    server = Server(Engine(spark, f"file://{tmp_path}/store", admin_password="long enough"), "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("ENGRAM_PASSWORD", "long enough")
    addr = "{}:{}".format(*server.server_address)
    ask, say, said = typed("INSERT INTO memories (content) VALUES ('over the wire')", "SELECT id, content FROM memories", "SELECT nothing FROM memories", "quit")
    assert main(["connect", "--addr", addr], ask, say) == 0
    assert "inserted" in said[0] and "over the wire" in said[1] and said[2].startswith("error: ")
    monkeypatch.setenv("ENGRAM_PASSWORD", "not this one")
    ask, say, said = typed()
    assert main(["connect", "--addr", addr], ask, say) == 1 and "wrong user" in said[0]
    server.shutdown()
    server.server_close()
