"""Memories in versioned Parquet: a version is a manifest, published by one atomic claim and a rename.

Every logical database is a list of parts and a counter of ids. A part has three tables: memories, and of these the
term counts and the postings, sorted by term, so that a search reads the pages of its terms and tokenizes nothing. A
write makes new parts and a new manifest; readers keep the version that they have read. A transaction is a version that
is not published: it remembers what it did, and if others have published in the meantime, it does that again on top.
"""

from __future__ import annotations

import functools
import json
import threading
import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import Extraction
from ..operators.index import Index, average_length, extract, postings, term_table
from ..schema import DEFAULT_DB, MEMORIES, EngineError, checked_name
from . import seal

TABLES = {"memories": MEMORIES, "tf": "id long, term string, tf long, dl long", "postings": "term string, id long, weight float, norm double, others array<string>"}
#: Versions that a checkpoint leaves, and seconds for which it leaves files that no version names (open transactions).
KEEP_VERSIONS = 10
GRACE = 3600
#: Rows of ids that are broadcast to those that they meet; more are left to Spark.
FEW = 262_144
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Version:
    """number is that of the published version that this one is, or was made from."""

    number: int
    dbs: dict[str, dict]  # name -> {"parts": [part], "next_id": n, "attached": path or None, "streams": {name: batch}, ...}
    ops: tuple = field(default=(), compare=False)  # what has been done since


def _columns(table: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in TABLES[table].split(", ")]


def _empty() -> dict:
    return {"parts": [], "next_id": 1, "attached": None, "streams": {}}


def _done(v: Version, op: tuple) -> Version:
    """v after one more step. Raises if the step is no longer possible."""
    kind, name, *rest = op
    dbs = dict(v.dbs)
    if kind in ("create", "attach"):
        if name in dbs:
            raise EngineError(f"database {name} exists")
        dbs[name] = rest[0]
    elif name not in dbs:
        raise EngineError(f"no database {name}")
    elif kind in ("drop", "detach"):
        del dbs[name]
    elif kind == "next":
        dbs[name] = dbs[name] | {"next_id": max(dbs[name]["next_id"], rest[0])}
    elif kind == "append":
        part, stream = rest
        state = dbs[name]
        low, high = part["ids"]
        if any(p["ids"][0] + p["shift"] <= high and low <= p["ids"][1] + p["shift"] for p in state["parts"]):
            # another process has given the same ids out: these move up
            part = part | {"shift": max(state["next_id"], high + 1) - low}
        state = state | {"parts": [*state["parts"], part], "next_id": max(state["next_id"], high + part["shift"] + 1)}
        if stream:
            if state["streams"].get(stream[0], -1) >= stream[1]:
                return v  # this batch is there already
            state["streams"] = state["streams"] | {stream[0]: stream[1]}
        dbs[name] = state
    elif kind == "heat":
        dbs[name] = dbs[name] | {"heat": rest[0]}
    elif kind == "replace":
        old, new = rest
        parts = dbs[name]["parts"]
        if not all(p in parts for p in old):
            raise EngineError(f"conflict: another session has changed rows of {name}")
        dbs[name] = dbs[name] | {"parts": [p for p in parts if p not in old] + list(new)}
    return Version(v.number, dbs, (*v.ops, op))


def tidy(write):
    """A method whose queries each delete their shuffle files at their end: those of a bulk load hold its texts several
    times, and else stay until the driver happens to collect its garbage."""

    @functools.wraps(write)
    def run(self, *args, **named):
        conf = self.spark.conf
        old = conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            return write(self, *args, **named)
        finally:
            conf.set(CLEANUP, old)

    return run


class Store:
    """A directory on any file system that Spark can write; with a password, its rows are sealed.

    A sealed row is one AES-GCM value, so that filters are not pushed down to its columns. The key is a literal of
    the plans that read and write: set spark.redaction.string.regex where plans or event logs are shown to others.
    Several processes can write: a version's number is claimed by a file that only one of them can make.
    """

    def __init__(self, spark: SparkSession, path: str, extraction: Extraction = Extraction(), password: str | None = None, create: bool = True, first: str = DEFAULT_DB):
        self.spark, self.path, self.extraction, self.password = spark, path.rstrip("/"), extraction, password
        self.lock = threading.RLock()
        self.given: dict[str, int] = {}  # next ids of open transactions
        self.others: dict[str, Store] = {}  # stores that have attached databases, by path
        self.homes: dict[str, str] = {}  # paths of the stores of attached databases
        if not create and not self._numbers():
            raise EngineError(f"no store in {self.path}")
        self.key = self._unlock(password)
        if not self._numbers():
            self._write_version(Version(0, {first: _empty()}))
        self.current = self._load()
        if any(isinstance(p, str) for d in self.current.dbs.values() for p in d["parts"]):
            self._upgrade()

    def _upgrade(self) -> None:
        """A store of the first layout, whose parts are memories alone, gets parts with an index, as a new version."""
        dbs = {}
        for name, old in self.current.dbs.items():
            paths = [p for p in old["parts"] if isinstance(p, str)]
            rows = self._open(paths, MEMORIES, name).withColumn("db", F.lit(name)) if paths else None
            dbs[name] = _empty() | old | {"parts": [p for p in old["parts"] if not isinstance(p, str)] + ([self._part(name, rows)] if paths else [])}
        self._write_version(Version(self.current.number, dbs))
        self.current = self._load()

    # small files

    def _files(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._files()
        at = path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def _read(self, name: str) -> str:
        fs, path = self._files()
        stream = fs.open(path(f"{self.path}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> bool:
        """A new file, whole from the start: a draft that is renamed."""
        fs, path = self._files()
        draft = path(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(path(f"{self.path}/{name}").getParent())
        if fs.rename(draft, path(f"{self.path}/{name}")):
            return True
        fs.delete(draft, False)
        return False

    def get_text(self, name: str) -> str | None:
        """A small file beside the versions: the newest that put_text has written."""
        if found := [f for f in self._names(f"files/{name}") if not f.startswith(".")]:
            return self._read(f"files/{name}/{found[-1]}")
        return self._read(name) if name in self._names("") else None  # where stores of the first layout have it

    def put_text(self, name: str, text: str) -> None:
        """A new copy beside the old one, which goes only when the new one is there."""
        with self.lock:
            fs, path = self._files()
            old = [f for f in self._names(f"files/{name}") if not f.startswith(".")]
            number = int(old[-1]) + 1 if old else 1
            while not self._put(f"files/{name}/{number:012d}", text):
                number += 1
            for f in old:
                fs.delete(path(f"{self.path}/files/{name}/{f}"), False)

    def _unlock(self, password: str | None) -> bytes | None:
        found = self.get_text("lock.json")
        if found is None:
            if password is None:
                return None
            if self._numbers():
                raise EngineError("this store is not sealed")
            found = json.dumps(seal.new_lock(password))
            self.put_text("lock.json", found)
        elif password is None:
            raise EngineError("this store is sealed: give its password")
        return seal.unlock(json.loads(found), password)

    # versions

    def _numbers(self) -> list[str]:
        return [n for n in self._names("versions") if n.endswith(".json") and not n.startswith(".")]

    def _load(self) -> Version | None:
        if not (names := self._numbers()):
            return None
        raw = json.loads(self._read(f"versions/{names[-1]}"))
        return Version(raw["number"], self._resolved(raw["dbs"]))

    def _resolved(self, dbs: dict[str, dict]) -> dict[str, dict]:
        """Attached databases are named in a manifest; their parts are those of their own store, as it is now."""
        return {n: self._attached(n, d["attached"]) if d.get("attached") else d for n, d in dbs.items()}

    def _attached(self, name: str, path: str) -> dict:
        if path not in self.others:
            self.others[path] = Store(self.spark, path, self.extraction, self.password, create=False)
        self.homes[name] = path
        return self.others[path].reload().dbs.get(name, _empty()) | {"attached": path}

    def _own(self, dbs: dict[str, dict]) -> dict[str, dict]:
        """What a manifest says of databases."""
        return {n: {"attached": d["attached"]} if d.get("attached") else d for n, d in dbs.items()}

    def _claim(self, number: int) -> bool:
        """Whether this writer, and no other, may write a version's number."""
        fs, path = self._files()
        jvm, at = self.spark._jvm, path(f"{self.path}/versions/{number:012d}.claim")
        fs.mkdirs(at.getParent())
        try:
            if fs.getUri().getScheme() == "file":
                jvm.java.nio.file.Files.createFile(jvm.java.nio.file.Path.of(at.toUri().getPath(), self.spark._sc._gateway.new_array(jvm.java.lang.String, 0)), self.spark._sc._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
            else:
                fs.create(at, False).close()
        except Exception as error:  # the gateway gives one type for all; only a lost race is expected
            if "exist" not in str(error).lower():
                raise
            return False
        return True

    def _write_version(self, v: Version) -> Version | None:
        """The next version after v.number, or None if another writer has that number."""
        number = v.number + 1
        if not self._claim(number):
            fs, path = self._files()
            for _ in range(100):  # the other one is about to write it
                if (names := self._numbers()) and int(names[-1].removesuffix(".json")) >= number:
                    return None
                time.sleep(0.1)
            fs.delete(path(f"{self.path}/versions/{number:012d}.claim"), False)  # it has died
            return None
        if not self._put(f"versions/{number:012d}.json", json.dumps({"number": number, "dbs": self._own(v.dbs)})):
            raise EngineError("cannot write a version")
        return Version(number, v.dbs)

    def publish(self, v: Version) -> Version:
        """Make v the current version. What others have published since it was begun stays: v's steps are repeated
        on top of that. Appended rows keep their ids, or move up if another process has used them; changed rows must
        not have been changed by others."""
        with self.lock:
            of = lambda op: self.homes.get(op[1]) if op[0] in ("append", "replace", "heat", "next") else None
            for path in dict.fromkeys(p for op in v.ops if (p := of(op))):
                self.others[path].publish(Version(-1, {}, tuple(op for op in v.ops if of(op) == path)))
            mine = tuple(op for op in v.ops if not of(op))
            while mine:
                made = latest = self._load()
                if latest.number != v.number:
                    for op in mine:
                        made = _done(made, op)
                else:
                    made = v
                if found := self._write_version(replace(made, number=latest.number)):
                    self.current = Version(found.number, self._resolved(self._own(found.dbs)))
                    return self.current
            return self.reload()

    def reload(self) -> Version:
        with self.lock:
            names = self._numbers()
            if names and (int(names[-1].removesuffix(".json")) != self.current.number or self.homes):
                self.current = self._load()
            return self.current

    def forget(self, v: Version) -> None:
        """Take back a version that is not published; ids that it has given out are not given again."""
        steps = [("next", n, d["next_id"]) for n, d in v.dbs.items() if n in self.current.dbs and d["next_id"] > self.current.dbs[n]["next_id"]]
        if steps:
            self.publish(Version(-1, {}, tuple(steps)))

    def vacuum(self, keep: int = KEEP_VERSIONS, grace: float = GRACE) -> int:
        """Delete manifests but the last ones, and files of rows that these do not name; returns how many went."""
        with self.lock:
            fs, path = self._files()
            names = self._numbers()
            for n in names[:-keep]:
                fs.delete(path(f"{self.path}/versions/{n}"), False)
                fs.delete(path(f"{self.path}/versions/{n.removesuffix('.json')}.claim"), False)
            states = [d for n in names[-keep:] for d in json.loads(self._read(f"versions/{n}"))["dbs"].values() if not d.get("attached")]
            named = {p[t].rpartition("/")[2] for d in states for p in d["parts"] for t in TABLES} | {d["heat"].rpartition("/")[2] for d in states if d.get("heat")}
            gone = 0
            for db in self._names("data"):
                for f in fs.listStatus(path(f"{self.path}/data/{db}")):
                    if f.getPath().getName() not in named and f.getModificationTime() < (time.time() - grace) * 1000:
                        gone += bool(fs.delete(f.getPath(), True))
            return gone

    # databases

    def create(self, v: Version, name: str) -> Version:
        self.given.pop(checked_name(name), None)
        return _done(v, ("create", checked_name(name), _empty()))

    def drop(self, v: Version, name: str) -> Version:
        if name == DEFAULT_DB:
            raise EngineError(f"database {DEFAULT_DB} cannot be dropped")
        if v.dbs.get(name, {}).get("attached"):
            raise EngineError(f"database {name} is attached: detach it")
        if name not in v.dbs:
            return v
        return _done(v, ("drop", name))

    def attach(self, v: Version, path: str, name: str) -> Version:
        if name in v.dbs:
            raise EngineError(f"database {name} exists")
        entry = self._attached(name, path.rstrip("/"))
        other = self.others[entry["attached"]]
        if other.key != self.key or name not in other.current.dbs:
            del self.homes[name]
            raise EngineError(f"{path} is sealed with another key" if other.key != self.key else f"no database {name} in {path}")
        return _done(v, ("attach", name, entry))

    def detach(self, v: Version, name: str) -> Version:
        if not v.dbs.get(name, {}).get("attached"):
            raise EngineError(f"database {name} is not attached")
        made = _done(v, ("detach", name))
        self.homes.pop(name, None)
        return made

    def status(self, v: Version) -> list[tuple[str, object]]:
        """What is stored: a page is a part here, and free ones are files that this version does not name."""
        parts = [p for d in v.dbs.values() for p in d["parts"]]
        named = {p["memories"] for p in parts}
        files = sum(len(self._names(f"data/{db}")) for db in self._names("data"))
        known = {p[t] for p in parts for t in TABLES} | {d["heat"] for d in v.dbs.values() if d.get("heat")}
        dirty = sum(op[2]["rows"] for op in v.ops if op[0] == "append") + sum(p["rows"] for op in v.ops if op[0] == "replace" for p in op[3])
        rows = sum(p["rows"] for p in parts)
        return [("databases", ",".join(sorted(v.dbs))), ("memories", rows), ("page_size", rows // max(len(named), 1)), ("page_count", len(named)), ("free_pages", max(files - len(known), 0)), ("checkpoint_seq", v.number), ("dirty_records", dirty)]

    # rows

    def kept_heat(self, v: Version, db: str) -> DataFrame | None:
        """(id, heat) as counted up to the last time that counts were kept."""
        at = v.dbs.get(db, {}).get("heat")
        return self._open([at], "id long, heat long", db) if at else None

    def keep_heat(self, v: Version, db: str, counts: DataFrame) -> Version:
        return _done(v, ("heat", db, self._save(counts, db)))

    def _table(self, v: Version, dbs: list[str] | None, table: str) -> DataFrame:
        """One of the tables of some databases; others are not opened."""
        out = None
        for name in v.dbs if dbs is None else dbs:
            if name not in v.dbs:
                raise EngineError(f"no database {name}")
            for shift in sorted({p["shift"] for p in v.dbs[name]["parts"]}):
                rows = self._parts([p for p in v.dbs[name]["parts"] if p["shift"] == shift], table, name)
                out = rows if out is None else out.unionByName(rows)
        if out is None:
            out = self.spark.createDataFrame([], TABLES[table])
            out = out if table == "memories" else out.withColumn("db", F.lit(""))
        return out

    def _parts(self, parts: list[dict], table: str, db: str) -> DataFrame:
        """Rows of parts that have one shift."""
        rows = self._open([p[table] for p in parts], TABLES[table], db).withColumn("db", F.lit(db))
        return rows.withColumn("id", F.col("id") + parts[0]["shift"]) if parts[0]["shift"] else rows

    def read(self, v: Version, dbs: list[str] | None = None) -> DataFrame:
        """The memories of some databases."""
        return self._table(v, dbs, "memories")

    def index(self, v: Version, dbs: list[str] | None = None) -> Index:
        """What a search reads, as it is stored; the statistics are in the manifest."""
        names = list(v.dbs) if dbs is None else dbs
        stats = []
        for name in names:
            parts = v.dbs[name]["parts"]
            if n := sum(p["rows"] for p in parts):
                stats.append((name, n, average_length(sum(p["dl"] for p in parts), n)))
        return Index(self.read(v, dbs), self._table(v, dbs, "postings"), self._table(v, dbs, "tf"), self.spark.createDataFrame(stats, "db string, n long, avgdl double"))

    def _path(self, db: str) -> str:
        return f"{self.homes.get(db, self.path)}/data/{db}/{uuid.uuid4().hex}"

    def _save(self, rows: DataFrame, db: str, path: str | None = None) -> str:
        path = path or self._path(db)
        if self.key is not None:
            rows = rows.select(seal.sealed(F.struct(*rows.columns), self.key, db).alias("sealed"))
        rows.write.parquet(path)
        return path

    def _open(self, paths: list[str], schema, db: str) -> DataFrame:
        if self.key is None:
            return self.spark.read.schema(schema).parquet(*paths)
        return seal.opened(self.spark.read.schema("sealed binary").parquet(*paths), schema, self.key, db)

    @tidy
    def _part(self, db: str, memories: DataFrame, tf: DataFrame | str | None = None, ids: tuple[int, int] | None = None) -> dict:
        """Write memories (and their term counts, if these are known; a path, if they are written) as a part; ids are
        the first and last, if there is one row for each number between them."""
        at = self._save(memories.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORIES]), db)
        stored = self._open([at], MEMORIES, db)
        if tf is None:
            tf = term_table(stored.select("db", "id", "content"), self.extraction)
        counts = tf if isinstance(tf, str) else self._save(tf.select(*_columns("tf")).sortWithinPartitions("term", "id"), db)
        entries = self._save(postings(stored).select(*_columns("postings")).sortWithinPartitions("term", "id"), db)
        dl = self._open([counts], TABLES["tf"], db).agg(F.sum("tf")).first()[0]
        if ids is None:
            n, low, high = stored.agg(F.count("*"), F.min("id"), F.max("id")).first()
            low, high = (0, -1) if low is None else (low, high)
        else:
            (low, high), n = ids, ids[1] - ids[0] + 1
        return {"memories": at, "tf": counts, "postings": entries, "rows": n, "dl": dl or 0, "ids": [low, high], "shift": 0}

    def _reserve(self, v: Version, db: str, n: int) -> int:
        """The first of n ids that no session of this process has."""
        with self.lock:
            known = self.reload().dbs.get(db, {}).get("next_id", 1)
            first = max(v.dbs[db]["next_id"], known, self.given.get(db, 1))
            self.given[db] = first + n
            return first

    @tidy
    def append(self, v: Version, db: str, rows: DataFrame, stream: tuple[str, int] | None = None, n: int | None = None) -> tuple[Version, int, int]:
        """Add rows (content, source, importance, tags, created_at), one or many: (version, first id, count).

        Ids go on from the database's counter, which never goes back. They follow the order of (created_at, content)
        by two levels, ranges and places in a range, so that a bulk load does not meet in one task. stream (name,
        batch) marks a batch that must not be added twice. n is the number of rows, if it is known.
        """
        if db not in v.dbs:
            raise EngineError(f"no database {db}")
        n = rows.count() if n is None else n
        first = self._reserve(v, db, n)
        if not n:
            return v, first, 0
        ranged = rows.repartitionByRange("created_at", "content").sortWithinPartitions("created_at", "content") if n > 1 else rows
        numbered = ranged.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
        if n > 1:  # ids have to be fixed before they are used twice
            numbering = self._save(numbered, db, f"{self._path(db)}-numbering")
            numbered = self._open([numbering], numbered.schema, db)
        sizes = numbered.groupBy("range").agg(F.count("*").alias("c"), F.min("at").alias("low"))
        bases = sizes.select("range", "low", F.coalesce(F.sum("c").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        ids = F.lit(first) + F.col("base") + F.col("at") - F.col("low")
        full = numbered.join(F.broadcast(bases), "range").select(F.lit(db).alias("db"), ids.cast("long").alias("id"), "created_at", F.col("created_at").alias("updated_at"), "importance", "content", "source", "tags")  # a row a partition
        # the terms are written with their ranks, which readers do not look at, so that contents are tokenized once
        # by id alone: db is a literal, which Spark drops from keys, so that rows dealt by both would be moved again, twice
        terms = term_table(full.select("db", "id", "content").repartition("id"), self.extraction).drop("db")
        counts = self._save(terms.sortWithinPartitions("term", "id"), db)
        ranked = self._open([counts], terms.schema, db).withColumn("db", F.lit(db))
        part = self._part(db, extract(full, self.extraction, ranked), counts, (first, first + n - 1))
        if n > 1:
            fs, path = self._files()
            fs.delete(path(numbering), True)
        return _done(v, ("append", db, part, stream)), first, n

    @tidy
    def rewrite(self, v: Version, db: str, where: Column, changes: dict[str, Column] | None) -> tuple[Version, int]:
        """Change (or, without changes, delete) the rows that meet a condition: (version, number of them).

        Only parts with such rows are written anew; a change leaves a part's terms as they are.
        """
        parts = v.dbs[db]["parts"]
        hit = F.coalesce(where, F.lit(False))
        tagged = [self._parts([p], "memories", db).where(hit).select(F.lit(i).alias("part")) for i, p in enumerate(parts)]
        if not tagged:
            return v, 0
        every = tagged[0]
        for t in tagged[1:]:
            every = every.unionByName(t)
        hits = {r["part"]: r["count"] for r in every.groupBy("part").count().collect()}  # a row for each part
        new = []
        for i, n in sorted(hits.items()):
            old = parts[i]
            rows = self._parts([old], "memories", db)
            if changes is not None:
                changed = rows.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in rows.columns])
                if old["shift"]:
                    new.append(self._part(db, changed, self._parts([old], "tf", db)))
                else:
                    new.append(old | {"memories": self._save(changed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORIES]), db)})
            elif n < old["rows"]:
                gone = rows.where(hit).select("id")
                gone = F.broadcast(gone) if n <= FEW else gone  # else all terms of the part would be moved
                new.append(self._part(db, rows.where(~hit), self._parts([old], "tf", db).join(gone, "id", "left_anti")))
        return (_done(v, ("replace", db, [parts[i] for i in sorted(hits)], new)) if hits else v), sum(hits.values())

    def compact(self, v: Version, db: str) -> Version:
        parts = v.dbs[db]["parts"]
        if len(parts) < 2 and not any(p["shift"] for p in parts):
            return v
        return _done(v, ("replace", db, parts, [self._part(db, self.read(v, [db]), self._table(v, [db], "tf"))]))


class Cluster(Store):
    """A directory of stores: main, and one for each further database.

    The databases of all stores below the directory, but of those whose names begin with an underscore, are mounted
    in the order of names when it is opened; two of one name are an error. A new database gets a store of its own; a
    store whose database is dropped is set aside under a name with an underscore.
    """

    def __init__(self, spark: SparkSession, directory: str, extraction: Extraction = Extraction(), password: str | None = None, create: bool = True):
        self.directory = directory.rstrip("/")
        self.mounts: dict[str, str] = {}
        super().__init__(spark, f"{self.directory}/{DEFAULT_DB}", extraction, password, create)
        fs, path = self._files()
        found = sorted(f.getPath().getName() for f in fs.listStatus(path(self.directory)) if f.isDirectory())
        for name in found:
            at = f"{self.directory}/{name}"
            if name == DEFAULT_DB or name.startswith(("_", ".")) or not fs.exists(path(f"{at}/versions")):
                continue
            self.others[at] = Store(spark, at, extraction, password, create=False)
            for db, state in self.others[at].current.dbs.items():
                if db == DEFAULT_DB and not state["parts"]:
                    continue  # every store that was made on its own has one
                if db in self.mounts or db in self.current.dbs:
                    raise EngineError(f"database {db} is in several stores, one of them {at}")
                self.mounts[db] = at
        self.current = self._load()

    def _resolved(self, dbs: dict[str, dict]) -> dict[str, dict]:
        return super()._resolved(dbs) | {n: self._attached(n, at) | {"mounted": True} for n, at in self.mounts.items()}

    def _own(self, dbs: dict[str, dict]) -> dict[str, dict]:
        return super()._own({n: d for n, d in dbs.items() if n not in self.mounts})

    def create(self, v: Version, name: str) -> Version:
        name = checked_name(name)
        if name in v.dbs:
            raise EngineError(f"database {name} exists")
        self.given.pop(name, None)
        at = f"{self.directory}/{name}"
        self.others[at] = Store(self.spark, at, self.extraction, self.password, first=name)
        self.mounts[name] = at
        return self.reload() if self.homes else replace(v, dbs=self._resolved(self._own(v.dbs)))

    def drop(self, v: Version, name: str) -> Version:
        if name not in self.mounts:
            return super().drop(v, name)
        at = self.mounts.pop(name)
        self.homes.pop(name, None)
        self.others.pop(at, None)
        fs, path = self._files()
        fs.rename(path(at), path(f"{self.directory}/_dropped-{name}-{uuid.uuid4().hex[:8]}"))
        self.current = self._load()
        return self.current

    def detach(self, v: Version, name: str) -> Version:
        if name in self.mounts:
            raise EngineError(f"database {name} belongs to this directory")
        return super().detach(v, name)

    def status(self, v: Version) -> list[tuple[str, object]]:
        rows = [("cluster_dir", self.directory), ("databases", len(v.dbs)), ("files_open", 1 + len(self.others))]
        for at in [self.path, *sorted(self.others)]:
            rows.append((f"file:{at}", sum(p["rows"] for n, d in v.dbs.items() for p in d["parts"] if self.homes.get(n, self.path) == at)))
        return rows
