"""What the operators share: shared-folder tables, bounded bitmaps, word hashes and connected components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts may be long, so that batches stay small in bytes.
BATCH_ROWS = 512
#: Words kept by a worker's cache of hashes; others are hashed each time.
CACHED_WORDS = 100_000

U64 = np.uint64
_SHIPPED: set[str] = set()
_TABLES: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small and make sure that executors can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if str(root) not in os.environ.get("PYTHONPATH", "").split(os.pathsep) and app not in _SHIPPED:
        _SHIPPED.add(app)
        folder = tempfile.mkdtemp()
        with zipfile.ZipFile(f"{folder}/engram_code.zip", "w") as out:
            for p in sorted((root / "engram").rglob("*.py")):
                out.write(p, p.relative_to(root))
        spark.sparkContext.addPyFile(f"{folder}/engram_code.zip")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset (tests in local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="engram-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it survives lost executors and has a known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that this application has materialized; results that read them must be written before."""
    jvm = spark._jvm
    while _TABLES:
        at = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    elif pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


# --- word and window hashes -------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hashes of words, looked up at C speed once they are known."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) <= 64:
            self[word] = h
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that their order is random."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words, by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    scale, out, have, run, width = 0x9E3779B97F4A7C15, None, 0, h, 1
    while True:
        if k & width:
            part = run[have : have + n]
            out = part.copy() if out is None else out * U64(scale) + part
            have += width
        if have == k:
            return mix(out)
        run = run[:-width] * U64(scale) + run[width:]
        width *= 2
        scale = (scale * scale * 0x2545F4914F6CDD1D) % 2**64 | 1


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its k-word shingles, A-Z in lower case; a shorter text is one.

    The texts of a batch are hashed in one go; windows over the end of a text are left out.
    """
    words = [t.lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    total = int(ends[-1]) if words else 0
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), U64, total)
    windows = window_hashes(h, k)
    out = []
    for w, end in zip(words, ends.tolist(), strict=True):
        n, start = len(w), end - len(w)
        if n >= k:
            out.append(distinct_sorted(windows[start : end - k + 1]))
        elif n:
            out.append(window_hashes(h[start:end], n) ^ U64(0xA5A5A5A5 + n))
        else:
            out.append(np.empty(0, U64))
    return out


# --- bitmaps of fixed size ----------------------------------------------------------------------


def bitmap(rows: DataFrame, position: str, bits: int) -> np.ndarray:
    """Collect a set of bit positions below 2**bits as 2**bits / 8 bytes, however many rows there are."""
    at = rows.select(F.col(position).cast("long").alias("p")).selectExpr("CAST(shiftright(p, 6) AS INT) w", "shiftleft(1L, CAST(p & 63 AS INT)) b")
    found = at.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found["w"].to_numpy()] = found["b"].to_numpy()
    return words.view(U64)


def in_bitmap(words: np.ndarray, position: np.ndarray) -> np.ndarray:
    position = position.astype(U64)
    return (words[position >> U64(6)] >> (position & U64(63))) & U64(1) != 0


#: Most bits of a bitmap that filters by id before a shuffle.
ID_BITS = 24


@dataclass(frozen=True)
class Ids:
    """A bitmap of hashes as a table of 64-bit words, 2 ** (bits - 6) rows at most: a bounded broadcast.

    There are eight bits for an id or more as long as ID_BITS allow; beyond that the bitmap fills up and saves less.
    """

    words: DataFrame
    bits: int

    @classmethod
    def of(cls, ids: DataFrame, column: str) -> Ids:
        bits = min(ID_BITS, max(12, ids.count().bit_length() + 3))
        at = ids.select(F.pmod(F.xxhash64(F.col(column)), F.lit(1 << bits)).alias("p"))
        words = at.selectExpr("shiftright(p, 6) w", "shiftleft(1L, CAST(p & 63L AS INT)) b").groupBy("w").agg(F.bit_or("b").alias("b"))
        return cls(materialize(words, "bitmap"), bits)

    def among(self, df: DataFrame, column: str, inside: bool = True) -> DataFrame:
        """The rows whose id is in the bitmap (with some others), or those whose id is surely not; in the JVM."""
        at, w, b = (fresh(df, c) for c in ("position", "word", "bits"))
        rows = df.withColumn(at, F.pmod(F.xxhash64(F.col(column)), F.lit(1 << self.bits)))
        rows = rows.join(F.broadcast(self.words.selectExpr(f"w {w}", f"b {b}")), F.shiftright(at, 6) == F.col(w), "left")
        held = F.expr(f"coalesce(shiftrightunsigned({b}, CAST({at} & 63L AS INT)) & 1L = 1L, false)")
        return rows.where(held if inside else ~held).select(every(df))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running(df: DataFrame, order: list[Column], *sums: str) -> DataFrame:
    """df with place, from 1 in a total order, and for each of sums before_<name>, the sum over all earlier rows.

    Two levels: rows are dealt out by ranges of the order and counted in each; a row for each range is summed up.
    """
    stored = materialize(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("range").orderBy(*order)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = stored.groupBy("range").agg(F.count("*").alias("all"), *(F.sum(c).alias(f"all_{c}") for c in sums))
    by = W.orderBy("range")  # as many rows as partitions
    starts = totals.select("range", before("all", by).alias("start"), *(before(f"all_{c}", by).alias(f"start_{c}") for c in sums))
    out = stored.withColumn("at", F.row_number().over(inside))
    for c in sums:
        out = out.withColumn(f"own_{c}", before(c, inside))
    out = out.join(F.broadcast(starts), "range")
    return out.select(*df.columns, (F.col("at") + F.col("start")).alias("place"), *((F.col(f"own_{c}") + F.col(f"start_{c}")).alias(f"before_{c}") for c in sums))


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# --- blobs: many small keyed rows travel as sorted arrays, one binary value for each bucket --------

#: Bits of a key that one shuffle deals out. Beyond HELD << STEP rows a second shuffle deals out as many again.
STEP = 11
#: Rows that a bucket holds, about.
HELD = 1 << 20
#: Rows gathered before a sorted run of them is sent.
FLUSH = 1_000_000
BLOBS = "bucket int, own long, rows binary"


def bits_for(total: int) -> int:
    """Bits of the bucket number for about `total` rows: buckets are in the thousands, or in the millions."""
    return STEP if total <= HELD << STEP else 2 * STEP


def partitions_for(size: int) -> int:
    """Partitions for so many bytes of blobs: some thousands at most, each reads its buckets one by one."""
    return min(8192, max(16, size >> 23))


def blob_batch(bucket: np.ndarray, own: np.ndarray | None, starts: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """BLOBS rows: rows[starts[i] : starts[i + 1]] for each bucket (or owner), without a copy."""
    ends = (np.append(starts, len(rows)) * rows.itemsize).astype(np.int32)
    values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows).view(np.uint8))])
    owner = pa.nulls(len(starts), pa.int64()) if own is None else pa.array(own.astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), owner, values], ["bucket", "own", "rows"])


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


def keyed(rows: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of a structured array, sorted by their field key, as a blob for each bucket that has any."""
    top = rows["key"] >> U64(64 - bits)
    at = run_starts(top)
    return blob_batch(top[at], None, at, rows)


def dealt(sent: DataFrame, kind: np.dtype, total: int) -> DataFrame:
    """BLOBS sorted by bucket in each partition; sent has buckets of the first STEP bits.

    The number of partitions is bounded. Where buckets would be too large to hold, a second shuffle deals each of
    them out again: its tasks gather many small blobs into sorted runs first, so that blobs stay large. Rows with
    an owner pass through.
    """
    parts = partitions_for(total * kind.itemsize)
    near = sent.repartition(parts, "bucket")
    bits = bits_for(total)
    if bits > STEP:

        low = 8 * kind["key"].itemsize

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, tops, n = [], [], 0

            def flush() -> pa.RecordBatch:
                rows = np.concatenate(held)
                key = rows["key"].astype(U64)
                top = key >> U64(64 - bits) if low == 64 else (np.concatenate(tops) << U64(STEP)) | (key >> U64(low - STEP))
                order = np.argsort(top, kind="stable")
                top = top[order]
                at = run_starts(top)
                return blob_batch(top[at], None, at, rows[order])

            for b in batches:
                yield b.filter(pc.is_valid(b.column(1)))
                for bucket, own, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if own is None:
                        held.append(np.frombuffer(raw, kind))
                        tops.append(np.full(len(held[-1]), bucket, U64))
                        n += len(held[-1])
                    if n >= FLUSH:
                        yield flush()
                        held, tops, n = [], [], 0
            if held:
                yield flush()

        near = near.mapInArrow(again, BLOBS).repartition(parts, "bucket")
    return near.sortWithinPartitions("bucket")


def each_bucket(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple[int | None, np.ndarray | pa.RecordBatch]]:
    """Bucket and rows of each, one bucket at a time and sorted by key; rows with an owner come as batches of None."""
    last, parts = None, []
    for b in batches:
        yield None, b.filter(pc.is_valid(b.column(1)))
        for bucket, own, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if own is not None:
                continue
            if bucket != last and parts:
                rows, parts = np.concatenate(parts), []
                yield last, rows[np.argsort(rows["key"], kind="stable")]
            last = bucket
            parts.append(np.frombuffer(raw, kind))
    if parts:
        rows = np.concatenate(parts)
        yield last, rows[np.argsort(rows["key"], kind="stable")]


# --- connected components ---------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node that links reach.

    Alternating large-star and small-star rounds until no edge changes; all state stays in tables. Hubs are
    handled by an aggregate and a join, which adaptive execution splits, and never gathered in one task.
    """
    edges = materialize(links.selectExpr("greatest(a, b) u", "least(a, b) v").where("u <> v").distinct(), "cc")
    while True:
        both = edges.unionByName(edges.selectExpr("v u", "u v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").selectExpr("v u", "m v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("explode(array(struct(v u, m v), struct(u u, m v))) e").selectExpr("e.u u", "e.v v").where("u <> v").distinct()
        new = materialize(small, "cc")
        a, b = (t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() for t in (edges, new))
        edges = new
        if a == b:
            break
    out = edges.selectExpr("u node", "v component")
    return out.unionByName(edges.selectExpr("v node", "v component").distinct())
