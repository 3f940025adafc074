"""Packing documents into sequences of fixed length (shortest pack first over the length histogram)."""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, materialize, prepare

#: Where a letter ends and plain punctuation begins, tokenizers of words always cut.
_CUT = re.compile(rb"(?<=[a-z])(?=[.,!*$%&#|])")
_PLAIN = re.compile(rb"[a-z]+")
_CACHED = 400_000
_CODERS: dict[str, Coder] = {}


class Coder:
    """Token ids of whole texts, by a cache of the ids of words.

    The tokenizer lower-cases its input, drops white space and never joins what white space parts, so that a
    text's ids are those of its words in order. Texts that hold a special token's string take the slow way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ids: dict[bytes, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        """Words of a-z alone are one unit of the model; other letters go in groups, the rest one by one."""
        tokenize = self.tokenizer.model.tokenize
        other = []
        for w in words:
            if _PLAIN.fullmatch(w):
                into[w] = np.array([t.id for t in tokenize(w.decode())], "<u4").tobytes()
            else:
                other.append(w)
        letters = [w for w in other if w.decode().isalpha()]
        for i in range(0, len(letters), 200):
            group = letters[i : i + 200]
            found = self.tokenizer.encode(b" ".join(group).decode(), add_special_tokens=False)
            ends = (np.flatnonzero(np.diff(np.array(found.word_ids))) + 1) * 4
            if len(ends) + 1 == len(group):  # else a letter turned into several when it was lower-cased
                ids = np.array(found.ids, "<u4").tobytes()
                into.update(zip(group, (ids[x:y] for x, y in zip([0, *ends.tolist()], [*ends.tolist(), len(ids)], strict=True)), strict=True))
        for w in other:
            if w not in into:
                into[w] = self.plain(w.decode())

    def __call__(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if b"<|" in text and any(s in text for s in self.special):
            return self.plain(text.decode())
        words = _CUT.sub(b" ", text.lower()).split()
        try:
            return b"".join(map(self.ids.__getitem__, words))
        except KeyError:
            new = [w for w in set(words) if w not in self.ids]
            if len(self.ids) + len(new) > _CACHED:  # the cache is full: begin it anew with this text's words
                self.ids, new = {}, list(set(words))
            self.learn(new, self.ids)
            return b"".join(map(self.ids.__getitem__, words))


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def cut(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize each document, end it with end_id and cut it into pieces of at most max_len ids.

    All pieces but a document's last are full. with_ids adds the ids themselves (array of int); else a piece
    is known by its crc32 and only a few numbers of it travel on.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens"))])
    if with_ids:
        schema.add("ids", T.ArrayType(T.IntegerType()))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(tokenizer)
        try:
            for batch in batches:
                yield from pieces(batch, encode)
        finally:
            encode.ids.clear()  # a worker outlives its tasks; its memory should not

    def pieces(batch: pa.RecordBatch, encode: Coder) -> Iterator[pa.RecordBatch]:
        at, rows, ids = [], [], []
        for i, text in enumerate(binary(batch, "text")):
            coded = encode(text) + end
            for s in range(0, len(coded), 4 * max_len):
                piece = coded[s : s + 4 * max_len]
                at.append(i)
                rows.append((s // 4, len(piece) // 4, zlib.crc32(piece), len(coded) // 4))
                if with_ids:
                    ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
        if rows:
            cols = np.array(rows, np.int64)
            out = [batch.column(0).take(pa.array(at)), *(pa.array(cols[:, k]) for k in range(4))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Place lengths, longest first, each into the packs with the most room left, else into new packs.

    Packs with the same room are kept as ranges of consecutive numbers with a count, so that the work depends
    on the number of lengths and not on that of documents. Returns, for each length, runs (count, first pack,
    offset) in the order of rank, and the number of packs.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first pack, count)
    heap: list[int] = []
    runs: dict[int, list[tuple[int, int, int]]] = {}
    packs = 0

    def put(room: int, first: int, count: int) -> None:
        if room not in rooms:
            heapq.heappush(heap, -room)
        ranges = rooms[room]
        if ranges and ranges[-1][0] + ranges[-1][1] == first:
            first, count = ranges[-1][0], ranges.pop()[1] + count
        ranges.append((first, count))

    for length in sorted(histogram, reverse=True):
        left, own = histogram[length], []
        while left:
            if heap and -heap[0] >= length:
                room = -heap[0]
                first, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    heapq.heappop(heap)
                n = min(left, count)
                if n < count:
                    put(room, first + n, count - n)
                own.append((n, first, max_len - room))
                put(room - length, first, n)
                left -= n
                continue
            # no pack has the room: a new one is now the emptiest until it is full, then the next
            each = max_len // length
            for n, held in ((left // each, each), (1, left % each)):
                if n and held:
                    own += [(n, packs, k * length) for k in range(held)]
                    put(max_len - held * length, packs, n)
                    packs += n
            left = 0
        runs[length] = own
    return runs, packs


def pack(pieces: DataFrame, max_len: int = 4096) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, start, length, ...), each at most max_len long.

    The histogram has at most max_len rows, so that the driver plans patterns whatever the corpus. A piece's
    rank among those of its length comes from two levels, salts of a length and places in a salt, about as many of
    each (the root of their number), so that a frequent length spreads over tasks. Empty input gives no rows; repeated rows are packed one by one.
    """
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    runs, _ = shortest_pack_first(histogram, max_len)
    salts = {n: math.isqrt(c - 1) + 1 for n, c in histogram.items()}
    lengths = spark.createDataFrame([(n, s) for n, s in salts.items()], "length long, salts int")  # at most max_len rows
    salted = pieces.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int")).drop("salts")
    bases = salted.groupBy("length", "salt").count()
    bases = bases.withColumn("base", F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))).select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1
    ranked = salted.withColumn("place", place).join(bases, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("base"))
    # Runs depend on max_len alone: each length meets the ranges of packs that longer ones have left.
    table = {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in runs.items()}
    shared = spark.sparkContext.broadcast({n: (np.cumsum(c) - c, first, offset) for n, (c, first, offset) in table.items()})

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for x in np.unique(n):
            mine = n == x
            begin, first, offset = shared.value[int(x)]
            i = np.searchsorted(begin, r[mine], "right") - 1
            seq[mine], off[mine] = first[i] + r[mine] - begin[i], offset[i]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("at", placed("length", "rank")).select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of max_len ids: one row for each piece.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null or empty texts are the end
    id alone. Repeated rows are packed once each; no rows give no rows; other columns, whatever their names, are
    ignored. A long text is tokenized whole by one task and cut into pieces.
    """
    pieces = materialize(cut(docs, tokenizer, max_len, end_id, id_col, text_col), "pieces")
    return pack(pieces, max_len)
