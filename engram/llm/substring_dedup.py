"""Word spans that occur earlier in the corpus are removed: a De Bruijn graph of word k-mers, compacted.

The nodes are word k-mers, sampled: of each window's k-mers the smallest by hash, so that equal windows sample the
same ones. Edges join the samples that follow one another in a text, with their distance; as k is over half a window,
two samples on an edge leave no word between them out.

1. Copies: of rows with the same text one is a unit of the graph; the others repeat it whole.
2. Nodes: samples meet in buckets by hash, each with the edge before and the edge after it. A node of two places or
   more is repeated. It is open to a side if all its places have the same edge there.
3. Paths: an edge between two nodes that are open to each other does not branch, and all places of either node run
   along it. So repeated nonbranching paths compact in each text, by its own places, into the same spans in all
   texts that hold them, without a walk from text to text. What no path covers, windows over branches and ends,
   stands for itself as a span of one window.
4. Verification: a span is known by 128 bits of its own words, not of its nodes. A group-by gives the first source
   coordinates (id, spot, start) of each path's span, and a join marks those that are not the first. Windows meet in
   buckets; of the windows in one run of sent rows only the first goes there, the others are marked at once.
5. Marked spans are removed from the texts.

A window in a path has the places of the path, and any other window has only places that no path covers: a window's
smallest k-mer is sampled at all its places, and if that node lies in a path at one of them, so it does at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BLOBS, U64, Ids, binary, blob_batch, dealt, distinct_sorted, each_bucket, keyed, materialize, mix, prepare, run_starts, window_hashes, word_hashes

#: Rows gathered before a sorted run of them is sent.
FLUSH = 250_000
#: Places of a node in one run of sent rows from which it is hot: its places then stay where they are, and the node
#: counts as branching for all, so that no bucket gathers a passage of a third of all documents.
HOT = 16
#: Stands for a null id, after all others.
_LAST = np.iinfo(np.int64).max
_PLACE = np.dtype([("key", "<u8"), ("spot", "<i8"), ("at", "<i4"), ("before", "<u8"), ("after", "<u8")])
_WINDOW = np.dtype([("key", "<u8"), ("proof", "<u8"), ("doc", "<i8"), ("spot", "<i8"), ("start", "<i4")])
_PATH = np.dtype([("key", "<i8"), ("proof", "<i8"), ("doc", "<i8"), ("start", "<i4"), ("size", "<i4")])
_FORWARD, _BACK = 1, 2
#: Added to the bucket of rows that carry paths.
_PATHS = 1 << 30
_WORDS = r"[^\x20\x09-\x0D]+"


def node_size(window: int) -> int:
    return window // 2 + 1


def _slide(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (minimum or maximum) over each w consecutive values."""
    done = 1
    while done * 2 <= w:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (w - done)], x[w - done :]) if w > done else x


def sampled(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From word hashes: each k-mer's hash, the smallest one of each window, and the places of the samples."""
    g = window_hashes(h, node_size(window))
    w = window - node_size(window) + 1
    least = _slide(g, w, np.minimum)
    pad = np.zeros(w - 1, U64)
    return g, least, np.flatnonzero(_slide(np.concatenate((pad, least, pad)), w, np.maximum) == g)


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x if len(known) else np.zeros(len(x), bool)


def _column(b: pa.RecordBatch, name: str) -> list:
    return b.column(b.schema.get_field_index(name)).to_pylist()


def send_places(units: DataFrame, window: int) -> DataFrame:
    """BLOBS of samples with their edges; places of hot nodes come as answers to their own texts already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["key"], kind="stable")]
            starts = run_starts(rows["key"])
            sizes = np.diff(np.append(starts, len(rows)))
            if (sizes > HOT).any():
                hot = np.repeat(sizes > HOT, sizes)
                yield _answers(rows[hot]["spot"], rows[hot]["at"] << 2)
                news = rows[starts[sizes > HOT]]
                news["at"] = -1  # says that the node is hot
                rows = np.concatenate((rows[~hot], news))
                rows = rows[np.argsort(rows["key"], kind="stable")]
            yield keyed(rows, common.STEP)

        for b in batches:
            for text, spot in zip(binary(b, "text"), _column(b, "spot"), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                g, _, at = sampled(word_hashes(words), window)
                rows = np.zeros(len(at), _PLACE)
                rows["key"], rows["spot"], rows["at"] = g[at], spot, at
                far = np.diff(at).astype(U64)
                rows["after"][:-1] = mix(rows["key"][1:] + mix(far))
                rows["before"][1:] = mix(rows["key"][:-1] + mix(far))
                held.append(rows)
                n += len(rows)
                if n >= FLUSH:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    return units.mapInArrow(run, BLOBS)


def _answers(spot: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Values by text, as BLOBS with an owner."""
    order = np.lexsort((value, spot))
    spot, value = spot[order], value[order]
    at = run_starts(spot)
    return blob_batch(spot[at] & ((1 << common.STEP) - 1), spot[at], at, value.astype("<i4"))


def repeated_nodes(units: DataFrame, window: int, total: int) -> DataFrame:
    """(own, rows): for the texts that hold repeated nodes, their places there (times 4) and open sides."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in each_bucket(batches, _PLACE):
            if bucket is None:
                yield rows
                continue
            starts = run_starts(rows["key"])
            sizes = np.diff(np.append(starts, len(rows)))
            hot = np.minimum.reduceat(rows["at"], starts) < 0
            alike = lambda side: np.minimum.reduceat(rows[side], starts) == np.maximum.reduceat(rows[side], starts)  # noqa: B023, E731
            sides = np.where(hot, 0, alike("after") * _FORWARD + alike("before") * _BACK)
            mine = np.repeat((sizes > 1) | hot, sizes) & (rows["at"] >= 0)
            if mine.any():
                yield _answers(rows["spot"][mine], (rows["at"] << 2)[mine] + np.repeat(sides, sizes)[mine])

    found = dealt(send_places(units, window), _PLACE, total).mapInArrow(meet, BLOBS)
    return found.selectExpr("own spot", "rows marks")


def text_spans(h: np.ndarray, words: list[bytes], marks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths (key, proof, start, size; doc is left open) and windows to judge, from a text's words and its nodes.

    Nonbranching paths of at least a window are one span each; other windows whose smallest k-mer is repeated are
    given by their starts.
    """
    k = node_size(window)
    g, least, _ = sampled(h, window)
    marks = np.sort(marks)
    at, sides = marks >> 2, marks & 3
    windows = _member(least, distinct_sorted(g[at]))
    on = (sides[:-1] & _FORWARD > 0) & (sides[1:] & _BACK > 0)
    begins = np.concatenate(([True], ~on))
    starts, ends = at[begins], at[np.append(begins[1:], True)] + k
    long = ends - starts >= window
    starts, ends = starts[long], ends[long]
    inside = np.zeros(len(windows) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - window + 1, -1)
    paths = np.zeros(len(starts), _PATH)
    proofs = [xxhash.xxh3_128_intdigest(b" ".join(words[i:j])) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    paths["key"] = np.array([p >> 64 for p in proofs], U64).view(np.int64)
    paths["proof"] = np.array([p & (2**64 - 1) for p in proofs], U64).view(np.int64)
    paths["start"], paths["size"] = starts, ends - starts
    return paths, np.flatnonzero(windows & (np.cumsum(inside[:-1]) == 0))


def _first_of_each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in the order of key and place, and which of them are the first of their words."""
    rows = rows[np.lexsort((rows["start"], rows["spot"], rows["doc"], rows["proof"], rows["key"]))]
    same = (rows["key"][1:] == rows["key"][:-1]) & (rows["proof"][1:] == rows["proof"][:-1])
    return rows, np.concatenate(([True], ~same))


def send_spans(held: DataFrame, window: int) -> DataFrame:
    """BLOBS of windows to judge; paths, and windows that are not the first of their run, have an owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows, first = _first_of_each(np.concatenate(some))
            if not first.all():
                yield _answers(rows["spot"][~first], rows["start"][~first])
            yield keyed(rows[first], common.STEP)

        for b in batches:
            found, owners = [], []
            for doc, spot, text, marks in zip(_column(b, "doc"), _column(b, "spot"), binary(b, "text"), _column(b, "marks"), strict=True):
                words = text.split()
                h = word_hashes(words)
                paths, at = text_spans(h, words, np.frombuffer(b"".join(marks), "<i4"), window)
                if len(paths):
                    paths["doc"] = doc
                    found.append(paths)
                    owners.append(spot)
                rows = np.zeros(len(at), _WINDOW)
                rows["key"], rows["proof"] = window_hashes(h, window)[at], window_hashes(mix(h ^ U64(0xD6E8FEB86659FD93)), window)[at]
                rows["doc"], rows["spot"], rows["start"] = doc, spot, at
                some.append(rows)
                n += len(rows)
                if n >= FLUSH:
                    yield from flush()
                    some, n = [], 0
            if found:
                own = np.array(owners, np.int64)
                at = np.cumsum([0] + [len(x) for x in found[:-1]])
                yield blob_batch(_PATHS + (own & ((1 << common.STEP) - 1)), own, at, np.concatenate(found))
        if n:
            yield from flush()

    return held.mapInArrow(run, BLOBS)


def late_windows(sent: DataFrame, total: int) -> DataFrame:
    """BLOBS with owners only: the starts of windows that are not the first, and the paths."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in each_bucket(batches, _WINDOW):
            if bucket is None:
                yield rows
                continue
            rows, first = _first_of_each(rows)
            if not first.all():
                yield _answers(rows["spot"][~first], rows["start"][~first])

    return dealt(sent, _WINDOW, total).mapInArrow(settle, BLOBS)


def late_paths(paths: DataFrame) -> DataFrame:
    """(spot, gone): of the paths (own, rows), start << 32 | size of those that are not the first of their words."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [np.frombuffer(x, _PATH) for x in _column(b, "rows")]
            if some:
                rows = np.concatenate(some)
                spot = np.repeat(b.column(0).to_numpy(), [len(x) for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(spot), *(pa.array(np.ascontiguousarray(rows[c]).astype(np.int64)) for c in _PATH.names)], ["spot", *_PATH.names])

    spans = paths.select("own", "rows").mapInArrow(parse, "spot long, key long, proof long, doc long, start long, size long")
    place = F.struct("doc", "spot", "start")
    firsts = spans.groupBy("key", "proof").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = spans.join(materialize(firsts, "firsts"), ["key", "proof"]).where(place != F.col("first"))
    return late.groupBy("spot").agg(F.collect_list(F.expr("shiftleft(start, 32) | size")).alias("gone"))


class Units:
    """The texts to compare, one of each that copies share: rows (doc, row, proof, spot, text).

    Rows with the same text are copies of the one with the smallest id. Texts without copies are read where they lie
    (rows, less those in a bitmap); the rest, which an exact join has told apart, are stored.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("row"), F.xxhash64(F.lit("second"), text).alias("proof"), text.alias("text"))
        self.rows = rows = rows.withColumn("spot", F.xxhash64("doc", "row", "proof"))
        classes = rows.groupBy("row", "proof").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1")
        classes = materialize(classes, "copied-texts")
        self.copied = Ids.of(classes, "row")
        maybe = self.copied.among(rows, "row").join(classes, ["row", "proof"], "left")
        copies = maybe.where("n IS NOT NULL")
        one = copies.groupBy("row", "proof").agg(F.min("doc").alias("doc"), F.first("text").alias("text")).withColumn("spot", F.xxhash64("doc", "row", "proof"))
        self.stored = materialize(maybe.where("n IS NULL").select(rows.columns).unionByName(one), "units")
        #: (row, proof, doc, times): the copies beside the one that stands for them
        each = copies.groupBy("row", "proof", "doc", "first").agg(F.count("*").alias("c"))
        self.copies = materialize(each.selectExpr("row", "proof", "doc", "c - if(doc = first, 1, 0) times").where("times > 0"), "copies")

    def all(self) -> DataFrame:
        return self.copied.among(self.rows, "row", False).unionByName(self.stored)

    def among(self, ids: Ids, inside: bool = True) -> DataFrame:
        """The units whose spot is among ids (with some others), or those whose spot is surely not."""
        return ids.among(self.copied.among(self.rows, "row", False), "spot", inside).unionByName(ids.among(self.stored, "spot", inside))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""One row for each document: doc_id, n_words, n_removed and text (kept words, joined by one space).

    Words are [^\x20\x09-\x0D]+, unchanged. A word goes if a window of `window` words of its document covers it
    whose sequence also starts earlier: in a smaller id, or earlier in the same document. All windows are judged on
    the input. Null, empty and short texts lose nothing. Ids are integers; rows without an id come after all
    others. Rows that share an id come one after the other, in the order of a hash of their texts, and of rows that
    repeat both one is the first. No rows give no rows; other columns are ignored, whatever their names. A long
    text is held whole in one task, with a few arrays as long as its words.
    """
    prepare(docs.sparkSession)
    total = int(docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) // 32  # samples, about
    units = Units(docs, id_col, text_col)

    # repeated nodes, and the spans of their paths
    nodes = materialize(repeated_nodes(units.all(), window, total), "nodes")
    held = units.among(Ids.of(nodes, "spot")).join(nodes.groupBy("spot").agg(F.collect_list("marks").alias("marks")), "spot")
    found = materialize(late_windows(send_spans(held.select("doc", "spot", "text", "marks"), window), total), "found")
    windows = found.where(F.col("bucket") < _PATHS).groupBy(F.col("own").alias("spot")).agg(F.collect_list("rows").alias("windows"))
    paths = late_paths(found.where(F.col("bucket") >= _PATHS))
    late = materialize(windows.join(paths, "spot", "full"), "late")

    # texts that lose words, and all others
    marked = Ids.of(late, "spot")
    result = "doc long, n_words long, n_removed long, text string"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, starts, gone in zip(binary(b, "text"), _column(b, "windows"), _column(b, "gone"), strict=True):
                words, removed = text.split(), 0
                if starts or gone:
                    edge = np.zeros(len(words) + 1, np.int32)
                    alone = np.frombuffer(b"".join(starts or []), "<i4")
                    paths = np.array(gone or [], np.int64)
                    np.add.at(edge, alone, 1)
                    np.add.at(edge, alone + window, -1)
                    np.add.at(edge, paths >> 32, 1)
                    np.add.at(edge, (paths >> 32) + (paths & (2**32 - 1)), -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    removed = len(words) - len(stay)
                    words = [words[i] for i in stay.tolist()]
                out.append((len(words) + removed, removed, b" ".join(words).decode()))
            cols = list(zip(*out, strict=True)) if out else [(), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc", "n_words", "n_removed", "text"])

    losing = units.among(marked).join(late, "spot", "left").select("doc", "text", "windows", "gone").mapInArrow(cut, result)
    words = F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))
    alone = units.among(marked, False).select("doc", words.alias("w"))
    alone = alone.select("doc", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array_join("w", " ").alias("text"))

    # copies repeat a text with a smaller id (or the same row): all of it, if it has a window
    own = units.stored.select("row", "proof", words.alias("w"))
    again = units.copies.join(own, ["row", "proof"]).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    n, whole = F.size("w").cast("long"), F.size("w") >= window
    again = again.select("doc", n.alias("n_words"), F.when(whole, n).otherwise(F.lit(0)).alias("n_removed"), F.when(whole, F.lit("")).otherwise(F.array_join("w", " ")).alias("text"))
    out = alone.unionByName(losing).unionByName(again)
    return out.select(F.when(F.col("doc") != _LAST, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "text")
