"""Exact Jaccard links of documents over word shingles, by a matrix of token groups.

Stages, none of which moves all pairs of anything:

1. Documents with one shingle set form a class; its smallest id stands for it.
2. Groups of similar documents: classes that share a min-hash are compared with the first of them, and exact links
   are closed. Thousands of near copies so become one group, in three comparisons each.
3. Token-group matrix: for each group the union of its members' prefix tokens. A document's prefix are its
   n - ceil(t n) + 1 first tokens in one global order; two sets of similarity t or more share a prefix token. Its
   index tokens are the first n - ceil(2 t n / (1 + t)) + 1 of them; the smaller of two linked sets has a shared one
   there. The order puts tokens of many documents last (any order is correct). Groups meet at a rare token if both
   hold it, at a frequent one only if one of them has it among its index tokens: of documents that share a passage
   and are not alike enough, the index tokens are their own, and they do not meet.
4. A pair of groups is opened only if what their prefixes share, and what can lie beyond it, is enough. There, a
   query document's overlap with the members is counted at once, but only if its overlap with the union of their
   sets is enough.
5. The links close the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BLOBS, U64, Ids, binary, bitmap, blob_batch, components, dealt, each_bucket, fresh, in_bitmap, keyed, materialize, mix, prepare, run_starts, shingle_sets

#: Tokens of the members of a group that are compared in one go, and least tokens of the queries that meet them.
MEMBERS = 1 << 20
ASK = 1 << 15
#: Tokens that a document counts besides its own.
EACH = 64
#: Tokens of at least so many documents come last in the global order: so many or a power of four times as many, the
#: least with which the bitmap of such tokens is a quarter full at most.
FREQUENT = 24
#: Bits of that bitmap: 2 MB, whatever the corpus.
FREQUENT_BITS = 24
#: A token of so many powers of four more documents is hot: its places are dealt out to SALTS buckets.
HOT_LEVELS = 4
SALTS = 64
#: A run of sent rows counts a token so often at most: enough for the first limit, and no token floods its bucket.
TIMES = 32
#: Rows gathered before sorted runs of them are sent.
FLUSH = 500_000
_SPREAD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_COUNTED = np.dtype([("key", "<u4")])  # the 32 bits of a token after those of its bucket
#: late is on a scale of 15 bits, 1000 log2(x + 1), rounded up.
_ENTRY = np.dtype([("key", "<u8"), ("grp", "<i8"), ("late", "<u2")])
#: Bit of an entry whose group meets all others at this token.
_MEETS = np.uint16(1 << 15)
_PROFILE = np.dtype([("n", "<i8"), ("c1", "<i8"), ("c2", "<i8"), ("k", "<i8", 3)])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")


def _places(tokens: np.ndarray) -> np.ndarray:
    """Places in the bitmap of frequent tokens, from the bits of a token that are counted."""
    return ((tokens >> U64(32 - common.STEP)) * U64(_SPREAD[0])) >> U64(64 - FREQUENT_BITS)


def profiles(texts: DataFrame, words: int, total: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, c1, c2, k0, k1, k2) of each document, and (place, level) of tokens in FREQUENT documents or more.

    n is the size of a document's set, c1 and c2 are 128 bits that stand for it, k are three min-hashes. Tokens are
    counted in the same pass: they travel as sorted runs of 32-bit remainders in buckets. Two tokens that agree in
    the 43 bits that count are one, which only changes their place in the order. A level is a power of four.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held)) >> U64(32 - common.STEP)
            starts = run_starts(keys)
            sizes = np.diff(np.append(starts, len(keys)))
            keys = np.repeat(keys[starts], np.minimum(sizes, TIMES))
            top = keys >> U64(32)
            at = run_starts(top)
            return blob_batch(top[at], None, at, keys.astype("<u4"))

        for b in batches:
            ids = b.column(0).to_numpy()
            rows = np.zeros(len(ids), _PROFILE)
            for i, s in enumerate(shingle_sets(binary(b, "text"), words)):
                if len(s):
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    rows[i] = (len(s), *np.array([d >> 64, d & (2**64 - 1)], U64).view(np.int64), np.array([(s * U64(m)).min() for m in _SPREAD], U64).view(np.int64))
                    held.append(s)
                    n += len(s)
            if len(ids):
                yield blob_batch(mix(ids.view(U64)) >> U64(64 - common.STEP), ids, np.arange(len(ids)), rows)
            if n >= FLUSH:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
            filled = [*cols, *[np.zeros(len(cols[0]), np.int64)] * (7 - len(cols))]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c) for c in filled)], ["kind", "id", "n", "c1", "c2", "k0", "k1", "k2"])

        for bucket, rows in each_bucket(batches, _COUNTED):
            if bucket is None:
                if rows.num_rows:
                    p = np.concatenate([np.frombuffer(x, _PROFILE) for x in rows.column(2).to_pylist()])
                    yield out(0, [rows.column(1).to_numpy(), *(np.ascontiguousarray(x) for x in (p["n"], p["c1"], p["c2"], *p["k"].T))])
                continue
            starts = run_starts(rows["key"])
            sizes = np.diff(np.append(starts, len(rows)))
            often = sizes >= FREQUENT
            if often.any():
                low = rows["key"][starts[often]].astype(U64)
                tokens = U64(bucket >> (bits - common.STEP)) << U64(64 - common.STEP) | low << U64(32 - common.STEP)
                yield out(1, [_places(tokens).astype(np.int64), (np.log2(sizes[often] / FREQUENT) // 2).astype(np.int64)])

    bits = common.bits_for(total)
    found = dealt(texts.mapInArrow(send, BLOBS), _COUNTED, total).mapInArrow(count, "kind int, id long, n long, c1 long, c2 long, k0 long, k1 long, k2 long")
    found = materialize(found, "profiles")
    return found.where("kind = 0").drop("kind"), found.where("kind = 1").select(F.col("id").alias("p"), F.col("n").cast("int").alias("level"))


def frequent_tokens(hits: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of frequent tokens and, among them, of hot ones."""
    rows = {r["level"]: r["count"] for r in hits.groupBy("level").count().collect()}  # a row for each power of four
    level = 0
    while sum(n for k, n in rows.items() if k >= level) > (1 << FREQUENT_BITS) // 4:
        level += 1
    return bitmap(hits.where(F.col("level") >= level), "p", FREQUENT_BITS), bitmap(hits.where(F.col("level") >= level + HOT_LEVELS), "p", FREQUENT_BITS)


def shared_prefixes(members: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int, total: int) -> DataFrame:
    """(a, b, shared, missed): pairs of groups, a < b, that meet at a token.

    members is (grp, text). shared is the number of tokens at which they meet; what else of two members' prefixes is
    shared are frequent tokens outside the index tokens of both, at most `missed`. Rows are made one by (token,
    group) in each run, so that the union that a group sends does not grow with its copies.
    """
    spark = members.sparkSession
    known = spark.sparkContext.broadcast(frequent)  # 2 * 2 ** FREQUENT_BITS bits

    def union(rows: np.ndarray) -> np.ndarray:
        """One row for each (token, group): the most that can be missed, and whether it is an index token."""
        rows = rows[np.lexsort((rows["grp"], rows["key"]))]
        first = np.flatnonzero(np.concatenate(([True], (rows["key"][1:] != rows["key"][:-1]) | (rows["grp"][1:] != rows["grp"][:-1]))))
        late = np.maximum.reduceat(rows["late"] & ~_MEETS, first) | np.maximum.reduceat(rows["late"] & _MEETS, first)
        rows = rows[first]
        rows["late"] = late
        return rows

    def prefixes(sets: list[np.ndarray], group: np.ndarray) -> np.ndarray:
        """The entries of a batch of documents."""
        size = np.array([len(s) for s in sets], np.int64)
        if not size.sum():
            return np.zeros(0, _ENTRY)
        tokens = np.concatenate(sets)
        place = _places(tokens)
        often, hot = in_bitmap(known.value[0], place), in_bitmap(known.value[1], place)
        doc = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(doc * 4 + often + hot, kind="stable")
        at = np.arange(len(tokens)) - np.repeat(np.cumsum(size) - size, size)
        keep = at < (size + (-percent * size) // 100 + 1)[doc]
        index = (at < (size + (-2 * percent * size) // (100 + percent) + 1)[doc])[keep]
        order, doc = order[keep], doc[keep]
        tokens, often, hot = tokens[order], often[order], hot[order]
        late = np.bincount(doc, often & ~index, minlength=len(sets))
        rows = np.zeros(len(doc), _ENTRY)
        rows["key"], rows["grp"], rows["late"] = tokens, group[doc], np.ceil(np.log2(late + 1) * 1000)[doc]
        rows["late"][index | ~often] |= _MEETS
        if hot.any():  # index tokens go to all salts, others to one
            salted, spread = rows[hot], np.repeat(rows[hot & index], SALTS)
            salted["key"] = mix(salted["key"] + mix(salted["grp"].astype(np.int64).view(U64)) % U64(SALTS) + U64(1))
            spread["key"] = mix(spread["key"] + np.tile(np.arange(1, SALTS + 1, dtype=U64), (hot & index).sum()))
            rows = np.concatenate((rows[~hot], salted, spread))
        return rows

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            rows = prefixes(shingle_sets(binary(b, "text"), words), b.column(b.schema.get_field_index("grp")).to_numpy())
            held.append(rows)
            n += len(rows)
            if n >= FLUSH:
                yield keyed(union(np.concatenate(held)), common.STEP)
                held, n = [], 0
        if n:
            yield keyed(union(np.concatenate(held)), common.STEP)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in each_bucket(batches, _ENTRY):
            if bucket is None:
                continue
            rows = union(rows)
            own, late = rows["grp"], rows["late"] & ~_MEETS
            starts = run_starts(rows["key"])
            sizes = np.diff(np.append(starts, len(rows)))
            run = np.repeat(np.arange(len(starts)), sizes)
            meets = (rows["late"] >= _MEETS) | (sizes[run] < FREQUENT)
            asks = np.flatnonzero(meets & (sizes[run] > 1))
            reach = np.cumsum(sizes[run[asks]])
            at = 0
            while at < len(asks):
                end = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + (1 << 20), "right")))
                some = asks[at:end]
                n = sizes[run[some]]
                left = np.repeat(some, n)
                right = np.repeat(starts[run[some]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keep = (own[left] != own[right]) & (~meets[right] | (own[left] < own[right]))
                left, right = left[keep], right[keep]
                if len(left):
                    pair = np.stack((np.minimum(own[left], own[right]), np.maximum(own[left], own[right])), 1)
                    missed = np.minimum(late[left], late[right])
                    order = np.lexsort((pair[:, 1], pair[:, 0]))
                    pair, missed = pair[order], missed[order]
                    first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]).any(1))))
                    times = np.diff(np.append(first, len(pair)))
                    missed = np.floor(2 ** (np.maximum.reduceat(missed, first) / 1000) - 1 + 1e-6).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[first, 0]), pa.array(pair[first, 1]), pa.array(times.astype(np.int64)), pa.array(missed)], ["a", "b", "shared", "missed"])
                at = end

    sent = members.mapInArrow(send, BLOBS)
    met = dealt(sent, _ENTRY, total).mapInArrow(meet, "a long, b long, shared long, missed long")
    return met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("missed").alias("missed"))


def verify(texts: DataFrame, members: DataFrame, queries: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members (grp, id, n) and queries (grp, id, n) of a group.

    Large groups are dealt out: about MEMBERS tokens of members and as many or ASK of the queries meet in a task's
    run of rows, members first, so that each is sent once unless both are many. The task holds the sets of these
    members as one sorted index and one query at a time. A query is looked up only if its overlap with the union of
    the members' sets is enough.
    """
    own, ask = (x.groupBy("grp").agg(F.sum(F.col("n") + EACH).alias(c)) for x, c in ((members, "own"), (queries, "ask")))
    many = own.join(ask, "grp").selectExpr("grp", f"own DIV {MEMBERS} chunks", f"ask DIV greatest({ASK}, least(own, {MEMBERS})) parts")
    many = materialize(many, "chunks")
    own = members.join(many, "grp").selectExpr("grp", "pmod(xxhash64(id), chunks + 1) * (parts + 1) c", "explode(sequence(0L, parts)) p", "id")
    ask = queries.join(many, "grp").selectExpr("grp", "pmod(xxhash64(id), parts + 1) p", "parts", "explode(sequence(0L, chunks)) c", "id")
    tasks = own.selectExpr("grp", "c + p chunk", "0 kind", "id").unionByName(ask.selectExpr("grp", "c * (parts + 1) + p chunk", "1 kind", "id"))
    tasks = materialize(tasks, "tasks")
    rows = tasks.join(Ids.of(tasks, "id").among(texts, "id"), "id").select("grp", "chunk", "kind", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, index = None, [], None
        for b in batches:
            found: list[tuple[np.ndarray, ...]] = []
            cols = [b.column(k).to_pylist() for k in range(4)]
            for group, chunk, kind, own, s in zip(*cols, shingle_sets(binary(b, "text"), words), strict=True):
                if (group, chunk) != last:
                    last, held, index = (group, chunk), [], None
                if kind == 0:
                    held.append((own, s))
                    continue
                if not held:
                    continue
                if index is None:
                    index = _Index(held)
                ids, both, sizes = index.overlaps(s, percent)
                hit = (100 * both >= percent * (sizes + len(s) - both)) & (ids != own)
                if hit.any():
                    other = ids[hit]
                    found.append((np.minimum(other, own), np.maximum(other, own)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "kind", "id").mapInArrow(run, "a long, b long").distinct()


class _Index:
    """The sets of some members as one sorted run of (token, member)."""

    def __init__(self, held: list[tuple[int, np.ndarray]]):
        self.ids = np.array([i for i, _ in held], np.int64)
        self.sizes = np.array([len(s) for _, s in held], np.int64)
        owner = np.repeat(np.arange(len(held)), self.sizes)
        tokens = np.concatenate([s for _, s in held])
        order = np.argsort(tokens, kind="stable")
        self.owner, tokens = owner[order], tokens[order]
        new = np.concatenate(([True], tokens[1:] != tokens[:-1]))
        self.union = tokens[new]
        self.starts = np.append(np.flatnonzero(new), len(tokens))

    def overlaps(self, s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, overlaps and sizes of the members; none if the union bounds all of them below percent."""
        at = np.searchsorted(self.union, s)
        at[at == len(self.union)] = 0
        at = at[self.union[at] == s]
        if 100 * len(at) < percent * len(s):
            return self.ids[:0], self.sizes[:0], self.sizes[:0]
        begin, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        places = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids, np.bincount(self.owner[places], minlength=len(self.ids)), self.sizes


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id.

    Words are lower-cased in A-Z; a document's set are its distinct shingles of `words` words, a shorter text is
    one shingle. Two documents link when 100 * intersection >= percent * union. component_id is the smallest id
    that links reach. Documents without words (null, empty or blank texts) link with nothing. Ids are integers;
    rows without an id get component null and link with nothing. Repeated rows each get a row; rows that share an id
    link as one document, by any of their texts. No rows give no rows; other columns are ignored, whatever their
    names. A long text is held whole in one task, with its shingles.
    """
    spark = prepare(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # tokens, about
    profile, hits = profiles(texts, words, total)
    classes = profile.where("n > 0").groupBy("c1", "c2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "k0", "k1", "k2")))
    classes = materialize(classes, "classes")

    # 2. stars around the first class of each min-hash
    keyed_ = classes.select("rep", "n", F.posexplode(F.array("k0", "k1", "k2")).alias("i", "k"))
    pivots = keyed_.groupBy("i", "k").agg(F.min(F.struct("rep", "n")).alias("first"), F.count("*").alias("m")).where("m > 1").selectExpr("i", "k", "first.rep grp", "first.n own")
    star = materialize(keyed_.join(pivots, ["i", "k"]).where(f"rep <> grp AND 100 * least(n, own) >= {percent} * greatest(n, own)").selectExpr("grp", "own", "rep id", "n").distinct(), "stars")
    near = materialize(verify(texts, star.selectExpr("grp", "grp id", "own n").distinct(), star.select("grp", "id", "n"), words, percent), "links")
    # an id with several texts is one document
    twice = profile.where("n > 0").groupBy("id").agg(F.min("c1").alias("low"), F.max("c1").alias("high")).where("low <> high").select("id")
    twice = profile.where("n > 0").join(twice, "id").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).selectExpr("id a", "rep b")
    firm = materialize(components(near.unionByName(twice)).selectExpr("node rep", "component firm"), "firm")
    placed = materialize(classes.select("rep", "n", "copies").join(firm, "rep", "left").selectExpr("rep", "n", "copies", "coalesce(firm, rep) grp"), "placed")
    sizes = materialize(placed.groupBy("grp").agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("copies").alias("rows")), "group-sizes")

    # 3. the matrix: documents that are groups of their own stay where they are, others meet their groups' names
    several = sizes.where("rows > 1").select("grp").join(placed, "grp").select("rep", "grp")
    named = profile.where("n > 0").select("id", "c1", "c2").join(classes.select("c1", "c2", "rep"), ["c1", "c2"]).join(several, "rep")
    named = materialize(named.groupBy("id").agg(F.min("grp").alias("grp"), F.max(F.expr("id = rep")).alias("stands")), "named")
    known = Ids.of(named, "id")
    alone = known.among(texts, "id", False).select(F.col("id").alias("grp"), "text")
    grouped = known.among(texts, "id").join(named, "id", "left").where("coalesce(stands, true)").select(F.coalesce("grp", "id").alias("grp"), "text")
    pairs = shared_prefixes(alone.unionByName(grouped), frequent_tokens(hits), words, percent, total // 3)

    # 4. open pairs whose bound allows a link
    of = lambda x: sizes.selectExpr(f"grp {x}", f"m m_{x}", f"low low_{x}", f"high high_{x}")
    p = str(percent)
    # tokens beyond both prefixes: at most ceil(p high / 100) - 1 of either; overlap needed: ceil(p (low + low) / (100 + p))
    fits = f"100 * high_a >= {p} * low_b AND 100 * high_b >= {p} * low_a"
    bound = f"shared + missed + greatest(({p} * high_a + 99) DIV 100 - 1, ({p} * high_b + 99) DIV 100 - 1) >= ({p} * (low_a + low_b) + 99 + {p}) DIV (100 + {p})"
    opened = pairs.join(of("a"), "a").join(of("b"), "b").where(f"{fits} AND {bound}").selectExpr("if((m_a, a) < (m_b, b), a, b) q", "if((m_a, a) < (m_b, b), b, a) grp")
    opened = materialize(opened, "opened")
    asking = materialize(opened.join(placed.selectExpr("grp q", "rep id", "n"), "q").select("grp", "id", "n"), "queries")
    inside = placed.join(asking.select("grp").distinct(), "grp").selectExpr("grp", "rep id", "n")
    far = verify(texts, inside, asking, words, percent)

    # 5. close
    joined = materialize(firm.selectExpr("rep a", "firm b").unionByName(far), "links")
    final = materialize(components(joined).selectExpr("node rep", "component"), "components")
    by_class = classes.select("c1", "c2", "rep").join(final, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    linked = profile.where("n > 0").join(by_class, ["c1", "c2"]).select("id", "n", "component")
    out = linked.unionByName(profile.where("n = 0").selectExpr("id", "n", "id component"))
    out = out.selectExpr("id doc_id", "n n_shingles", "component component_id")
    unnamed = docs.where(F.col(id_col).cast("long").isNull()).selectExpr("CAST(NULL AS LONG) doc_id", "CAST(0 AS LONG) n_shingles", "CAST(NULL AS LONG) component_id")
    return out.unionByName(unnamed)


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is its group's smallest; rows that link with nothing, or have no id, stay."""
    found = similar_groups(docs, words, percent, id_col, text_col)
    name = fresh(docs, "gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
