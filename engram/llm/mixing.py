"""Mixing sources to target weights by systematic sampling: DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import every, materialize, running


def _hash(text: Column, seed: int) -> Column:
    """32 bits of a text's md5 with the seed, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed} "), text)), 1, 8), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], most: int = 3) -> DataFrame:
    """Target of each source, for sizes (source, source_size): one row for each source.

    Sources in code point order, null last, take the weights in turn. They share the sum of all sizes by weight,
    but none takes over `most` times its size: with caps in the order of cap / weight, the level that caps leave
    is (total - caps before) / (weights from here on), and the first source whose cap reaches it sets the level of
    all that follow. This is where resharing the excess until none is above ends. All sums are of integers, in two
    levels, so that sources may be many; the total and the level, two rows, come to the driver.
    """
    named = [F.col("source").isNull(), F.col("source")]
    w = running(sizes.select("source", "source_size"), named)
    weight = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    w = w.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap"))
    w = materialize(running(w, [F.col("cap") / F.col("weight"), *named], "cap", "weight"), "levels")
    total = w.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  # products of longs
    w = w.withColumn("rest", F.lit(total["size"]) - F.col("before_cap")).withColumn("shares", F.lit(total["weight"]) - F.col("before_weight"))
    level = wide(F.col("cap")) * wide(F.col("shares")) >= wide(F.col("weight")) * wide(F.col("rest"))
    first = w.where(level).agg(F.min(F.struct("place", "rest", "shares")).alias("first")).first()["first"]
    cap = F.col("cap").cast("double")
    if first is None:
        target = cap
    else:
        share = F.lit(first["rest"]).cast("double") * F.col("weight") / F.lit(first["shares"])
        target = F.when(F.col("place") < first["place"], cap).otherwise(F.least(cap, share))
    return w.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 0, salts: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False
) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, copies, taken.

    A document expects target / source_size copies. Prefix sums of these run through each source; one random offset
    for a source is added, and a document is taken once for each integer that its step crosses. The order rises
    through the size classes (bits and leading digits of the size) with one half of the documents and falls with
    the other, each by salt, size and id: documents of every size are met in proportion, what the offset adds on
    the way up it takes back on the way down, and the words taken come near the target. The offset and the salts
    are hashes of seed, source and id: reruns agree.

    A prefix sum is a rank times the expected copies. Ranks come from three levels, so that no source, however hot,
    meets in one task: counts are summed along the classes of a source, of which there are a few hundred at any
    size, then along the salts of a class, one row for each salt, and ranks are counted inside a cell of source,
    class and salt. Salts grow with the number of rows.

    A document is taken at most its expected copies, rounded up. Null text: size 0; null source: a source of its own; documents of size 0 are ranked as others are, but take no
    words. Repeated rows count one by one. No rows give no rows; a
    long text is only counted. carry adds a column row, a struct of all columns
    of docs, whatever their names.
    """
    if salts is None:
        salts = max(64, docs.count() // 50_000)
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # never null: a plain equi-join
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), key.alias("key"), n_words(F.col(text_col)).alias("size"), *([F.struct(*every(docs)).alias("row")] if carry else []))
    rows = rows.withColumn("salt", _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed) % salts)
    falls = F.col("salt") % 2 == 1
    grade = F.length(F.bin("size")) * 16 + F.conv(F.substring(F.bin("size"), 1, 4), 2, 10).cast("int")
    rows = rows.withColumn("class", F.when(falls, 9999 - grade).otherwise(grade)).withColumn("order", F.when(falls, -F.col("size")).otherwise(F.col("size")))
    sized = materialize(rows.drop("row"), "sizes")
    if not carry:
        rows = sized
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    offset = _hash(F.concat(F.lit("offset "), F.coalesce("source", F.lit("null source"))), seed) / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets(sources, weights, most).select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("key"), "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    cells = sized.groupBy("key", "class", "salt").count()
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = cells.groupBy("key", "class").agg(F.sum("count").alias("n"))
    classes = classes.select("key", "class", before("n", W.partitionBy("key").orderBy("class")).alias("start")).join(rates, "key")
    cells = cells.select("key", "class", "salt", before("count", W.partitionBy("key", "class").orderBy("salt")).alias("inside"))
    cells = cells.join(classes, ["key", "class"]).withColumn("base", F.col("start") + F.col("inside")).drop("start", "inside")
    place = F.row_number().over(W.partitionBy("key", "class", "salt").orderBy("order", "doc_id"))
    ranked = rows.withColumn("place", place).join(cells, ["key", "class", "salt"])
    rank = F.col("base") + F.col("place")
    copies = (F.floor(F.col("offset") + rank * F.col("rate")) - F.floor(F.col("offset") + (rank - 1) * F.col("rate"))).cast("long")
    copies = F.least(copies, F.ceil("rate").cast("long"))  # sums of doubles could cross one integer more
    out = ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), *(["row"] if carry else []))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    taken = mix_sources(docs, carry=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
