"""Exact duplicates by content-defined chunk recipes: DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

#: What equality ignores: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
#: A piece of text up to the end of a run of marks, of any script.
_PIECE = r"[^\p{IsPunctuation}$+<=>^`|~]*[\p{IsPunctuation}$+<=>^`|~]+|[^\p{IsPunctuation}$+<=>^`|~]+"


def _sha256(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 16, most: int = 4096, digest: Callable[[Column], Column] = _sha256, proof: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, n_chars, text_sha256, chunks): the recipe of each text without its white space.

    A chunk ends after a piece, up to some marks, whose hash says so, which one in one_in does: cuts depend on
    content alone, in any script. Equal texts have equal chunks, and long texts that share a part share its chunks
    from the first cut in it on. Chunks of more than `most` code points, and texts without marks, are cut there.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), F.translate(text, SPACE, "").alias("t"))
    pieces = F.regexp_extract_all("t", F.lit(_PIECE), F.lit(0))
    ended = F.transform(pieces, lambda p: F.when(F.pmod(F.xxhash64(p), F.lit(one_in)) == 0, F.concat(p, F.lit("\n"))).otherwise(p))
    # the text has no line ends of its own any more; the pattern takes `most` code points of a line at a time
    cuts = F.regexp_extract_all(F.array_join(ended, ""), F.lit(rf"[^\n]{{1,{most}}}"), F.lit(0))
    recipe = F.transform(cuts, lambda c: F.struct(digest(c).alias("digest"), F.char_length(c).alias("size"), proof(c).alias("proof")))
    return plain.select("doc_id", "n_chars", F.sha2("t", 256).alias("text_sha256"), recipe.alias("chunks"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cut) -> DataFrame:
    r"""One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without [\x20\x09-\x0D]; null counts as empty, and all empty texts are
    equal. Of equal texts the row with the most code points stays, then the smallest doc_id (a null id before
    others). Rows with the id of the row that stays are all kept: ids tell rows apart. Other columns, whatever their
    names, are ignored; an empty table gives no rows. A long text is cut by one task, and travels no further.

    Chunks become identifiers: one number for each digest, size and proof (a second hash) that occur more than once,
    so that occurrences whose digests agree and whose contents do not are told apart. A text with a chunk that
    occurs once has no copy. Of the others the ordered lists of identifiers are compared, then the digest of the
    whole text as a last check. Texts move nowhere: shuffles carry some 50 bytes for about a thousand characters.
    Counts of a hot group are summed before the shuffle, and the joins are plain equi-joins, which adaptive
    execution splits where they are skewed.
    """
    recipes = materialize(chunked(docs, id_col, text_col, **cut).withColumn("rid", F.monotonically_increasing_id()), "recipes")
    lists = recipes.select("rid", F.size("chunks").alias("n"), F.posexplode("chunks").alias("at", "c")).select("rid", "n", "at", "c.digest", "c.size", "c.proof")
    known = lists.groupBy("digest", "size", "proof").agg(F.count("*").alias("times")).where("times > 1")
    known = materialize(known.select("digest", "size", "proof", F.monotonically_increasing_id().alias("chunk_id")), "chunks")
    numbered = lists.join(known, ["digest", "size", "proof"]).groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("at", "chunk_id"))).alias("ids"))
    whole = numbered.where(F.size("ids") == F.col("n")).select("rid", F.transform("ids", lambda x: x["chunk_id"]).alias("ids"))
    empty = recipes.where(F.size("chunks") == 0).select("rid", F.array().cast("array<bigint>").alias("ids"))
    lined = whole.unionByName(empty).join(recipes.drop("chunks"), "rid")
    lined = materialize(lined, "lists")
    groups = lined.groupBy("ids", "text_sha256").agg(F.min(F.struct((-F.col("n_chars")).alias("order"), "doc_id")).alias("best"), F.count("*").alias("group_size"))
    groups = materialize(groups.where("group_size > 1"), "groups")
    copies = lined.select("rid", "ids", "text_sha256").join(groups, ["ids", "text_sha256"]).select("rid", F.col("best.doc_id").alias("keep_id"), "group_size")
    out = recipes.select("rid", "doc_id", "text_sha256").join(copies, "rid", "left").withColumn("alone", F.col("group_size").isNull())
    keep = F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns."""
    name = fresh(docs, "keep")
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")
