"""Lines that several documents share stay in the first of them only."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Ids, every, materialize

SPACE = " \t\n\x0b\x0c\r"


def line_keys(rows: DataFrame, least_chars: int) -> DataFrame:
    r"""(doc, row, at, h1, h2) from (doc, row, text): places of lines whose key has at least least_chars code points.

    A key is the line without [\x20\x09-\x0D] at its ends and with A-Z in lower case; two 64-bit hashes stand
    for it. row tells apart rows of one id with different texts.
    """
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    keys = F.transform(F.split(lower, "\n"), lambda x: F.btrim(x, F.lit(SPACE)))
    places = F.filter(F.transform(keys, lambda k, i: F.struct(i.alias("at"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"), (F.char_length(k) >= least_chars).alias("long"))), lambda s: s["long"])
    return rows.select("doc", "row", F.explode(places).alias("p")).select("doc", "row", "p.at", "p.h1", "p.h2")


def dedup_lines(docs: DataFrame, least_docs: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    r"""docs with text_col rewritten and, if counts, two columns: n_lines (before) and n_dropped.

    Keys in at least least_docs documents lose all their lines but those in the smallest id that holds them;
    other lines stay in order, joined by \n. Null or empty text is one empty line (and becomes an empty text).
    Rows without an id count as one document after all others. Repeated rows are one document and fare alike.
    No rows give no rows. Other columns are kept as they are, whatever their names; with counts, docs' own n_lines
    and n_dropped give way. A long text is split by one task; only a place in it travels for each line.

    Lines are hashed, not moved: a line travels as two hashes and its place. Documents of a hash are counted with
    a partial aggregate (a hot line gives one row for each task), and hashes over the threshold are joined back to
    their places, a plain join that adaptive execution splits for a hot line. Places to drop, an array for each
    document, then meet the texts by id; texts that lose nothing (but a few, by a bitmap of fixed size) stay where
    they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*every(docs)).alias("all"), F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("row"))
    lines = line_keys(rows, least_chars)
    holders = F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("unnamed")
    if least_docs <= 2:  # two different ids are enough, no distinct count is needed
        shared = lines.groupBy("h1", "h2").agg(*holders).where("first <> last OR (unnamed AND first IS NOT NULL)")
    else:
        once = lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
        shared = once.groupBy("h1", "h2").agg(*holders, F.count("*").alias("n")).where(F.col("n") >= least_docs)
    shared = materialize(shared.select("h1", "h2", "first"), "shared-lines")
    drops = lines.join(shared, ["h1", "h2"]).where("doc IS NULL OR doc <> first").groupBy("doc", "row").agg(F.collect_set("at").alias("gone"))
    drops = materialize(drops.select(F.col("doc").alias("doc1"), F.col("row").alias("row1"), "gone", F.xxhash64("doc", "row").alias("spot1")), "drops")
    known, spotted = Ids.of(drops, "spot1"), rows.withColumn("spot", F.xxhash64("doc", "row"))
    stay = known.among(spotted, "spot", False).withColumn("gone", F.lit(None).cast(drops.schema["gone"].dataType))
    lose = known.among(spotted, "spot").join(drops.drop("spot1"), F.col("doc").eqNullSafe(F.col("doc1")) & (F.col("row") == F.col("row1")), "left")
    both = stay.select("all", "text", "gone").unionByName(lose.select("all", "text", "gone"))
    all_lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("gone")), lambda i: F.get(all_lines, i))
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    names = [c for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    out = [new.alias(c) if c == text_col else F.col("all").getField(c).alias(c) for c in names]
    if counts:
        out += [F.size(all_lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return both.select(*out)
