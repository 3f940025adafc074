"""Search and association: BM25 over an expanded query, re-ranked by keyword cosine."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import Extraction, keyword_scores, term_counts
from .index import Index, cooccurrence, document_frequency, idf


@dataclass(frozen=True)
class Ranking:
    k1: float = 1.2
    b: float = 0.75
    hops: int = 1
    expansion_limit: int = 8
    decay: float = 0.5
    similarity_weight: float = 0.5
    min_score: float = 0.0
    limit: int = 10


#: Terms and weights; a query has at most max_keywords of them.
Vector = list[tuple[str, float]]


def text_vector(spark: SparkSession, text: str, how: Extraction = Extraction()) -> Vector:
    """The keywords of a query text."""
    row = spark.createDataFrame([(0, text)], "q int, content string").coalesce(1)
    return [(r.term, r.weight) for r in keyword_scores(term_counts(row, ["q"], how=how), ["q"], how).select("term", "weight").collect()]


def seed_vector(index: Index, db: str, id: int) -> Vector:
    """The stored keywords of one memory."""
    found = index.memories.where((F.col("db") == db) & (F.col("id") == id)).select("keywords").first()
    return [(k.term, float(k.weight)) for k in found.keywords] if found else []


def in_dbs(df: DataFrame, dbs: list[str] | None) -> DataFrame:
    return df if dbs is None else df.where(F.col("db").isin(dbs))


def _of(df: DataFrame, terms) -> DataFrame:
    """The rows of a few terms: a literal list, which reaches the scan."""
    return df.where(F.col("term").isin(sorted(set(terms))))


def _summed(vector: Vector) -> dict[str, float]:
    total: dict[str, float] = {}
    for term, weight in vector:
        total[term] = total.get(term, 0.0) + weight
    return total


def _frame(index: Index, vector: Vector) -> DataFrame:
    """(term, weight); a query's terms."""
    return index.stats.sparkSession.createDataFrame(sorted(_summed(vector).items()), "term string, weight double")


def _per_db(index: Index, vector: Vector, dbs: list[str] | None) -> DataFrame:
    """The vector in each database: at most as many rows as a query has terms times the databases."""
    rows = [(r.db, *x) for r in in_dbs(index.stats, dbs).select("db").collect() for x in sorted(_summed(vector).items())]
    return index.stats.sparkSession.createDataFrame(rows, "db string, term string, weight double")


def expand(index: Index, vector: Vector, how: Ranking = Ranking(), dbs: list[str] | None = None) -> DataFrame:
    """(db, term, weight): the terms that most often share a memory with the query's, hop by hop.

    A hop h multiplies by decay ** h on top of the weight that its frontier already has. Only the query's own terms
    are left out of every hop; a term that is reached twice adds up. The first hop reads the postings of the
    query's terms only.
    """
    seeds = sorted(_summed(vector))
    entries, found, frontier = in_dbs(index.postings, dbs), None, None
    for hop in range(1, how.hops + 1):
        if frontier is None:
            edges = cooccurrence(_of(entries, seeds)).join(F.broadcast(_frame(index, vector)), "term")  # a query's terms
            counts = document_frequency(_of(in_dbs(index.tf, dbs), seeds))
        else:
            edges = cooccurrence(entries.join(frontier.select("db", "term"), ["db", "term"], "left_semi")).join(frontier, ["db", "term"])
            counts = index.df
        weight = F.col("weight") * F.col("cnt") / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)) * F.lit(how.decay**hop)
        step = edges.join(counts, ["db", "term"], "left").select("db", F.col("other").alias("term"), weight.alias("weight")).where(~F.col("term").isin(seeds))
        frontier = step.groupBy("db", "term").agg(F.sum("weight").alias("weight"))
        found = frontier if found is None else found.unionByName(frontier).groupBy("db", "term").agg(F.sum("weight").alias("weight"))
    if found is None:
        return _per_db(index, vector, dbs).where("false")
    best = W.partitionBy("db").orderBy(F.desc("weight"), "term")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= how.expansion_limit).drop("r")


def bm25(index: Index, query: DataFrame, how: Ranking = Ranking()) -> DataFrame:
    """(db, id, bm25) of the memories that hold a term of query (db, term, weight).

    query has a few rows for each database, which come to the driver: their terms, as literals, select the pages of
    the term table that are read. The rows found say how many memories hold a term.
    """
    rows = [tuple(r) for r in query.select("db", "term", "weight").collect()]  # keywords and expansion limits bound it
    small = index.stats.sparkSession.createDataFrame(rows, "db string, term string, weight double")
    hits = in_dbs(_of(index.tf, [r[1] for r in rows]), sorted({r[0] for r in rows})).join(F.broadcast(small), ["db", "term"])  # as above
    terms = idf(document_frequency(hits), index.stats)
    full = hits.join(terms.select("db", "term", "idf"), ["db", "term"]).join(index.stats, "db")
    norm = F.col("tf") + how.k1 * (1 - how.b + how.b * F.greatest(F.col("dl"), F.lit(1)) / F.col("avgdl"))
    return full.groupBy("db", "id").agg(F.sum(F.col("weight") * F.col("idf") * F.col("tf") * (how.k1 + 1) / norm).alias("bm25"))


def cosine(entries: DataFrame, vector: Vector) -> DataFrame:
    """(db, id, cosine) between a vector and the keywords of the memories that share a term with it; others have 0."""
    total = _summed(vector)
    q = entries.sparkSession.createDataFrame(sorted(total.items()), "term string, q double")
    length = math.sqrt(sum(x * x for x in total.values()))
    sums = _of(entries, total).join(F.broadcast(q), "term").groupBy("db", "id").agg(F.sum(F.col("weight").cast("double") * F.col("q")).alias("dot"), F.first("norm").alias("n"))  # a query's terms
    norm = F.col("n") * F.lit(length)
    value = F.when(norm > 0, F.least(F.greatest(F.col("dot") / norm, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return sums.select("db", "id", value.alias("cosine"))


def rank(index: Index, vector: Vector, how: Ranking = Ranking(), dbs: list[str] | None = None, without: tuple[str, int] | None = None) -> DataFrame:
    """(db, id, score), best first: every database is ranked by its own statistics, then all are merged."""
    query = _per_db(index, vector, dbs).unionByName(expand(index, vector, how, dbs))
    scores = bm25(index, query, how)
    if without:
        scores = scores.where(~((F.col("db") == without[0]) & (F.col("id") == without[1])))
    near = cosine(in_dbs(index.postings, dbs), vector)
    joint = F.round(F.col("bm25") + how.similarity_weight * F.coalesce("cosine", F.lit(0.0)), 4)
    all_rows = scores.join(near, ["db", "id"], "left").select("db", "id", joint.alias("score"))
    return all_rows.where(F.col("score") >= how.min_score).orderBy(F.desc("score"), "db", "id").limit(how.limit)


def search(index: Index, text: str, how: Ranking = Ranking(), dbs: list[str] | None = None, extraction: Extraction = Extraction()) -> DataFrame:
    return rank(index, text_vector(index.memories.sparkSession, text, extraction), how, dbs)


def related(index: Index, db: str, id: int, how: Ranking = Ranking(), dbs: list[str] | None = None) -> DataFrame:
    """Memories that share keywords with one; it is left out in its own database only."""
    return rank(index, seed_vector(index, db, id), how, dbs or [db], (db, id))


def materialized(index: Index, ranked: DataFrame) -> DataFrame:
    """db, id, score, content, keywords, tags, importance of ranked rows, at most a ranking's limit of them."""
    found = [tuple(r) for r in ranked.select("db", "id", "score").collect()]
    rows = index.stats.sparkSession.createDataFrame(found, "db string, id long, score double")
    return index.memories.where(F.col("id").isin([r[1] for r in found])).join(F.broadcast(rows), ["db", "id"]).select("db", "id", "score", "content", "keywords", "tags", "importance")


def by_keyword(index: Index, db: str, term: str, limit: int) -> DataFrame:
    hits = index.postings.where((F.col("db") == db) & (F.col("term") == term))
    return hits.orderBy(F.desc("weight"), "id").limit(limit)


def all_terms(index: Index, db: str) -> DataFrame:
    return index.postings.where(F.col("db") == db).groupBy("term").agg(F.count("*").alias("n")).orderBy("term")


def hottest(heat: DataFrame, limit: int) -> DataFrame:
    return heat.orderBy(F.desc("heat"), "id").limit(limit)
