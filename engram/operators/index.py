"""Index tables of memories: all statistics are per logical database, which leads every key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Extraction, key_points, ranked_terms, term_counts
from ..schema import KEYWORDS

KEY = ["db", "id"]


def term_table(rows: DataFrame, how: Extraction = Extraction()) -> DataFrame:
    """(db, id, term, tf, dl, rank, weight) of rows (db, id, content): term frequencies, their sum for the memory, and
    of its keywords the rank and weight.

    Rows that lie together by (db, id) are not moved.
    """
    keys = KEY[::-1]  # a sort looks at a number first
    return ranked_terms(term_counts(rows.select("db", "id", "content"), keys, how=how), keys, how).select(*KEY, "term", "tf", "dl", "rank", "weight")


def keyword_lists(terms: DataFrame) -> DataFrame:
    """(db, id, scored) of a term table: the keywords of each memory that has any, with weights of 64 bits."""
    entry = lambda k: F.struct(k["term"].alias("term"), k["weight"].alias("weight"))
    lists = F.array_sort(F.collect_list(F.struct("rank", "term", "weight")))
    return terms.where("rank IS NOT NULL").groupBy(*KEY).agg(F.transform(lists, entry).alias("scored"))


def with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows (db, id, ...) with scored and with keywords, which are these with weights of 32 bits."""
    none = F.array().cast("array<struct<term:string,weight:double>>")
    full = rows.drop("keywords", "key_points").join(lists, KEY, "left").withColumn("scored", F.coalesce("scored", none))
    return full.withColumn("keywords", F.col("scored").cast(KEYWORDS))


def with_keywords(rows: DataFrame, how: Extraction = Extraction(), terms: DataFrame | None = None) -> DataFrame:
    """rows (db, id, content, ...) with keywords, and scored, which are these with weights of 64 bits.

    terms is the term table of the rows, if it is there already: contents are not tokenized again, and only keywords
    are moved. Without it one shuffle by (db, id) serves the counting, the ranking of terms and the join.
    """
    if terms is None:
        rows = rows.repartition(*KEY)
        terms = term_table(rows, how)
    return with_lists(rows, keyword_lists(terms))


def with_points(rows: DataFrame, how: Extraction = Extraction()) -> DataFrame:
    return rows.withColumn("key_points", key_points(F.col("content"), F.col("scored"), how)).drop("scored")


def extract(rows: DataFrame, how: Extraction = Extraction(), terms: DataFrame | None = None) -> DataFrame:
    """rows (db, id, content, ...) with keywords and key_points, as a write of them would store."""
    return with_points(with_keywords(rows, how, terms), how)


def postings(memories: DataFrame) -> DataFrame:
    """(db, term, id, weight, norm, others) of the stored keywords: norm is the length of the memory's keyword vector,
    others are all its terms, so that neither similarity nor co-occurrence has to look a memory up."""
    norm = F.sqrt(F.aggregate("keywords", F.lit(0.0), lambda a, k: a + k["weight"].cast("double") * k["weight"].cast("double")))
    each = memories.select("db", "id", norm.alias("norm"), F.transform("keywords", lambda k: k["term"]).alias("others"), F.explode("keywords").alias("k"))
    return each.select("db", "k.term", "id", "k.weight", "norm", "others")


def tag_index(memories: DataFrame) -> DataFrame:
    return memories.select("db", F.explode(F.array_distinct("tags")).alias("tag"), "id")


def average_length(total: float, n: int) -> float:
    """Above zero."""
    return max(total / n, 1.1920929e-07)


def doc_lengths(memories: DataFrame, tf: DataFrame) -> DataFrame:
    """(db, id, dl): the sum of term frequencies; 0 for a memory without terms."""
    sums = tf.groupBy(*KEY).agg(F.first("dl").alias("dl"))
    return memories.select(*KEY).join(sums, KEY, "left").select(*KEY, F.coalesce("dl", F.lit(0)).alias("dl"))


def corpus_stats(memories: DataFrame, tf: DataFrame) -> DataFrame:
    """(db, n, avgdl), with avgdl above zero."""
    sums = tf.groupBy("db").agg(F.sum("tf").alias("total"))
    counts = memories.groupBy("db").agg(F.count("*").alias("n"))
    return counts.join(sums, "db", "left").select("db", "n", F.greatest(F.coalesce("total", F.lit(0)) / F.col("n"), F.lit(1.1920929e-07)).alias("avgdl"))


def document_frequency(tf: DataFrame) -> DataFrame:
    return tf.groupBy("db", "term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    value = F.greatest(F.lit(0.0), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    return df.join(stats, "db").select("db", "term", "df", value.alias("idf"))


def cooccurrence(entries: DataFrame) -> DataFrame:
    """(db, term, other, cnt): memories that have both as keywords; of all postings in both directions.

    Of some postings only the edges that begin at their terms: a search never builds the whole graph.
    """
    pairs = entries.select("db", "term", F.explode("others").alias("other"))
    return pairs.where("term <> other").groupBy("db", "term", "other").agg(F.count("*").alias("cnt"))


@dataclass
class Index:
    """What a search reads: stored tables, of which it needs the pages of a few terms, and a row for each database."""

    memories: DataFrame
    postings: DataFrame
    tf: DataFrame  # db, id, term, tf, dl
    stats: DataFrame  # db, n, avgdl

    @property
    def lengths(self) -> DataFrame:
        return doc_lengths(self.memories, self.tf)

    @property
    def df(self) -> DataFrame:
        return document_frequency(self.tf)

    @classmethod
    def build(cls, memories: DataFrame, how: Extraction = Extraction()) -> Index:
        tf = term_table(memories, how).drop("rank", "weight")
        return cls(memories, postings(memories), tf, corpus_stats(memories, tf))


class StoredIndex(Index):
    """An index of rows that stay where they are: each table is written under path when it is first asked for.

    Contents are tokenized and moved once, for the terms. Keywords come from the stored terms and meet the rows when
    somebody reads them; key points are evaluated by who reads them.
    """

    def __init__(self, rows: DataFrame, path: str, how: Extraction = Extraction()):
        self.rows, self.path, self.how = rows, path, how

    def _keep(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.path}/{name}")

    @cached_property
    def _terms(self) -> DataFrame:
        return self._keep("tf", term_table(self.rows.select("db", "id", "content").repartition(*KEY), self.how), "term", "db")

    @cached_property
    def _lists(self) -> DataFrame:
        return self._keep("keywords", keyword_lists(self._terms))

    @cached_property
    def memories(self) -> DataFrame:
        return with_points(with_lists(self.rows, self._lists), self.how)

    @cached_property
    def postings(self) -> DataFrame:
        return self._keep("postings", postings(self._lists.withColumn("keywords", F.col("scored").cast(KEYWORDS))), "term", "db")

    @cached_property
    def tf(self) -> DataFrame:
        return self._terms.drop("rank", "weight")

    @cached_property
    def stats(self) -> DataFrame:
        return self._keep("stats", corpus_stats(self.rows, self.tf))

    @property
    def lengths(self) -> DataFrame:
        return doc_lengths(self.rows, self.tf)

    def complete(self) -> StoredIndex:
        """This index, with all tables written."""
        self.postings, self.stats  # noqa: B018
        return self
