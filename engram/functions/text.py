"""Tokens, keywords and key sentences as Column functions: nothing here leaves the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segment import cut_arrays
from .stopwords import CHINESE, ENGLISH

CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{F900}-\x{FAFF}]"
#: Latin words and numbers, with a decimal part or a percent sign.
WORD = r"[a-zA-Z0-9]+(?:\.[0-9]+)?%?"
# Marks that end a sentence, and those that may still follow in it.
ENDS = "。！？.!?;；\n"
CLOSERS = "\"”'’)）.。！？"
#: Up to the first mark that ends it, or the end of the text. Java takes ten times as long for [^...] with other marks than ASCII.
SENTENCE = rf"(?s).*?(?:[{ENDS}][{CLOSERS}]*|\z)"
#: Tokens that are only white space, ASCII punctuation or these marks are noise.
NOISE = r"^[\s\p{Punct}，。！？；：、“”‘’（）《》—…·【】「」]*$"
#: One character that is not white space.
VISIBLE = r"[^ \t\n\x0b\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same characters by ranges: Java takes five times as long for VISIBLE, which SQL uses.
VISIBLE_RANGES = r"[\x{0}-\x{8}\x{E}-\x{1F}\x{21}-\x{84}\x{86}-\x{9F}\x{A1}-\x{167F}\x{1681}-\x{1FFF}\x{200B}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{205E}\x{2060}-\x{2FFF}\x{3001}-\x{10FFFF}]"
SPACE = " \t\n\x0b\x0c\r\u0085 　"


@dataclass(frozen=True)
class Extraction:
    """How many keywords and key sentences, and what counts as a word."""

    max_keywords: int = 16
    max_key_points: int = 3
    min_keyword_len: int = 2
    max_key_point_len: int = 140
    stopwords: Collection[str] = field(default=(*ENGLISH, *CHINESE))
    dictionary: Mapping[str, int] | None = None  # words of scripts without spaces, with their frequencies


def normalize_term(term: Column) -> Column:
    plain = F.btrim(term, F.lit(SPACE))
    return F.when(plain.rlike("[A-Za-z]") & ~plain.rlike(CJK), F.lower(plain)).otherwise(plain)


def raw_tokens(text: Column, how: Extraction = Extraction()) -> Column:
    """Latin words in lower case; runs of CJK as the dictionary's words or, without one, as overlapping pairs.

    Only texts with CJK go to the dictionary, in Arrow batches; all else stays in the JVM.
    """
    plain = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    latin = F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))
    both = F.regexp_extract_all(text, F.lit(f"{WORD}|{CJK}+"), F.lit(0))

    def pairs(t: Column) -> Column:
        return F.when(t.rlike(CJK) & (F.char_length(t) > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))).otherwise(F.array(normalize_term(t)))

    if how.dictionary:
        words = F.arrow_udf(cut_arrays(how.dictionary), "array<string>")
        return F.coalesce(words(F.when(text.rlike(CJK), both)), latin)
    return F.when(text.rlike(CJK), F.flatten(F.transform(both, pairs))).otherwise(latin)


def is_term(token: Column, how: Extraction = Extraction()) -> Column:
    """Long enough, not noise and not a stop word."""
    return (F.char_length(token) >= how.min_keyword_len) & ~token.isin(list(how.stopwords)) & ~token.rlike(NOISE)


def tokens(text: Column, how: Extraction = Extraction()) -> Column:
    """The tokens that are terms, in order; repeats stay."""
    return F.filter(raw_tokens(text, how), lambda t: is_term(t, how))


def term_counts(rows: DataFrame, keys: list[str], text_col: str = "content", how: Extraction = Extraction()) -> DataFrame:
    """(keys, term, tf): how often each token occurs in each row.

    Tokens are filtered as rows, not inside an array: so the filter is compiled.
    """
    each = rows.select(*keys, F.explode(raw_tokens(F.col(text_col), how)).alias("term")).where(is_term(F.col("term"), how))
    return each.groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def ranked_terms(counts: DataFrame, keys: list[str], how: Extraction = Extraction()) -> DataFrame:
    """(keys, term, tf) with dl, the sum of tf over the row, and the rank and weight of the best terms.

    Terms are ranked by frequency and length; the first has weight 1, others than the best have neither.
    """
    length = F.least(F.greatest(F.char_length("term") - 2, F.lit(0)), F.lit(6))
    raw = (1 + F.log(F.col("tf").cast("double"))) * (1 + F.lit(0.12) * length)
    order = W.partitionBy(*keys).orderBy(F.desc("raw"), "term")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = counts.withColumn("raw", raw).select("*", F.sum("tf").over(every).alias("dl"), F.row_number().over(order).alias("rank"), F.first("raw").over(every).alias("top"))
    weight = F.least(F.greatest(F.col("raw") / F.col("top"), F.lit(0.0)), F.lit(1.0))
    best = F.col("rank") <= how.max_keywords
    return found.select(*counts.columns, "dl", F.when(best, F.col("rank")).alias("rank"), F.when(best, weight).alias("weight"))


def keyword_scores(counts: DataFrame, keys: list[str], how: Extraction = Extraction()) -> DataFrame:
    """(keys, term, weight, rank): the best terms of each row."""
    return ranked_terms(counts, keys, how).where("rank IS NOT NULL").select(*keys, "term", "weight", "rank")


def sentences(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(SPACE))), lambda s: s != "")


def char_bigrams(text: Column) -> Column:
    """Pairs of neighbours among the characters that are not white space; a single one stands for itself."""
    chars = F.regexp_extract_all(text, F.lit(VISIBLE_RANGES), F.lit(0))

    def pairs(c: Column) -> Column:
        n = F.size(c)
        return F.when(n < 2, c).otherwise(F.zip_with(F.slice(c, F.lit(1), n - 1), F.slice(c, F.lit(2), n - 1), lambda a, b: F.concat(a, b)))

    return F.flatten(F.transform(F.array(chars), pairs))  # the outer transform binds the characters once


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats: what they share by what either has; 0 if both are empty."""
    return bound(F.size(F.array_intersect(a, b)), lambda n: F.coalesce(F.try_divide(n, F.size(a) + F.size(b) - n), F.lit(0.0)))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def key_points(text: Column, keywords: Column, how: Extraction = Extraction()) -> Column:
    """Up to max_key_points sentences, in text order, that hold the keywords and are not near copies of each other.

    keywords is an array of (term, weight). Terms are sought as they are written, case and all. A sentence's bigrams
    are computed when it is its turn, and kept with it if it is chosen.
    """
    sum_of = F.aggregate(keywords, F.lit(0.0), lambda a, k: a + k["weight"])
    shape = "array<struct<at:int,s:string,g:array<string>>>"

    def met(s: Column, i: Column) -> Column:
        hit = F.aggregate(keywords, F.lit(0.0), lambda a, k: a + F.when(s.contains(k["term"]), k["weight"]).otherwise(F.lit(0.0)))
        return F.struct(i.alias("at"), s.alias("s"), hit.alias("hit"))

    def scored(x: Column, total: Column) -> Column:
        length = F.char_length(x["s"]).cast("double")  # squared, an int would overflow from 46 381 characters on
        score = F.lit(0.60) * F.least(x["hit"] / total, F.lit(1.0)) + F.lit(0.25) / (1 + F.lit(0.08) * x["at"]) + F.lit(0.15) * F.exp(-(length - 40) * (length - 40) / F.lit(1250.0))
        return F.struct((-score).alias("order"), x["at"].alias("at"), x["s"].alias("s"))

    def step(acc: Column, x: Column) -> Column:
        def add(g: Column) -> Column:
            near = F.exists(acc, lambda a: jaccard(a["g"], g) > 0.75)
            return F.when(near, acc).otherwise(F.concat(acc, F.array(F.struct(x["at"].alias("at"), x["s"].alias("s"), g.alias("g")))))

        return F.when(F.size(acc) >= how.max_key_points, acc).otherwise(bound(F.array_distinct(char_bigrams(x["s"])), add))

    hits = F.filter(F.transform(sentences(text), met), lambda x: x["hit"] > 0)
    ranked = bound(F.when(sum_of > 0, sum_of).otherwise(F.lit(1.0)), lambda total: F.array_sort(F.transform(hits, lambda x: scored(x, total))))
    chosen = F.aggregate(ranked, F.array().cast(shape), step)
    return F.transform(F.array_sort(chosen), lambda x: F.left(x["s"], F.lit(how.max_key_point_len)))


def split_list(text: Column, mark: str) -> Column:
    return F.filter(F.transform(F.split(text, "\\" + mark), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")


def clamp_importance(x: Column) -> Column:
    return F.least(F.greatest(x.cast("float"), F.lit(0.0).cast("float")), F.lit(1.0).cast("float"))
