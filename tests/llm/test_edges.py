"""What all operators have to stand: clashing names, repeated rows, one very long text."""

import random

import pytest
from pyspark.sql import functions as F

from engram.llm import exact_dedup, jaccard, line_dedup, mixing, packing, quality_classifier, quality_rules, substring_dedup, toxicity
from engram.llm.queries import TOKENIZER

NAMES = ["n_lines", "n_dropped", "__id", "a.b", "doc", "row", "all", "gone", "keep", "position", "spot", "possible", "copies", "size", "class", "salt", "id", "grp", "label", "x", "host", "logit", "p", "w", "n`t"]


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """Documents with further columns that are named like the operators' own."""
    base = docs.where("doc_id < 400").select("doc_id", "text", "lang", "source")
    return base.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)]).cache()


OPERATORS = {
    "line_dedup": lambda d, labels: line_dedup.dedup_lines(d, counts=False),
    "jaccard": lambda d, labels: jaccard.keep_one_of_each(d),
    "exact_dedup": lambda d, labels: exact_dedup.drop_exact_copies(d),
    "mixing": lambda d, labels: mixing.mixed_documents(d),
    "quality_classifier": lambda d, labels: quality_classifier.keep_good(d, labels),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_of_any_name_come_through(clashing, labels, name):
    out = OPERATORS[name](clashing, labels)
    assert out.columns == clashing.columns
    rows = [tuple(r)[4:] for r in out.collect()]
    assert rows and set(rows) == {tuple(range(len(NAMES)))}


def test_reports_do_not_read_other_columns(clashing, labels):
    for out in (substring_dedup.remove_repeats(clashing), toxicity.toxicity(clashing, labels), quality_rules.judge(clashing), packing.pack_documents(clashing, TOKENIZER), mixing.mix_sources(clashing), exact_dedup.exact_groups(clashing), jaccard.similar_groups(clashing), quality_classifier.classify(clashing, labels)):
        assert out.select("doc_id").distinct().count() == clashing.select("doc_id").distinct().count()


@pytest.fixture(scope="module")
def long_text(spark):
    """A text of 20 MB, its copy with other white space, and a short text with a part of it."""
    rng = random.Random(6)
    words = [f"x{rng.randrange(10**6)}" for _ in range(3_000_000)]
    lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
    texts = ["\n".join(lines), "\n\n".join(lines), "\n".join(lines[100:110])]
    assert len(texts[0]) > 20_000_000
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source").repartition(3, "doc_id").cache()


def test_a_text_of_20_megabytes(spark, long_text):
    n = 3_000_000
    assert [(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(long_text).orderBy("doc_id").collect()] == [(0, 1, 2), (1, 1, 2), (2, 2, 1)]
    found = substring_dedup.remove_repeats(long_text).select("doc_id", "n_words", "n_removed").orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(0, n, 0), (1, n, n), (2, 120, 120)]
    found = line_dedup.dedup_lines(long_text).select("doc_id", "n_lines", "n_dropped").orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(0, n // 12, 0), (1, n // 6 - 1, n // 12), (2, 10, 10)]
    found = jaccard.similar_groups(long_text).orderBy("doc_id").collect()
    assert [r.component_id for r in found] == [0, 0, 2] and found[0].n_shingles == found[1].n_shingles > n - 100
    assert [r.n_words for r in quality_rules.judge(long_text).orderBy("doc_id").collect()] == [n, n, 120]
    assert mixing.mix_sources(long_text).agg(F.max("size")).first()[0] == n


def test_a_long_text_is_packed_and_scored(spark, long_text, labels):
    pieces = packing.pack_documents(long_text.where("doc_id = 0"), TOKENIZER)
    r = pieces.agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.max("length").alias("most")).first()
    assert r.n == r.all > 3_000_000 and r.most == 4096
    short = long_text.where("doc_id = 2").selectExpr("doc_id + 10 doc_id", "text", "lang", "source")
    both = long_text.where("doc_id = 0").unionByName(short)
    some = spark.createDataFrame([(0, 1, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(both, some).where("score BETWEEN 0 AND 1").count() == 2
    assert toxicity.toxicity(both, some).where("score BETWEEN 0 AND 1").count() == 2
