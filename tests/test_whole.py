"""Registered queries over small tables of known texts, against brute force: no part of a text or table is left out."""

import pytest

from engram.queries import QUERIES

LONG = "One two three four five six seven eight nine ten eleven twelve thirteen. " * 3 + "The end"
TEXTS = [("en", LONG), ("en", "a b"), ("de", ""), ("en", "z"), ("fr", "x y " * 40)]


@pytest.fixture
def tables(spark, tmp_path):
    """A function that stores (lang, text) rows as a data set; ids begin with 1."""

    def store(rows):
        docs = [(i, text, lang, "src1") for i, (lang, text) in enumerate(rows)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return store


def brute_bigrams(text):
    seen = "".join(text.split())
    return [a + b for a, b in zip(seen, seen[1:])] if len(seen) > 1 else list(seen)


def test_bigrams_of_whole_texts(spark, tables):
    found = {r.id: r.bigrams for r in QUERIES["bigrams"](spark, tables(TEXTS)).collect()}
    assert found == {i: "|".join(brute_bigrams(text)) for i, (_, text) in enumerate(TEXTS, 1)}


def brute_jaccard(a, b):
    x, y = set(brute_bigrams(a)), set(brute_bigrams(b))
    return round(len(x & y) / len(x | y), 4) if x | y else 0.0


def test_jaccard_of_all_sentences(spark, tables):
    texts = [["One two three.", "One two four.", "Five six.", "Five six seven.", "One two three."], ["Only one here."], ["Same words.", "Same words."], []]
    found = {(r.id, r.place): r.jaccard for r in QUERIES["jaccard"](spark, tables([("en", " ".join(t)) for t in texts])).collect()}
    pairs = {(i, k): (t[k], t[min(k + 1, len(t) - 1)]) for i, t in enumerate(texts, 1) for k in range(max(len(t) - 1, min(len(t), 1)))}
    assert len(pairs) == 6 and found == {k: brute_jaccard(*p) for k, p in pairs.items()}


def test_searches_meet_databases_of_any_language(spark, tables):
    path = tables([("en", "clown stupid trash idiot"), ("it", "clown stupid trash idiot"), ("it", "other words only"), ("en", "plain text here")])
    for name in ("search_multi_db", "related_cross_db"):
        assert ("it", 2) in {(r.db, r.id) for r in QUERIES[name](spark, path).collect()}, name
