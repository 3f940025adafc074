"""Queries write no more of the index than they read, and no text twice."""

import pytest

from engram import queries as q
from engram.oracle import ORACLES
from engram.plans import dialect as d

PLAIN = ("point_lookup", "order_importance_desc_limit", "order_created_asc")
SEARCHES = ("bm25", "candidates", "expand_hop2", "search_one_db", "related_by_text", "related_by_id", "related_cross_db", "related_two_hops")


@pytest.fixture
def kept(monkeypatch):
    """Names and columns of the index tables that are written, in an application that has none yet."""
    names = {}
    keep = q.ix.StoredIndex._keep
    monkeypatch.setattr(q, "_INDEXES", {})
    monkeypatch.setattr(q.ix.StoredIndex, "_keep", lambda self, name, df, *by: names.update({name: df.columns}) or keep(self, name, df, *by))
    return names


@pytest.mark.parametrize("name", PLAIN)
def test_rows_alone_need_no_index(spark, sf_dir, duck, same, kept, name):
    same(q.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())
    assert not kept


def test_searches_store_no_texts(spark, sf_dir, duck, same, kept):
    for name in SEARCHES:
        same(q.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())
    assert set(kept) == {"tf", "keywords", "postings", "stats"}
    assert not any("content" in columns for columns in kept.values())


@pytest.mark.parametrize(
    "rest, needed",
    [("id FROM memories", False), ("* FROM memories", True), ("key_points FROM memories", True), ("id FROM memories WHERE tag = 'a' OR NOT keyword = 'b'", True), ("id FROM memories WHERE NOT tag = 'a' AND importance > 0.5", False)],
)
def test_what_needs_keywords(rest, needed):
    assert q.reads_keywords(d.parse(f"SELECT {rest}")) is needed
