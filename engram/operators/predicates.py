"""Predicates as columns or, where an index table knows the answer, as semi-joins."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import dialect as d
from ..schema import NAMED, STAR

_OPS = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def condition(e) -> Column:
    """A predicate over rows of memories. There are no NULLs: NOT is a plain complement."""
    match e:
        case d.Equals("keyword", value):
            return F.exists("keywords", lambda k: k["term"] == value)
        case d.Equals("tag", value):
            return F.array_contains("tags", value)
        case d.Equals(column, value):
            return F.col(column) == value
        case d.Contains(text):
            return F.col("content").contains(text)
        case d.Importance(op, value):  # 32-bit against 32-bit
            return _OPS[op](F.col("importance"), F.lit(value).cast("float"))
        case d.And(a, b):
            return condition(a) & condition(b)
        case d.Or(a, b):
            return condition(a) | condition(b)
        case d.Not(a):
            return ~condition(a)
    raise TypeError(e)


def filtered(memories: DataFrame, e, entries: DataFrame | None = None) -> DataFrame:
    """The memories that meet a predicate.

    Keywords at the top of a conjunction become semi-joins with the postings table if there is one: that reads
    a term's few rows instead of the keywords of all memories. All else is one filter, pushed to the scan.
    """
    rest = []
    for part in _conjuncts(e):
        if entries is not None and isinstance(part, d.Equals) and part.column == "keyword":
            memories = memories.join(entries.where(F.col("term") == part.value).select("db", "id"), ["db", "id"], "left_semi")
        elif part is not None:
            rest.append(condition(part))
    for c in rest:
        memories = memories.where(c)
    return memories


def _conjuncts(e) -> list:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, d.And) else [e]


def reads_keywords(s: d.Select) -> bool:
    """Whether a SELECT needs the extracted columns; others need the rows alone."""

    def asked(e) -> bool:
        match e:
            case d.And(a, b) | d.Or(a, b):
                return asked(a) or asked(b)
            case d.Not(a):
                return asked(a)
        return isinstance(e, d.Equals) and e.column == "keyword"

    return asked(s.where) or not {"keywords", "keywords_inline", "key_points"}.isdisjoint(STAR if s.columns is None else s.columns)


def selected(memories: DataFrame, s: d.Select, entries: DataFrame | None = None) -> DataFrame:
    """SELECT: filter, order and limit.

    keyword = alone gives candidates by weight, then id, all else by id. ORDER BY keeps that order among ties, and
    DESC turns all of it round.
    """
    columns = list(STAR if s.columns is None else s.columns)
    rows = filtered(memories, s.where, entries)
    candidates = [(F.col("id"), False)]
    if isinstance(s.where, d.Equals) and s.where.column == "keyword":
        candidates.insert(0, (F.filter("keywords", lambda k: k["term"] == s.where.value)[0]["weight"], True))
    by, falls = s.order or (None, False)
    keys = [(F.col(by), False), *candidates] if by else candidates
    rows = rows.orderBy(*[c.desc() if desc != falls else c.asc() for c, desc in keys])
    if s.limit is not None:
        rows = rows.limit(s.limit)
    assert set(columns) <= set(NAMED)
    return rows.select(*[F.transform("keywords", lambda k: k["term"]).alias(c) if c == "keywords_inline" else F.col(c) for c in columns])


