"""The one record type, and the rules for names."""

from __future__ import annotations

import re

from pyspark.sql import types as T

KEYWORDS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.FloatType())]))

MEMORIES = T.StructType(
    [
        T.StructField("db", T.StringType(), False),
        T.StructField("id", T.LongType(), False),
        T.StructField("created_at", T.LongType(), False),
        T.StructField("updated_at", T.LongType(), False),
        T.StructField("importance", T.FloatType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("tags", T.ArrayType(T.StringType()), False),
        T.StructField("key_points", T.ArrayType(T.StringType()), False),
        T.StructField("keywords", KEYWORDS, False),
    ]
)

DEFAULT_DB = "main"
#: What SELECT * shows, and what can be named.
STAR = ("id", "content", "key_points", "keywords", "tags", "source", "importance", "created_at")
NAMED = (*STAR, "updated_at", "keywords_inline")
_NAME = re.compile(r"[a-z_][a-z0-9_]{0,63}")


class EngineError(Exception):
    """A statement that cannot be run."""


def checked_name(name: str) -> str:
    """Trimmed and in lower case: a letter or underscore, then letters, digits and underscores, 64 at most."""
    plain = name.strip().lower()
    if not _NAME.fullmatch(plain):
        raise EngineError(f"not a valid name: {name!r}")
    return plain
