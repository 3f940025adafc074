"""Cells as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keywords(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda k: F.format_string("%s(%.2f)", k["term"], k["weight"])), ", ")


def keywords_inline(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda k: k["term"]), ", ")


def key_points(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda p: F.concat(F.lit("• "), p)), "\n")


def tags(c: Column) -> Column:
    return F.array_join(c, ", ")


def importance(c: Column) -> Column:
    return F.format_string("%.2f", c)


def time(c: Column) -> Column:
    """UTC to the second; before 1970 a dash."""
    whole = F.timestamp_seconds(F.floor(c / 1000))
    return F.when(c < 0, F.lit("-")).otherwise(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), whole.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"))


CELLS = {"id": lambda c: c.cast("string"), "content": lambda c: c, "source": lambda c: c, "keywords": keywords, "keywords_inline": keywords_inline, "key_points": key_points, "tags": tags, "importance": importance, "created_at": time, "updated_at": time}


def cell(name: str) -> Column:
    return CELLS[name](F.col("keywords" if name == "keywords_inline" else name))


def rendered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every cell as text, in the order asked for."""
    return rows.select(*[cell(c).alias(c) for c in columns])
