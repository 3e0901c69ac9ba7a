"""Annotations of a trace: order of comments and tag occurrences, and which of them may stand side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What orders tag occurrences and comments, as far as a table has it.
PLACES = ("start_line", "start_char", "end_line", "end_char", "line", "char")


def in_order(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds place: the row's number, from 1, within its tag or group of comments, by line and character."""
    keys = [c for c in PLACES if c in rows.columns]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*keys)).cast("long"))


def distinct_places(rows: DataFrame, group: list[str]) -> DataFrame:
    """One row a place in each group: a tag marks a span once, and a group has one comment at a character."""
    return rows.dropDuplicates([*group, *[c for c in PLACES if c in rows.columns]])
