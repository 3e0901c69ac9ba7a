"""Markers along a trace: runs of a key with a place on a pixel axis, and lookups among them.

Markers: (start, n_lines, key, view_start, width).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_total, runs, with_next_start

#: Lines a pixel, and the least width of a marker.
LINES_PER_PIXEL, LEAST_WIDTH = 20, 13


def markers(lines: DataFrame, order: str, key: str) -> DataFrame:
    """Runs of equal key, laid out one behind the other: a marker is n_lines / LINES_PER_PIXEL wide, LEAST_WIDTH at least."""
    s = with_next_start(runs(lines, order, key)).select("start", "n_lines", "key")
    s = s.withColumn("width", F.greatest(F.floor(F.col("n_lines") / LINES_PER_PIXEL), F.lit(LEAST_WIDTH)).cast("long"))
    return running_total(s, "start", F.col("width"), "view_start").select("start", "n_lines", "key", "view_start", "width")


def by_line(m: DataFrame, low: int, high: int) -> DataFrame:
    """Markers that start at a line from low to high."""
    return m.where(F.col("start").between(low, high))


def containing(m: DataFrame, line: int) -> DataFrame:
    """Markers around a line; the upper bound is inclusive, so a line on a border is in two."""
    return m.where((F.col("start") <= line) & (F.lit(line) <= F.col("start") + F.col("n_lines")))


def by_pixel(m: DataFrame, low: int, high: int) -> DataFrame:
    """Markers that a window of pixels touches."""
    return m.where((F.col("view_start") <= high) & (F.col("view_start") + F.col("width") >= low))


def extent(m: DataFrame) -> DataFrame:
    """(max_pixel, max_line): where the last marker ends."""
    return m.agg(F.max(F.col("view_start") + F.col("width")).alias("max_pixel"), F.max(F.col("start") + F.col("n_lines") - 1).alias("max_line"))
