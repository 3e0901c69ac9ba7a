"""Differences of two traces as regions of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import runs


def diff_regions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(start_line, end_line, is_match): maximal regions where left(line, text) and right(line, text) agree or not.

    A line that only one side has differs. Texts are compared as they are; mask them first if needed.
    """
    both = left.withColumnRenamed("text", "_l").join(right.withColumnRenamed("text", "_r"), "line", "full")
    d = both.select("line", (F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_l") == F.col("_r"))).alias("same"))
    d = d.withColumn("same", F.coalesce("same", F.lit(False)))
    return runs(d, "line", "same").select(F.col("start").alias("start_line"), F.col("last").alias("end_line"), F.col("key").alias("is_match"))


def merged_regions(matching: DataFrame, differing: DataFrame) -> DataFrame:
    return matching.unionByName(differing).orderBy("start_line")
