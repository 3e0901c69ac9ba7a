"""Text search in lines: every hit with its line, offset and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A pattern that finds this text as it is."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def hits_in(text: Column, pattern: str) -> Column:
    """Array of (at, length) of all hits of a pattern, from left to right; at counts from 0. Empty hits do not count."""
    found = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m) > 0)
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(F.length(b).alias("skip"), F.length(m).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,length:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + x["skip"]
        return F.struct((at + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), x["n"].alias("length")))).alias("out"))

    return F.aggregate(lengths, start, step)["out"]


#: Lines that a search shows without asking, and one more to tell that there are more.
SHOWN = 10_001


def lines_with(lines: DataFrame, text: str, most: int = SHOWN) -> DataFrame:
    """The first lines(line, text), `most` at most, that hold a text."""
    return lines.where(F.contains("text", F.lit(text))).orderBy("line").limit(most)


def search(lines: DataFrame, pattern: str, regex: bool = True, case_sensitive: bool = True) -> DataFrame:
    """(line, at, length) of every hit in lines(line, text); with a column `offset` of lines (their place in the file) also file_offset.

    Plain text is quoted, so its signs are no pattern. Null texts have no hits. The pattern must not
    match the empty string next to other hits.
    """
    p = pattern if regex else quoted(pattern)
    p = p if case_sensitive else "(?i)" + p
    found = lines.where(F.col("text").rlike(p)).withColumn("_h", F.explode(hits_in(F.col("text"), p)))
    out = found.select("line", F.col("_h.at").cast("long").alias("at"), F.col("_h.length").cast("long").alias("length"), *(["offset"] if "offset" in lines.columns else []))
    return out.withColumn("file_offset", F.col("offset") + F.col("at")).drop("offset") if "offset" in lines.columns else out
