"""The event table as an execution trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instruction line per event: the event's order is the line, its user the thread, its type the module."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    mnemonic = F.when(F.col("event_type") == "signup", "call").when(F.col("event_type") == "error", "ret").when(F.col("event_type") == "purchase", "jz").otherwise("mov")
    return e.select(
        F.col("event_id").alias("line"),
        F.col("user_id").alias("thread"),
        F.concat("event_type", F.lit(".dll")).alias("module"),
        mnemonic.alias("mnemonic"),
        k.alias("offset"),
        F.concat("event_type", F.lit(":"), k.cast("string")).alias("instruction_id"),
        k.alias("flags"),
        k.alias("addr"),
        (F.col("event_id") % 256).alias("byte"),
    )


#: The same view in SQL, to put before an oracle query.
TRACE_SQL = """t AS (
 SELECT event_id AS line, user_id AS thread, event_type || '.dll' AS module,
  CASE event_type WHEN 'signup' THEN 'call' WHEN 'error' THEN 'ret' WHEN 'purchase' THEN 'jz' ELSE 'mov' END AS mnemonic,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  event_type || ':' || regexp_extract(props, '([0-9]+)', 1) AS instruction_id,
  event_id % 256 AS byte
 FROM events)"""
