"""Index tables on disk: writing, first-wins deduplication, clustering, life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.control_flow import first_per_key
from ..operators.ordered import running_total

#: Lines per directory of the line table.
LINE_BUCKET = 1 << 20


def write_lines(lines: DataFrame, path: str) -> None:
    """The line table, in directories of LINE_BUCKET lines and sorted inside, so that range reads prune.

    Every write replaces the table; an interrupted one leaves no _SUCCESS mark.
    """
    d = lines.withColumn("line_bucket", F.floor(F.col("line") / LINE_BUCKET))
    d.repartitionByRange("line_bucket", "line").sortWithinPartitions("line").write.mode("overwrite").partitionBy("line_bucket").parquet(path)


def read_range(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """Lines from low to high inclusive: only their directories are read."""
    b = F.col("line_bucket").between(low // LINE_BUCKET, high // LINE_BUCKET)
    return spark.read.parquet(path).where(b & F.col("line").between(low, high)).drop("line_bucket")


def write_first(rows: DataFrame, keys: list[str], order: str, path: str, sort: list[str]) -> None:
    """A dimension table with one row per key, the first by `order`, clustered by `sort`."""
    first_per_key(rows, keys, order).repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("overwrite").parquet(path)


def with_trailing_line(lines: DataFrame, ended: str = "ended") -> DataFrame:
    """lines(line, text, ended) plus one empty line if every line ended in a newline; an empty table stays empty."""
    extra = lines.agg((F.max("line") + 1).alias("line"), F.bool_and(ended).alias("_all")).where("_all").select("line", F.lit("").alias("text"), F.lit(False).alias(ended))
    return lines.select("line", "text", ended).unionByName(extra)


def thread_ids(raw: DataFrame, column: str = "tid") -> DataFrame:
    """Thread ids as numbers: leading zeros go, the text `null` is null."""
    return raw.withColumn(column, F.nullif(F.col(column), F.lit("null")).cast("int"))


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a table; none there is no error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def write_annotations(rows: DataFrame, path: str, root: str, row: str) -> None:
    """Annotations as XML, rewritten as a whole."""
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def write_regions(regions: DataFrame, path: str) -> None:
    """A diff's regions(start_line, end_line, is_match), numbered from 0 in line order, in directories of matching and differing ones."""
    d = running_total(regions, "start_line", F.lit(1), "region")
    d.write.mode("overwrite").partitionBy("is_match").parquet(path)


def read_regions(spark: SparkSession, path: str, matching: bool | None = None, number: int | None = None) -> DataFrame:
    """Regions of a diff in line order: all, the matching or the differing ones, or the one of a number."""
    d = spark.read.parquet(path)
    if matching is not None:
        d = d.where(F.col("is_match") == matching)
    if number is not None:
        d = d.where(F.col("region") == number)
    return d.orderBy("start_line")


def state_of(spark: SparkSession, path: str) -> str:
    """missing, created (begun and not ended) or populated."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return "missing"
    return "populated" if is_complete(spark, path) else "created"


def reopened(spark: SparkSession, path: str) -> bool:
    """Whether a table can be read; what an interrupted write left behind is wiped."""
    state = state_of(spark, path)
    if state == "created":
        drop(spark, path)
    return state == "populated"


def write_table(rows: DataFrame, path: str, sort: list[str]) -> None:
    """An index table without keys (events, blocks, calls, jumps), clustered by `sort`."""
    rows.repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("overwrite").parquet(path)
