"""Helpers that several operators of this package use."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space that separates words in all contracts of this package.
SPACES = r"[\x20\x09-\x0D]+"
NON_SPACE = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is configured and there is no cluster (tests)."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if place is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="tracewright-")
        sc.setCheckpointDir(place)
        place = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing reads any more; other frames stay as they are."""
    for t in tables:
        if place := getattr(t, "_stored_at", None):
            sc = t.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one in HOT_SHARE of the rows is hot, so there are fewer hot keys than this.
HOT_SHARE = 1000
#: Pairs of one key that go to one place in spread_join.
KEY_PAIRS = 4096


def join_one(rows: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", n: str | None = None, nulls: bool = False) -> DataFrame:
    """rows joined ("inner" or "left") with `one`, which has one small row a key; the key columns once. nulls: null keys are equal.

    Hot keys are fewer than HOT_SHARE: their rows of `one` are broadcast, so that the rows of such a key stay spread over the
    tasks that hold them. The others shuffle, and none of them brings a task more than one in HOT_SHARE of all rows. n: a
    column of `one` with the number of rows that each key has, if that is known; it is dropped.
    """
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    o = one.select(*[F.col(k).alias(a) for k, a in names.items()], *[c for c in one.columns if c not in names])
    # plain equality of a single number keeps a broadcast table small
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(a)) if nulls else F.col(k) == F.col(a) for k, a in names.items()])
    counts = o.select(*names.values(), F.col(n).alias("_n")) if n else rows.groupBy(*[F.col(k).alias(a) for k, a in names.items()]).agg(F.count("*").alias("_n"))
    total = (o.agg(F.sum(n)).first()[0] or 0) if n else rows.count()
    mark = lambda names: F.xxhash64(*[F.col(c).cast(o.schema[a].dataType) for c, a in zip(names, o.columns, strict=False)])
    hot = [r[0] for r in counts.where(F.col("_n") > total / HOT_SHARE).select(mark(names.values())).distinct().collect()]
    o = o.drop(n) if n else o
    new = [c for c in o.columns if c not in names.values()]
    plain = lambda d: d.join(o, same, how).select(*rows.columns, *new)
    if not hot:
        return plain(rows)
    # by hashes, so that the list is a filter and no join; keys that share one with a hot key go with it
    theirs = F.broadcast(o.where(mark(names.values()).isin(hot)))
    return rows.where(mark(names).isin(hot)).join(theirs, same, how).select(*rows.columns, *new).unionByName(plain(rows.where(~mark(names).isin(hot))))


def spread_join(pairs: DataFrame, one: DataFrame, key: str, other: str, per: int | None = None) -> DataFrame:
    """pairs(key, other, ...) joined with `one`, which has one row a key, of any size.

    A key of very many pairs goes to several places, each with up to about `per` of them and a copy of its row.
    """
    parts = stored(pairs.groupBy(key).agg(F.count("*").alias("_n")).select(key, F.ceil(F.col("_n") / (per or KEY_PAIRS)).cast("int").alias("_parts"), "_n"), "key-parts")
    copies = one.join(parts.drop("_n"), key).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    dealt = join_one(pairs, parts, [key], n="_n").withColumn("_part", F.pmod(F.xxhash64(other), "_parts").cast("int")).drop("_parts")
    return dealt.join(copies, [key, "_part"]).drop("_part")


def words_of(text: Column) -> Column:
    """Words of a text, native; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(df: DataFrame, keep: list[str], given: list[str], fields: list[T.StructField], work: Callable[..., tuple], rows: bool = False) -> DataFrame:
    """Columns `keep` as they are, then `fields`, which work(*lists of the given columns) returns in order.

    Runs on Arrow batches, so kept columns of any type pass untouched. rows: work returns the
    places of the input rows that its output rows belong to first, and may repeat or drop rows.
    """
    schema = T.StructType([*[df.schema[c] for c in keep], *fields])
    names = [f.name for f in schema]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[: len(keep)]
            out = work(*[c.to_pylist() for c in batch.columns[len(keep) :]])
            if rows:
                at = pa.array(out[0], pa.int64())
                kept, out = [c.take(at) for c in kept], out[1:]
            new = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=names)

    bound_batches(df.sparkSession)
    inputs = [F.col(c).alias(f"_given{i}") for i, c in enumerate(given)]
    return df.select(*[F.col(f"`{c}`") for c in keep], *inputs).mapInArrow(run, schema)


def bound_batches(spark: SparkSession, rows: int = 256, size: int = 32 << 20) -> None:
    """Lower the session's rows and bytes per Arrow batch to at most these: bounds memory where texts are long.

    Spark reads the setting when a query runs, so it stays lowered; a lower one of the caller's is kept.
    """
    for name, most, default in (("maxRecordsPerBatch", rows, 10_000), ("maxBytesPerBatch", size, (1 << 31) - 2)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, str(default))
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # one given with a unit is the caller's choice
            spark.conf.set(key, str(most))


class Memo(dict):
    """Remembers make(key) for the `limit` to twice `limit` keys met last; long keys are made anew each time."""

    def __init__(self, make: Callable, limit: int, longest: int = 64) -> None:
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
