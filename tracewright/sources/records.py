"""Fixed-size records of binary files, read by ranges of rows: no row or task ever holds a whole file."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

#: Bytes of one partition of a file, about, and rows of a batch.
RANGE_BYTES = 64 << 20
BATCH_ROWS = 1 << 16


class Rows(InputPartition):
    """Rows first to stop - 1 of a file."""

    def __init__(self, path: str, first: int, stop: int) -> None:
        super().__init__((path, first, stop))


def opened(path: str) -> pa.NativeFile:
    """A file of a local path or of any store that Arrow reads (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


class FixedRecords(DataSource):
    """Format `fixed_records`; options files (JSON list of path and size), skip, rows (at most; -1: all), range_bytes, fields (JSON list of name and bytes)."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> StructType:
        fields = json.loads(self.options["fields"])
        return StructType([StructField("path", StringType()), StructField("row", LongType()), *[StructField(n, LongType()) for n, _ in fields]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FixedRecordReader(self.options)


class FixedRecordReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.files = json.loads(options["files"])
        self.skip, self.rows = int(options["skip"]), int(options["rows"])
        self.fields, self.range_bytes = json.loads(options["fields"]), int(options["range_bytes"])
        self.record = np.dtype([(n, f"<i{b}") for n, b in self.fields])

    def partitions(self) -> list[InputPartition]:
        out, size = [], self.record.itemsize
        step = max(1, self.range_bytes // size)
        for path, n_bytes in self.files:
            n = max(0, n_bytes - self.skip) // size
            n = n if self.rows < 0 else min(n, self.rows)
            out += [Rows(path, i, min(i + step, n)) for i in range(0, n, step)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None or partition.value is None:
            return
        path, first, stop = partition.value
        names = ["path", "row", *[n for n, _ in self.fields]]
        with opened(path) as f:
            for at in range(first, stop, BATCH_ROWS):
                n = min(BATCH_ROWS, stop - at)
                data = np.frombuffer(f.read_at(n * self.record.itemsize, self.skip + at * self.record.itemsize), self.record)
                columns = [pa.array([path] * n), pa.array(np.arange(at, at + n)), *[pa.array(data[c].astype(np.int64)) for c, _ in self.fields]]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path or pattern names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted((f.getPath().toString(), f.getLen()) for f in (found or []) if f.isFile())


def fixed_records(spark: SparkSession, path: str, skip: int, fields: list[tuple[str, int]], rows: int = -1, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, row, fields...) of files of fixed-size records behind a head of `skip` bytes; fields are (name, bytes), little-endian and signed.

    Every partition reads its own range of a file. Bytes behind the last whole record are left out; rows: only so many from the front.
    """
    spark.dataSource.register(FixedRecords)
    options = {"files": json.dumps(listed(spark, path)), "skip": str(skip), "rows": str(rows), "range_bytes": str(range_bytes), "fields": json.dumps(fields)}
    return spark.read.format("fixed_records").options(**options).load()


def pointed_data(records: DataFrame, data_path: str, pointer: str, size: str) -> DataFrame:
    """records with `data`: the bytes of a data file that a record's pointer and size name; null where these are null, negative or beyond its end."""
    spark = records.sparkSession
    files = listed(spark, data_path)
    if len(files) != 1:
        raise FileNotFoundError(data_path)
    path, end = files[0]
    schema = StructType([*records.schema, StructField("data", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as f:
            for b in batches:
                spans = zip(b.column(pointer).to_pylist(), b.column(size).to_pylist(), strict=True)
                ok = lambda p, n: p is not None and n is not None and 0 <= p and 0 <= n and p + n <= end
                data = [f.read_at(n, p) if ok(p, n) else None for p, n in spans]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], names=schema.names)

    # rows in the order of the file, so that reads go forward
    return records.sortWithinPartitions(F.col(pointer)).mapInArrow(run, schema)
