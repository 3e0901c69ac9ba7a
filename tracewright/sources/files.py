"""Other inputs: binary table headers, export tables, descriptors, annotations, trace metadata, databases."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import fixed_records, pointed_data

REGISTER = T.StructType([T.StructField("name", T.StringType()), T.StructField("isValue", T.BooleanType())])
FUNCTION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("createHandle", T.BooleanType()),
        T.StructField("retReg", REGISTER),
        T.StructField("valueInputReg", REGISTER),
        T.StructField("memoryInputReg", REGISTER),
        T.StructField("memoryInputLenReg", REGISTER),
        T.StructField("memoryOutputReg", REGISTER),
        T.StructField("memoryOutputBufLenReg", REGISTER),
        T.StructField("outputDataAddressIndex", T.StringType()),
    ]
)
CHANNELS = T.StructType([T.StructField("method", T.StringType()), T.StructField("functions", T.ArrayType(FUNCTION))])


def channel_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """One row per method and function of a descriptor file (a JSON array)."""
    d = spark.read.schema(CHANNELS).option("multiLine", True).json(path)
    return d.select("method", F.explode("functions").alias("f")).select("method", "f.*")


def annotations(spark: SparkSession, path: str, row_tag: str, schema: T.StructType) -> DataFrame:
    """Regions, tags, comments or message types of an annotation file: the elements named row_tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def trace_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Version, command line and word size of a trace; files of the older layout lack some and get nulls."""
    fields = ["version", "commandLine", "bitness", "arguments", "is64Bit"]
    d = spark.read.format("xml").option("rowTag", "trace").schema(T.StructType([T.StructField(f, T.StringType()) for f in fields])).load(path)
    word = F.coalesce(F.col("bitness"), F.when(F.lower("is64Bit") == "true", "64").when(F.col("is64Bit").isNotNull(), "32"))
    return d.select("version", F.coalesce("commandLine", "arguments").alias("command_line"), word.cast("int").alias("word_size"))


def database_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an index database over JDBC; the driver's jar must be on Spark's class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


HEAD = [("header_ver", 4), ("record_ver", 4), ("row_count", 8), ("row_size", 8), ("table_fp", 8)]


def itable_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, header_ver, record_ver, row_count, row_size, table_fp) of binary tables: two ints and three longs, little-endian. Nothing behind the heads is read."""
    return fixed_records(spark, path, 0, HEAD, rows=1).drop("row").withColumns({c: F.col(c).cast("int") for c in ("header_ver", "record_ver")})


def module_records(spark: SparkSession, path: str) -> DataFrame:
    """The module table: six longs a record behind the table's head."""
    names = ["load_eid", "unload_eid", "start_addr", "end_addr", "win_name_fp", "device_name_fp"]
    return fixed_records(spark, path, 32, [(n, 8) for n in names])


def line_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, start): one long per trace line; the last row is the end of the data."""
    return fixed_records(spark, path, 0, [("start", 8)])


def memory_contexts(spark: SparkSession, path: str, data_path: str | None = None) -> DataFrame:
    """(path, row, address, size, data_fp): three longs a record behind the table's head; with a data file, `data` too: the bytes that a record points to there."""
    r = fixed_records(spark, path, 32, [("address", 8), ("size", 8), ("data_fp", 8)])
    return r if data_path is None else pointed_data(r, data_path, "data_fp", "size")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("rva", T.LongType()), T.StructField("name", T.StringType())])))
def exports_of(content: pd.Series) -> pd.Series:
    """(rva, name) of a Windows library's exports, without forwarders; other files give an empty list."""

    def one(data: bytes) -> list[dict]:
        try:
            pe = struct.unpack_from("<I", data, 0x3C)[0]
            if data[:2] != b"MZ" or data[pe : pe + 4] != b"PE\0\0":
                return []
            sections, optional = struct.unpack_from("<H", data, pe + 6)[0], struct.unpack_from("<H", data, pe + 20)[0]
            head = pe + 24
            wide = struct.unpack_from("<H", data, head)[0] == 0x20B
            table, size = struct.unpack_from("<II", data, head + (112 if wide else 96))
            spans = [struct.unpack_from("<IIII", data, head + optional + 40 * i + 8) for i in range(sections)]

            def at(rva: int) -> int:
                for virtual_size, virtual, raw_size, raw in spans:
                    if virtual <= rva < virtual + max(virtual_size, raw_size):
                        return rva - virtual + raw
                raise ValueError(rva)

            _, n_names, functions, names, ordinals = struct.unpack_from("<IIIII", data, at(table) + 20)
            out = []
            for i in range(n_names):
                name = at(struct.unpack_from("<I", data, at(names) + 4 * i)[0])
                ordinal = struct.unpack_from("<H", data, at(ordinals) + 2 * i)[0]
                rva = struct.unpack_from("<I", data, at(functions) + 4 * ordinal)[0]
                if not table <= rva < table + size:  # inside the table: a forwarder
                    out.append({"rva": rva, "name": data[name : data.index(b"\0", name)].decode("latin-1")})
            return out
        except (struct.error, ValueError, IndexError):
            return []

    return content.map(lambda b: one(bytes(b)) if b is not None else [])


def exports(spark: SparkSession, path: str) -> DataFrame:
    """(module, rva, name) of libraries; module names are the files' names, upper-case."""
    b = spark.read.format("binaryFile").load(path).select(F.upper(F.substring_index("path", "/", -1)).alias("module"), F.explode(exports_of("content")).alias("e"))
    return b.select("module", "e.rva", "e.name")


def syscall_names(spark: SparkSession, path: str) -> DataFrame:
    """(id, name): the system call table as a two-column CSV; tables differ by system version, so it is a parameter."""
    return spark.read.schema("id int, name string").csv(path)
