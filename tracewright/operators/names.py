"""Names of functions: from the exports of loaded libraries, and back from descriptors to the trace's functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def named_functions(functions: DataFrame, exports: DataFrame) -> DataFrame:
    """functions(module, offset, ...) with `name`: what their library exports at their offset, or null; named ones first, by name, then by module and offset.

    exports: (module, rva, name). Library names are compared without case; of several names for one place the first by spelling counts.
    """
    e = exports.groupBy(F.upper("module").alias("_m"), F.col("rva").cast("long").alias("_o")).agg(F.min("name").alias("name"))
    f = functions.drop("name")
    out = f.join(e, (F.upper("module") == F.col("_m")) & (F.col("offset") == F.col("_o")), "left").drop("_m", "_o")
    return out.orderBy(F.col("name").isNull(), F.lower("name"), "module", "offset")


def described_functions(descriptors: DataFrame, exports: DataFrame, functions: DataFrame) -> DataFrame:
    """descriptors(name, ...) with the columns of functions(module, offset, ...), one row a function of the trace that a descriptor names by an export.

    A name that several libraries export leads to all their functions; exports of a place given twice count once; descriptors
    of functions that the trace never ran go.
    """
    e = exports.select("name", F.upper("module").alias("_m"), F.col("rva").cast("long").alias("_o")).distinct()
    f = functions.drop("name")
    return descriptors.join(e, "name").join(f, (F.upper("module") == F.col("_m")) & (F.col("offset") == F.col("_o"))).drop("_m", "_o")
