"""Sharding along a Hilbert curve over quantised metadata.

Several metadata columns are cut into 2**bits levels each (by quantiles, of strings too, so that
levels carry about equal numbers of rows); a cell's place on the Hilbert curve through the grid orders the
rows, and runs of equal row counts become the shards. A shard then spans a compact box of the
metadata space, so that min/max statistics of its files prune on every dimension.

Ranks come without a global sort: rows per cell are counted (at most 2**(bits * dims) cells),
cells with many rows are dealt into sub-cells by a hash of the id, and each sub-cell numbers
its own rows behind the offset that the counts give.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

BITS = 4
#: Rows of a sub-cell, about.
SUBCELL_ROWS = 20_000


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of coords (n, dims), by the transposed-axes method of Skilling (2004)."""
    x = coords.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def text_cuts(d: DataFrame, name: str, levels: int) -> list[str]:
    """At most levels - 1 values of a string column that part its rows into about equal runs, by whole strings.

    Each distinct value is counted, the counts are ranged over the value and summed up within ranges;
    only the ranges' sums meet in one place.
    """
    values = d.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("_n"))
    values = stored(values.repartitionByRange(name).withColumn("_p", F.spark_partition_id()), "shard-values")
    ranges = values.groupBy("_p").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("_p", before.alias("_c"))
    total = values.agg(F.coalesce(F.sum("_n"), F.lit(1))).first()[0]
    upto = F.sum("_n").over(Window.partitionBy("_p").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_c")
    crossing = values.join(ranges, "_p").withColumn("_up", upto)
    crossed = F.floor(F.col("_up") * levels / total) > F.floor((F.col("_up") - F.col("_n")) * levels / total)
    return [r[0] for r in crossing.where(crossed).select(name).collect()]  # at most `levels` rows


def shards(rows: DataFrame, n_shards: int, dims: dict[str, Column], tie: list[str], bits: int = BITS) -> DataFrame:
    """Adds cell (curve index), shard (0 to n_shards - 1) and slot (gapless from 0 in each shard); counts differ by one at most.

    dims: the metadata dimensions, numeric or strings (whole strings, in binary order); nulls go to the lowest level.
    tie: columns that order rows of one cell; together they should be unique (else equal rows
    still get different slots, in any order). An empty table gives an empty result. Columns of
    rows named cell, shard, slot are replaced.
    """
    spark = rows.sparkSession
    names = [f"_d{i}" for i in range(len(dims))]
    d = rows.drop("cell", "shard", "slot").withColumns(dict(zip(names, dims.values(), strict=True)))
    d = stored(d, "shard-rows")
    levels = 1 << bits
    strings = [n for n in names if d.schema[n].dataType == T.StringType()]
    numbers = [n for n in names if n not in strings]
    shares = [i / levels for i in range(1, levels)]
    found = d.agg(F.count("*").alias("all"), *[F.percentile_approx(F.col(n).cast("double"), shares, 10_000).alias(n) for n in numbers]).first()
    cuts = {n: found[n] or [] for n in numbers} | {n: text_cuts(d, n, levels) for n in strings}
    for n in names:
        bounds = sorted(set(cuts[n]))
        d = d.withColumn(n, sum((F.when(F.col(n) > b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int"))
    packed = sum((F.col(n) * (levels**i) for i, n in enumerate(names)), F.lit(0)).cast("int")
    d = d.withColumn("_grid", packed).drop(*names)
    # at most levels ** len(dims) cells
    counts = d.groupBy("_grid").agg(F.count("*").alias("_n"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            g = b["_grid"].to_numpy()
            coords = np.stack([g // levels**i % levels for i in range(len(names))], axis=1)
            yield pd.DataFrame({"_grid": g, "cell": hilbert_index(coords, bits), "_n": b["_n"]})

    cells = stored(counts.mapInPandas(index, "_grid int, cell long, _n long"), "shard-cells")
    total = found["all"]
    before = F.coalesce(F.sum("_n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("_grid", "cell", before.alias("_before"), F.ceil(F.col("_n") / SUBCELL_ROWS).cast("long").alias("_subs"))
    d = d.join(F.broadcast(cells), "_grid").drop("_grid")
    d = d.withColumn("_sub", F.pmod(F.xxhash64(*tie), F.col("_subs"))).drop("_subs")
    subs = d.groupBy("cell", "_sub").agg(F.count("*").alias("_m"))
    ahead = F.coalesce(F.sum("_m").over(Window.partitionBy("cell").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    subs = subs.select("cell", "_sub", ahead.alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("cell", "_sub").orderBy(*tie)) - 1
    d = d.withColumn("_place", place).join(subs, ["cell", "_sub"])
    d = d.withColumn("_rank", F.col("_before") + F.col("_ahead") + F.col("_place"))
    small, extra = divmod(int(total), n_shards)
    edge = extra * (small + 1)
    r = F.col("_rank")
    low = F.floor(r / (small + 1))
    d = d.withColumn("shard", F.when(r < edge, low).otherwise(extra + F.floor((r - edge) / max(small, 1))).cast("int"))
    start = F.when(F.col("shard") < extra, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - extra) * small)
    return d.withColumn("slot", (r - start).cast("long")).drop("_sub", "_before", "_ahead", "_place", "_rank")
