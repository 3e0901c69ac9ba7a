"""Live traces: lines that arrive in order per thread, with state kept by Spark.

The traced tool works on finished files only; these are the same operators for a stream of parsed
lines (line, thread, ts, mnemonic, instruction_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def thread_lengths(lines: DataFrame) -> DataFrame:
    """Running instruction count per thread."""
    return lines.groupBy("thread").agg(F.count("*").alias("length"))


def activity(lines: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Lines per module and time window; lines later than `delay` are dropped by the watermark."""
    w = lines.withWatermark("ts", delay).groupBy(F.window("ts", width), "module")
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "module", "n")


BLOCK = T.StructType(
    [
        T.StructField("thread", T.LongType()),
        T.StructField("start_line", T.LongType()),
        T.StructField("end_line", T.LongType()),
        T.StructField("owner_line", T.LongType()),
        T.StructField("x_offset", T.LongType()),
        T.StructField("width", T.LongType()),
    ]
)
_STATE = T.StructType([T.StructField("stack", T.ArrayType(T.LongType())), T.StructField("start", T.LongType()), T.StructField("last", T.LongType()), T.StructField("x", T.LongType()), T.StructField("width", T.LongType()), T.StructField("previous", T.StringType())])


def _blocks(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stack, start, last, x, width, previous = ([], None, None, 0, 0, None)
    if state.exists:
        s = state.get
        stack, start, last, x, width, previous = list(s[0]), s[1], s[2], s[3], s[4], s[5]
    lines = pd.concat(list(batches)).sort_values("line")
    out = []
    for line, mnemonic in zip(lines["line"], lines["mnemonic"], strict=True):
        line = int(line)
        if start is None:
            stack, start = [line], line
        elif previous in ("call", "ret"):
            out.append((key[0], start, last, stack[-1], x, width))
            x, width, start = x + width, 0, line
            if previous == "ret":
                stack.pop()
            if previous == "call" or not stack:
                stack.append(line)
        last, width, previous = line, width + 1, mnemonic
    state.update((stack, start, last, x, width, previous))
    yield pd.DataFrame(out, columns=BLOCK.names)


def thread_function_blocks(lines: DataFrame) -> DataFrame:
    """Blocks of each thread as they end; the block still open stays in the state, with the thread's call stack."""
    return lines.groupBy("thread").applyInPandasWithState(_blocks, BLOCK, _STATE, "append", GroupStateTimeout.NoTimeout)
