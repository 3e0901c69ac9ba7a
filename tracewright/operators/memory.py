"""Register and memory state: last writer wins, byte by byte."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import message_text
from .control_flow import return_lines
from .ordered import scan, scans, settled

#: Lines per first-level snapshot, and first-level snapshots per second-level one.
BRANCH = 1000
#: Addresses that a search takes together.
PAGE = 65536


def bytes_of(refs: DataFrame) -> DataFrame:
    """(line, seq, addr, byte): one row per byte of refs(line, seq, addr, value_hex); addresses are decimal(20, 0)."""
    b = refs.select("line", "seq", F.col("addr").alias("_a"), F.posexplode(F.regexp_extract_all("value_hex", F.lit("(..)"), F.lit(1))).alias("_i", "byte"))
    return b.select("line", "seq", (F.col("_a") + F.col("_i")).cast("decimal(20,0)").alias("addr"), "byte")


def newest(writes: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The newest value per key; partial aggregation keeps one row per key and task."""
    return writes.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(F.struct(*order)).alias("_at")).select(*keys, value, F.col("_at.line").alias("line"))


def state_at(byte_writes: DataFrame, line: int) -> DataFrame:
    """(addr, byte, line): each byte's newest write at or before a line."""
    return newest(byte_writes.where(F.col("line") <= line), ["addr"], "byte", ["line", "seq"])


def merged_registers(refs: DataFrame) -> DataFrame:
    """Newest value per register of refs(line, seq, reg, value_hex, is_before).

    On one line a value after the instruction beats one before it; the first after-value wins, and
    among before-values the last.
    """
    order = F.struct("line", ~F.col("is_before"), F.when(F.col("is_before"), F.col("seq")).otherwise(-F.col("seq")))
    return refs.groupBy("reg").agg(F.max_by("value_hex", order).alias("value_hex"), F.max("line").alias("line"))


def snapshot(writes: DataFrame, keys: list[str], value: str, level: int) -> DataFrame:
    """Newest write of each key within buckets of BRANCH ** level lines: (bucket, keys, value, line, seq)."""
    order = F.struct("line", "seq")
    d = writes.withColumn("bucket", F.floor(F.col("line") / BRANCH**level))
    got = d.groupBy("bucket", *keys).agg(F.max_by(value, order).alias(value), F.max(order).alias("_at"))
    return got.select("bucket", *keys, value, F.col("_at.line").alias("line"), F.col("_at.seq").alias("seq"))


def serving_level(line: Column, at: int) -> Column:
    """The level of snapshots that serves a line for the state at another: 2 and 1 for whole buckets, 0 for single lines; null behind it."""
    whole = lambda level: (at + 1) // BRANCH**level * BRANCH**level
    return F.when(line > at, None).when(line < whole(2), 2).when(line < whole(1), 1).otherwise(0)


def state_from_snapshots(writes: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], value: str, line: int) -> DataFrame:
    """State at a line from whole second-level buckets, then whole first-level ones, then single lines."""
    top, mid = (line + 1) // BRANCH**2, (line + 1) // BRANCH
    cols = [*keys, value, "line", "seq"]
    parts = (
        second.where(F.col("bucket") < top)
        .select(*cols)
        .unionByName(first.where((F.col("bucket") >= top * BRANCH) & (F.col("bucket") < mid)).select(*cols))
        .unionByName(writes.where((F.col("line") >= mid * BRANCH) & (F.col("line") <= line)).select(*cols))
    )
    return newest(parts, keys, value, ["line", "seq"])


def search(state: DataFrame, needle_hex: str) -> DataFrame:
    """Addresses where a byte string (upper-case hex) stands in contiguous memory; overlapping hits count.

    Each page is searched by itself, together with what a hit that starts in it needs of the bytes behind it.
    """
    size = len(needle_hex) // 2
    needle = F.unhex(F.lit(needle_hex))
    page = lambda a: F.floor(a / PAGE).cast("long")
    s = state.select("addr", "byte", F.explode(F.sequence(page(F.greatest(F.col("addr") - size + 1, F.lit(0))), page(F.col("addr")))).alias("_p"))
    w = Window.partitionBy("_p").orderBy("addr")
    s = s.withColumn("_r", F.col("addr") - F.row_number().over(w))
    runs = s.groupBy("_p", "_r").agg(F.min("addr").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("addr", "byte"))), lambda x: x["byte"]), "").alias("hex"))
    # as binary, since a part of a string is counted off from its start
    runs = runs.withColumn("hex", F.unhex("hex")).where(F.contains("hex", needle))
    at = F.filter(F.sequence(F.lit(0), F.length("hex") - size), lambda i: F.substr(F.col("hex"), i + 1, F.lit(size)) == needle)
    hits = runs.select("_p", F.explode(at).alias("_i"), "start").select("_p", (F.col("start") + F.col("_i")).alias("addr"))
    return hits.where(page(F.col("addr")) == F.col("_p")).select(F.col("addr").cast("long").alias("addr"))


def window_of(state: DataFrame, low: int, high: int, unset: str = "??") -> DataFrame:
    """Each address of a span with its byte, `unset` where nothing was written."""
    span = state.sparkSession.range(low, high + 1).withColumnRenamed("id", "addr")
    near = state.where(F.col("addr").between(low, high)).select(F.col("addr").cast("long").alias("addr"), "byte")
    return span.join(near, "addr", "left").select("addr", F.coalesce("byte", F.lit(unset)).alias("byte"))


def spliced(old_hex: Column, new_hex: Column, width: int, high_byte: bool = False) -> Column:
    """A 64-bit register value after a write to its part of `width` bits (16 hex digits each; a 32-bit write clears the top)."""
    digits = width // 4
    if width == 32:
        return F.lpad(F.right(new_hex, F.lit(8)), 16, "0")
    if high_byte:
        return F.concat(F.substring(old_hex, 1, 12), F.right(new_hex, F.lit(2)), F.right(old_hex, F.lit(2)))
    return F.concat(F.substring(old_hex, 1, 16 - digits), F.right(new_hex, F.lit(digits)))


#: Bytes that a pointer is followed for, and of a page.
POINTED = 256
#: Lines for which a page's writes are read together.
PAGE_LINES = 1 << 16


class PageLogs(NamedTuple):
    """Rows of page_logs and the lines of their spans."""

    rows: DataFrame
    lines: int


def _cell(address: str) -> tuple[Column, Column]:
    """The page of an unsigned address of 64 bits, and the place in it, as integers."""
    a = F.col(address).cast("decimal(20,0)")
    high = a >= F.lit(Decimal(1 << 63))
    bits = F.when(high, (a - F.lit(Decimal(1 << 64))).cast("long")).otherwise(a.cast("long"))
    return F.shiftright(bits, POINTED.bit_length() - 1) + F.when(high, F.lit((1 << 64) // POINTED)).otherwise(F.lit(0)), bits.bitwiseAND(F.lit(POINTED - 1)).cast("int")


def _logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of page_logs from (_p, _b, _t, _o, _c) in the order of pages, spans and times."""
    key, parts = None, []

    def row() -> tuple:
        times, places, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
        left = np.zeros(POINTED, "<u2")
        left[places] = codes  # of a place that comes more than once the last stays
        return (*key, times.astype("<i4").tobytes(), places.astype("<u2").tobytes(), codes.astype("<u2").tobytes(), left.tobytes())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["_p", "_b", "_times", "_places", "_codes", "_left"])

    for batch in batches:
        p, b, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | (b[1:] != b[:-1])) + 1), len(p)] if len(p) else [0]
        out = []
        for lo, hi in pairwise(cuts):
            if key != (p[lo], b[lo]):
                if parts:
                    out.append(row())
                key, parts = (int(p[lo]), int(b[lo])), []
            parts.append([x[lo:hi] for x in rest])
        yield batch_of(out)
    if parts:
        yield batch_of([row()])


def page_logs(byte_writes: DataFrame, page_lines: int | None = None) -> PageLogs:
    """The writes of bytes_as_of by pages of POINTED addresses and spans of page_lines lines: one row each with the times (lines of the span), places and
    bytes (two characters) of its writes in order, packed, and what they leave of the page.

    It is made in one pass over the writes and serves any number of requests; settled, since each reads it twice.
    """
    span = page_lines or PAGE_LINES
    page, place = _cell("addr")
    seq = F.col("seq").cast("long") if "seq" in byte_writes.columns else F.lit(0).cast("long")
    b = F.floor(F.col("line") / span)
    code = F.ascii("byte") * 256 + F.ascii(F.substring("byte", 2, 1))
    w = byte_writes.where("addr IS NOT NULL AND line IS NOT NULL AND byte IS NOT NULL")
    w = w.select(page.alias("_p"), b.alias("_b"), (F.col("line") - b * span).cast("int").alias("_t"), place.alias("_o"), code.alias("_c"), seq.alias("_seq"))
    w = w.repartition("_p", "_b").sortWithinPartitions("_p", "_b", "_t", "_seq").drop("_seq")
    logs = w.mapInArrow(_logs, "_p long, _b long, _times binary, _places binary, _codes binary, _left binary")
    return PageLogs(settled(logs), span)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_p, _b, _held): what a page holds before each asked span, from (_p, _b, _left) in the order of pages and spans; _left is null where it is asked."""
    key, state = None, np.zeros(POINTED, "<u2")
    for batch in batches:
        out = []
        for p, b, left in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != p:
                key, state = p, np.zeros(POINTED, "<u2")
            if left is None:
                out.append((p, b, state.tobytes()))
            else:
                left = np.frombuffer(left, "<u2")
                state = np.where(left > 0, left, state)
        columns = zip(*out, strict=True) if out else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary()], strict=True)], ["_p", "_b", "_held"])


def _read(asks: pd.DataFrame, page: pd.DataFrame) -> pd.DataFrame:
    """(line, role, _i, hex) of the asks of a page and span, from its log and what it held before."""
    state, times, places, codes = np.zeros(POINTED, "<u2"), np.zeros(0, "<i4"), None, None
    for held, t, o, c in zip(page["_held"], page["_times"], page["_places"], page["_codes"], strict=True):
        if held is not None:
            state = np.frombuffer(held, "<u2").copy()
        else:
            times, places, codes = np.frombuffer(t, "<i4"), np.frombuffer(o, "<u2"), np.frombuffer(c, "<u2")
    asks = asks.sort_values("_t")
    done, out = 0, []
    for upto, lo, hi in zip(times.searchsorted(asks["_t"].to_numpy(), "right").tolist(), asks["_from"].tolist(), asks["_to"].tolist(), strict=True):
        if upto > done:
            state[places[done:upto]] = codes[done:upto]
            done = upto
        found = state[lo:hi]
        out.append(found[found > 0].astype(">u2").tobytes().decode("latin-1"))
    got = asks[["line", "role", "_i"]].assign(hex=out)
    return got[got["hex"] != ""]


def bytes_as_of(requests: DataFrame, byte_writes: DataFrame | PageLogs, page_lines: int | None = None) -> DataFrame:
    """(line, role, hex): the set bytes from `low` to low + size - 1 as they stand after line `at`, in address order, for
    requests(line, role, at, low, size) with unique (line, role); requests without any set byte give no row.

    byte_writes: (addr, line, byte), or with seq where a line writes a byte more than once: the last counts; or page_logs() of
    them, where more requests follow. Writes and requests meet by pages of POINTED addresses and spans of page_lines lines: each such
    group starts with what the page holds by then and is read once, in line order. So neither a busy page nor a long trace comes
    to one task, and no request asks for single bytes.
    """
    logs, span = byte_writes if isinstance(byte_writes, PageLogs) else page_logs(byte_writes, page_lines)
    r = requests.where("at IS NOT NULL AND low IS NOT NULL AND size > 0")
    page, place = _cell("low")
    b = F.floor(F.col("at") / span)
    r = r.withColumns({"_first": page, "_lo": place.cast("long"), "_b": b, "_t": (F.col("at") - b * span).cast("int")})
    r = r.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_lo") + F.col("size") - 1) / POINTED))))
    r = r.select("line", "role", "_t", "_b", (F.col("_first") + F.col("_i")).alias("_p"), "_i", F.greatest(F.col("_lo") - F.col("_i") * POINTED, F.lit(0)).alias("_from"), F.least(F.col("_lo") + F.col("size") - F.col("_i") * POINTED, F.lit(POINTED)).alias("_to"))
    asked = r.select("_p", "_b").distinct()
    # a page's spans pass one after the other, each as what it leaves
    before = logs.join(asked.select("_p").distinct(), "_p", "left_semi").select("_p", "_b", "_left")
    marks = before.unionByName(asked.withColumn("_left", F.lit(None).cast("binary")))
    marks = marks.repartition("_p").sortWithinPartitions("_p", "_b", F.col("_left").isNotNull())
    held = marks.mapInArrow(_held, "_p long, _b long, _held binary")
    pages = logs.join(asked, ["_p", "_b"], "left_semi").select("_p", "_b", "_times", "_places", "_codes").unionByName(held, allowMissingColumns=True)
    found = r.groupBy("_p", "_b").cogroup(pages.groupBy("_p", "_b")).applyInPandas(_read, "line long, role string, _i long, hex string")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_i", "hex"))), lambda x: x["hex"])  # the pages of one request
    return found.groupBy("line", "role").agg(F.array_join(parts, "").alias("hex"))


def pointed(calls: DataFrame, byte_writes: DataFrame | PageLogs, size: int = POINTED) -> DataFrame:
    """(line, payload): hex of the set bytes at buffer to buffer + size - 1 as they stand at the line of calls(line, buffer); calls without any go."""
    asked = calls.select("line", F.lit("entry").alias("role"), F.col("line").alias("at"), F.col("buffer").alias("low"), F.lit(size).cast("long").alias("size"))
    return bytes_as_of(asked, byte_writes).select("line", F.col("hex").alias("payload"))


def pointed_texts(calls: DataFrame, byte_writes: DataFrame | PageLogs, size: int = POINTED) -> DataFrame:
    """(line, text): first line, trimmed, of the text that calls(line, buffer, return_line) point to when entered; where that is empty, when returned from.

    Calls without any set byte at either time go.
    """
    times = F.explode(F.array(F.struct(F.lit("entry").alias("role"), F.col("line").alias("at")), F.struct(F.lit("exit").alias("role"), F.col("return_line").alias("at"))))
    asked = calls.select("line", F.col("buffer").alias("low"), F.lit(size).cast("long").alias("size"), times.alias("_t")).select("line", "low", "size", "_t.*")
    text = message_text(F.col("hex"))
    at = lambda role: F.max(F.when(F.col("role") == role, text))
    found = bytes_as_of(asked, byte_writes).groupBy("line").agg(at("entry").alias("_entry"), at("exit").alias("_exit"))
    return found.select("line", F.coalesce(F.nullif("_entry", F.lit("")), "_exit", "_entry").alias("text"))


#: Lanes of a 64-bit register that writes to its parts set: the top half, the next two bytes, the high byte and the low byte.
LANES = {"top": 8, "mid": 4, "high": 2, "low": 2}


def register_part(name: Column) -> Column:
    """(reg, width) of a general register's name: the 64-bit register and the bits of the part (-8: the second byte); other names are whole, width null."""
    n = F.upper(name)
    pick = lambda p, i=1: F.regexp_extract(n, p, i)
    classic, index, numbered = r"^([RE]?)([ABCD])X$", r"^([RE]?)(SI|DI|BP|SP|IP)(L?)$", r"^R(8|9|1[0-5])([DWB]?)$"
    byte = r"^([ABCD])([LH])$"
    of = lambda reg, width: F.struct(reg.alias("reg"), width.cast("int").alias("width"))
    wide = lambda prefix: F.when(prefix == "R", 64).when(prefix == "E", 32).otherwise(16)
    return (
        F.when(n.rlike(classic), of(F.concat(F.lit("R"), pick(classic, 2), F.lit("X")), wide(pick(classic))))
        .when(n.rlike(byte), of(F.concat(F.lit("R"), pick(byte), F.lit("X")), F.when(pick(byte, 2) == "L", 8).otherwise(-8)))
        .when(n.rlike(index), of(F.concat(F.lit("R"), pick(index, 2)), F.when(pick(index, 3) == "L", 8).otherwise(wide(pick(index)))))
        .when(n.rlike(numbered), of(F.concat(F.lit("R"), pick(numbered)), F.when(pick(numbered, 2) == "D", 32).when(pick(numbered, 2) == "W", 16).when(pick(numbered, 2) == "B", 8).otherwise(64)))
        .otherwise(of(n, F.lit(None)))
    )


def register_file(writes: DataFrame, clears_top: bool = True) -> DataFrame:
    """(reg, line, value_hex): the full 64-bit value (16 digits) of each register after each line that writes a part of it.

    writes: (reg, line, seq, width, value_hex): width 64, 32, 16, 8 or -8 (the second byte); of a part that a line writes more than once the last
    counts. A 32-bit write clears the top half, or leaves it if clears_top is false. Parts never written are
    zero. Each lane of bytes carries its last writer in one scan by register.
    """
    v = F.lpad("value_hex", 16, "0")
    w = F.col("width")
    zero = F.lit("0" * 8)
    lanes = {
        "top": F.when(w == 64, F.substring(v, 1, 8)).when((w == 32) & F.lit(clears_top), zero),
        "mid": F.when(w.isin(64, 32), F.substring(v, 9, 4)),
        "high": F.when(w.isin(64, 32, 16), F.substring(v, 13, 2)).when(w == -8, F.substring(v, 15, 2)),
        "low": F.when(w.isin(64, 32, 16, 8), F.substring(v, 15, 2)),
    }
    d = writes.select("reg", "line", "seq", *[c.alias(n) for n, c in lanes.items()])
    # one row a register and line, so that the order is unique
    d = d.groupBy("reg", "line").agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("seq"))).alias(n) for n in LANES])
    d = scans(d, "line", {f"_{n}": (F.col(n), "last") for n in LANES}, ("reg",), inclusive=True)
    full = F.concat(*[F.coalesce(F.col(f"_{n}"), F.lit("0" * digits)) for n, digits in LANES.items()])
    return d.select("reg", "line", full.alias("value_hex"))


def leaf_deltas(parsed: DataFrame, skip: int | None = None) -> DataFrame:
    """(line, seq, kind, key, value_hex, is_before): one row per register or memory change of a line(line, refs).

    key: the register's name, or the address in decimal. Values keep their order on the line; changes of
    the address `skip` (a thread's information block) are left out, lines without changes give no row.
    """
    r = parsed.select("line", F.posexplode("refs").alias("seq", "_r"))
    if skip is not None:
        r = r.where(F.col("_r.addr").isNull() | (F.col("_r.addr") != skip))
    key = F.when(F.col("_r.kind") == "memory", F.col("_r.addr").cast("string")).otherwise(F.col("_r.reg"))
    return r.select("line", "seq", F.col("_r.kind").alias("kind"), key.alias("key"), F.col("_r.value_hex").alias("value_hex"), F.col("_r.is_before").alias("is_before"))


def syscall_register(flags: Column, is_entry: Column, value: Column, wide_flag: int) -> Column:
    """(reg, value_hex, is_before): what a system call's line tells of: the stack pointer on entry, the result on exit.

    wide_flag: the bit of the flags that marks 64-bit execution; else registers have 32 bits.
    """
    wide = is_wide(flags, wide_flag)
    reg = F.concat(F.when(wide, "R").otherwise("E"), F.when(is_entry, "SP").otherwise("AX"))
    digits = F.when(wide, 16).otherwise(8)
    return F.struct(reg.alias("reg"), F.right(F.lpad(F.hex(value), 16, "0"), digits).alias("value_hex"), is_entry.alias("is_before"))


def is_wide(flags: Column, wide_flag: int) -> Column:
    """Whether a line ran in 64-bit mode; null flags did not."""
    return F.coalesce(flags.bitwiseAND(F.lit(wide_flag)) != 0, F.lit(False))


def write_levels(levels: dict[int, DataFrame], path: str) -> None:
    """Snapshot tables by level, in directories of level and bucket and sorted by key, so that reading a state prunes."""
    for level, d in levels.items():
        keys = [c for c in d.columns if c not in ("bucket", "line", "seq")]
        d.repartition("bucket").sortWithinPartitions("bucket", *keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/level={level}")


def value_at(requests: DataFrame, writes: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """requests(key, line, ...) with `name`: the value of the last of writes(key, line, value) at or before the line; null if there is none.

    Requests and writes of a key are read as one sequence, so no join grows with the number of writes before a line.
    """
    rest = [c for c in requests.columns if c not in (key, "line")]
    w = writes.select(F.col(key).alias("_k"), "line", F.col(value).alias("_value"), F.lit(0).alias("_ask"))
    r = requests.select(F.col(key).alias("_k"), "line", F.struct(F.lit(1).alias("_one"), *rest).alias("_rest"), F.lit(1).alias("_ask"))
    both = r.unionByName(w, allowMissingColumns=True).withColumn("_at", F.col("line") * 2 + F.col("_ask"))
    both = scan(both, "_at", F.col("_value"), name, "last", ("_k",)).where("_ask = 1")
    return both.select(F.col("_k").alias(key), "line", *[F.col(f"_rest.{c}").alias(c) for c in rest], name)


def call_messages(calls: DataFrame, registers: DataFrame, byte_writes: DataFrame) -> DataFrame:
    """calls(line, at, buffer_reg, length_reg, ...) with buffer, length and payload (hex).

    The registers are read at the call's line, what they point to at line `at`: the call's own for a
    sent message, the return's for a received one. registers: (reg, line, value), value a number; byte_writes:
    (addr, line, byte). Bytes that were never written are left out; a call without a buffer, a length or any byte has a null payload.
    """
    c = calls
    for what, reg in (("buffer", "buffer_reg"), ("length", "length_reg")):
        c = value_at(c.withColumnRenamed(reg, "reg"), registers, "reg", "value", what).withColumnRenamed("reg", reg)
    keys = [x for x in c.columns]
    known = F.col("buffer").isNotNull() & (F.col("length") > 0)
    asked = c.where(known).select(F.struct(*keys).alias("_id"), F.col("at").alias("line"), F.posexplode(F.sequence(F.col("buffer"), F.col("buffer") + F.col("length") - 1)).alias("_i", "addr"))
    found = value_at(asked.where("line is not null"), byte_writes, "addr", "byte", "byte").where("byte is not null")
    text = found.groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "byte"))), lambda x: x["byte"]), "").alias("payload"))
    text = text.select("_id.line", "payload")
    return c.join(text, "line", "left")


def call_events(lines: DataFrame, descriptors: DataFrame, registers: DataFrame, byte_writes: DataFrame) -> DataFrame:
    """(line, return_line, func, type, input_value, ret_value, buffer, length, message): what the described functions were called with and gave.

    Every line that executes the instruction at which a described function starts is a call; its return line is that of the
    call line just before it. Registers of arguments are read at the entry, those of results at the return line. descriptors: (instruction_id, func, type, ret_reg,
    value_reg, value_is_value, in_reg, in_len_reg, out_reg, out_len_reg, data_index), any register null; registers: (reg, line,
    value_hex) as register_file gives them; byte_writes as for bytes_as_of; lines as for return_lines.

    input_value: the register's digits, or the text it points to, at the entry or else at the return. Sends: all but the last
    character of `length` bytes at in_reg, at the entry. Receives and checks: the first line, trimmed, of `length` bytes at
    out_reg, at the return; a check with a data_index reads where the last receive of this index and value before it was told to
    write. Lengths are the low 32 bits. Without a return line there is no result and no received message; without an address or
    any set byte the message is null.
    """
    h = lines.select("line", "instruction_id").join(descriptors, "instruction_id")
    h = settled(h.join(return_lines(lines).select((F.col("call_line") + 1).alias("line"), "return_line"), "line", "left"))
    roles = {"value": "value_reg", "in": "in_reg", "in_len": "in_len_reg", "out": "out_reg", "out_len": "out_len_reg", "ret": "ret_reg"}
    wanted = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("reg"), F.col("return_line" if r == "ret" else "line").alias("at")) for r, c in roles.items()])
    asks = h.select(F.col("line").alias("call"), F.explode(wanted).alias("_w")).select("call", "_w.role", "_w.reg", F.col("_w.at").alias("line")).where("reg IS NOT NULL AND line IS NOT NULL")
    named = registers.join(F.broadcast(asks.select("reg").distinct()), "reg", "left_semi")  # writes of registers that no function names are not read
    got = value_at(asks, named, "reg", "value_hex", "_v")
    wide = got.groupBy("call").agg(*[F.max(F.when(F.col("role") == r, F.col("_v"))).alias(f"_{r}") for r in roles]).withColumnRenamed("call", "line")
    c = h.join(wide, "line", "left")
    number = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")
    short = lambda x: F.conv(F.right(x, F.lit(8)), 16, 10).cast("long")
    sends = F.col("type") == "send"
    c = c.withColumns({"buffer": F.when(sends, number("_in")).otherwise(number("_out")), "length": F.when(sends, short("_in_len")).otherwise(short("_out_len"))})
    c = settled(c.drop(*roles.values(), "_in", "_in_len", "_out", "_out_len"))
    written = page_logs(byte_writes)  # read once, for the texts and for the messages
    texts = c.where("NOT value_is_value").select("line", number("_value").alias("buffer"), "return_line").where("buffer IS NOT NULL")
    texts = pointed_texts(texts, written).withColumnRenamed("text", "_text")
    c = settled(c.join(texts, "line", "left").withColumn("input_value", F.when(F.col("value_is_value"), F.col("_value")).otherwise(F.col("_text"))))
    # a check reads where the last receive of its key was told to write
    keyed = F.coalesce(F.col("type").isin("receive", "check") & F.col("data_index").isNotNull(), F.lit(False))
    key = F.concat("data_index", F.coalesce("input_value", F.lit("")))
    told = F.when(F.col("type") == "receive", F.struct("buffer", "length"))
    k = scan(c.where(keyed).withColumn("_key", key), "line", told, "_told", "last", ("_key",))
    k = k.withColumns({n: F.when(F.col("type") == "check", F.col(f"_told.{n}")).otherwise(F.col(n)) for n in ("buffer", "length")})
    c = settled(c.where(~keyed).unionByName(k.drop("_key", "_told")))
    asked = c.where("type IN ('send', 'receive', 'check')").select("line", F.lit("message").alias("role"), F.when(sends, F.col("line")).otherwise(F.col("return_line")).alias("at"), F.col("buffer").alias("low"), F.col("length").alias("size"))
    found = bytes_as_of(asked, written).select("line", "hex")
    sent = F.decode(F.unhex(F.substring(F.col("hex"), F.lit(1), F.greatest(F.col("length") - 1, F.lit(0)).cast("int") * 2)), "ISO-8859-1")
    message = F.when(F.col("hex").isNull(), None).when(sends, sent).otherwise(message_text(F.col("hex")))
    return c.join(found, "line", "left").select("line", "return_line", "func", "type", "input_value", F.col("_ret").alias("ret_value"), "buffer", "length", message.alias("message"))
