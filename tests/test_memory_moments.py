"""Memory and registers as of each call against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import memory, ordered


@pytest.mark.parametrize("span", [1 << 16, 20])
def test_bytes_as_of(spark, span):
    """Random writes and requests over several pages, with several writes of a byte on a line and unset bytes."""
    r = random.Random(span)
    writes = [(r.randrange(700) if i % 5 else r.randrange(250, 262), r.randrange(300), seq, f"{r.randrange(256):02X}") for seq, i in enumerate(range(900))]
    asks = [(i, role, r.choice([None, *range(-1, 320, 3)]), r.choice([None, r.randrange(720)]), r.choice([1, 5, 256, 600, 0])) for i in range(80) for role in ("a", "b")]
    want = {}
    for line, role, at, low, size in asks:
        state = {}
        for a, w_line, seq, byte in sorted(writes, key=lambda w: (w[1], w[2])):
            if at is not None and w_line <= at:
                state[a] = byte
        found = "".join(state[a] for a in range(low, low + size) if a in state) if low is not None else ""
        if found:
            want[line, role] = found
    w = spark.createDataFrame(writes, "addr long, line long, seq long, byte string")
    q = spark.createDataFrame(asks, "line long, role string, at long, low long, size long")
    out = memory.bytes_as_of(q, w, span)
    assert {(x["line"], x["role"]): x["hex"] for x in out.collect()} == want and len(want) > 30
    assert memory.bytes_as_of(q.where("false"), w).count() == 0 and memory.bytes_as_of(q, w.where("false")).count() == 0


def test_addresses_beyond_63_bits(spark):
    top = 2**64 - 4
    w = spark.sql(f"SELECT CAST({top} + id AS DECIMAL(20,0)) AS addr, id AS line, hex(id + 16) AS byte FROM range(4)")
    q = spark.sql(f"SELECT 1L AS line, 'x' AS role, 2L AS at, CAST({top} AS DECIMAL(20,0)) AS low, 4L AS size")
    assert [r["hex"] for r in memory.bytes_as_of(q, w).collect()] == ["101112"]


def test_pointed_texts_are_retried_at_the_return(spark):
    writes = [(100 + i, line, f"{ord(c):02X}") for line, text in ((5, "old \nx"), (20, "new")) for i, c in enumerate(text)] + [(200, 30, "41"), (300, 1, "20"), (300, 40, "42")]
    w = spark.createDataFrame(writes, "addr long, line long, byte string")
    calls = spark.createDataFrame([(6, 100, 9), (21, 100, 50), (7, 200, 35), (8, 200, 9), (9, 300, 41), (10, 300, None), (11, None, 50)], "line long, buffer long, return_line long")
    assert {r["line"]: r["text"] for r in memory.pointed_texts(calls, w).collect()} == {6: "old", 21: "new", 7: "A", 8: "", 9: "B", 10: ""}
    assert {r["line"]: r["payload"] for r in memory.pointed(calls, w, 3).collect()} == {6: "6F6C64", 21: "6E6577", 9: "20", 10: "20"}


@pytest.fixture(params=[1 << 20, 7], ids=["one bucket", "many buckets"])
def buckets(request, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", request.param)


@pytest.mark.parametrize("clears", [True, False])
def test_register_file(spark, buckets, clears):
    r = random.Random(4)
    rows = [(f"R{r.randrange(3)}", r.randrange(60), seq, r.choice([64, 32, 16, 8, -8]), f"{r.randrange(1 << 64):016X}"[r.choice([0, 8]) :]) for seq in range(200)]
    now, want = {}, {}
    for reg, line, _, width, value in sorted(rows, key=lambda x: (x[1], x[2])):
        old, new = now.get(reg, 0), int(value, 16)
        if width == -8:
            now[reg] = old & ~0xFF00 | (new & 0xFF) << 8
        else:
            mask = (1 << width) - 1
            now[reg] = (0 if width == 32 and clears else old & ~mask) | new & mask
        want[reg, line] = f"{now[reg]:016X}"
    d = spark.createDataFrame(rows, "reg string, line long, seq int, width int, value_hex string")
    assert {(x["reg"], x["line"]): x["value_hex"] for x in memory.register_file(d, clears).collect()} == want


def test_register_parts(spark):
    names = {"rax": ("RAX", 64), "EBX": ("RBX", 32), "CX": ("RCX", 16), "DL": ("RDX", 8), "ah": ("RAX", -8), "ESI": ("RSI", 32), "SPL": ("RSP", 8), "BP": ("RBP", 16), "R8": ("R8", 64), "R10D": ("R10", 32), "R15W": ("R15", 16), "R9B": ("R9", 8), "XMM0": ("XMM0", None), "RFLAGS": ("RFLAGS", None)}
    d = spark.createDataFrame([(n,) for n in names], "n string").select("n", memory.register_part(F.col("n")).alias("p")).select("n", "p.*")
    assert {r["n"]: (r["reg"], r["width"]) for r in d.collect()} == names


def test_call_events(spark):
    """A send, a receive into a place, and a check that reads where the receive was told to write."""
    text = lambda at, line, s: [(at + i, line, f"{ord(c):02X}") for i, c in enumerate(s)]
    lines, n = [], 0
    for name in ("send", "recv", "check"):
        lines += [(n, 1, "a", "call", f"call {name}"), (n + 1, 1, "lib", "mov", name), (n + 2, 1, "lib", "ret", "end"), (n + 3, 1, "a", "mov", "next")]
        n += 4
    d = spark.createDataFrame([(-1, 1, "a", "mov", "start"), *lines], "line long, thread long, module string, mnemonic string, instruction_id string")
    desc = [("send", "Send", "send", "RAX", "RCX", True, "RDX", "R8", None, None, None), ("recv", "Recv", "receive", "RAX", "RCX", False, None, None, "RDX", "R8", "k"), ("check", "Check", "check", "RAX", "RCX", False, None, None, "R9", "R10", "k")]
    desc = spark.createDataFrame(desc, "instruction_id string, func string, type string, ret_reg string, value_reg string, value_is_value boolean, in_reg string, in_len_reg string, out_reg string, out_len_reg string, data_index string")
    regs = [("RCX", 0, 7), ("RDX", 0, 0x1000), ("R8", 0, 6), ("RAX", 3, 1), ("RCX", 4, 0x3000), ("RDX", 4, 0x2000), ("R8", 4, 9), ("RAX", 7, 0), ("R9", 8, 0x5000), ("RAX", 11, 5)]
    regs = spark.createDataFrame([(r, line, f"{v:016X}") for r, line, v in regs], "reg string, line long, value_hex string")
    writes = text(0x1000, 0, "hello!") + text(0x1000, 3, "later!") + text(0x3000, 2, "pipe\n") + text(0x2000, 6, "ANSWER\nxx") + text(0x2000, 10, "SECOND\nxx")
    out = memory.call_events(d, desc, regs, spark.createDataFrame(writes, "addr long, line long, byte string")).orderBy("line").collect()
    got = [(r["line"], r["return_line"], r["func"], r["input_value"], r["ret_value"], int(r["buffer"]), r["length"], r["message"]) for r in out]
    assert got == [
        (1, 3, "Send", f"{7:016X}", f"{1:016X}", 0x1000, 6, "hello"),
        (5, 7, "Recv", "pipe", f"{0:016X}", 0x2000, 9, "ANSWER"),
        (9, 11, "Check", "pipe", f"{5:016X}", 0x2000, 9, "SECOND"),
    ]


def test_page_logs_serve_many_requests(spark):
    """Writes are read once, however many requests follow; pages on both sides of 2**63, equal lines and spans without writes."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(len(x))
            yield x

    tops = [0, 2**63 - 2, 2**64 - 3]
    rows = [(top + i, line, seq, f"{(i * 16 + line + seq) % 256:02x}") for top in tops for i in range(3) for line in (0, 5, 70) for seq in (1, 0)]
    w = spark.createDataFrame([(str(a), *rest) for a, *rest in rows], "addr string, line long, seq long, byte string").withColumn("addr", F.col("addr").cast("decimal(20,0)"))
    written = memory.page_logs(w.mapInPandas(counted, w.schema), 20)
    asks = [(n, line, top) for n, (line, top) in enumerate((line, top) for line in (-1, 4, 5, 6, 69, 70, 200) for top in tops)]
    q = spark.createDataFrame([(n, "x", line, str(top)) for n, line, top in asks], "line long, role string, at long, low string").withColumns({"low": F.col("low").cast("decimal(20,0)"), "size": F.lit(300).cast("long")})
    want = {}
    for n, line, top in asks:
        seen = {a: byte for a, at, seq, byte in sorted(rows, key=lambda r: (r[1], r[2])) if at <= line and top <= a < top + 300}
        if seen:
            want[n] = "".join(seen[a] for a in sorted(seen))
    for _ in range(2):
        assert {r["line"]: r["hex"] for r in memory.bytes_as_of(q, written).collect()} == want and want
    assert read.value == len(rows)


def test_call_events_reads_writes_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for x in batches:
            read.add(len(x))
            yield x

    rows = [(n, 1, "ab"[n % 3 == 0], m, i) for n, (m, i) in enumerate([("mov", "start"), ("call", "call"), ("mov", "receive"), ("ret", "end"), ("mov", "next"), ("call", "call"), ("mov", "check"), ("ret", "end"), ("mov", "next")])]
    d = spark.createDataFrame(rows, "line long, thread long, module string, mnemonic string, instruction_id string")
    desc = [(t, t, t, "R4", "R5", False, None, None, "R1", "R2", "p") for t in ("receive", "check")]
    desc = spark.createDataFrame([(x[0], *x[1:]) for x in desc], "instruction_id string, func string, type string, ret_reg string, value_reg string, value_is_value boolean, in_reg string, in_len_reg string, out_reg string, out_len_reg string, data_index string")
    regs = spark.createDataFrame([("R1", 0, f"{600:016X}"), ("R2", 0, f"{4:016X}"), ("R5", 0, f"{100:016X}"), ("R1", 5, f"{900:016X}"), ("R9", 1, "no number")], "reg string, line long, value_hex string")
    writes = [(100, 0, "6B"), (600, 1, "61"), (601, 1, "62"), (900, 1, "7A")]
    w = spark.createDataFrame(writes, "addr long, line long, byte string")
    out = memory.call_events(d, desc, regs, w.mapInPandas(counted, w.schema)).collect()
    assert sorted((r["line"], r["input_value"], int(r["buffer"])) for r in out) == [(2, "k", 600), (6, "k", 600)]
    assert read.value == len(writes)
