"""Golden cases: memory writes, interval algebra, pipe events, trace text, files, streams."""

import json
import random
import struct

from pyspark.sql import functions as F

from tracewright.functions import sinks
from tracewright.functions import text as tx
from tracewright.operators import channels as ch
from tracewright.operators import intervals as iv
from tracewright.operators import memory
from tracewright.sources import files, trace_text


def state(spark, writes):
    rows = [(line, seq, addr, v) for seq, (addr, v, line) in enumerate(writes)]
    d = spark.createDataFrame(rows, "line long, seq long, addr long, value_hex string").withColumn("addr", F.col("addr").cast("decimal(20,0)"))
    return memory.newest(memory.bytes_of(d), ["addr"], "byte", ["line", "seq"])


def test_last_writer_wins(spark):
    read = lambda w: [x["byte"] for x in state(spark, w).orderBy("addr").collect()]
    assert read([(0, "00000001", 0), (4, "00000002", 1)]) == ["00", "00", "00", "01", "00", "00", "00", "02"]
    assert read([(0, "0101", 0), (1, "0202", 1), (2, "0303", 2), (3, "04", 3)]) == ["01", "02", "03", "04"]
    assert read([(2, "01020304", 0), (3, "0506", 1), (4, "0708", 1)]) == ["01", "05", "07", "08"]
    assert state(spark, [(4 * i, f"{i:08X}", i) for i in range(1000)]).count() == 4000


def test_memory_search_joins_neighbours_across_pages(spark):
    s = state(spark, [(65534, "AABB", 0), (65536, "CCDD", 1), (70000, "AABB", 2)])
    assert sorted(x["addr"] for x in memory.search(s, "BBCC").collect()) == [65535]
    assert sorted(x["addr"] for x in memory.search(s, "AABB").collect()) == [65534, 70000]


def test_memory_search_page_by_page(spark, monkeypatch):
    """Regions over several pages, and needles longer than a page, without a window over all runs."""
    monkeypatch.setattr(memory, "PAGE", 16)
    s = state(spark, [(13, "AABBAABB", 0), (17, "AA", 1), (47, "AABBAA", 2), (4, "AABBAA", 3)])
    hits = memory.search(s, "AABBAA")
    assert sorted(x["addr"] for x in hits.collect()) == [4, 13, 15, 47]
    assert "SinglePartition" not in hits._jdf.queryExecution().executedPlan().toString()
    whole = spark.range(5, 100).select(F.col("id").cast("decimal(20,0)").alias("addr"), F.lpad(F.hex(F.col("id") % 25), 2, "0").alias("byte"))
    needle = "".join(f"{a % 25:02X}" for a in range(7, 47))
    assert sorted(x["addr"] for x in memory.search(whole, needle).collect()) == [7, 32, 57]


def test_pointed_bytes_of_late_calls(spark, monkeypatch):
    from tracewright.plans import memory_queries

    rows = [(10, 1, "mov", 8, 1), (3000, 1, "call", 8, 2), (9000, 1, "call", 8, 3)]
    lines = spark.createDataFrame(rows, "line long, thread long, mnemonic string, addr long, byte long")
    monkeypatch.setattr(memory_queries, "trace_lines", lambda *_: lines)
    assert {r["line"]: r["payload"] for r in memory_queries.pointed_bytes(spark, "").collect()} == {3000: "020E", 9000: "0315"}


def test_second_level_snapshots_take_part(spark):
    rows = [(line, 0, addr, f"{line % 251:02X}") for addr in range(5) for line in range(addr * 7, 2_400_000, 99_991 + addr)]
    d = spark.createDataFrame(rows, "line long, seq long, addr long, byte string")
    first, second = (memory.snapshot(d, ["addr"], "byte", level) for level in (1, 2))
    for line in (4321, 999_999, 1_000_000, 2_345_678):
        got = memory.state_from_snapshots(d, first, second, ["addr"], "byte", line)
        assert sorted(map(tuple, got.select("addr", "byte", "line").collect())) == sorted(map(tuple, memory.state_at(d, line).select("addr", "byte", "line").collect()))


def test_registers(spark):
    rows = [(1, 0, "RAX", "01", True), (1, 1, "RAX", "02", False), (1, 2, "RAX", "03", False), (2, 0, "RBX", "04", True), (2, 1, "RBX", "05", True)]
    d = spark.createDataFrame(rows, "line long, seq int, reg string, value_hex string, is_before boolean")
    assert {r["reg"]: r["value_hex"] for r in memory.merged_registers(d).collect()} == {"RAX": "02", "RBX": "05"}


DIFFERENCES = [
    ([(0, 10), (11, 20), (21, 30), (31, 40)], [], [(0, 10), (11, 20), (21, 30), (31, 40)]),
    ([], [(0, 10), (11, 20)], []),
    ([(0, 10), (21, 30)], [(5, 15)], [(0, 4), (21, 30)]),
    ([(5, 15), (21, 30)], [(0, 10)], [(11, 15), (21, 30)]),
    ([(0, 15), (21, 30)], [(5, 10)], [(0, 4), (11, 15), (21, 30)]),
    ([(0, 30)], [(16, 30), (5, 10)], [(0, 4), (11, 15)]),
    ([(0, 30)], [(16, 30), (0, 4)], [(5, 15)]),
    ([(0, 30)], [(11, 19), (26, 30)], [(0, 10), (20, 25)]),
    ([(5, 30)], [(11, 19), (0, 9)], [(10, 10), (20, 30)]),
]
COVERAGE = [
    ([(0, 15), (16, 30), (31, 85), (86, 101)], True),
    ([(1, 15), (16, 30), (31, 85), (86, 100)], True),
    ([(0, 15), (16, 30), (32, 85), (86, 101)], False),
    ([(2, 15), (16, 30), (31, 85), (86, 101)], False),
    ([(0, 15), (16, 30), (31, 85), (86, 99)], False),
]


def test_interval_difference(spark):
    make = lambda k: spark.createDataFrame([(i, s, e) for i, c in enumerate(DIFFERENCES) for s, e in c[k]], "g int, s long, e long")
    got = {}
    for r in iv.difference(make(0), make(1), ["g"]).collect():
        got.setdefault(r["g"], []).append((r["s"], r["e"]))
    for i, (_, _, want) in enumerate(DIFFERENCES):
        assert sorted(got.get(i, [])) == sorted(want)


def test_interval_coverage(spark):
    c = spark.createDataFrame([(i, s, e) for i, (x, _) in enumerate(COVERAGE) for s, e in x], "g int, s long, e long")
    t = spark.createDataFrame([(i, 1, 100) for i in range(len(COVERAGE))], "g int, ts long, te long")
    assert {r["g"]: r["covered"] for r in iv.covered(t, c, ["g"]).collect()} == {i: y for i, (_, y) in enumerate(COVERAGE)}


PIPE = "\\.\\pipe\\mynamepipe"
FIRST = [
    ("client", 375744, "open", "0xF8", ""),
    ("client", 385178, "send", "0xF8", "This is a test."),
    ("client", 391590, "receive", "0xF8", "This is the answer."),
    ("client", 402442, "close", "0xF8", ""),
    ("server", 387947, "open", "0xF4", ""),
    ("server", 431677, "receive", "0xF4", "This is a test."),
    ("server", 436462, "send", "0xF4", "This is the answer."),
    ("server", 442158, "close", "0xF4", ""),
    ("server", 442224, "close", "0xF4", ""),
]
ANSWER = "Default answer from server"
SECOND = (
    [("server", line, "open", h, "") for line, h in ((1732413, "0x118"), (1741477, "0x120"), (1749553, "0x128"), (1757626, "0x130"))]
    + [
        ("server", 1765950, "receive", "0x118", "Message 2"),
        ("server", 1770738, "send", "0x118", ANSWER),
        ("server", 1771676, "receive", "0x120", "Message 1"),
        ("server", 1775507, "send", "0x120", ANSWER),
        ("server", 1777180, "close", "0x118", ""),
        ("server", 1778658, "close", "0x120", ""),
    ]
    + [(c, line, kind, "0x114", p) for c, m in (("client1", "Message 1"), ("client2", "Message 2")) for line, kind, p in ((1723886, "open", ""), (1734413, "send", m), (1740825, "receive", ANSWER), (1752640, "close", ""))]
)


def full(spark, rows):
    e = spark.createDataFrame([(t, line, k, h, PIPE, p) for t, line, k, h, p in rows], "trace string, line long, type string, handle string, channel_id string, payload string")
    return ch.streams(e).join(ch.payloads(ch.stream_events(e)), ["trace", "handle", "open_line"], "left")


def verified(s, left, right):
    s = s.where("sends is not null")
    return [(r["handle_1"], r["handle_2"]) for r in ch.verify_bytes(s.where(F.col("trace") == left), s.where(F.col("trace") == right)).where("ok").collect()]


def test_pipes(spark):
    s = full(spark, FIRST)
    assert s.count() == 2
    assert verified(s, "client", "server") == [("0xF8", "0xF4")]
    s = full(spark, SECOND)
    assert ch.matched(s.where("trace = 'client1'"), s.where("trace = 'server'")).count() == 4
    assert verified(s, "client1", "server") == [("0x114", "0x120")]
    assert verified(s, "client2", "server") == [("0x114", "0x118")]
    assert s.where("NOT closed").count() == 2


def test_verifiers(spark):
    d = spark.createDataFrame([(["ab", "cde", "fgh"], ["abc", "def", "gh"])], "s array<string>, r array<string>")
    none = F.array().cast("array<string>")
    one = lambda c: d.select(c.alias("x")).first()["x"]
    assert not one(ch.tcp_ok(F.col("s"), F.col("r")))
    lit = lambda *x: F.array(*[F.lit(y) for y in x]) if x else none
    assert one(ch.queue_ok(lit("a", "b", "c"), lit("a", "c"))) and not one(ch.queue_ok(lit("a", "b", "c"), lit("c", "a")))


def test_verifiers_of_random_streams(spark):
    """Every check against plain Python, on streams of few short messages."""
    r = random.Random(9)
    some = lambda: ["".join(r.choice("ab") for _ in range(r.randrange(1, 3))) for _ in range(r.choice([0, 1, 2, 3]))]
    rows = [(t, f"{t}{i}", 1, i % 2, some(), some()) for t in "lr" for i in range(40)]
    d = spark.createDataFrame(rows, "trace string, handle string, open_line long, channel_id int, sends array<string>, receives array<string>")

    def queue(s, got):
        it = iter(s)
        return all(x in it for x in got)

    checks = {
        ch.verify_bytes: lambda s, got: "".join(s).startswith("".join(got)),
        ch.verify_counts: lambda s, got: all(got.count(x) <= s.count(x) for x in got),
        ch.verify_prefixes: lambda s, got: all(any(y.startswith(x) for y in got) for x in s),
        (lambda a, b: ch.verify_in_turn(a, b, ch.tcp_ok)): lambda s, got: all(x == y for x, y in zip(s, got)),
        (lambda a, b: ch.verify_in_turn(a, b, ch.queue_ok)): queue,
    }
    for run, ok in checks.items():
        out = run(d.where("trace = 'l'"), d.where("trace = 'r'")).collect()
        want = {(a[1], b[1]): ok(a[4], b[5]) and ok(b[4], a[5]) for a in rows for b in rows if a[0] == "l" and b[0] == "r" and a[3] == b[3]}
        assert {(x["handle_1"], x["handle_2"]): x["ok"] for x in out} == want and len(out) == len(want) and 0 < sum(want.values()) < len(want)


def test_pairings(spark):
    """The last partner counts, and one message without a partner undoes the match."""
    rows = [("l", "h", 1, 2, "send", "ab"), ("l", "h", 1, 3, "receive", "xyz"), ("l", "h", 1, 9, "send", "ab"), ("l", "e", 1, 4, "send", ""), ("r", "h", 0, 5, "receive", "abc"), ("r", "h", 0, 6, "receive", "ab"), ("r", "h", 0, 7, "send", "x"), ("r", "h", 0, 8, "send", "q"), ("r", "g", 0, 5, "receive", "abc")]
    d = spark.createDataFrame(rows, "trace string, handle string, open_line long, line long, type string, payload string").withColumn("channel_id", F.lit("c"))
    got = ch.pairings(d.where("trace = 'l'"), d.where("trace = 'r'")).collect()
    assert sorted((x["handle_1"], x["line_1"], x["handle_2"], x["line_2"]) for x in got) == [("h", 2, "h", 6), ("h", 3, "h", 7), ("h", 9, "h", 6)]


def test_payloads_are_whole_texts(spark, tmp_path):
    from tracewright.plans import comm_queries as comm

    same = "x" * 50
    rows = [(1, 0, "user", same + "a"), (41, 0, "user", same + "b"), (81, 0, "user", same + "abc")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {(r["send_handle"], r["recv_handle"]) for r in comm.payload_prefix_join(spark, str(tmp_path)).collect()}
    assert found == {(1, 1), (1, 81), (41, 41), (81, 81)}
    for q in (comm.verify_tcp, comm.verify_udp, comm.verify_queue):
        assert {(r["handle_1"], r["handle_2"]) for r in q(spark, str(tmp_path)).where("ok").collect()} == {(1, 1), (41, 41), (81, 81)}
    for q in (comm.verify_pipe, comm.verify_by_prefix):
        assert {(r["handle_1"], r["handle_2"]) for r in q(spark, str(tmp_path)).where("ok").collect()} >= {(1, 1), (41, 41), (81, 81)}


def test_text_trace(spark, tmp_path):
    text = [
        "0 S:ThreadBegin TID=4420 ",
        "A I:1F kernel32.dll+2A10 (77A12A10) call qword ptr [rip+0x1000] | RSP=000000000012F208 [000000000012F208]=08A1127700000000",
        "B I:20 kernel32.dll+2A15 (77A12A15) ret | RSP=1",
        "C I:21 api-ms-win-core.dll+10 (7700010) mov eax, ebx | EAX=2",
        "1F T: 4421 switch | |",
        "20 I:22 kernel32.dll+2A16 (77A12A16) nop | ",
    ]
    (tmp_path / "t.txt").write_text("\n".join(text))
    rows = trace_text.with_instruction_ids(trace_text.parse(trace_text.read_lines(spark, str(tmp_path / "t.txt")))).orderBy("line").collect()
    assert [r["line"] for r in rows] == list(range(6))
    assert [r["thread"] for r in rows] == [4420, 4420, 4420, 4420, 4421, 4421]
    assert [r["mnemonic"] for r in rows] == [None, "call", "ret", "mov", None, "nop"]
    assert [r["module"] for r in rows][3] == "api-ms-win-core.dll" and rows[1]["module_offset"] == 0x2A10
    assert [(x["kind"], x["reg"], x["value_hex"]) for x in rows[1]["refs"]] == [("register", "RSP", "000000000012F208"), ("memory", None, "08A1127700000000")]
    assert rows[1]["refs"][1]["addr"] == 0x12F208 and not rows[1]["refs"][1]["is_before"]
    assert [r["instruction_id"] or None for r in rows][1:4] == [f"0:{0x2A10}", f"0:{0x2A15}", f"1:{0x10}"]


def test_diffs_cover_the_whole_trace(spark, monkeypatch):
    from tracewright.plans import lookup_queries as lookup

    lines = spark.range(2**20 - 6000, 2**20 + 500).select(F.col("id").alias("line"), F.lit("0:1").alias("instruction_id"))
    monkeypatch.setattr(lookup, "trace_lines", lambda *_: lines)
    want, first = [], 2**20 - 6000
    for k in range(2**20 - 6000, 2**20 + 500):
        if k + 1 == 2**20 + 500 or (k % 97 < 3) != ((k + 1) % 97 < 3):
            want.append((first, k, k % 97 >= 3))
            first = k + 1
    for q in (lookup.diff_by_position, lookup.diff_merged):
        assert sorted((r["start_line"], r["end_line"], r["is_match"]) for r in q(spark, "").collect()) == want


def test_floats(spark):
    d = spark.createDataFrame([(struct.pack(">d", -2.5).hex(), struct.pack(">f", 1.25).hex(), "4000C90FDAA22168C235"), (None, "xx", None)], "a string, b string, c string")
    r = d.select(tx.float64_of_hex("a").alias("a"), tx.float32_of_hex("b").alias("b"), tx.float80_of_hex("c").alias("c")).collect()
    assert r[0]["a"] == -2.5 and r[0]["b"] == 1.25 and abs(r[0]["c"] - 3.141592653589793) < 1e-15
    assert r[1]["a"] is None and r[1]["b"] is None


def test_binary_headers_and_descriptors(spark, tmp_path):
    (tmp_path / "m.itable").write_bytes(struct.pack("<iiqqq", 1, 2, 2, 48, -1) + struct.pack("<12q", *range(12)))
    h = files.itable_headers(spark, str(tmp_path / "m.itable")).first()
    assert (h["header_ver"], h["record_ver"], h["row_count"], h["row_size"], h["table_fp"]) == (1, 2, 2, 48, -1)
    m = files.module_records(spark, str(tmp_path / "m.itable")).orderBy("row").collect()
    assert [r["device_name_fp"] for r in m] == [5, 11]
    (tmp_path / "c.json").write_text(json.dumps([{"method": "pipe", "functions": [{"name": "ReadFile", "type": "receive", "createHandle": False}]}]))
    assert files.channel_descriptors(spark, str(tmp_path / "c.json")).first()["name"] == "ReadFile"
    assert files.exports(spark, str(tmp_path / "m.itable")).count() == 0


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotations><region name='r' start='1' end='9'/><region name='s' start='2' end='3'/></annotations>")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("_name", T.StringType()), T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType())])
    r = files.annotations(spark, str(tmp_path / "a.xml"), "region", schema).orderBy("_name").collect()
    assert [(x["_name"], x["_start"], x["_end"]) for x in r] == [("r", 1, 9), ("s", 2, 3)]


def test_sinks(spark, tmp_path):
    lines = spark.range(10).select(F.col("id").alias("line"), F.lit("x").alias("text"))
    path = str(tmp_path / "lines")
    assert not sinks.is_complete(spark, path)
    sinks.write_lines(lines, path)
    assert sinks.is_complete(spark, path)
    assert sorted(r["line"] for r in sinks.read_range(spark, path, 3, 5).collect()) == [3, 4, 5]
    sinks.drop(spark, path)
    assert not sinks.is_complete(spark, path)
    ended = lines.withColumn("ended", F.lit(True))
    assert sinks.with_trailing_line(ended).count() == 11
    assert sinks.with_trailing_line(ended.withColumn("ended", F.col("line") < 9)).count() == 10
    assert sinks.with_trailing_line(ended.where("false")).count() == 0
    ids = sinks.thread_ids(spark.createDataFrame([("007",), ("null",)], "tid string"))
    assert [r["tid"] for r in ids.collect()] == [7, None]


def test_live_blocks_equal_batch_blocks(spark, tmp_path):
    from test_control_flow import frame, trace

    from tracewright.operators import control_flow as flow
    from tracewright.streaming import live

    rows = trace(11, threads=3, n=60)
    f = frame(spark, rows)
    for i, part in enumerate((rows[:70], rows[70:])):
        frame(spark, part).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in/*"))
    q = live.thread_function_blocks(stream.withColumn("thread", F.col("thread").cast("long"))).writeStream.format("memory").queryName("live_blocks").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {(r["thread"], r["start_line"]): (r["owner_line"], r["x_offset"], r["width"]) for r in spark.table("live_blocks").collect()}
    finally:
        q.stop()
    names = {r[0]: r[5] for r in rows}
    want = {(r["thread"], r["start_line"]): (r["function_start"], r["x_offset"], r["width"]) for r in flow.thread_function_blocks(f).collect()}
    assert got and all((names[o], x, w) == want[k] for k, (o, x, w) in got.items())
    assert len(want) - len(got) == 3  # each thread's last block is still open


def test_tables_of_diffs_levels_and_their_states(spark, tmp_path):
    import os

    from tracewright.functions import sinks
    from tracewright.operators import memory

    path = str(tmp_path / "diff")
    assert sinks.state_of(spark, path) == "missing" and not sinks.reopened(spark, path)
    sinks.write_regions(spark.createDataFrame([(0, 4, True), (5, 6, False), (7, 9, True)], "start_line long, end_line long, is_match boolean"), path)
    assert sinks.state_of(spark, path) == "populated" and sinks.reopened(spark, path)
    assert [r["start_line"] for r in sinks.read_regions(spark, path).collect()] == [0, 5, 7]
    assert [r["start_line"] for r in sinks.read_regions(spark, path, matching=False).collect()] == [5]
    assert [r["end_line"] for r in sinks.read_regions(spark, path, number=2).collect()] == [9]
    os.remove(f"{path}/_SUCCESS")
    assert sinks.state_of(spark, path) == "created" and not sinks.reopened(spark, path) and sinks.state_of(spark, path) == "missing"
    writes = spark.createDataFrame([(i, 0, i % 7, f"{i % 256:02X}") for i in range(2500)], "line long, seq int, addr long, byte string")
    levels = {k: memory.snapshot(writes, ["addr"], "byte", k) for k in (1, 2)}
    memory.write_levels(levels, str(tmp_path / "levels"))
    back = spark.read.parquet(str(tmp_path / "levels"))
    assert back.where("level = 1").count() == 21 and back.where("level = 2").count() == 7 and sorted(r[0] for r in back.where("level = 1").select("bucket").distinct().collect()) == [0, 1, 2]
    sinks.write_table(writes, str(tmp_path / "t"), ["line"])
    sinks.write_first(writes, ["addr"], "line", str(tmp_path / "f"), ["addr"])
    assert sorted(r["line"] for r in spark.read.parquet(str(tmp_path / "f")).collect()) == list(range(7))


def test_state_from_levels_beyond_the_first(spark):
    """Lines behind a whole second-level bucket: all three levels take part and give the plain state."""
    from tracewright.operators import memory

    rows = [(i, 0, i % 50, f"{i % 256:02X}") for i in [*range(0, 3000), *range(999_000, 1_003_400)]]
    b = spark.createDataFrame(rows, "line long, seq int, addr long, byte string")
    first, second = memory.snapshot(b, ["addr"], "byte", 1), memory.snapshot(b, ["addr"], "byte", 2)
    got = {r["addr"]: (r["byte"], r["line"]) for r in memory.state_from_snapshots(b, first, second, ["addr"], "byte", 1_002_500).collect()}
    assert got == {r["addr"]: (r["byte"], r["line"]) for r in memory.state_at(b, 1_002_500).collect()} and len(got) == 50


def test_long_intervals_are_few_buckets(spark):
    """Stabs and overlaps of intervals from 1 to a million long, against all pairs."""
    from tracewright.operators import intervals as iv

    r = random.Random(6)
    rows = [(i, i % 2, s, s + r.choice([0, 3, 40, 5_000, 1_000_000])) for i, s in enumerate(r.randrange(2_000_000) for _ in range(150))]
    d = spark.createDataFrame(rows, "id long, g int, s long, e long")
    left, right = d.selectExpr("g", "id id_l", "s s_l", "e e_l"), d.selectExpr("g", "id id_r", "s s_r", "e e_r")
    got = sorted((x["id_l"], x["id_r"]) for x in iv.overlaps(left, right, group=("g",)).collect())
    assert got == sorted((a, b) for a, g, s, e in rows for b, h, t, f in rows if g == h and s <= f and t <= e)
    p = spark.createDataFrame([(0, 1_000_000), (1, rows[1][2])], "g int, p long")
    assert sorted((x["p"], x["id"]) for x in iv.stab(d, p, group=("g",)).collect()) == sorted((q, i) for g, q in ((0, 1_000_000), (1, rows[1][2])) for i, h, s, e in rows if g == h and s <= q <= e)
    assert iv.stab(d.where("false"), p, group=("g",)).count() == 0


def test_lines_of_several_files_and_parts(spark, tmp_path):
    """File order, whatever the sizes of files and parts."""
    (tmp_path / "a.txt").write_text("first\n")
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(3000)))
    (tmp_path / "c.txt").write_text("last")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = sorted((r["line"], r["text"]) for r in trace_text.read_lines(spark, str(tmp_path / "*.txt")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == list(enumerate(["first", *(f"b{i}" for i in range(3000)), "last"]))


def test_metadata_and_annotations_round_trip(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<root><trace><version>3</version><arguments>a.exe -x</arguments><is64Bit>true</is64Bit></trace></root>")
    assert tuple(files.trace_metadata(spark, str(tmp_path / "m.xml")).first()) == ("3", "a.exe -x", 64)
    rows = spark.createDataFrame([("todo", 3, "see here"), ("todo", 1, "first")], "group string, line int, text string")
    sinks.write_annotations(rows, str(tmp_path / "notes"), "comments", "comment")
    from tracewright.operators import annotations

    back = files.annotations(spark, str(tmp_path / "notes"), "comment", rows.schema)
    assert [(r["place"], r["text"]) for r in annotations.in_order(back, ["group"]).orderBy("place").collect()] == [(1, "first"), (2, "see here")]
    assert annotations.distinct_places(back.unionByName(back), ["group"]).count() == 2


def test_display_texts(spark):
    d = spark.createDataFrame([("?\x3f004100", "C:\\dir\\a.dll", "48690A2020"), (None, None, None)], "h string, p string, m string")
    r = d.select(tx.hex_text(F.lit("00004100")).alias("h"), tx.file_of_path(F.col("p")).alias("f"), tx.message_text(F.col("m")).alias("t"), tx.message_text(F.col("m"), F.lit(2)).alias("cut")).collect()
    assert tuple(r[0]) == ("A\\0", "a.dll", "Hi", "H") and r[1]["f"] is None and r[1]["t"] is None


def test_newer_thread_marks(spark):
    lines = [(0, "0 1A {"), (1, "1 I:1 a.dll+10 mov eax, ebx | RAX=01"), (2, "2 T: 7 switch | |"), (3, "3 I:2 a.dll+12 ret")]
    out = trace_text.parse(spark.createDataFrame(lines, "line long, text string")).orderBy("line").collect()
    assert [r["thread"] for r in out] == [26, 26, 7, 7]


def test_exports_of_a_library(spark, tmp_path):
    """A library of three exports, one of them a forwarder."""
    base, raw = 0x1000, 0x200
    names = [b"alpha\0", b"beta\0", b"gone\0"]
    texts, at = b"", 40 + 12 + 12 + 6
    starts = []
    for n in names:
        starts.append(base + at + len(texts))
        texts += n
    forward = base + at + len(texts)
    texts += b"other.gone\0"
    functions = struct.pack("<III", 0x5000, 0x6000, forward)
    body = struct.pack("<IIHHIIIIIII", 0, 0, 0, 0, 0, 1, 3, 3, base + 40, base + 52, base + 64) + functions + struct.pack("<III", *starts) + struct.pack("<HHH", 1, 0, 2) + texts
    optional = struct.pack("<H", 0x20B).ljust(112, b"\0") + struct.pack("<II", base, len(body)) + b"\0" * 120
    coff = struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, len(optional), 0)
    section = b".edata\0\0" + struct.pack("<IIII", len(body), base, len(body), raw) + b"\0" * 16
    head = b"MZ".ljust(0x3C, b"\0") + struct.pack("<I", 0x40) + b"PE\0\0" + coff + optional + section
    (tmp_path / "lib.dll").write_bytes(head.ljust(raw, b"\0") + body)
    (tmp_path / "cut.dll").write_bytes((head.ljust(raw, b"\0") + body)[:150])
    got = sorted(tuple(r) for r in files.exports(spark, str(tmp_path / "*.dll")).collect())
    assert got == [("LIB.DLL", 0x5000, "beta"), ("LIB.DLL", 0x6000, "alpha")]
    (tmp_path / "calls.csv").write_text("1,NtOpenFile\n2,NtClose\n")
    assert files.syscall_names(spark, str(tmp_path / "calls.csv")).where("id = 2").first()["name"] == "NtClose"
    (tmp_path / "lines.offsets").write_bytes(struct.pack("<qqq", 0, 17, 40))
    assert [r["start"] for r in files.line_offsets(spark, str(tmp_path / "lines.offsets")).orderBy("row").collect()] == [0, 17, 40]
