"""Lines with their ends, records by ranges and thread events of text traces."""

import random
import re
import struct

import pytest

from tracewright.functions import sinks
from tracewright.operators import ordered
from tracewright.sources import files, records, trace_text


def test_lines_keep_their_ends(spark, tmp_path, monkeypatch):
    """Files give their bytes again, over many parts; the last line's missing end is told."""
    monkeypatch.setattr(ordered, "BUCKET", 50)
    r = random.Random(8)
    contents = ["one\r\ntwo\nthree\rfour", "", "\n", "\r", "x\r\r\ny\r", "".join("w" * r.randrange(30) + r.choice(["\n", "\r\n", "\r", "\n\n"]) for _ in range(3000)), "é\r\n日本\nend\n"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        for i, c in enumerate(contents):
            path = tmp_path / f"f{i}.txt"
            path.write_bytes(c.encode())
            rows = trace_text.read_lines_with_ends(spark, str(path)).orderBy("line").collect()
            assert "".join(x["text"] + x["terminator"] for x in rows) == c and [x["line"] for x in rows] == list(range(len(rows)))
            want = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", c)
            assert [x["text"] + x["terminator"] for x in rows] == want and [x["ended"] for x in rows] == [w[-1] in "\r\n" for w in want]
            d = trace_text.read_lines_with_ends(spark, str(path))
            assert sinks.with_trailing_line(d).count() == len(want) + bool(want and want[-1][-1] in "\r\n")
        both = trace_text.read_lines_with_ends(spark, str(tmp_path / "f*.txt")).orderBy("line").collect()
        assert "".join(x["text"] + x["terminator"] for x in both) == "".join(contents)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbfa\nb")
    assert [x["terminator"] for x in trace_text.read_lines_with_ends(spark, str(tmp_path / "mark.txt")).orderBy("line").collect()] == ["\n", ""]


def test_records_by_ranges(spark, tmp_path):
    values = [(-i, i * (1 << 40)) for i in range(50)]
    (tmp_path / "a.bin").write_bytes(b"head" + b"".join(struct.pack("<iq", *v) for v in values) + b"rest")
    (tmp_path / "b.bin").write_bytes(b"he")
    d = records.fixed_records(spark, str(tmp_path / "*.bin"), 4, [("x", 4), ("y", 8)], range_bytes=100)
    assert d.rdd.getNumPartitions() == 7
    assert sorted((r["row"], r["x"], r["y"]) for r in d.collect()) == [(i, *v) for i, v in enumerate(values)]
    assert records.fixed_records(spark, str(tmp_path / "none"), 0, [("x", 4)]).count() == 0


def test_memory_contexts_point_into_the_data(spark, tmp_path):
    (tmp_path / "data").write_bytes(bytes(range(200)))
    rows = [(0x1000, 4, 10), (0x2000, 0, 0), (0x3000, 8, 195), (0x4000, 2, -1), (0x5000, 3, 197)]
    (tmp_path / "c.itable").write_bytes(struct.pack("<iiqqq", 1, 1, 5, 24, 32) + b"".join(struct.pack("<qqq", *r) for r in rows))
    got = files.memory_contexts(spark, str(tmp_path / "c.itable"), str(tmp_path / "data")).orderBy("row").collect()
    assert [None if r["data"] is None else bytes(r["data"]) for r in got] == [bytes([10, 11, 12, 13]), b"", None, None, bytes([197, 198, 199])]
    assert [(r["address"], r["size"], r["data_fp"]) for r in got] == rows
    with pytest.raises(FileNotFoundError):
        files.memory_contexts(spark, str(tmp_path / "c.itable"), str(tmp_path / "nothing"))


def events_of(lines):
    """As the traced tool tells them by text, line by line."""
    held, last, out = None, None, []
    for i, t in enumerate(lines):
        m = re.match(r"^[0-9a-fA-F]+\s([0-9a-fA-F]+)\s\{", t)
        new = m and m.group(1)
        kind, tid = None, new
        for mark, k in (("} ThreadBegin ", 0), ("} ThreadEnd ", 1), ("} ApplicationEnd ", 4)):
            if kind is None and mark in t:
                kind = k
        if kind is None and new and (new != held or last == 0):
            kind = 3
        if kind is None and t and (t[0] in "TS" or t[t.find(" ") + 1 :][:1] in ("T", "S")):
            kind = 0 if re.search(".+ThreadBegin", t) else 1 if re.search(".+ThreadEnd", t) else 2 if "switch" in t else None
        if kind == 0 and (m := re.search(r"(?:^|\s)TID=(\S+)", t)):
            tid = m.group(1)
        if kind == 2 and (m := re.match(r"^[^:]*:(.*?).switch", t)):
            tid = m.group(1).strip()
        if kind is not None:
            out.append([i, tid or held, kind])
            last = kind
        held = tid or held
    ends = [e[0] for e in out[1:]] + [len(lines)]
    return [(i, tid, kind, e - i, i - out[0][0]) for (i, tid, kind), e in zip(out, ends)]


GOLDEN = ["0 01 {64 OFF} ThreadBegin | TIB=07", "1 01 {64 OFF} mov | RAX=1", "2 01 {64 OFF} mov |", "3 02 {64 OFF} ThreadBegin |", "4 02 {64 OFF} nop |", "5 01 {64 OFF} nop |", "6 I:1 a.dll+1 nop |", "7 01 {64 OFF} ThreadEnd | Code=0", "8 01 {64 OFF} nop |", "9 02 {64 OFF} ApplicationEnd | Code=0"]
OLD = ["0 S:ThreadBegin TID=4420 ", "A I:1F kernel32.dll+2A10 call |", "1F T: 4421 switch | |", "20 I:22 nop |", "21 S:ThreadEnd TID=4421 Code=0", "22 S:SyscallEntry 3 (x)|"]


@pytest.mark.parametrize("bucket", [1 << 20, 7])
def test_thread_events(spark, monkeypatch, bucket):
    monkeypatch.setattr(ordered, "BUCKET", bucket)
    run = lambda lines: sorted(map(tuple, trace_text.thread_events(spark.createDataFrame(list(enumerate(lines)), "line long, text string")).collect()))
    assert run(GOLDEN) == events_of(GOLDEN) == [(0, "01", 0, 1, 0), (1, "01", 3, 2, 1), (3, "02", 0, 1, 3), (4, "02", 3, 1, 4), (5, "01", 3, 2, 5), (7, "01", 1, 2, 7), (9, "02", 4, 1, 9)]
    assert run(OLD) == events_of(OLD) == [(0, "4420", 0, 2, 0), (2, "4421", 2, 2, 2), (4, "4421", 1, 2, 4)]
    assert run(["no event"]) == [] and run([]) == []
    r = random.Random(bucket)
    for _ in range(2):
        lines = [r.choice([f"{i:X} {r.randrange(1, 3):02} {{64 OFF}} {r.choice(['ThreadBegin |', 'ThreadEnd |', 'ApplicationEnd |', 'mov |', 'mov |', 'mov |'])}", f"{i:X} I:1 a.dll nop |", *OLD]) for i in range(80)]
        assert run(lines) == events_of(lines)


def test_names_of_functions_from_files(spark, tmp_path):
    """Exports and descriptors read from files lead to the trace's functions."""
    from tracewright.operators import names

    (tmp_path / "c.json").write_text('[{"method": "pipe", "functions": [{"name": "WriteFile", "type": "send"}, {"name": "Gone", "type": "open"}]}, {"method": "queue", "functions": [{"name": "Read", "type": "receive"}]}]')
    exports = spark.createDataFrame([("LIB.DLL", 16, "WriteFile"), ("LIB.DLL", 16, "Alias"), ("LIB.DLL", 32, "Read"), ("OTHER.DLL", 8, "Read"), ("OTHER.DLL", 8, "Read")], "module string, rva long, name string")
    functions = spark.createDataFrame([("lib.dll", 16, "0:16"), ("lib.dll", 32, "0:32"), ("other.dll", 8, "1:8"), ("lib.dll", 8, "0:8")], "module string, offset long, instruction_id string")
    assert [(r["instruction_id"], r["name"]) for r in names.named_functions(functions, exports).collect()] == [("0:16", "Alias"), ("0:32", "Read"), ("1:8", "Read"), ("0:8", None)]
    d = names.described_functions(files.channel_descriptors(spark, str(tmp_path / "c.json")), exports, functions)
    assert sorted((r["method"], r["name"], r["type"], r["instruction_id"]) for r in d.collect()) == [("pipe", "WriteFile", "send", "0:16"), ("queue", "Read", "receive", "0:32"), ("queue", "Read", "receive", "1:8")]
