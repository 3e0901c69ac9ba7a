"""Messages that begin others, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import channels as ch


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("aé") for _ in range(r.choice([0, 1, 2, 3, 4, 7, 8, 9, 15, 16, 17]))) for _ in range(n)]


def test_pairs_are_those_of_plain_python(spark):
    sends = [(i % 2, i, t) for i, t in enumerate(texts(1, 90) + [None])]
    receives = [(i % 2, i, t) for i, t in enumerate(texts(2, 90) + [None])]
    s = spark.createDataFrame(sends, "channel_id long, s long, sent string")
    r = spark.createDataFrame(receives, "channel_id long, r long, recv string")
    got = ch.prefix_pairs(s, r).select("s", "r").collect()
    want = sorted((i, j) for c, i, a in sends for d, j, b in receives if c == d and a is not None and b is not None and b.startswith(a))
    assert sorted(map(tuple, got)) == want


def test_a_message_is_cut_at_lengths_that_may_begin_it_only(spark):
    """Messages of other beginnings have lengths of their own, which once were tried on every message of the channel."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in range(100, 400)]
    d = spark.createDataFrame([(1, w) for w in words], "channel_id long, sent string")
    tried = ch.may_begin(d, d.withColumnRenamed("sent", "recv"))
    assert tried.count() == len(words) and tried.where(F.col("_n") != F.length("recv")).isEmpty()


def begun(a, b):
    """Every message that was sent begins a received one."""
    return all(any(r.startswith(s) for r in b) for s in a)


def counted(a, b):
    return all(b.count(m) <= a.count(m) for m in b)


def piped(a, b):
    return "".join(a).startswith("".join(b))


@pytest.mark.parametrize("check,holds", [(ch.verify_prefixes, begun), (ch.verify_counts, counted), (ch.verify_bytes, piped)], ids=["prefixes", "counts", "bytes"])
def test_all_pairs_of_streams(spark, monkeypatch, check, holds):
    """Streams without messages too, and more of them than meet in one row."""
    monkeypatch.setattr(ch, "TOGETHER", 3, raising=False)
    r = random.Random(4)
    some = lambda: [r.choice(["", "a", "ab", "é", "b"]) for _ in range(r.choice([0, 0, 1, 2, 3]))]
    rows = [(i % 2, i, k, some(), some()) for i in range(40) for k in (0, 5)]
    d = spark.createDataFrame(rows, "channel_id long, handle long, open_line long, sends array<string>, receives array<string>")
    left, right = d.where("handle < 20"), d.where("handle >= 20")
    got = check(left, right)
    want = {(a[1], a[2], b[1], b[2]): holds(a[3], b[4]) and holds(b[3], a[4]) for a in rows for b in rows if a[1] < 20 <= b[1] and a[0] == b[0]}
    assert 0 < sum(want.values()) < len(want)
    found = got.select("handle_1", "open_line_1", "handle_2", "open_line_2", "ok").collect()
    assert len(found) == len(want) and {tuple(x[:4]): x["ok"] for x in found} == want
    # rows of pairs are made last: they pass through no join, sort or shuffle
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan and "Join" not in plan[: plan.index("posexplode")]


def test_messages_of_one_name_use_the_same_step(spark, monkeypatch):
    tried = []
    step = ch.may_begin
    monkeypatch.setattr(ch, "may_begin", lambda s, r: tried.append(step(s, r)) or tried[-1])
    d = spark.createDataFrame([(k, k, "c", "abcdefgh"[k:] * 3 + "z" * k) for k in range(8)] + [(9, 9, "c", "ab"), (10, 10, "d", "abcdefgh")], "id long, line long, channel_name string, message string")
    rows = [tuple(r) for r in d.collect()]
    got = ch.message_matches(d, d).select("channel_name", "send_id", "recv_id").collect()
    assert sorted(map(tuple, got)) == sorted((a[2], a[0], b[0]) for a in rows for b in rows if a[2] == b[2] and b[3].startswith(a[3]))
    assert tried[0].count() == len(got)
