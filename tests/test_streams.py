"""Streams of handles and unions of intervals against plain Python, in one bucket and in many."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.operators import channels as ch
from tracewright.operators import intervals as iv
from tracewright.operators import ordered


@pytest.fixture(params=[1 << 20, 7], ids=["one bucket", "many buckets"], autouse=True)
def buckets(request, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", request.param)


def frame(spark, rows):
    return spark.createDataFrame(rows, "trace string, handle string, line long, type string")


def of_data(events):
    """As the traced tool does it: all opens, then all closes, then all data, over a list of streams."""
    streams = [[t, h, line, 0] for t, h, line, kind in sorted(events, key=lambda e: e[2]) if kind == "open"]
    for t, h, line, kind in sorted(events, key=lambda e: e[2]):
        if kind == "close":
            found = None
            for s in streams:
                if (s[0], s[1]) == (t, h) and s[2] < line and (found is None or found[2] < s[2]):
                    found = s
            if found:
                found[3] = line
    out = {}
    for t, h, line, kind in events:
        if kind == "send":
            for s in streams:
                if (s[0], s[1]) == (t, h) and s[2] < line and (s[3] == 0 or s[3] > line):
                    out[t, h, line] = s[2]
    return out


def got(spark, events):
    return {(r["trace"], r["handle"], r["line"]): r["open_line"] for r in ch.assigned(frame(spark, events)).collect()}


def case(*events):
    return [("a", "h", line, kind) for line, kind in events]


def test_a_stream_that_never_ends_takes_the_data(spark):
    """The close ends the stream of line 5 only; what comes behind belongs to that of line 1."""
    events = case((1, "open"), (5, "open"), (8, "close"), (10, "send"))
    assert got(spark, events) == {("a", "h", 10): 1} == of_data(events)


def test_a_later_close_moves_the_end(spark):
    events = case((1, "open"), (4, "close"), (5, "send"), (9, "close"), (10, "send"))
    assert got(spark, events) == {("a", "h", 5): 1} == of_data(events)
    ends = ch.ended_opens(frame(spark, events)).collect()
    assert [(r["open_line"], r["end_line"]) for r in ends] == [(1, 9)]


@pytest.mark.parametrize("seed", range(4))
def test_random_streams(spark, seed):
    r = random.Random(seed)
    events = [(r.choice("ab"), r.choice(["x", "y", None]), line, r.choice(["open", "close", "send", "send", "open" if seed % 2 else "close"])) for line in range(240)]
    # an open, a close and a send on one line
    events += [("a", "x", line, kind) for line in (300, 310, 311) for kind in ("open", "close", "send")]
    assert got(spark, events) == of_data(events)
    latest = {(x["trace"], x["handle"], x["close_line"]): x["open_line"] for x in ch.latest_opens(frame(spark, events)).collect()}
    for t, h, line, kind in events:
        if kind == "close":
            assert latest[t, h, line] == max((o for a, b, o, k in events if k == "open" and (a, b) == (t, h) and o < line), default=None)


def test_streams_that_opens_and_closes_bound(spark):
    events = case((1, "send"), (2, "open"), (3, "open"), (4, "send"), (5, "close"), (6, "send"), (7, "close"), (8, "open"), (9, "send"))
    s = ch.streams(frame(spark, events).withColumn("channel_id", F.lit("c"))).collect()
    assert sorted((x["open_line"], x["close_line"], x["closed"]) for x in s) == [(2, 5, True), (8, None, False)]
    assert sorted((x["line"], x["open_line"]) for x in ch.stream_events(frame(spark, events)).collect()) == [(4, 2), (9, 8)]


def test_results(spark):
    d = spark.createDataFrame([("send", "0000000100000000"), ("send", "0000000000000001"), ("send", None), ("open", None)], "type string, result string")
    assert sorted(map(tuple, ch.successful(d).collect()), key=str) == [("open", None), ("send", "0000000000000001")]


def test_sockets(spark):
    rows = [("a", "s", 1, "socket", None, None), ("a", "s", 3, "accept", None, "c0"), ("a", "s", 4, "bind", "p1", None), ("a", "s", 5, "bind", "p2", None), ("a", "s", 20, "accept", None, "c1"), ("a", "t", 9, "socket", None, None), ("a", "t", 30, "socket", None, None), ("a", "t", 41, "connect", "p3", None)]
    d = spark.createDataFrame(rows, "trace string, handle string, line long, type string, address string, child string")
    assert sorted((r["handle"], r["open_line"], r["channel_id"]) for r in ch.socket_streams(d).collect()) == [("c0", 3, None), ("c1", 20, "p1"), ("s", 1, "p1"), ("t", 9, None), ("t", 30, "p3")]


@pytest.mark.parametrize("touching", [True, False])
def test_unions(spark, touching):
    r = random.Random(3)
    rows = [(r.choice([0, 1, None]), s, s + r.choice([0, 1, 5, 40])) for s in (r.randrange(400) for _ in range(150))]
    want = set()
    of = defaultdict(list)
    for g, s, e in rows:
        of[g].append((s, e))
    for g, spans in of.items():
        spans.sort()
        low, high = spans[0]
        for s, e in spans[1:]:
            if s > high + touching:
                want.add((g, low, high))
                low, high = s, e
            high = max(high, e)
        want.add((g, low, high))
    d = spark.createDataFrame(rows, "g int, s long, e long")
    assert set(map(tuple, iv.merged(d, ["g"], touching).select("g", "s", "e").collect())) == want
    whole = {(s, e) for s, e in ((x["s"], x["e"]) for x in iv.merged(d, []).collect())}
    days = {x for _, s, e in rows for x in range(s, e + 1)}
    assert {x for s, e in whole for x in range(s, e + 1)} == days and all(s - 1 not in days and e + 1 not in days for s, e in whole)


def test_gaps_and_pages(spark):
    hidden = spark.createDataFrame([(3, 5), (5, 9), (10, 12), (20, 30), (28, 29), (60, 90)], "s long, e long")
    unseen = {*range(3, 13), *range(20, 31), *range(60, 91)}
    assert sorted(map(tuple, iv.gaps(hidden, 4, 70).collect())) == [(13, 19), (31, 59)]
    assert sorted(map(tuple, iv.gaps(hidden, 0, 100).collect())) == [(0, 2), (13, 19), (31, 59), (91, 100)]
    assert iv.gaps(hidden, 62, 80).collect() == [] and list(map(tuple, iv.gaps(hidden.where("false"), 2, 4).collect())) == [(2, 4)]
    seen = [x for x in range(101) if x not in unseen]
    for line in (0, 15, 25, 59, 100):
        assert sorted(r["line"] for r in iv.page(hidden, line, 100, 10).collect()) == [x for x in seen if x < line][-10:]
        assert sorted(r["line"] for r in iv.page(hidden, line, 100, 10, left=False).collect()) == [x for x in seen if x > line][:10]
    assert iv.visible_count(hidden, 1, 35).first()["lines"] == sum(1 <= x <= 35 for x in seen)


def test_places_of_lines(spark):
    hidden = spark.createDataFrame([(-4, 2), (7, 9), (9, 12), (13, 13), (50, 60)], "s long, e long")
    unseen = {*range(0, 3), *range(7, 14), *range(50, 61)}
    seen = [x for x in range(71) if x not in unseen]
    lines = spark.range(71).selectExpr("id AS line", "id * 2 AS shown2")
    got = iv.shown_positions(lines, hidden).collect()
    assert {r["line"]: r["shown"] for r in got} == {x: seen.index(x) if x in seen else None for x in range(71)} and all(r["shown2"] == 2 * r["line"] for r in got)
    back = iv.lines_shown_at(spark.range(80).selectExpr("id AS shown"), hidden, 70).collect()
    assert {r["shown"]: r["line"] for r in back} == dict(enumerate(seen))
    assert {r["shown"] for r in iv.shown_positions(lines, hidden.where("false")).collect()} == set(range(71))


def test_totals_beside_wide_rows(spark):
    """Texts pass through no window: a bucket of lines would bring all of theirs to one task."""
    rows = [(k * 3, None if k % 7 == 0 else "x" * (k % 5)) for k in range(40)]
    d = ordered.running_total(spark.createDataFrame(rows, "line long, text string"), "line", F.length("text"), "at", wide=True)
    assert sorted(map(tuple, d.select("line", "text", "at").collect()), key=lambda x: x[0]) == [(n, t, sum(len(x or "") for m, x in rows if m < n)) for n, t in rows]
    for line in d._jdf.queryExecution().optimizedPlan().toString().split("\n"):
        assert "Window" not in line or "text#" not in line


def test_stored_lines_and_hits_keep_texts_out_of_windows(spark):
    from tracewright.plans import lookup_queries as lookup

    for query in (lookup.line_sink, lookup.search_plain):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()
        windows = plan.toString().split("Window [")[1:]
        below = [next(x for x in w.split("\n")[1:] if "Project [" in x) for w in windows]
        assert windows and all("text#" not in x.split("AS _v0")[0].replace("length(text#", "") for x in below)
