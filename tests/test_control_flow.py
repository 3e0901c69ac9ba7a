"""The window formulations against state machines in plain Python, on random traces."""

import random

import pytest

from tracewright.operators import control_flow as flow
from tracewright.operators import ordered
from tracewright.operators.ordered import carried_after, carried_before, running_total, runs


@pytest.fixture(params=[1 << 20, 7], ids=["one bucket", "many buckets"])
def buckets(request, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET", request.param)


def trace(seed, threads=6, n=150):
    r = random.Random(seed)
    rows, line = [], 0
    for _ in range(n * threads):
        k = r.randrange(20)
        rows.append((line, r.randrange(threads), f"m{k % 3}.dll", r.choice(["call", "ret", "mov", "jz", "mov"]), k, f"0:{k}", r.randrange(4096)))
        line += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "line long, thread int, module string, mnemonic string, offset long, instruction_id string, flags long")


def owners(rows):
    stacks, prev, out = {}, {}, {}
    for line, th, _, m, *_ in rows:
        if th not in stacks:
            stacks[th] = [line]
        elif prev[th] == "call":
            stacks[th].append(line)
        elif prev[th] == "ret":
            stacks[th].pop()
            if not stacks[th]:
                stacks[th].append(line)
        out[line] = stacks[th][-1]
        prev[th] = m
    return out


def calls(rows):
    """As the traced tool does it: stack per thread, last function start carried on."""
    stack, start, prev, out = {}, {}, {}, {}
    for line, th, _, m, _, iid, _ in rows:
        if th not in stack:
            stack[th], start[th] = [], line
        else:
            pm, pid = prev[th]
            if pm == "call":
                if stack[th]:
                    out.setdefault(pid, (start[th], line))
                    start[th] = line
                stack[th].append(line)
            elif pm == "ret" and stack[th]:
                start[th] = stack[th].pop()
        prev[th] = (m, iid)
    return out


@pytest.mark.parametrize("seed,threads", [(1, 6), (2, 1)])
def test_function_owner(spark, seed, threads, buckets):
    rows = trace(seed, threads)
    got = {r["line"]: r["owner_line"] for r in flow.function_owner(frame(spark, rows)).collect()}
    assert got == owners(rows)


@pytest.mark.parametrize("seed,threads", [(3, 6), (4, 1)])
def test_block_widths_sum_to_thread_lengths(spark, seed, threads, buckets):
    f = frame(spark, trace(seed, threads))
    widths = {r[0]: r[1] for r in flow.thread_function_blocks(f).groupBy("thread").sum("width").collect()}
    assert widths == {r["thread"]: r["length"] for r in flow.thread_lengths(f).collect()}


@pytest.mark.parametrize("seed,threads", [(5, 6), (6, 1)])
def test_basic_blocks(spark, seed, threads, buckets):
    rows = trace(seed, threads)
    expected, open_ = {}, {}
    done = []
    for line, th, _, m, _, iid, _ in rows:
        b = open_.setdefault(th, [line, iid, iid, 0])
        b[2], b[3] = iid, b[3] + 1
        if m in ("call", "ret") or m.startswith("j"):
            done.append(open_.pop(th))
    done += open_.values()
    for line, s, e, n in sorted(done):
        expected.setdefault(s, (line, e, n))
    got = {r["start_instruction"]: (r["first_line"], r["end_instruction"], r["length"]) for r in flow.basic_blocks(frame(spark, rows)).collect()}
    assert got == expected


@pytest.mark.parametrize("threads", [6, 1])
def test_call_associations(spark, threads, buckets):
    rows = trace(7, threads)
    by_line = {r[0]: r[5] for r in rows}
    got = {r["call_instruction"]: (r["caller"], r["callee"]) for r in flow.call_associations(frame(spark, rows)).collect()}
    assert got == {k: (by_line[a], by_line[b]) for k, (a, b) in calls(rows).items()}


@pytest.mark.parametrize("bucket", [3, 7, 1000])
def test_ordered_helpers_do_not_depend_on_buckets(spark, bucket):
    r = random.Random(bucket)
    rows = [(i, r.choice(["a", "b", None]), r.randrange(5)) for i in range(40)]
    d = spark.createDataFrame(rows, "line long, k string, v long")
    total, expected = 0, {}
    for i, _, v in rows:
        expected[i] = total
        total += v
    assert {x["line"]: x["t"] for x in running_total(d, "line", d["v"], "t", bucket).collect()} == expected
    last, before = None, {}
    for i, k, _ in rows:
        before[i] = last
        last = k if k is not None else last
    assert {x["line"]: x["c"] for x in carried_before(d, "line", d["k"], "c", bucket).collect()} == before
    islands, current = [], object()
    key = None
    for i, k, _ in rows:
        key = k if k is not None else key
        if not islands or key != current:
            islands.append([key, i, 0])
            current = key
        islands[-1][2] += 1
    got = sorted((x["start"], x["key"], x["rows"]) for x in runs(d, "line", "k", bucket).collect())
    assert sum(x[2] for x in got) == 40
    assert [g for g in got if g[1] is not None] == [(s, k, n) for k, s, n in islands if k is not None]


def test_empty_trace(spark):
    f = frame(spark, [])
    assert flow.thread_function_blocks(f).count() == 0
    assert flow.basic_blocks(f).count() == 0
    assert runs(f, "line", "module").count() == 0


def test_reachable_leaves_no_node_out_silently(spark):
    from tracewright.operators.graph import reachable

    edges, start = spark.createDataFrame([(i, i + 1) for i in range(6)], "a long, b long"), spark.createDataFrame([(0,)], "node long")
    assert reachable(edges, start).count() == reachable(edges, start, max_rounds=6).count() == 7
    with pytest.raises(RuntimeError):
        reachable(edges, start, max_rounds=5)


@pytest.mark.parametrize("bucket", [1 << 20, 7])
def test_carried_within_groups(spark, bucket):
    """One group over many buckets, a null group, and rows without a value."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [(i, r.choice([0, 0, 0, 0, 1, None]), r.choice([None, None, i])) for i in range(300)]
    d = spark.createDataFrame(rows, "line long, thread int, v long")
    back = {x["line"]: x["x"] for x in carried_before(d, "line", F.col("v"), "x", bucket, ("thread",)).collect()}
    on = {x["line"]: x["x"] for x in carried_after(d, "line", F.col("v"), "x", bucket, ("thread",)).collect()}
    assert len(back) == len(on) == 300
    for i, t, _ in rows:
        same = [v for j, u, v in rows if u == t and v is not None]
        assert back[i] == max((v for v in same if v < i), default=None) and on[i] == min((v for v in same if v > i), default=None)
