"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from tracewright.plans.catalogue import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def text(x):
    if x is None or x != x:
        return "null"
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


def floats(names):
    """The floats of register_floats, by struct."""
    import struct

    import pyarrow.parquet as pq

    out = []
    for line in pq.read_table(f"{SF}/events.parquet", columns=["event_id"]).column(0).to_pylist():
        data = (line * 7919 + 4607182418800017408).to_bytes(8, "big")
        wide, narrow = struct.unpack(">d", data)[0], struct.unpack(">f", data[:4])[0]
        shown = str(wide)
        row = {"line": line, "f64": wide, "f32": narrow, "shown": shown if len(shown) <= 13 else shown[:10] + "..."}
        out.append(tuple(text(row[n]) for n in names))
    return sorted(out)


#: Plain Python for the queries without SQL.
BRUTE = {"register_floats": floats}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted(tuple(map(text, r)) for r in got.select(*names).collect())
    if name not in ORACLES:
        assert rows == BRUTE[name](names)
        return
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert rows == sorted(tuple(text(r[i]) for i in at) for r in cur.fetchall())
