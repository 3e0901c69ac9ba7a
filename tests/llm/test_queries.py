"""The registered queries on the smallest tables: DuckDB's rows where there is SQL, else what the contract fixes."""

import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tracewright.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text FROM documents").fetchall()


def shown(x):
    if x is None or x != x:
        return "null"
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, duck):
    out = queries.QUERIES[name](spark, SF)
    names = sorted(out.columns)
    cur = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert sorted(tuple(map(shown, r)) for r in out.select(*names).collect()) == sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())


def test_op1(spark, documents):
    out = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, SF).collect()}
    assert len(out) == len(documents) and all(not r["kept"] for r in out.values() if r["base_failed"])
    for i, t in documents:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (out[i]["n_words"], out[i]["word_chars"]) == (len(w), sum(map(len, w)))


def test_op2(spark, documents):
    import hashlib

    out = {r["doc_id"]: r for r in queries.op2_byte_bpe(spark, SF).collect()}
    assert len(out) == len(documents)
    assert all(out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in documents)


def test_op3(spark, documents):
    out = queries.op3_hilbert_shards(spark, SF).collect()
    texts = dict(documents)
    slots = defaultdict(list)
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(r["doc_id"] for r in out) == sorted(texts) and sorted(slots) == list(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op4(spark, documents):
    out = {r["doc_id"]: r for r in queries.op4_toxicity(spark, SF).collect()}
    assert set(out) == {i for i, _ in documents}
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_op6(spark, documents):
    out = {r["doc_id"]: r for r in queries.op6_line_dedup(spark, SF).collect()}
    assert set(out) == {i for i, _ in documents}
    assert all((r["n_removed"] == 0) == (r["left_crc32"] == zlib.crc32((dict(documents)[i] or "").encode())) for i, r in out.items())


def test_op9(spark, documents):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = queries.op9_harmonic_packing(spark, SF).collect()
    of, places = defaultdict(list), defaultdict(list)
    for r in out:
        of[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(of) == {i for i, _ in documents}
    for i, text in documents:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(of[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for v in places.values():
        ends = Counter()
        for o, n in sorted(v):
            assert o == ends["at"]
            ends["at"] += n
        assert ends["at"] <= 4096


def test_op13(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = dict(zip([i for i, _ in documents], [len(e.ids) for e in t.encode_batch([x or "" for _, x in documents], add_special_tokens=False)], strict=True))
    out = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op13_token_counts(spark, SF).collect()}
    assert out == {i: (len((x or "").encode()), n[i], n[i] > 2048) for i, x in documents}
