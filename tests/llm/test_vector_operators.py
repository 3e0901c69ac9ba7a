"""Hard negatives, code compression and token counts against plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import code_compression, hard_negatives, shared, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VECTORS = "vec_id long, embedding array<float>, label int, code string, key string"


@pytest.fixture(scope="module")
def rows():
    """Clustered, equal, tied, null, broken and short vectors; ids twice, null ids and labels."""
    r = random.Random(7)
    # multiples of 1/32, so that equal scores and distances are common
    out = [(i, [float(np.float32(r.randrange(-32, 33) / 32)) for _ in range(8)], r.randrange(3), "x", "y") for i in range(300)]
    hot = out[5][1]
    out += [(1000 + i, hot, 1 if i % 2 else None, "x", "y") for i in range(100)]
    out += [(2000, None, 1, None, None), (2001, [0.5] * 7 + [math.nan], 1, None, None), (2002, [0.5] * 7 + [None], 1, None, None), (2003, [0.5] * 7 + [math.inf], 2, None, None)]
    out += [(2004, [0.5, 0.25], 1, None, None), (2100, [0.5, 0.5], 1, None, None), (2005, [0.5, 0.5], 2, None, None), (2006, [], 0, None, None), (None, [0.125] * 8, 1, None, None), (40, out[40][1], 2, None, None)]
    return out


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(5)


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v):
    return [math.floor(256 * x) for x in v]


def mined(rows, k=5):
    use = [(i, whole(v), n) for i, v, n, *_ in rows if i is not None and n is not None and good(v)]
    out = []
    for a, v, n in use:
        if a % 20:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), i, m) for i, w, m in use if len(w) == len(v) and i != a]
        for p, i, _ in sorted(x for x in score if x[2] == n)[:k]:
            fits = sorted(x for x in score if x[2] != n and 80 * p >= 100 * x[0] >= 100 * p)[:k]
            out += [(a, i, rank + 1, j, -p, -s) for rank, (s, j, _) in enumerate(fits)]
    return sorted(out)


def ran(d, **more):
    use = hard_negatives.usable(d, F.col("vec_id"), F.col("label"), F.col("embedding"))
    return sorted(map(tuple, hard_negatives.mine(use, F.col("id") % 20 == 0, **more).collect()))


def test_hard_negatives(vectors, rows):
    want = mined(rows)
    assert len(want) > 200 and ran(vectors) == want


def test_hard_negatives_in_small_blocks(vectors, rows, monkeypatch):
    """Blocks, groups and tiles of a few anchors give the same rows."""
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 2)
    monkeypatch.setattr(hard_negatives, "TILE", 2)
    assert ran(vectors) == mined(rows)


def test_hard_negatives_of_large_numbers(spark):
    """Products beyond 2^53 are exact too."""
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-(1 << 20), 1 << 20) ), float(r.randrange(9))], i // 4 % 2) for i in range(0, 400, 4)]
    got = ran(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), k_positives=3, k_negatives=3)
    assert got and got == mined(rows, 3)


def test_hard_negatives_of_little(vectors):
    assert ran(vectors.where("false")) == [] and ran(vectors.where("vec_id = 20")) == [] and ran(vectors.where("vec_id % 20 <> 0")) == []
    assert hard_negatives.mine(hard_negatives.usable(vectors.where("false"), F.col("vec_id"), F.col("label"), F.col("embedding")), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def compressed(rows, parts, entries, rounds):
    use = sorted(((i, v, n) for i, v, n, *_ in rows if good(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(use[0][1])
    use = [(i, np.array(whole(v), object).reshape(parts, -1), n) for i, v, n in use if len(v) == size]
    books = [[use[e][1][p] for e in range(min(entries, len(use)))] for p in range(parts)]

    def nearest(p, x):
        return min((int(((x - e) ** 2).sum()), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in use:
                of[nearest(p, v[p])[1]].append(v[p])
            books[p] = [[int(x) // len(of[k]) for x in sum(of[k])] if k in of else e for k, e in enumerate(books[p])]
            books[p] = [np.array(e, object) for e in books[p]]
    at = [[nearest(p, v[p]) for p in range(parts)] for _, v, _ in use]
    total = defaultdict(int)
    for (_, _, n), a in zip(use, at):
        total[n] += sum(d for d, _ in a)
    return sorted(((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), total[n]) for (i, _, n), a in zip(use, at)), key=str), books


@pytest.mark.parametrize("parts,entries,rounds", [(4, 16, 2), (2, 5, 4), (8, 64, 1), (1, 256, 0)])
def test_codes(vectors, rows, parts, entries, rounds):
    want, books = compressed(rows, parts, entries, rounds)
    out, got = code_compression.compress(vectors, parts, entries, rounds)
    assert sorted(map(tuple, out.select("vec_id", "code", "error", "label_error").collect()), key=str) == want
    assert [[list(map(int, e)) for e in part] for part in got.entries] == [[list(map(int, e)) for e in part] for part in books]


def test_codes_of_large_numbers(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randrange(-(1 << 22), 1 << 22)) for _ in range(4)], i % 3) for i in range(60)]
    out, _ = code_compression.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 2, 7, 2)
    assert sorted(map(tuple, out.select("vec_id", "code", "error", "label_error").collect()), key=str) == compressed(rows, 2, 7, 2)[0]


def test_codes_of_little(vectors):
    out, books = code_compression.compress(vectors.where("false"))
    assert out.count() == 0 and out.columns == ["vec_id", "label", "code", "error", "label_error"] and books.entries.size == 0
    assert code_compression.compress(vectors.where("vec_id = 2006"))[0].count() == 0
    out, _ = code_compression.compress(vectors.where("vec_id in (7, 8)"), 4)
    assert sorted(r["code"] for r in out.collect()) == ["00" * 4, "01" * 4]


def test_bounds_rule_out_most():
    """Later rounds look at a part of the distances only, and bounds stay bounds."""
    r = np.random.default_rng(1)
    parts = code_compression.integers(r.normal(size=(2000, 8)) * 0.05 + r.integers(0, 4, size=(2000, 1))).reshape(2000, 2, 4)
    books = code_compression.Codebooks.of(parts[:16].transpose(1, 0, 2), None, np.ones(2))
    codes, upper, lower, _, looked = code_compression.assign(parts, books, None, None, None)
    assert looked == 2000 * 2 * 16
    moved = books.entries + r.integers(-2, 3, size=books.entries.shape)
    books = code_compression.Codebooks.of(moved, books.entries, np.ones(2))
    codes, upper, lower, best, looked = code_compression.assign(parts, books, codes, upper, lower)
    full = np.stack([code_compression.squared(parts, books.entries[None, :, e]) for e in range(16)], 2)
    assert (codes == full.argmin(2)).all() and (best == full.min(2)).all() and looked < 2000 * 2 * 8
    assert (lower <= np.sqrt(full) + 1e-6).all() and (upper >= np.sqrt(best) - 1e-6).all()


@pytest.mark.parametrize("share", [20, 1000000, 1])
def test_joins_of_hot_keys(spark, monkeypatch, share):
    """Hot keys, null ones too, give the rows of a plain join."""
    rows = [(i, None if i % 3 == 0 else i % 50 if i % 3 == 1 else i) for i in range(600)]
    d = spark.createDataFrame(rows, "i long, k long")
    monkeypatch.setattr(shared, "HOT_SHARE", share)
    monkeypatch.setattr(shared, "KEY_PAIRS", 7)
    sums = defaultdict(int)
    for i, k in rows:
        sums[k] += i
    totals = d.groupBy("k").agg(F.count("*").alias("n"), F.sum("i").alias("s"))
    for out in (shared.join_one(d, totals, ["k"], n="n", nulls=True), shared.join_one(d, totals.drop("n"), ["k"], nulls=True)):
        assert out.columns == ["i", "k", "s"] and sorted(map(tuple, out.collect())) == sorted((i, k, sums[k]) for i, k in rows)
    few = totals.where("k % 2 = 0")
    for how in ("inner", "left"):
        got = sorted(map(tuple, shared.join_one(d, few, ["k"], how, "n").collect()))
        assert got == sorted((i, k, sums[k] if k is not None and k % 2 == 0 else None) for i, k in rows if how == "left" or (k is not None and k % 2 == 0))
    spread = shared.spread_join(d, totals.drop("n"), "k", "i")
    assert sorted((r["i"], r["k"], r["s"]) for r in spread.collect()) == sorted((i, k, sums[k]) for i, k in rows if k is not None)


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "aab", "ehlo", " 'streveml'ld!?", "0123 9", "éÀßİıſǅ", "é̀ä́각가", "日本語。、が", "😀👍🏽‍", "​\u0085  \x1c\x1f\t\n ", "Σςσ", "АбвЙй"]


def random_text(r):
    out = []
    for _ in range(r.randrange(0, 12)):
        a = r.choice(ALPHABETS)
        out.append("".join(r.choice(a) for _ in range(r.randrange(1, 20))))
        out.append(r.choice(["<|startoftext|>", "<|endoftext|>", "<|", "'s", "'re", "'LL", " ", "", "", ""]))
    return "".join(out)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))


def lengths(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_the_tokenizers(tokenizer, counter):
    r = random.Random(11)
    texts = [None, "", *(random_text(r) for _ in range(6000))]
    assert list(counter.of_texts(texts)) == lengths(tokenizer, texts)


def test_every_settled_character(tokenizer, counter):
    """Texts that go past the library's normaliser are those that it leaves alone but for the case."""
    texts = [f"x{chr(c)}y" for c in range(0x10000) if not 0xD800 <= c < 0xE000 and token_counts._SETTLED.fullmatch(chr(c))]
    assert len(texts) > 30000 and [counter.settled(t) for t in texts if t[1].strip()] == [tokenizer.normalizer.normalize_str(t) for t in texts if t[1].strip()]
    assert list(counter.of_texts(texts[::7])) == lengths(tokenizer, texts[::7])


@pytest.mark.parametrize("chunk,reach,span,states,few", [(48, 32, 1 << 16, 1 << 16, 32), (5, 3, 64, 40, 4), (2, 1, 7, 5, 0)])
def test_counts_of_long_words(tokenizer, monkeypatch, chunk, reach, span, states, few):
    """Words over many chunks and spans: maps from several states compose to the tokenizer's counts."""
    for name, value in {"CHUNK": chunk, "REACH": reach, "SPAN": span, "STATES": states, "FEW": few}.items():
        monkeypatch.setattr(token_counts, name, value)
    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(chunk)
    n = 60000 if chunk > 40 else 3000
    texts = ["a" * n, "ha" * n, *("".join(r.choice(x) for _ in range(n)) for x in ("ab", "etaoinshr", "日本語", "0a", "x'"))]
    assert list(counter.of_texts(texts)) == lengths(tokenizer, texts)


def test_scan_of_maps():
    """Chunks within a word take the lane that the chunk before leads to; a missing entry is told, and all that hang on it."""
    aligned = np.array([True, False, False, True, False])
    lane_chunk, entries, exits = np.array([0, 3, 1, 1, 2, 4]), np.array([0, 0, 5, 6, 7, 9]), np.array([6, 8, 1, 7, 2, 3])
    assert token_counts.composed(5, aligned, lane_chunk, entries, exits).tolist() == [0, 3, 4, 1, -1]
    assert token_counts.composed(5, aligned, lane_chunk, entries, np.array([4, 9, 1, 7, 2, 3])).tolist() == [0, -1, -1, 1, 5]


def test_count(docs, texts, nothing, tokenizer):
    d = docs.withColumn("n_tokens", F.lit("mine"))
    out = token_counts.count(d, public_tokenizers.path("word_bpe_49k.json"), 100)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "n_bytes", "n_tokens", "over_limit"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"], r["score"]) for r in out.collect()}
    want = lengths(tokenizer, texts.values())
    assert got == {i: (len((t or "").encode()), n, n > 100, "mine") for (i, t), n in zip(texts.items(), want)}
    assert token_counts.count(nothing, public_tokenizers.path("word_bpe_49k.json"), 100).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
