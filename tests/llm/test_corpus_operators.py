"""Sharding, line dedup, near-dedup, cover tree, packing and the pipeline against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import components, cover_tree, harmonic_packing, hilbert_shards, line_dedup, minhash_dedup

tokenizers_there = pytest.importorskip("public_tokenizers")


def joined(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, r.randrange(101, 160)) for _ in range(40)] + [(7, 7), (200, 201), (200, 201)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    nodes = {x for p in links for x in p}
    assert got == joined(nodes, links)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("bits,dims", [(3, 2), (2, 3)])
def test_hilbert_index_is_a_walk(bits, dims):
    n = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(n)] * dims), axis=-1).reshape(-1, dims)
    index = hilbert_shards.hilbert_index(grid, bits)
    assert sorted(index.tolist()) == list(range(n**dims))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("subcell", [20_000, 3])
def test_shards(docs, texts, subcell, monkeypatch):
    monkeypatch.setattr(hilbert_shards, "SUBCELL_ROWS", subcell)
    dims = {"n": F.col("n_chars"), "s": F.col("source"), "l": F.col("lang")}
    out = hilbert_shards.shards(docs.withColumn("slot", F.lit("x")), 8, dims, ["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(v) for v in slots.values()]
    assert len(slots) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    spans = {s: (min(r["cell"] for r in out if r["shard"] == s), max(r["cell"] for r in out if r["shard"] == s)) for s in slots}
    assert all(spans[s][1] <= spans[s + 1][0] for s in range(7))


def test_levels_of_whole_strings(spark):
    """Strings that share a long beginning still make levels of about equal size; a hot one keeps to itself."""
    rows = [(i, "https://www.example.org/collection/" + ("hot" if i % 3 == 0 else f"part-{i % 64:02}")) for i in range(1200)] + [(2000 + i, None) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    cuts = sorted(hilbert_shards.text_cuts(d, "source", 16))
    assert 9 <= len(cuts) <= 16
    sizes = Counter(sum(s is not None and s > c for c in cuts) for _, s in rows)
    assert max(v for k, v in sizes.items() if k) <= 420 and sorted(sizes.values())[-2] <= 1200 / 16 + 64
    out = hilbert_shards.shards(d, 8, {"s": F.col("source")}, ["doc_id"]).collect()
    assert Counter(r["shard"] for r in out).most_common()[-1][1] == 1205 // 8
    assert hilbert_shards.text_cuts(d.where("source is null"), "source", 16) == []


def test_shards_of_little(docs, nothing):
    dims = {"n": F.col("n_chars")}
    assert hilbert_shards.shards(nothing, 8, dims, ["doc_id"]).count() == 0
    assert sorted(r["shard"] for r in hilbert_shards.shards(docs.where("doc_id < 3"), 8, dims, ["doc_id"]).collect()) == [0, 1, 2]


def test_line_dedup(docs, texts):
    out = {r["doc_id"]: r for r in line_dedup.without_repeats(docs.withColumn("n_lines", F.lit("x"))).collect()}
    assert len(out) == len(texts)
    assert out[30]["text"] == out[31]["text"] == "" and out[3]["text"] == texts[3]
    assert out[34]["text"].strip() == "" and out[35]["text"].split() == "Start here. End there.".split()
    changed = out[32]["text"]
    assert "changed" in changed and len(changed.split()) < len(texts[4].split()) / 2
    assert out[36]["text"] is None and out[37]["text"] == "" and out[39]["text"] == out[40]["text"] == "one two three"
    for i in (0, 1, 2, 7, 41, 42, 44):
        assert out[i]["text"] == texts[i] and out[i]["removed_lines"] is None
    assert out[35]["source"] is None and out[34]["score"] == "mine"


def test_every_repeated_run_goes(docs, texts):
    """No run of lines of MIN_WORDS words that an earlier document has stays in a later one."""
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs).collect()}
    seen = {}
    for i in sorted(out):
        h, w = line_dedup.digests(out[i])
        for _, _, key in line_dedup.runs(h, w, line_dedup.MIN_WORDS):
            assert seen.setdefault(key, i) == i


@pytest.mark.parametrize("holders", [2000, 2])
def test_no_more_goes_than_earlier_documents_have(spark, holders, monkeypatch):
    """Deleted lines lie in blocks of MIN_WORDS words or more that some earlier document holds line by line; all ways of alignment tried."""
    monkeypatch.setattr(line_dedup, "HOLDER_PAIRS", holders)
    r = random.Random(21)
    pool = [" ".join(r.choice("alpha beta gamma delta river stone lamp".split()) + str(r.randrange(60)) for _ in range(r.choice([3, 6, 9, 16]))) + "." for _ in range(30)]
    texts = {}
    for i in range(40):
        body = []
        for _ in range(r.randrange(1, 5)):
            at = r.randrange(30)
            body += pool[at : at + r.randrange(1, 6)] + [f"own line {i} {r.randrange(10**6)}."]
        texts[i] = "\n".join(body)
    rows = [*texts.items(), (7, texts[3]), (50, None), (51, "\n\n")]
    out = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len(out) == len(rows)
    cut = {i: [x.strip() for x in line_dedup.lines_of(t)] for i, t in texts.items()}
    for x in out:
        i = x["doc_id"]
        if i not in texts or i == 7:
            continue
        a, may = cut[i], set()
        for k in [*range(i), *([7] if i > 7 else [])]:
            for b in {tuple(cut[k]), *([tuple(cut[3])] if k == 7 else [])}:
                for p in range(len(a)):
                    for q in range(len(b)):
                        if a[p] == b[q] and not (p and q and a[p - 1] == b[q - 1]):
                            n = 0
                            while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                                n += 1
                            if sum(len(y.split()) for y in a[p : p + n]) >= line_dedup.MIN_WORDS:
                                may |= set(range(p, p + n))
        gone = set(x["removed_lines"] or [])
        assert gone <= may and (not may or gone), i
        assert "own line" not in " ".join(a[k] for k in gone)


def patience(later, words, first, least):
    """Lines of `later` in common blocks with `first`, by plain loops: unique common lines in a longest chain, grown both ways, until nothing more goes; then runs that stand elsewhere."""
    gone = set()

    def grown(i, j):
        s = e = 0
        while i - s > 0 and j - s > 0 and i - s - 1 not in gone and later[i - s - 1] == first[j - s - 1]:
            s += 1
        while i + e < len(later) and j + e < len(first) and i + e not in gone and later[i + e] == first[j + e]:
            e += 1
        block = range(i - s, i + e)
        if sum(words[k] for k in block) < least:
            return False
        gone.update(block)
        return True

    while True:
        left = [x for k, x in enumerate(later) if k not in gone]
        once = [(k, first.index(x)) for k, x in enumerate(later) if k not in gone and words[k] and left.count(x) == 1 and first.count(x) == 1]
        best = []  # (length of the longest chain that ends here, place in first, chain)
        for k, j in once:
            length = max([n for n, q, _ in best if q < j], default=0)
            chain = min([(q, c) for n, q, c in best if n == length and q < j], default=(0, []))[1]
            best.append((length + 1, j, [*chain, (k, j)]))
        top = max([n for n, _, _ in best], default=0)
        chain = min([(j, c) for n, j, c in best if n == top], default=(0, []))[1]
        if not [1 for k, j in chain if k not in gone and grown(k, j)]:
            break

    def run(lines, w, k):
        total = 0
        for e in range(k, len(lines)):
            total += w(lines[e])
            if total >= least:
                return tuple(lines[k : e + 1])

    of = dict(zip(later, words))
    for k in range(len(later)):
        mine = run(later, of.get, k) if words[k] else None
        there = [j for j in range(len(first)) if mine and tuple(first[j : j + len(mine)]) == mine]
        if there and k not in gone:
            grown(k, there[0])
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_lines_are_those_of_plain_patience(spark, seed):
    """Random documents of few lines, moved, repeated and cut, against loops over all earlier documents that hold a run first."""
    r = random.Random(seed)
    pool = [" ".join(f"w{k}x{i}" for i in range(r.choice([1, 2, 5, 9, 16]))) + "." for k in range(24)]
    docs = []
    for i in range(40):
        lines = [r.choice(pool) for _ in range(r.randrange(0, 14))]
        if docs and r.random() < 0.6:
            old = r.choice(docs).split("\n")
            at = r.randrange(len(old))
            lines[r.randrange(len(lines) + 1) : 0] = old[at : at + r.randrange(1, 8)]
        docs.append("\n".join(lines))
    split = [[x.strip() for x in line_dedup.lines_of(t)] for t in docs]
    count = [[len(x.split()) for x in d] for d in split]

    def runs(d, w):
        for k in range(len(d)):
            for e in range(k, len(d)):
                if w[k] and sum(w[k : e + 1]) >= 15:
                    yield tuple(d[k : e + 1])
                    break

    first = {}
    want = {}
    for i, (d, w) in enumerate(zip(split, count)):
        gone = set()
        for j in {first[x] for x in runs(d, w) if x in first}:
            gone |= patience(d, w, split[j], 15)
        for x in runs(d, w):
            first.setdefault(x, i)
        if gone:
            want[i] = sorted(gone)
    out = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert {x["doc_id"]: x["lines"] for x in out.collect()} == want and len(want) > 10


def test_line_dedup_of_nothing(nothing):
    assert line_dedup.without_repeats(nothing).count() == 0


def test_blocks_that_moved():
    r = np.random.default_rng(1)
    h = r.integers(1, 2**60, 12, dtype=np.uint64)
    w = np.full(12, 20)
    later = np.concatenate([h[6:9], h[0:3], h[11:12]])
    assert line_dedup.common_blocks(later, w[:7], np.concatenate([h[:9]])) == [0, 1, 2, 3, 4, 5]


def plain_groups(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for k in s:
            where[k].append(i)
    common = Counter((a, b) for v in where.values() for a in v for b in v if a < b)
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    return {i: len(s) for i, s in sets.items()}, joined(list(texts), links)


def test_minhash(docs, texts):
    n, component = plain_groups(texts)
    out = {r["doc_id"]: r for r in minhash_dedup.groups(docs.withColumn("component_id", F.lit(1))).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in out.items()} == {i: (n[i], component[i], component[i] == i) for i in texts}


@pytest.mark.parametrize("small", [256, 4])
def test_minhash_chain(spark, small, monkeypatch):
    """A chain of near copies whose ends are far apart, and a large group of copies of one base."""
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "FEW", 3 if small == 4 else 512)
    monkeypatch.setattr(minhash_dedup, "MANY", 5 if small == 4 else 2048)
    r = random.Random(3)
    words = [f"w{r.randrange(9999)}" for _ in range(120)]
    texts, now = {}, words[:]
    for i in range(25):
        texts[i] = " ".join(now)
        now = now[:]
        now[r.randrange(120)] = f"x{i}"
    for i in range(100, 140):
        w = words[::-1]
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(120)] = f"y{r.randrange(9999)}"
        texts[i] = " ".join(w)
    n, component = plain_groups(texts)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in minhash_dedup.groups(d).collect()} == component


def test_pairs_near_the_threshold_are_found():
    """Of pairs at similarity 0.75 to 0.85, signatures lose no more than the stated share."""
    r = np.random.default_rng(4)
    fewest, lost, n = minhash_dedup.least_matches(), 0, 1500
    for k in range(n):
        size = int(r.integers(120, 400))
        share = 0.75 + 0.1 * r.random()
        common = int(np.ceil(2 * size * share / (1 + share)))
        both = r.integers(0, 2**63, 2 * size - common, dtype=np.uint64)
        a, b = (minhash_dedup.signature(np.unique(x)) for x in (both[:size], both[size - common :]))
        same = a == b
        banded = same.reshape(-1, minhash_dedup.ROWS).all(axis=1).any()
        lasts = len(minhash_dedup._survivors(a[None], b[None], np.zeros(1, int), np.zeros(1, int), np.zeros(1, int), fewest)[0])
        lost += not (banded and lasts)
    assert lost <= 1


def test_blocks_return_forests():
    """Many likely pairs that are no links, and a few links: one link a pair of components comes back."""
    r = np.random.default_rng(6)
    base = np.unique(r.integers(0, 2**63, 200, dtype=np.uint64))
    sets, component = [], []
    for k in range(60):
        own = r.integers(0, 2**63, 20 if k % 2 else 70, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[: 200 - len(own) // 2], own])))
        component.append(k % 2 if k < 50 else k)
    p, q = np.nonzero(np.ones((60, 60), bool))
    links = minhash_dedup._forest(p, q, np.zeros(len(p), int), component, sets, 75)
    exact = set()
    for a in range(60):
        for b in range(60):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                exact.add((component[a], component[b]))
    assert joined(component, links) == joined(component, exact) and len(links) < 60


def test_minhash_of_odd_ids(spark, texts):
    rows = [(None, texts[3]), (None, None), (1, texts[3]), (1, texts[5]), (2, texts[5]), (3, texts[3])]
    out = minhash_dedup.groups(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"]) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, None)] * 2


def test_minhash_of_nothing(nothing):
    assert minhash_dedup.groups(nothing).count() == 0


def vectors(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + r.normal(size=16) * r.choice([0.02, 0.3])).tolist()) for i in range(150)]
    rows += [(200 + k, rows[5][1]) for k in range(4)] + [(210, [2 * x for x in rows[5][1]])]
    return rows + [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [1.0, None] + [1.0] * 14), (304, []), (305, [1.0, 2.0]), (306, [float("inf")] * 16)]


@pytest.mark.parametrize("seed,block", [(1, 1500), (2, 20)])
def test_cover_tree(spark, seed, block, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = vectors(seed)
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 300}
    ids = list(good)
    cos = np.stack(list(good.values())) @ np.stack(list(good.values())).T
    np.fill_diagonal(cos, -1)
    a, b = np.nonzero(cos >= 0.95)
    component = joined([i for i, _ in rows], [(ids[x], ids[y]) for x, y in zip(a, b, strict=True)])
    n = dict(zip(ids, (cos >= 0.95).sum(axis=1).tolist(), strict=True))
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(0)).withColumn("kept", F.lit("x"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.links(d).collect()}
    assert got == {i: (n.get(i, 0), component[i], component[i] == i) for i, _ in rows}
    assert cover_tree.links(d.where("false")).count() == 0


def test_cuts():
    for n in list(range(1, 300)) + [1365, 2047, 2048, 2049, 4000, 4095, 4096, 4097, 9000, 100_000]:
        parts = harmonic_packing.cuts(n)
        assert sum(parts) == n and min(parts) > 0 and max(parts) <= 4096
        for p in parts:
            k = 4096 // p
            assert 4096 - k * p <= max(0.02 * 4096, 64 + k)


def test_ids_of_any_text():
    """Parts encoded apart give the ids of the whole text, for random strings of all kinds."""
    r = random.Random(8)
    ids = harmonic_packing._Ids(tokenizers_there.path("word_bpe_49k.json"))
    assert ids.apart
    pool = [chr(c) for c in range(32, 0x250)] + [chr(c) for c in range(0x250, 0x3000, 7)] + [chr(c) for c in range(0x3000, 0x2FFFF, 997) if not 0xD800 <= c < 0xE000]
    pool += ["<|endoftext|>", "A<|", "'s", "'ll", "\u0130", "\u0307", "\u0338", "\u03a3", "\u1e9e", "\n", "\t", " ", " . "]
    narrow = "aI\u0130e\u00e9\u00c0,.'!- \n|<s\u0307"
    texts = ["".join(r.choice(pool if k % 2 else narrow) for _ in range(r.randrange(1, 13))) for k in range(100_000)]
    texts += ["\u0130,", "a\u0130!", "", "x" * 5000 + "." * 300, "ab. " * 9000, None]
    wrong = [t for t, got in zip(texts, ids.of_texts(texts), strict=True) if got != ids.whole(t or "")]
    assert not wrong
    other = harmonic_packing._Ids(tokenizers_there.path("byte_bpe_50k.json"))
    assert not other.apart and list(other.of_texts(["a b.\n c"])) == [other.whole("a b.\n c")]


def test_memory_of_two_halves(monkeypatch):
    monkeypatch.setattr(harmonic_packing, "MEMO", 5)
    ids = harmonic_packing._Ids(tokenizers_there.path("word_bpe_49k.json"))
    texts = [f"stone w{i} river {'a' * (i % 9 + 1)}. stone" for i in range(400)]
    assert list(ids.of_texts(texts)) == [ids.whole(t) for t in texts]


def test_little_padding(spark):
    r = random.Random(2)
    rows = [(i, at, n, "mine", 0) for i in range(4000) for at, n in enumerate(harmonic_packing.cuts(int(r.lognormvariate(6, 1.2)) + 1))]
    out = harmonic_packing.pack(spark.createDataFrame(rows, "doc_id long, start long, length long, offset string, sequence_id int")).collect()
    assert len(out) == len(rows)
    used, bins = sum(x["length"] for x in out), {x["sequence_id"] for x in out}
    assert used > 0.97 * 4096 * len(bins)


@pytest.mark.parametrize("group", [10_000, 7])
def test_packing(docs, texts, group, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(harmonic_packing, "GROUP_PIECES", group)
    path = tokenizers_there.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = harmonic_packing.pack(harmonic_packing.tokens(docs, path, 2)).collect()
    of = defaultdict(list)
    for r in out:
        of[r["doc_id"]].append(r)
    assert set(of) == set(texts)
    for i, rows in of.items():
        ids = np.array([*t.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and zlib.crc32(bytes(r["ids"])) == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 4096


def test_packing_of_nothing(nothing):
    assert harmonic_packing.pack(harmonic_packing.tokens(nothing, tokenizers_there.path("word_bpe_49k.json"), 2)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert now and set(now) <= set(before)
        if name != "line dedup":
            assert all(before[i] == t for i, t in now.items())
        if name == "MinHash near-dedup":
            _, component = plain_groups(before)
            assert set(now) == set(component.values())
        before = now
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == set(before)
    assert sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())


def test_stages_of_odd_tables(spark):
    """Nulls, long and repeated rows, clashing names and no rows at all through every stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = docs.orderBy("doc_id").limit(60)
    first = some.where("text is not null").first()
    odd = [
        first.asDict(),
        first.asDict(),
        {**first.asDict(), "doc_id": None},
        {**first.asDict(), "doc_id": 10**6, "text": None, "n_chars": None, "lang": None, "source": None},
        {**first.asDict(), "doc_id": 10**6 + 1, "text": "", "n_chars": 0},
        {**first.asDict(), "doc_id": 10**6 + 2, "text": "stone river lamp " * 20_000, "n_chars": 340_000},
    ]
    table = some.unionByName(spark.createDataFrame([tuple(o[c] for c in docs.columns) for o in odd], docs.schema))
    clashes = {c: F.lit(f"own {c}") for c in ("score", "kept", "predicted", "toxic", "n_words", "n_lines", "removed_lines", "component_id", "_words", "_rest")}
    table = table.withColumns(clashes)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in clashes), name
        assert stage(spark, table.where("false"), sf).count() == 0, name
    assert corpus_pipeline.pack_sequences(spark, table, sf).where("doc_id is null").count() > 0
    assert corpus_pipeline.pack_sequences(spark, table.where("false"), sf).count() == 0
