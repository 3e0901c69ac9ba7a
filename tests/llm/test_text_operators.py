"""Quality rules, BPE, license scans, toxicity and URL filters against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import byte_bpe, license_scans, quality_rules, toxicity, url_filters

tokenizers_there = pytest.importorskip("public_tokenizers")


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, cover = Counter(windows), set()
    for i, k in enumerate(windows):
        if c[k] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)


def test_base_rules(docs, texts):
    out = quality_rules.base_rules(docs.withColumn("n_words", F.lit("clash"))).collect()
    for r in out:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(texts[r["doc_id"]]), r["doc_id"]


def test_ratio_equals_plain_counts(spark, docs, texts):
    labels = spark.createDataFrame([(i, 1 if i < 10 else 0, 0) for i in range(20)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = quality_rules.ratio_table(docs, quality_rules.trusted_ids(labels), buckets=97)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, ratios).collect()}
    assert len(got) == len(texts) and got[36]["score"] == got[37]["score"] == 0.0 and not got[36]["kept"]
    assert got[30]["score"] == got[31]["score"] == got[3]["score"]
    import math

    grams = {}
    rows = docs.select("doc_id", F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\s\p{Punct}]+|\p{Punct}+"), F.lit(0)), lambda t: F.xxhash64(t)).alias("h"))
    rows = rows.select("doc_id", "h", F.transform("h", lambda x, i: F.when(i > 0, F.xxhash64(F.get("h", i - 1), x))).alias("p"))
    for r in rows.collect():
        grams[r["doc_id"]] = [x % 97 for x in r["h"]] + [x % 97 for x in r["p"][1:]]
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i < 10:
            target.update(g)
    a = quality_rules.SMOOTHING
    ratio = lambda b: math.log((target[b] + a) / (sum(target.values()) + 97 * a)) - math.log((raw[b] + a) / (sum(raw.values()) + 97 * a))
    for i, g in grams.items():
        assert got[i]["score"] == pytest.approx(sum(map(ratio, g)) / len(g) if g else 0.0, abs=1e-9)


def test_filters_on_verdicts_stay_above(spark):
    """A filter on a result column works no array out anew: long texts stay quick."""
    words = [f"w{i % 7000}" for i in range(20_000)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:5000]))], "doc_id long, text string")
    assert [r["doc_id"] for r in quality_rules.base_rules(d).where("not base_failed").collect()] == [2]
    assert quality_rules.judge(d, [0.0] * 50).where("kept and n_words > 100").count() == 1
    assert quality_rules.judge(d, [0.1] * 50).where("score > 0.05 and not kept").select("doc_id").collect()[0][0] == 1


def test_quality_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ratios = quality_rules.ratio_table(nothing, quality_rules.trusted_ids(labels))
    assert set(ratios) == {0.0} and quality_rules.judge(nothing, ratios).count() == 0


def test_bpe_is_exact_and_reversible(docs, texts):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = tokenizers_there.path("byte_bpe_multi_50k.tiktoken"), tokenizers_there.PATTERN
    own = byte_bpe.RankBpe.load(path, pattern)
    them = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    out = byte_bpe.decode(byte_bpe.encode(docs.withColumn("ids", F.lit(1)), path, pattern), path, pattern).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == them.encode_ordinary(t) and bytes(r["decoded"]) == t.encode() and r["score"] == "mine"
    for odd in ("a" * 5000, "ab" * 40000, "é" * 999, "\n" * 300, "日本語" * 500, "<|endoftext|>"):
        assert own.ids(odd).tolist() == them.encode_ordinary(odd)


def test_bpe_of_nothing(nothing):
    path, pattern = tokenizers_there.path("byte_bpe_multi_50k.tiktoken"), tokenizers_there.PATTERN
    assert byte_bpe.decode(byte_bpe.encode(nothing, path, pattern), path, pattern).count() == 0


def stretches(low, templates=license_scans.TEMPLATES, share=license_scans.SHARE):
    """(line, label) -> containment: the best stretch that starts in a line with a template's word, by all stretches."""
    words = [(w, k) for k, line in enumerate(low.split("\n")) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line)]
    out = {}
    for label, template in templates.items():
        s = set(template.split())
        width = math.ceil(len(s) / share - 1e-9)
        for i, (w, line) in enumerate(words):
            held = len({x for x, _ in words[i : i + width]} & s) / len(s) if w in s else 0
            if held >= share:
                out[line, label] = max(held, out.get((line, label), 0))
    return out


def test_licenses(docs, texts):
    freq = license_scans.template_frequencies(docs)
    out = {r["doc_id"]: r for r in license_scans.scan(docs, freq).collect()}
    lower = str.maketrans(license_scans.UPPER, license_scans.LOWER)
    for i, t in texts.items():
        low = (t or "").translate(lower)
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at, labels = [], set()
        for phrase, label in license_scans.PHRASES.items():
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        blocks = stretches(low)
        assert {(b["line"], b["label"]): b["containment"] for b in r["blocks"]} == blocks and len(r["blocks"]) == len(blocks)
        assert r["labels"] == ",".join(sorted(labels | {label for _, label in blocks}))
    assert out[43]["n_base"] == 4


def test_wrapped_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal"
    bsd = "# Redistribution and use in source and binary\n# forms, with or without\n#\n# modification, are permitted provided that\n# the following conditions are met:"
    scattered = "\n".join(w + " filler" * 9 for w in license_scans.TEMPLATES["mit-grant"].split())
    far = "all " + "so " * 300 + "rights " + "so " * 300 + "reserved " + "so " * 300
    texts = [mit, "Copyright\n\n" + bsd, mit.replace(" ", "\n"), scattered, mit + "\n" + bsd, mit.replace("\n", " ") + "\nend", "All\nrights reserved"]
    texts += [scattered.replace("\n", " "), far, far.replace("rights ", "rights\n"), "x " * 400 + mit.replace("\n", " ") + " y" * 400, f"{mit}\n{mit}\nall rights reserved all rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scans.scan(docs, license_scans.template_frequencies(docs)).collect()}
    assert [out[i]["labels"] for i in range(len(texts))] == ["mit-grant", "bsd-grant", "mit-grant", "", "bsd-grant,mit-grant", "mit-grant", "rights-reserved", "", "", "", "mit-grant", "mit-grant,rights-reserved"]
    for i, t in enumerate(texts):
        assert {(b["line"], b["label"]): b["containment"] for b in out[i]["blocks"]} == stretches(t.lower())
    assert out[0]["score"] == 1.0 and out[3]["score"] == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_licenses_of_random_texts(spark, seed):
    """Texts of few words, so that stretches touch, overlap and just miss; line ends anywhere."""
    r = random.Random(seed)
    templates = {"a": "one two three four five", "b": "two six seven eight nine ten", "c": "five", "d": "one one two", "e": "three nine"}
    words = "one two three four five six seven eight nine ten or and".split()
    texts = ["".join(r.choice(words) + r.choice([" ", " ", "\n"]) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in license_scans.scan(docs, license_scans.template_frequencies(docs, templates), templates).collect():
        assert {(b["line"], b["label"]): b["containment"] for b in row["blocks"]} == stretches(texts[row["doc_id"]], templates)


def test_license_filters(spark):
    """Length and positions rule out what they must, and nothing that the exact count would keep."""
    templates = {"a": "one two three four five", "b": "two six seven eight nine", "c": "five"}
    index = license_scans.Index.of(templates, {"one": 9, "two": 1, "six": 2}, 0.8)
    rank = {w: i for i, w in enumerate(index.words)}
    blocks = ["two one", "two six seven eight", "two six seven one", "one three four five", "one three four", "five", "eight nine seven six two one three four five", "five four nine six"]
    rows = [(k, sorted({rank[w] for w in x.split()})) for k, x in enumerate(blocks)]
    d = spark.createDataFrame(rows, "k int, ranks array<int>").withColumn("t", index.candidates(F.col("ranks"))).orderBy("k")
    got = [{index.labels[t] for t in r["t"]} for r in d.collect()]
    exact = [{x for x, t in templates.items() if len(set(t.split()) & set(b.split())) >= 0.8 * len(set(t.split()))} for b in blocks]
    assert all(e <= g for e, g in zip(exact, got, strict=True))
    # rarest first: eight five four nine seven three two six one; "b" asks for eight or nine
    assert got[0] == got[2] == set() and got[1] == {"b"} and got[5] == {"c"}
    # nine is there and four words are enough, but behind nine only six could match "b"
    assert got[7] == {"a", "c"}


def test_many_templates(spark):
    """Templates of whole licenses' size, one plan for all of them; names that clash are replaced."""
    import random

    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    templates = {f"t{k:03}": " ".join(r.sample(vocabulary, 150)) for k in range(120)}
    texts = []
    for k in range(12):
        words = templates[f"t{k:03}"].split()
        lost = r.sample(range(150), 20 if k % 2 else 45)
        texts.append(" ".join("zz" if i in lost else w for i, w in enumerate(words)) + ("\nend" if k % 3 else ""))
    docs = spark.createDataFrame([(i, t, "mine", 7) for i, t in enumerate(texts)] + [(12, None, None, 7)], "doc_id long, text string, labels string, _t int")
    out = license_scans.scan(docs, license_scans.template_frequencies(docs, templates), templates).orderBy("doc_id").collect()
    assert [x["labels"] for x in out] == [f"t{k:03}" if k % 2 else "" for k in range(12)] + [""] and {x["_t"] for x in out} == {7}


def test_licenses_of_nothing(nothing):
    assert license_scans.scan(nothing, license_scans.template_frequencies(nothing)).count() == 0


INSULTS = ["idiot", "moron", "worthless"]


@pytest.fixture(scope="module")
def toxic(spark):
    import random

    from llm_prose import prose

    r = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        t = prose(r, 60)
        bad = i % 4 == 0
        if bad:
            w = t.split(" ")
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(INSULTS))
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, 1, int(bad)))
    hidden = ["an 1d10t here", "such a m.o.r.o.n he is", "you are an i d i o t today", "wooorthlesss stuff", "the m0r0n walks"]
    rows += [(1000 + k, prose(r, 30) + " " + t) for k, t in enumerate(hidden)] + [(2000, None), (2001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), len(hidden)


def test_toxicity(toxic):
    docs, labels, n_hidden = toxic
    costs, evidence, prior = toxicity.fitted(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs, costs, evidence, prior).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.where(toxicity.remainder(F.col("doc_id")) == 0).collect()}
    assert truth and all(out[i]["predicted"] == t for i, t in truth.items())
    assert [out[1000 + k]["predicted"] for k in range(n_hidden)] == [1] * n_hidden
    assert out[2000]["score"] == out[2001]["score"] < 0.5


def test_toxicity_of_noise_of_each_kind(toxic, spark):
    flat = np.zeros((toxicity.CLASSES,) * 3, np.float32)
    assert "ass" in toxicity.readings("455", flat) and "tits" in toxicity.readings("7175", flat)
    assert toxicity.readings("26", flat) == []
    docs, labels, _ = toxic
    costs, evidence, prior = toxicity.fitted(docs, labels)
    long = "=".join(["plain"] * 40)
    assert "idiot" in toxicity.readings("idio" + "t" * 70, costs)
    assert any("idiot" in w for w in toxicity.readings(long + "1d10t" + long, costs))
    assert "ass" in toxicity.spaced("an a s s there", flat) and "asshole" in toxicity.spaced("@ s s h o l e", flat)
    noise = ["an i d ! o t here", "such a 1 d ! 0 t", "m  o  r  o  n", "i - d - i . . o - t", "idio" + "t" * 70]
    out = toxicity.score(spark.createDataFrame(list(enumerate([*noise, "a plain 100 of 2024 - b"])), "doc_id long, text string"), costs, evidence, prior)
    assert [r["predicted"] for r in out.orderBy("doc_id").collect()] == [1] * len(noise) + [0]


def test_viterbi_finds_the_best_of_all_paths():
    """Against every path of the lattice, on short words under random costs."""
    import itertools
    import random

    r = np.random.default_rng(3)
    costs = r.gamma(2.0, 1.5, (toxicity.CLASSES,) * 3).astype(np.float32)
    rr = random.Random(5)

    def steps(word, i):
        c = word[i]
        if c.isalpha():
            again = i and word[i - 1] == c
            return [(c, 0.0)] + ([("", toxicity.REPEAT_COST if not re.search(r"(.)\1\1", word[max(0, i - 2) : i + 3]) else 0.0)] if again else [])
        drop = toxicity.OTHER_COST if c.isdigit() else toxicity.DROP_COST + (1.0 if c in toxicity.LOOKS else 0.0)
        return [(x, toxicity.SIGN_COST) for x in toxicity.LOOKS.get(c, "")] + [("", drop)]

    def cost(text):
        a = b = 0
        total = 0.0
        for ch in text + " ":
            k = toxicity.class_of(ch)
            total += float(costs[a, b, k])
            a, b = b, k
        return total

    for _ in range(60):
        word = "".join(rr.choice("iddooott1103!$@|-.") for _ in range(rr.randrange(2, 9)))
        best = {}
        for path in itertools.product(*[steps(word, i) for i in range(len(word))]):
            text = "".join(x for x, _ in path)
            if text:
                best[text] = min(best.get(text, 1e9), sum(e for _, e in path) + cost(text))
        ends = {}
        for text, c in best.items():
            ends[text[-2:]] = min(ends.get(text[-2:], (1e9, "")), (c, text))
        want = [c for c, _ in sorted(ends.values())[:3]]
        assert [best[t] for t in toxicity.restore(word, costs)] == pytest.approx(want, abs=1e-4)


def test_doubled_letters_and_odd_rows(toxic, spark):
    flat = np.zeros((toxicity.CLASSES,) * 3, np.float32)
    assert set(toxicity.squeezed("idiioot")) == {"idiioot", "idioot", "idiiot", "idiot"} and toxicity.readings("stone", flat) == ["stone"]
    docs, labels, _ = toxic
    costs, evidence, prior = toxicity.fitted(docs, labels)
    spaced = "w o r t h l e s s " * 30
    rows = [(1, "idiioot", "x", 1), (1, "idiioot", "x", 1), (1, "plain", "x", 1), (None, "an idiot", "x", 1), (2, "river stone " * 30_000 + "idiot", "x", 1), (3, "quiet " * 20_000, "x", 1), (4, spaced, "x", 1)]
    out = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int"), costs, evidence, prior).collect()
    assert sorted((r["doc_id"] or 0, r["predicted"]) for r in out) == [(0, 1), (1, 0), (1, 1), (1, 1), (2, 1), (3, 0), (4, 1)]
    assert all(isinstance(r["score"], float) for r in out)


def test_toxicity_without_labels(toxic, nothing):
    docs, labels, _ = toxic
    costs, evidence, prior = toxicity.fitted(docs, labels.where("false"))
    assert not evidence and toxicity.score(docs, costs, evidence, prior).where("predicted = 1").count() == 0
    costs, evidence, prior = toxicity.fitted(nothing, labels)
    assert toxicity.score(nothing, costs, evidence, prior).count() == 0


URLS = [
    ("http://A.Example.NET/en/1?x", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/de", "example.net", "/de", "net/", "block"),
    ("ftp://x.example.com/de/9#y", "x.example.com", "/de/9", "example.com/de/", "block"),
    ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
    ("http://w.org/fr/a", "w.org", "/fr/a", "org/fr/", "allow"),
    ("http://m.casino-win.example.com/en/1", "m.casino-win.example.com", "/en/1", None, "block"),
    ("http://x.net?q=/en/", "x.net", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("http:///p", "", "/p", None, "allow"),
    ("http://a.net/://b.com/x", "a.net", "/://b.com/x", "net/", "block"),
]


def test_urls(spark):
    from tracewright.llm.queries import URL_BLOCKED, URL_RULES

    d = spark.createDataFrame([(i, u[0], i) for i, u in enumerate(URLS)], "page_id long, url string, verdict int")
    out = url_filters.judge(d, URL_RULES, URL_BLOCKED).orderBy("page_id").collect()
    assert [(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out] == URLS
    assert url_filters.judge(d.where("false"), URL_RULES, URL_BLOCKED).count() == 0


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    xxhash = pytest.importorskip("xxhash")
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b, seed=0: len(b))  # every pair of equal length collides
    p = tmp_path / "d.bin"
    p.write_bytes(url_filters.DigestArray.pack([("aa", 1), ("bb", 2), ("ccc", 1)]))
    a = url_filters.DigestArray(str(p))
    assert a.codes_of([b"bb", b"aa", b"dd", b"ccc", b"ddd", b""]).tolist() == [2, 1, 0, 1, 0, 0]
    p.write_bytes(url_filters.DigestArray.pack([]))
    assert url_filters.DigestArray(str(p)).codes_of([b"x"]).tolist() == [0]


def test_long_lists_of_patterns(spark, tmp_path):
    """A table of 40,000 patterns is hashed, sorted and laid out by Spark and the workers; urls with hosts of 40,000 labels are judged."""
    listed = [f"h{i}.example.org/{'p' * (i % 5)}" for i in range(40_000)] + ["é.example/", "no slash", None, "h7.example.org/pp", "h7.example.org/pp"]
    patterns = spark.createDataFrame([(k,) for k in listed], "pattern string").repartition(7)
    deep = "a." * 40_000
    urls = [f"http://h{i}.example.org/{'p' * j}" for i in (0, 7, 39_999, 40_000) for j in range(6)] + [f"https://{deep}h3.example.org/pppp?x", f"https://{deep}net", "http://É.example/", "http://é.example/x", None, "", "x", "http://", "http://no slash"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate([*urls, *urls])], "page_id long, url string, rule string")
    short = url_filters.judge(pages, [("net/", "block")], [k for k in listed if k and "/" in k]).orderBy("page_id").collect()
    long = url_filters.judge(pages, [("net/", "block")], patterns).orderBy("page_id").collect()
    assert long == short and [r["verdict"] for r in long][: len(urls)] == [r["verdict"] for r in long][len(urls) :]
    held = {k for k in listed if k}
    fits = lambda i, j: any(f"h{i}.example.org/{'p' * n}" in held for n in range(j + 1))
    assert [r["verdict"] == "block" for r in long][:24] == [fits(i, j) for i in (0, 7, 39_999, 40_000) for j in range(6)]
    assert [r["verdict"] for r in long][24:33] == ["block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow"]
    assert url_filters.judge(pages, [], patterns.where("false")).where("verdict = 'block'").count() == 0
    assert url_filters.suffixes(b"a.b.c", 2) == [b"c", b"b.c"] and url_filters.suffixes(b"a.b", 9) == [b"b", b"a.b"] and url_filters.suffixes(b"", 1) == [b""]


def test_sha_of_ids_matches_the_contract(docs, texts):
    path, pattern = tokenizers_there.path("byte_bpe_multi_50k.tiktoken"), tokenizers_there.PATTERN
    own = byte_bpe.RankBpe.load(path, pattern)
    out = byte_bpe.encode(docs, path, pattern).select("doc_id", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("h")).collect()
    for r in out:
        ids = own.ids(texts[r["doc_id"]] or "").tolist()
        assert r["h"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_repeated_ids_and_clashing_names(spark):
    """Rows of one id are rows of their own; columns named like results are replaced, others stay."""
    from tracewright.llm import harmonic_packing, hilbert_shards

    rows = [(1, "the mit license text", 5, "x"), (1, "other words under the MIT license", 6, "y"), (1, "other words under the MIT license", 6, "y"), (None, "words", 7, "z"), (2, None, 8, "w")]
    names = ("n_words", "labels", "ids", "decoded", "cell", "shard", "blocks", "start", "length", "sequence_id", "offset", "kept", "own")
    d = spark.createDataFrame(rows, "doc_id long, text string, n long, s string").withColumns({c: F.lit("mine") for c in names})
    path, pattern = tokenizers_there.path("byte_bpe_multi_50k.tiktoken"), tokenizers_there.PATTERN
    for out in (
        license_scans.scan(d, license_scans.template_frequencies(d)),
        quality_rules.judge(d, [0.1] * 20),
        byte_bpe.decode(byte_bpe.encode(d, path, pattern), path, pattern),
        hilbert_shards.shards(d, 2, {"n": F.col("n"), "s": F.col("s")}, ["doc_id", "text"]),
    ):
        got = out.collect()
        assert len(got) == len(rows) and {r["own"] for r in got} == {"mine"}
    pieces = harmonic_packing.pack(harmonic_packing.tokens(d, tokenizers_there.path("word_bpe_49k.json"), 2)).collect()
    assert sorted((r["doc_id"] or 0) for r in pieces) == [0, 1, 1, 1, 2] and len({(r["sequence_id"], r["offset"]) for r in pieces}) == 5
