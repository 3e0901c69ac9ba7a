"""Toxicity of noisy text: restore words by a noisy channel, then score the restored text.

Channel: a word's characters become a lattice, in which digits and symbols may stand for letters
they look like, repeated letters and separators may vanish, and letters that stand apart
("l i k e  t h i s") are joined. A character trigram model, counted over the whole corpus, and
the channel's costs give the best paths by Viterbi's algorithm, without a beam. Words of letters only
have few paths (doubled letters may be one), which all count; each distinct word is decoded
once and remembered. Texts of any length are read whole; very long words and runs are decoded
in parts that overlap by OVERLAP characters, so a word shorter than that stands whole in one of them.

Score: character substrings and whole words of labelled documents (a bounded sample, by hash of
the id) whose share of toxic documents is high are evidence; a document's score is the logistic
of the prior plus the evidence of its toxic words, strongest first and fading. Language, source and ids are no inputs.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .minhash_dedup import shingle_set, signature
from .shared import Memo, bound_batches, mapped, stored

#: Labelled documents that the scorer learns from at most.
TRAIN_BOUND = 12_000
#: Fewest toxic training documents with a piece of evidence, and the clean ones allowed for each of them: parts of
#: toxic words that other words share are no evidence.
SUPPORT, IMPURE = 5, 0.02
#: Each further toxic word of a text counts this much of what the stronger one before it would have.
FADING = 0.8
SKETCHES = 4
MEMO = 200_000
CLASSES = 64
# What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il"}
SIGN_COST, DROP_COST, REPEAT_COST, OTHER_COST = 1.0, 0.7, 0.5, 4.0
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Longest text that one lattice covers, and by how much the parts of a longer one overlap.
PART, OVERLAP = 128, 64
_SIGNS = re.escape("".join(c for c in LOOKS if not c.isalnum()))
_ONE = rf"(?:[^\W_]|[{_SIGNS}])"
_APART = re.compile(rf"(?<![\w{_SIGNS}]){_ONE}(?:[\s.\-_*]+{_ONE})+(?![\w{_SIGNS}])")
_BETWEEN = re.compile(r"[\s.\-_*]+")
_WIDE = re.compile(r"[\s.\-_*]{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_DOUBLE = re.compile(r"(.)(?=\1)")
_TRIPLE = re.compile(r"(.)\1\1")
_LONG_RUN = re.compile(r"(.)\1{3,}")


def class_of(c: str) -> int:
    """0: no letter; 1 to 26: a to z; other letters share 27 to 62."""
    if "a" <= c <= "z":
        return ord(c) - 96
    return 27 + ord(c) % 36 if c.isalpha() else 0


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return np.array([class_of(chr(i)) if not 0xD800 <= i < 0xE000 else 0 for i in range(0x10000)], np.int64)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n): how often three character classes stand together, over all texts; at most CLASSES ** 3 codes."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                joined = "\n\n".join(x or "" for x in batch.column(0).slice(at, 64).to_pylist()).lower()
                points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
                c = _classes()[np.minimum(points, 0xFFFF)]
                if len(c) > 2:
                    total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["code", "n"])

    return docs.select(text).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def trigram_costs(counts: DataFrame) -> np.ndarray:
    """-log P(third | first two), smoothed by the two-gram; float32, CLASSES ** 3 numbers."""
    n = np.zeros(CLASSES**3)
    for r in counts.collect():  # at most CLASSES ** 3 rows
        n[r["code"]] = r["n"]
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    two = n.sum(axis=0) + 0.1
    two /= two.sum(axis=1, keepdims=True)
    p = (n + 5.0 * two[None]) / (n.sum(axis=2, keepdims=True) + 5.0)
    return -np.log(p).astype(np.float32)


def restore(word: str, costs: np.ndarray | list, apart: bool = False, keep: int = 3) -> list[str]:
    """The best readings of a lower-case word that end in different letters, best first; apart: word ends may be put between letters.

    Viterbi over the whole lattice: what is to come depends on the last two letters only, so the best
    path to each pair of these is kept, and no other path can be better.
    """
    states: dict[str, tuple[float, str, int, int]] = {"": (0.0, "", 0, 0)}
    for i, c in enumerate(word):
        steps: list[tuple[str, float]] = []
        if c.isalpha():
            steps.append((c, 0.0))
            if i and word[i - 1] == c:
                steps.append(("", REPEAT_COST if not _TRIPLE.search(word[max(0, i - 2) : i + 3]) else 0.0))
        else:
            steps += [(x, SIGN_COST) for x in LOOKS.get(c, "")]
            steps.append(("", OTHER_COST if c.isdigit() else DROP_COST + (1.0 if c in LOOKS else 0.0)))
        classes = [class_of(x) if x else 0 for x, _ in steps]
        after: dict[str, tuple[float, str, int, int]] = {}

        def reach(cost: float, text: str, a: int, b: int, after: dict = after) -> None:
            key = text[-2:]
            had = after.get(key)
            if had is None or (cost, text) < had[:2]:
                after[key] = (cost, text, a, b)

        for cost, text, a, b in states.values():
            for (x, extra), k in zip(steps, classes, strict=True):
                if not x:
                    reach(cost + extra, text, a, b)
                    continue
                reach(cost + extra + float(costs[a][b][k]), text + x, b, k)
                if apart and text and text[-1] != " ":
                    between = cost + extra + 1.0 + float(costs[a][b][0]) + float(costs[b][0][k])
                    reach(between, f"{text} {x}", 0, k)
        states = after
    ends = sorted((cost + float(costs[a][b][0]), text) for cost, text, a, b in states.values())
    return list(dict.fromkeys(t for _, t in ends if t))[:keep]


def squeezed(word: str) -> list[str]:
    """A word of letters and all that it may be if doubled letters stand for one: every path of its lattice."""
    at = [m.start() for m in _DOUBLE.finditer(word)]
    out = [word]
    for i in reversed(at):
        out += [w[:i] + w[i + 1 :] for w in out]
    return out


def parts(word: str) -> list[str]:
    """A word as it is, or for bounded work its distinct overlapping parts; of a long run of one character three stay."""
    if len(word) > OVERLAP:
        word = _LONG_RUN.sub(r"\1\1\1", word)
    return list(dict.fromkeys(word[at : at + PART] for at in range(0, max(1, len(word) - OVERLAP), PART - OVERLAP)))


def readings(token: str, costs: np.ndarray | list) -> list[str]:
    """Words that a lower-case token may mean.

    A token of letters has few paths, which all count; one with signs, digits or many repeated letters is decoded.
    """
    core = token.strip(EDGES)
    if core.isalpha() and not _TRIPLE.search(core):
        lead, tail = len(token) - len(token.lstrip(EDGES)), len(token) - len(token.rstrip(EDGES))
        odd = (lead == 1 and token[0] in "@$") or (0 < tail <= 2 and token[-1] in "@$")
        if not odd and len(_DOUBLE.findall(core)) <= 3:
            return squeezed(core)
    plain = _LETTERS.findall(token)
    if not any(c.isalpha() or c in LOOKS for c in token):
        return plain
    # signs that end a run of three or more are decoration
    shape = re.sub(r"([^\w\s])\1{2,}", "", token).strip("\"#%&'()*,-./:;<=>?[\\]^_`{}~")
    return plain + [y for part in parts(shape) for x in restore(part, costs) for y in x.split()]


def traits(word: str) -> set[str]:
    """What a word may give evidence by: itself, and its substrings of four and five letters with its ends marked."""
    w = f"^{word}$"
    return {w, *(w[i : i + n] for n in (4, 5) for i in range(len(w) - n + 1))}


def spaced(low: str, costs: np.ndarray) -> set[str]:
    """Restored words of runs of single characters that stand apart."""
    out: set[str] = set()
    for run in apart_in(low):
        out.update(of_run(run, costs))
    return out


def apart_in(low: str) -> set[str]:
    """Distinct runs of single characters without what stands between them; wider gaps may be word ends, so what they part counts too."""
    out: set[str] = set()
    for m in _APART.finditer(low):
        pieces = [_BETWEEN.sub("", x) for x in _WIDE.split(m.group())]
        out.update(["".join(pieces), *(x for x in pieces if len(x) > 1)])
    return out


def of_run(run: str, costs: np.ndarray) -> list[str]:
    return [y for part in parts(run) for x in restore(part, costs, apart=True) for y in [*x.split(), x.replace(" ", "")]]


def words_in(text: str | None, costs: np.ndarray, memo: dict[str, list[str]]) -> set[str]:
    """Restored words of a text."""
    low = (text or "").lower()
    out = spaced(low, costs)
    for token in set(low.split()):
        got = memo.get(token)
        if got is None:
            got = readings(token, costs)
            if len(memo) >= MEMO:
                memo.clear()
            memo[token] = got
        out.update(got)
    return out


class Scorer:
    """Toxic words of texts; remembers what it found in MEMO distinct tokens at least."""

    def __init__(self, costs: np.ndarray, evidence: dict[str, float], base: float) -> None:
        self.costs, self.base = costs.tolist(), base
        self.weights = {x: math.log(p / (1 - p)) - base for x, p in evidence.items()}
        self.memo = Memo(self.of_token, MEMO)
        self.runs = Memo(lambda run: self.weigh(of_run(run, self.costs)), MEMO)

    def weigh(self, words) -> tuple[tuple[str, float], ...]:
        out = []
        for w in words:
            best = max((self.weights[x] for x in traits(w) if x in self.weights), default=0.0)
            if best > 0:
                out.append((w, best))
        return tuple(out)

    def of_token(self, token: str) -> tuple[tuple[str, float], ...]:
        return self.weigh(readings(token, self.costs))

    def strong(self, text: str | None) -> dict[str, float]:
        low = (text or "").lower()
        out: dict[str, float] = {}
        for got in filter(None, map(self.memo.__getitem__, set(low.split()))):
            out.update(got)
        for got in filter(None, map(self.runs.__getitem__, apart_in(low))):
            out.update(got)
        return out


_scorers: dict[str, Scorer] = {}


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _without_copies(rows: DataFrame, text: str) -> DataFrame:
    """(doc_id, toxic) of rows, one of each group of near copies: evidence should not count one text many times.

    A row goes if an earlier one shares any of its SKETCHES smallest hashes of three-word shingles.
    """

    def work(texts: list[str | None]) -> tuple:
        return ([[int(x) for x in signature(shingle_set(t, 3), SKETCHES)] for t in texts],)

    k = mapped(rows, ["doc_id", "toxic"], [text], [T.StructField("k", T.ArrayType(T.LongType()))], work)
    k = stored(k, "toxicity-sketches").select("doc_id", "toxic", F.posexplode("k").alias("i", "k"))
    first = k.groupBy("i", "k").agg(F.min("doc_id").alias("first"))
    return k.join(first, ["i", "k"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.bool_and(F.col("doc_id") == F.col("first")).alias("own")).where("own").drop("own")


def train(docs: DataFrame, labels: DataFrame, costs: np.ndarray, bound: int = TRAIN_BOUND, text: str = "text") -> tuple[dict[str, float], float]:
    """(share of toxic documents of each piece of evidence, prior); learns from rows with remainder not 0 only.

    No labels, or labels of one kind: no evidence, and the smoothed prior.
    """
    docs = docs.select("doc_id", text)
    known = labels.where("toxic is not null and doc_id is not null").where(remainder(F.col("doc_id")) != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # at most `bound` rows, so it may be broadcast
    given = docs.join(F.broadcast(sample), "doc_id")
    single = stored(_without_copies(given, text), "toxicity-sample")  # at most `bound` rows too
    n, toxic = single.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = (toxic + 0.5) / (n + 1.0)
    given = docs.join(F.broadcast(single), "doc_id").select("toxic", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good, memo, table = Counter(), Counter(), {}, costs.tolist()
        for batch in batches:
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set().union(*map(traits, words_in(t, table, memo)))
                (bad if label else good).update(seen)
        # what toxic documents never have is no evidence; the rest counts on both sides
        names = list(bad.keys() | {x for x in good if x not in bad})
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[x] for x in names], pa.int64()), pa.array([good[x] for x in names], pa.int64())], names=["trait", "bad", "good"])

    counts = given.mapInArrow(run, "trait string, bad long, good long").groupBy("trait").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = (F.col("bad") + prior) / (F.col("bad") + F.col("good") + 1.0)
    kept = counts.withColumn("share", share).where((F.col("bad") >= SUPPORT) & (F.col("good") <= F.col("bad") * IMPURE))
    rows = kept.select("trait", "share").collect()  # what SUPPORT of at most `bound` documents have in common
    return {r["trait"]: r["share"] for r in rows}, prior


def score(docs: DataFrame, costs: np.ndarray, evidence: dict[str, float], prior: float, text: str = "text") -> DataFrame:
    """Adds score (0 to 1), predicted (1 if score >= 0.5) and toxic_words (restored, strongest first).

    Null and empty texts have no evidence: the score of any text without toxic words. Equal texts get
    equal scores, rows of equal id their own each; ties among words go by spelling. Columns named like an added one are replaced.
    """
    base = math.log(prior / (1 - prior))
    key = uuid.uuid4().hex

    def work(texts: list[str | None]) -> tuple:
        scorer = _scorers.get(key)
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[key] = Scorer(costs, evidence, base)
        scores, found = [], []
        for t in texts:
            strong = sorted(scorer.strong(t).items(), key=lambda x: (-x[1], x[0]))
            z = min(base, -1.0) + (sum(x * FADING**k for k, (_, x) in enumerate(strong)) if strong else -1.0)
            scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            found.append([w for w, _ in strong])
        return scores, [int(x >= 0.5) for x in scores], found

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_words", T.ArrayType(T.StringType()))]
    d = docs.drop("score", "predicted", "toxic_words")
    return mapped(d.withColumn("_text", F.col(text)), d.columns, ["_text"], fields, work)


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text") -> tuple[np.ndarray, dict[str, float], float]:
    """Character costs over all of docs, evidence and prior."""
    costs = trigram_costs(trigram_counts(docs, text))
    return costs, *train(docs, labels, costs, text=text)
