"""MinHash near-dedup with sequential Bayesian verification.

Words (split at ASCII white space, A-Z lowered) form distinct five-word shingles, each known by a
64-bit hash. Documents with equal sets are one class, of which only one member goes on. Banded
signatures give buckets; a bucket's members are candidates of its smallest member, never of
each other, so a bucket of any size costs a row a member. Candidates compare signatures
batch by batch and leave as soon as the posterior probability of a similarity at or above
the threshold falls under the chosen miss probability; survivors are confirmed on their full
sets. Where a bucket then holds members of several components, those outside its largest one
compare signatures with all members of other components, in blocks of bounded size. Members
with a likely partner come to their block once more with their full sets, and the block
confirms its pairs, likeliest first, skipping those whose ends are connected by then. A block
returns a forest, never its pairs; so no link between components that the bands propose is lost.

Bands of five rows over 200 hashes: a pair at similarity 0.75 shares none of the 40 bands with
probability 2e-5; the sequential comparison then loses 7.7e-4 of such pairs (3.3e-4 at 0.76), reckoned with
independent hashes: 8e-4 in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import discard, join_one, mapped, spread_join, stored

WORDS = 5
HASHES, ROWS = 200, 5
PERCENT = 75
BATCH = 25
#: Members of a bucket that meet in one block, on either side, and their shingles; buckets up to SMALL members share tasks of about TASK_ROWS rows.
FEW, MANY, SMALL, TASK_ROWS = 512, 2048, 256, 4000
BLOCK_SHINGLES = 2_000_000
MISS = 1e-4
MEMO = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _words() -> _WordHashes:
    return _WordHashes()


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; fewer words than `words`: one for them all; none: empty."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    mult = _odd(words, 11)
    n = len(h) - size + 1
    g = np.full(n, size * 0xD1B54A32D192ED03 % 2**64, np.uint64)
    for i in range(size):
        g += h[i : i + n] * mult[i]
    return np.unique(_mixed(g))


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    a = _odd(hashes, 7)[:, None]
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (a * shingles[None, at : at + 256]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def least_matches(percent: int = PERCENT, hashes: int = HASHES, batch: int = BATCH, miss: float = MISS) -> list[int]:
    """For each batch end n: the fewest equal hashes with P(similarity >= threshold | matches of n) >= miss, uniform prior."""
    s = (np.arange(20_000) + 0.5) / 20_000
    high = s >= percent / 100
    out = []
    for n in range(batch, hashes + 1, batch):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[high].sum() / p.sum() >= miss:
                break
        out.append(m)
    return out


def shingled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_hash, sig): set_hash is 128 bits of the whole set, sig 16 bits of each least hash."""

    def work(texts: list[str | None]) -> tuple:
        import xxhash

        sets = [shingle_set(t) for t in texts]
        short = [(signature(x) & np.uint32(0xFFFF)).astype("<u2").tobytes() for x in sets]
        return [len(x) for x in sets], [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], short

    kinds = {"n_shingles": T.LongType(), "set_hash": T.BinaryType(), "sig": T.BinaryType()}
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return mapped(given, ["doc_id"], ["_text"], [T.StructField(n, k) for n, k in kinds.items()], work)


def banded(reps: DataFrame) -> DataFrame:
    """(rep, band, bucket) of every band of reps(rep, sig)."""
    part = lambda k: F.substring(F.col("sig"), k * (2 * ROWS) + 1, F.lit(2 * ROWS))
    buckets = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda k: F.xxhash64(k, part(k)))
    return reps.select("rep", F.posexplode(buckets).alias("band", "bucket"))


def _signatures(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<u2").reshape(len(data), -1)


def _survivors(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, seen: np.ndarray, fewest: list[int], done: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (p, q) of rows of x and y that last through all batches from `done` on, with their equal hashes."""
    for k in range(done, len(fewest)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen = seen + (x[p, part] == y[q, part]).sum(axis=1)
        live = seen >= fewest[k]
        p, q, seen = p[live], q[live], seen[live]
        if not len(p):
            break
    return p, q, seen


def likely(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that the sequential comparison of signatures does not rule out."""
    fewest = least_matches(percent)
    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    both = spread_join(pairs.select("a", "b"), left, "a", "b").join(right, "b")
    both = both.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                n = np.arange(len(b))
                p, _, _ = _survivors(_signatures(b["sa"].tolist()), _signatures(b["sb"].tolist()), n, n, np.zeros(len(b), int), fewest)
                yield b.iloc[p][["a", "b"]]

    return both.select("a", "b", "sa", "sb").mapInPandas(prune, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets, of sets(rep, shingles), reach the threshold."""
    pairs = stored(pairs, "minhash-likely")
    both = spread_join(pairs, sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a", "b")
    both = both.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for p, q in zip(b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield b.loc[good, ["a", "b"]]

    links = stored(both.mapInPandas(exact, "a long, b long"), "minhash-links")
    discard(pairs)
    return links


def blocks(hits: DataFrame, reps: DataFrame, at: DataFrame) -> DataFrame:
    """(task, band, bucket, rep, component, as_few, as_any, n, sig): who meets whom between components.

    In every bucket the members outside its largest component (few) meet all others (any), block by
    block, in tasks of bounded size; small buckets share a task.
    """
    here = hits.join(at.withColumnRenamed("node", "rep"), "rep", "left").join(reps.select("rep", "n"), "rep")
    here = here.select("band", "bucket", "rep", "n", F.coalesce("component", "rep").alias("component"))
    sizes = here.groupBy("band", "bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    mixed = sizes.groupBy("band", "bucket").agg(F.max(F.struct("m", "component", "w")).alias("top"), F.sum("m").alias("all"), F.sum("w").alias("all_w"), F.count("*").alias("parts")).where("parts > 1")
    blocks_of = lambda m, w, limit: F.ceil(F.greatest(m / limit, w / BLOCK_SHINGLES)).cast("long")
    mixed = mixed.select(
        "band",
        "bucket",
        F.col("top.component").alias("main"),
        ((F.col("all") <= SMALL) & (F.col("all_w") <= BLOCK_SHINGLES)).alias("small"),
        blocks_of(F.col("all") - F.col("top.m"), F.col("all_w") - F.col("top.w"), FEW).alias("rows"),
        blocks_of(F.col("all"), F.col("all_w"), MANY).alias("columns"),
    )
    # not discarded: what is returned reads it
    here = stored(here.join(mixed, ["band", "bucket"]), "minhash-mixed")
    size = here.where("small").agg(F.count("*").alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("w")).first()
    groups = F.lit(max(1, size["m"] // TASK_ROWS, size["w"] // BLOCK_SHINGLES))
    minor = F.col("component") != F.col("main")
    drawn = F.xxhash64("rep")
    one = here.where("small").withColumns({"as_few": minor, "as_any": F.lit(True), "task": F.concat(F.lit("s"), F.pmod(F.xxhash64("bucket"), groups).cast("string"))})
    large = here.where("not small")
    upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    few = large.where(minor).select("*", F.pmod(drawn, "rows").alias("_i"), upto("columns").alias("_j")).withColumns({"as_few": F.lit(True), "as_any": F.lit(False)})
    many = large.select("*", upto("rows").alias("_i"), F.pmod(drawn, "columns").alias("_j")).withColumns({"as_few": F.lit(False), "as_any": F.lit(True)})
    dealt = few.unionByName(many).withColumn("task", F.concat_ws(":", "band", "bucket", "_i", "_j"))
    kept = ["task", "band", "bucket", "rep", "component", "as_few", "as_any", "n"]
    return one.select(*kept).unionByName(dealt.select(*kept)).join(reps.select("rep", "sig"), "rep")


def _open_pairs(g: pd.DataFrame, fewest: list[int], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal): likely pairs of rows of one bucket's block, few and any, of different components; each pair in its first shared band."""
    f, m = np.nonzero(g["as_few"].to_numpy())[0], np.nonzero(g["as_any"].to_numpy())[0]
    c, n, sig = g["component"].to_numpy(), g["n"].to_numpy(), _signatures(g["sig"].tolist())
    band = int(g["band"].iloc[0])
    out = []
    for at in range(0, len(f), 64):
        x = f[at : at + 64]
        fit = np.minimum(n[x][:, None], n[m][None, :]) * 100 >= np.maximum(n[x][:, None], n[m][None, :]) * percent
        p, q = np.nonzero((c[x][:, None] != c[m][None, :]) & fit)
        p, q, seen = _survivors(sig, sig, x[p], m[q], np.zeros(len(p), int), fewest)
        if len(p):
            own = (sig[p].reshape(len(p), -1, ROWS) == sig[q].reshape(len(p), -1, ROWS)).all(axis=2).argmax(axis=1) == band
            out.append((p[own], q[own], seen[own]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _forest(p: np.ndarray, q: np.ndarray, seen: np.ndarray, component: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between components, by pairs of rows (p, q) whose sets reach the threshold; pairs already connected are not looked at."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    links = []
    rows, starts = np.unique(p, return_index=True)  # p ascends
    for k, at, end in zip(rows.tolist(), starts.tolist(), [*starts[1:].tolist(), len(p)], strict=True):
        rest = q[at + np.argsort(-seen[at:end], kind="stable")].tolist()
        step = 1
        while rest := [j for j in rest if root(component[j]) != root(component[k])]:
            now, rest, step = rest[:step], rest[step:], step * 8
            x, ys = sets[k], [sets[j] for j in now]
            all_y = np.concatenate(ys)
            hit = x[np.minimum(np.searchsorted(x, all_y), len(x) - 1)] == all_y
            common = np.add.reduceat(hit, np.cumsum([0, *map(len, ys[:-1])]), dtype=np.int64)
            for j, y, both in zip(now, ys, common.tolist(), strict=True):
                a, b = root(component[k]), root(component[j])
                if a != b and 100 * both >= percent * (len(x) + len(y) - both):
                    up[max(a, b)] = min(a, b)
                    links.append((component[k], component[j]))
    return links


def between(met: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between components that the blocks' members have, as a forest a block."""
    fewest = least_matches(percent)
    kept = met.columns

    def flag(b: pd.DataFrame) -> pd.DataFrame:
        some = []
        for _, g in b.groupby(["band", "bucket"], sort=False):
            i, j, _ = _open_pairs(g, fewest, percent)
            some.append(g.iloc[np.unique(np.concatenate([i, j]))])
        return pd.concat(some)

    def verify(b: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, g in b.groupby(["band", "bucket"], sort=False):
            links += _forest(*_open_pairs(g, fewest, percent), g["component"].tolist(), [np.frombuffer(x, np.uint64) for x in g["shingles"]], percent)
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    open_ = stored(met.groupBy("task").applyInPandas(flag, met.schema).select(*kept), "minhash-open")
    full = open_.join(sets, "rep")
    joins = stored(full.groupBy("task").applyInPandas(verify, "a long, b long"), "minhash-joins")
    discard(open_)
    return joins


def groups(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id reachable over links, itself included.

    Null texts and texts without words have no shingle and link with nothing; equal sets are
    always linked. Rows that repeat a doc_id stay rows of their own with one component. An empty
    table gives an empty result; other columns are ignored. Rows without a doc_id are no candidates: no component,
    kept null.
    """
    base = stored(shingled(docs, text), "minhash-signatures")
    reps = (
        base.where("n_shingles > 0 and doc_id is not null")
        .groupBy("n_shingles", "set_hash")
        .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.count("*").alias("m"))
        .withColumnRenamed("n_shingles", "n")
    )
    reps = stored(reps, "minhash-classes")
    rows = banded(reps)
    shared = rows.groupBy("band", "bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count("*").alias("_n")).where("leader < last").drop("last")
    shared = stored(shared, "minhash-leaders")
    hits = stored(join_one(rows, shared, ["band", "bucket"], n="_n"), "minhash-buckets")
    discard(shared)
    # the texts move once; all later checks use the sets of documents that share a bucket
    near = hits.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text")).join(near, "doc_id", "left_semi")
    sets = mapped(texts, ["doc_id"], ["_text"], [T.StructField("shingles", T.BinaryType())], lambda ts: ([shingle_set(t).tobytes() for t in ts],))
    sets = stored(sets.withColumnRenamed("doc_id", "rep"), "minhash-sets")
    pairs = hits.where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = confirmed(likely(pairs, reps, percent), sets, percent)
    at = components(links)
    joins = between(blocks(hits.select("band", "bucket", "rep"), reps, at), sets, percent)
    discard(hits, sets, links)
    over = components(joins)
    over = over.select(F.col("node").alias("_low"), F.col("component").alias("_lowest"))
    at = reps.select(F.col("rep").alias("node")).distinct().join(at, "node", "left").select("node", F.coalesce("component", "node").alias("_low"))
    at = at.join(over, "_low", "left").select("node", F.coalesce("_lowest", "_low").alias("component"))
    of_class = reps.join(at.withColumnRenamed("node", "rep"), "rep").select(F.col("n").alias("n_shingles"), "set_hash", "m", F.col("component").alias("component_id"))
    # a set of very many copies stays where its documents are; documents without words or id ask for no class
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = base.drop("sig")
    out = join_one(rows.where(linked), stored(of_class, "minhash-components"), ["n_shingles", "set_hash"], n="m")
    out = out.unionByName(rows.where(~linked).withColumn("component_id", F.lit(None).cast("long")))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
