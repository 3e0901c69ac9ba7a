"""Line dedup by pairwise alignment.

A text is cut into lines: at line ends, and within long lines also behind sentence ends, so that
a passage that stands in the middle of a paragraph is seen too. Single lines may be common; runs of lines that reach
MIN_WORDS words are what counts as rare, however many documents share them: each run's hash leads every later document to
the first document that holds it (one pair a document and first holder, so a run that
thousands share costs thousands of pairs, not millions). Runs and first documents of very many
pairs are joined where the pairs are, so neither comes to one task. Each pair is aligned by patience diff,
and common blocks of MIN_WORDS words or more are deleted from the later document. Runs that
patience leaves over, as they moved or repeat within a document, are matched by their
hashes, so every repeated run goes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, join_one, mapped, spread_join, stored

#: Fewest words of a block that is deleted.
MIN_WORDS = 15
#: Later documents that one copy of a first document's lines is aligned with, about.
HOLDER_PAIRS = 2000
_LINE = re.compile(r"[^.!?\n]*(?:[.!?](?![ \t])[^.!?\n]*)*(?:[.!?]|\n|\Z)")


def lines_of(text: str | None) -> list[str]:
    """Lines of a text; joined they give the text again."""
    return list(filter(None, _LINE.findall(text))) if text else []


def digests(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, words) of each line; the hash ignores white space around the line."""
    import xxhash

    lines = lines_of(text)
    h = np.fromiter((xxhash.xxh64_intdigest(x.strip().encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    return h, np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))


def runs(h: np.ndarray, w: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start, end, hash) of the shortest run of at least `least` words from each line that has words."""
    import xxhash

    data, out = memoryview(h.tobytes()), []
    total = np.concatenate([[0], np.cumsum(w)])
    ends = np.searchsorted(total, total[:-1] + least)  # first end with enough words
    for i in np.nonzero((w > 0) & (ends < len(total)))[0].tolist():
        j = int(ends[i])
        out.append((i, j, xxhash.xxh64_intdigest(data[8 * i : 8 * j]) - 2**63))
    return out


def _increasing(seconds: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails, at, back = [], [], []
    for i, x in enumerate(seconds):
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def common_blocks(later: np.ndarray, words: np.ndarray, first: np.ndarray, least: int = MIN_WORDS) -> list[int]:
    """Lines of `later` that stand in blocks of `least` words or more common with `first`."""
    a, b, w = later.tolist(), first.tolist(), words.tolist()
    gone = [False] * len(a)

    def take(i: int, j: int) -> bool:
        """Grow the match of a[i] and b[j] both ways; delete it if it is long enough."""
        s, t = i, j
        while s > 0 and t > 0 and not gone[s - 1] and a[s - 1] == b[t - 1]:
            s, t = s - 1, t - 1
        e, f = i, j
        while e < len(a) and f < len(b) and not gone[e] and a[e] == b[f]:
            e, f = e + 1, f + 1
        if sum(w[s:e]) < least:
            return False
        gone[s:e] = [True] * (e - s)
        return True

    in_b = Counter(b)
    place = {x: j for j, x in enumerate(b)}
    while True:
        in_a = Counter(x for x, g in zip(a, gone, strict=True) if not g)
        once = [i for i, x in enumerate(a) if not gone[i] and in_a[x] == 1 and in_b.get(x) == 1 and w[i]]
        chain = [once[k] for k in _increasing([place[a[i]] for i in once])]
        if not any([take(i, place[a[i]]) for i in chain if not gone[i]]):
            break
    held = {}
    for i, _, key in runs(first, np.array([len_w for len_w in _words_for(first, a, w)]), least) if any(not g for g in gone) else []:
        held.setdefault(key, i)
    for i, _, key in runs(later, words, least):
        if key in held and not gone[i]:
            take(i, held[key])
    return [i for i, g in enumerate(gone) if g]


def _words_for(first: np.ndarray, a: list[int], w: list[int]) -> list[int]:
    """Words of the first document's lines as far as the later one has them; other lines count as long."""
    known = dict(zip(a, w, strict=True))
    return [known.get(x, 1 << 20) for x in first.tolist()]


def repeated_lines(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines): places of the lines to delete, for every document that has any."""

    def cut(texts: list[str | None]) -> tuple:
        hashes, words, keys = [], [], []
        for t in texts:
            h, w = digests(t)
            hashes.append(h.tobytes())
            words.append(np.minimum(w, 65535).astype("<u2").tobytes())
            keys.append(sorted({k for _, _, k in runs(h, w, least)}))
        return hashes, words, keys

    kinds = {"h": T.BinaryType(), "w": T.BinaryType(), "keys": T.ArrayType(T.LongType())}
    given = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_text"))
    cuts = stored(mapped(given, ["doc_id"], ["_text"], [T.StructField(n, k) for n, k in kinds.items()], cut), "line-hashes")
    keys = cuts.select("doc_id", F.explode_outer("keys").alias("key")).where("key is not null")
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("_n")).where("first < last").drop("last")
    # a run that a large part of the documents share stays where its documents are
    shared = stored(shared, "line-keys")
    pairs = join_one(keys, shared, ["key"], n="_n").where("doc_id > first").select("doc_id", "first").distinct()
    pairs = stored(pairs, "line-pairs")
    discard(shared)
    # a first document that very many later ones share goes to several places, each with a part of them;
    # documents of equal id are one for the pairing; their rows are aligned each
    firsts = cuts.select(F.col("doc_id").alias("first"), F.col("h").alias("hf"))
    both = spread_join(pairs, firsts, "first", "doc_id", HOLDER_PAIRS).join(cuts.select("doc_id", "h", "w"), "doc_id")

    def align(hs: list[bytes], ws: list[bytes], fs: list[bytes]) -> tuple:
        u8 = lambda x: np.frombuffer(x, np.uint64)
        return ([common_blocks(u8(h), np.frombuffer(w, "<u2").astype(np.int64), u8(f), least) for h, w, f in zip(hs, ws, fs, strict=True)],)

    found = mapped(both, ["doc_id"], ["h", "w", "hf"], [T.StructField("lines", T.ArrayType(T.IntegerType()))], align).where(F.size("lines") > 0)
    # a document's places: bounded by its own lines and first holders
    out = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    out = stored(out, "line-repeats")
    discard(cuts, pairs)
    return out


def without_repeats(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated blocks cut out of `text`, plus n_lines and removed_lines (array of places).

    The first document (by doc_id) keeps its blocks. Null and empty texts have no lines and stay
    as they are, as do null ids; blocks within one document are no repeats. Documents of equal id
    never delete from each other. Columns named n_lines or removed_lines are replaced.
    """
    repeats = repeated_lines(docs, text, least).select(F.col("doc_id").alias("_id"), F.col("lines").alias("removed_lines"))
    d = docs.drop("n_lines", "removed_lines")
    d = d.join(repeats, d["doc_id"].cast("long") == F.col("_id"), "left").drop("_id")

    def rebuild(given: list[str | None], removed: list[list[int] | None]) -> tuple:
        texts, counts = [], []
        for t, gone in zip(given, removed, strict=True):
            lines = lines_of(t)
            if gone:
                out = set(gone)
                t = "".join(x for i, x in enumerate(lines) if i not in out)
            texts.append(t)
            counts.append(len(lines))
        return texts, counts

    fields = [T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType())]
    out = mapped(d, [c for c in d.columns if c != text], [text, "removed_lines"], fields, rebuild)
    return out.select(*docs.drop("n_lines", "removed_lines").columns, "n_lines", "removed_lines")
