"""Hard negatives by blocked dense products.

Anchors are cut into blocks of bounded size. A block of them is broadcast; every task multiplies it with its candidates, batch
after batch, in doubles, which are exact while products stay below 2^53, and keeps the best few of each anchor. What tasks
keep is merged by anchor: the best of the best. The first pass finds each anchor's positives, the second one the negatives whose scores lie in
the window under each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .code_compression import integers, matrix
from .shared import bound_batches, discard, stored

#: Numbers in the anchors that are broadcast together (8 bytes each) and their rows; rows of a block at most.
GROUP_NUMBERS = 1 << 22
GROUP_ROWS = 1 << 15
BLOCK_ROWS = 4096
#: Anchors multiplied at once with a batch of candidates: bounds the products in memory.
TILE = 512
#: Doubles hold integers below this exactly; scores are multiplied by 100 for the window.
EXACT = 1 << 53
LONGEST = (1 << 63) - 1
#: Place of no candidate.
NONE = -np.inf


@dataclass
class Anchors:
    """A group of anchors of one length: key, id, label and integer vector of each; in the second pass the positives' scores."""

    keys: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    largest: int
    #: anchor's row, rank of the positive, score of each positive
    at: np.ndarray | None = None
    score: np.ndarray | None = None


class Best:
    """The k best (score, id) of each lane seen so far: higher scores first, then smaller ids."""

    def __init__(self, lanes: int, k: int) -> None:
        self.k = k
        self.scores = np.full((lanes, k), NONE)
        self.ids = np.zeros((lanes, k), np.int64)

    def add(self, lanes: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores[candidate, lane of the slice], NONE where they do not meet; ids of the candidates, ascending."""
        last, last_id = self.scores[lanes, -1], self.ids[lanes, -1]
        better = (scores > last) | ((scores == last) & (scores > NONE) & (ids[:, None] < last_id))
        some = np.nonzero(better.any(0))[0]
        if not len(some):
            return
        s = np.where(better[:, some], scores[:, some], NONE)
        at = np.arange(len(some))
        new_s, new_i = [], []
        for _ in range(min(self.k, len(ids))):
            best = s.argmax(0)  # the first of equals has the smallest id
            new_s.append(s[best, at])
            new_i.append(ids[best])
            s[best, at] = NONE
        rows = lanes.start + some
        all_s = np.concatenate([self.scores[rows], np.array(new_s).T], 1)
        all_i = np.concatenate([self.ids[rows], np.array(new_i).T], 1)
        order = np.lexsort((all_i, -all_s), 1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lane, slot = np.nonzero(self.scores > NONE)
        return lane, self.ids[lane, slot], self.scores[lane, slot]


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, vectors) of candidates of the anchors' length, by id."""
    for b in batches:
        fits, flat = matrix(b.column("v"), size)
        if len(fits):
            ids, labels = (b.column(c).to_numpy(zero_copy_only=False)[fits] for c in ("id", "label"))
            order = np.argsort(ids, kind="stable")
            yield ids[order], labels[order], integers(flat[order])


def products(a: Anchors, tile: slice, vectors: np.ndarray) -> tuple[np.ndarray, bool]:
    """scores[candidate, anchor], and whether they are doubles. Beyond doubles, Python's integers, kept within 64 bits."""
    largest = int(np.abs(vectors).max(initial=0))
    if 100 * vectors.shape[1] * largest * a.largest < EXACT:
        return vectors.astype(np.float64) @ a.vectors[tile].astype(np.float64).T, True
    exact = np.dot(vectors.astype(object), a.vectors[tile].astype(object).T)
    return exact, False


def _exact_top(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int, lane: int) -> list[tuple[int, int, int]]:
    """(lane, id, score) of the k best fitting candidates by Python's integers."""
    some = sorted(((-int(scores[i]), int(ids[i])) for i in np.nonzero(fits)[0]))[:k]
    return [(lane, i, max(-LONGEST, min(LONGEST, -s))) for s, i in some]


def _merge(beyond: dict[int, list], found: list[tuple[int, int, int]], k: int) -> None:
    for row in found:
        beyond[row[0]] = sorted([*beyond.get(row[0], []), row], key=lambda r: (-r[2], r[1]))[:k]


def _best_of_tasks(candidates: DataFrame, a: Anchors, k: int) -> DataFrame:
    """(lane, id, score): the k best of each lane that a task has seen. Lanes are anchors, or the positives of anchors."""
    size, window = a.vectors.shape[1], a.at is not None
    shared = candidates.sparkSession.sparkContext.broadcast(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        best = Best(len(a.at) if window else len(a.keys), k)
        beyond: dict[int, list] = {}
        for ids, labels, vectors in _batches(batches, size):
            for at in range(0, len(a.keys), TILE):
                tile = slice(at, min(at + TILE, len(a.keys)))
                scores, plain = products(a, tile, vectors)
                alike = labels[:, None] == a.labels[tile]
                if not window:
                    fits = alike & (ids[:, None] != a.ids[tile])
                    if plain:
                        best.add(tile, np.where(fits, scores, NONE), ids)
                    else:
                        for j in range(tile.stop - at):
                            _merge(beyond, _exact_top(scores[:, j], ids, fits[:, j], k, at + j), k)
                    continue
                # lanes lie in the order of their anchors
                lanes = slice(*np.searchsorted(a.at, [at, tile.stop]).tolist())
                of = a.at[lanes] - at
                p = a.score[lanes]
                if plain and (100 * np.abs(p.astype(np.float64)) < EXACT).all():
                    s = scores[:, of]
                    fits = ~alike[:, of] & (s <= p) & (100 * s >= 80 * p)
                    best.add(lanes, np.where(fits, s, NONE), ids)
                else:
                    for j in range(lanes.stop - lanes.start):
                        s, top = scores[:, of[j]].astype(object), int(p[j])
                        fits = ~alike[:, of[j]] & (100 * s >= 80 * top) & (s <= top)
                        _merge(beyond, _exact_top(s, ids, fits.astype(bool), k, lanes.start + j), k)
        lane, got, score = best.rows()
        rows = [*zip(lane.tolist(), got.tolist(), map(int, score.tolist()), strict=True), *(x for some in beyond.values() for x in some)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["lane", "id", "score"])

    found = candidates.mapInArrow(run, "lane long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def usable(vectors: DataFrame, id: Column, label: Column, vector: Column) -> DataFrame:
    """(id, label, v) of the rows that take part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(id.isNotNull() & label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(id.cast("long").alias("id"), label.cast("long").alias("label"), vector.cast("array<double>").alias("v"))


def groups(anchors: DataFrame) -> Iterator[Anchors]:
    """The anchors in groups of one vector length and at most GROUP_NUMBERS numbers and GROUP_ROWS rows (one block, if it has more), one at a time.

    Rows are numbered within their partition of the stored table, and blocks are runs of these numbers: of at
    most BLOCK_ROWS rows whatever the ids are.
    """
    row = F.monotonically_increasing_id()
    a = stored(anchors.withColumn("key", row).withColumn("size", F.size("v")), "anchors")
    names = ["size", "part", "run"]
    run = F.floor(F.col("key").bitwiseAND((1 << 33) - 1) / BLOCK_ROWS)
    a = a.withColumns({"part": F.shiftright("key", 33), "run": run})

    def load(together: list) -> Anchors:
        wanted = a.sparkSession.createDataFrame(together, a.select(*names).schema)
        rows = a.join(F.broadcast(wanted), names).orderBy("key").collect()
        v = integers(np.array([r["v"] for r in rows]).reshape(len(rows), together[0]["size"]))
        columns = [np.array([r[c] for r in rows], np.int64) for c in ("key", "id", "label")]
        return Anchors(*columns, v, int(np.abs(v).max(initial=0)))

    together: list = []
    n = 0
    for r in a.groupBy(*names).count().orderBy(*names).collect():
        if together and ((n + r["count"]) * max(r["size"], GROUP_NUMBERS // GROUP_ROWS) > GROUP_NUMBERS or together[0]["size"] != r["size"]):
            yield load(together)
            together, n = [], 0
        together.append({c: r[c] for c in names})
        n += r["count"]
    if together:
        yield load(together)
    discard(a)


def mine(rows: DataFrame, is_anchor: Column, k_positives: int = 5, k_negatives: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (id, label, v) of usable().

    Scores are integer inner products of floor(256 * x); higher ones come first, then smaller ids. An anchor's
    positives are its first k_positives other rows of its label; for each of them the first k_negatives rows of other labels with
    80 * positive_score <= 100 * negative_score <= 100 * positive_score are returned, ranked from 1.

    Every row meets every anchor, in blocks; a task keeps a bounded number of rows an anchor. Rows of the
    anchor's own id are no other rows. Repeated ids are rows of their own: an anchor that occurs twice has its results twice. Vectors of different
    lengths do not meet; those of no components score 0. Scores beyond 64 bits count as the nearest that fits. Without anchors, positives or
    negatives there are no rows.
    """
    spark = rows.sparkSession
    bound_batches(spark, 4096)
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = None
    for a in groups(rows.where(is_anchor)):
        positives = _best_of_tasks(rows, a, k_positives).orderBy("lane", "rank").collect()
        if not positives:
            continue
        a.at = np.array([r["lane"] for r in positives], np.int64)
        a.score = np.array([r["score"] for r in positives], np.int64)
        negatives = _best_of_tasks(rows, a, k_negatives)
        known = [(i, int(a.ids[r["lane"]]), r["id"], r["score"]) for i, r in enumerate(positives)]
        lanes = F.broadcast(spark.createDataFrame(known, "lane long, anchor_id long, positive_id long, positive_score long"))
        n = negatives.join(lanes, "lane").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        n = stored(n, "negatives")
        out = n if out is None else out.unionByName(n)
    return out if out is not None else spark.createDataFrame([], kind)
