"""Embedding near-dedup: exact threshold pairs by a dual traversal of cover trees.

Equal vectors become one with a multiplicity, and all are normalised in double precision. The
tree's top level is a bounded number of centres, every vector belongs to its nearest one, and a
centre's vectors are dealt into blocks of bounded size. Within a block, nested nets with
halving radii give the lower levels. Blocks of neighbouring centres form groups; a vector
travels to another group only if its own distance to one of that group's centres is at most the
centre's covering radius plus the distance that the cosine threshold stands for. There, pairs of
nodes are dropped level by level by the same bound, and taken as a whole where all of
their members must be links. What reaches the bottom is computed. A pair of groups returns link
counts and a forest that connects what is linked, never the links themselves.

Where vectors have no structure (all of them about equally far from each other) no exact method by
distances can rule groups out: every vector then travels to every group, so groups are as
large as a task's memory allows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import discard, join_one, mapped, stored

COSINE = 0.95
#: Vectors of a block, about.
BLOCK = 3000
#: Centres of the top level at most, for each vector length.
PIVOTS = 2048
#: Numbers that the vectors of a group have at most, about; small inputs are cut into GROUPS groups at least.
GROUP_NUMBERS, GROUPS = 4_000_000, 8
#: Radii of the nets that order the centres, and of the nested nets below them: each half of the one above.
UPPER, RADII = (1.0, 0.5), (0.5, 0.25, 0.125)
#: Node pairs that a traversal holds at a time, about.
HELD = 1_000_000
SLACK = 1e-9


def reach(cosine: float) -> float:
    """Distance of unit vectors at this cosine."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * cosine))


def usable(values: list | None) -> bool:
    """Whether a vector is there, not zero, and finite throughout."""
    if values is None or not len(values) or any(v is None for v in values):
        return False
    x = np.asarray(values, dtype=np.float64)
    return bool(np.isfinite(x).all() and x.any())


def net(x: np.ndarray, radii: tuple[float, ...]) -> np.ndarray:
    """(rows, levels): for each row the number of its centre on each level: greedy nets with these radii, each inside the one above."""
    dots = x.astype(np.float32) @ x.astype(np.float32).T
    out = np.zeros((len(x), len(radii)), np.int64)
    group = np.zeros(len(x), np.int64)
    for k, r in enumerate(radii):
        near = dots >= 1.0 - r * r / 2.0
        near &= group[:, None] == group[None, :]
        open_ = np.ones(len(x), bool)
        for i in range(len(x)):
            if open_[i]:
                mine = near[i] & open_
                mine[i] = True
                out[mine, k] = i
                open_ &= ~mine
        group = out[:, k]
    return out


def rows_of(data: list[bytes], dim: int, wide: bool) -> np.ndarray:
    """Unit vectors, in double precision, of vectors as they were given (32- or 64-bit floats)."""
    x = np.frombuffer(b"".join(data), "<f8" if wide else "<f4").reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Tree:
    """Nested nets over the rows of x: levels[k] = (starts, ends, centres, radii) of nodes, as runs of the row order."""

    def __init__(self, x: np.ndarray, labels: np.ndarray) -> None:
        order = np.lexsort(labels.T[::-1])
        self.order, self.x = order, x[order]
        labels = labels[order]
        self.levels = []
        for k in range(labels.shape[1]):
            new = np.ones(len(x), bool)
            new[1:] = (labels[1:, : k + 1] != labels[:-1, : k + 1]).any(axis=1)
            starts = np.nonzero(new)[0]
            ends = np.append(starts[1:], len(x))
            centres = self.x[starts]
            own = np.repeat(np.arange(len(starts)), ends - starts)
            d2 = np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", self.x, centres[own]))
            self.levels.append((starts, ends, centres, np.sqrt(np.maximum.reduceat(d2, starts))))
        n = np.arange(len(x))
        self.levels.append((n, n + 1, self.x, np.zeros(len(x))))

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 child (on the next level) of each node."""
        starts, ends = self.levels[level][:2]
        below = self.levels[level + 1][0]
        return np.searchsorted(below, starts), np.searchsorted(below, ends)


class Forest:
    """A spanning forest of links between numbered things, as they come."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        up = self.up
        live = up[p] != up[q]
        if not live.any():
            return
        for a, b in zip(p[live].tolist(), q[live].tolist(), strict=True):
            x, y = a, b
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((a, b))
        while (up != (over := up[up])).any():
            up = over
        self.up = up


def _children(a: Tree, b: Tree, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of children of the node pairs (i, j), in pieces of about HELD."""
    a0, a1 = (x[i] for x in a.children(level))
    b0, b1 = (x[j] for x in b.children(level))
    # node pairs of very many children are cut along the first side
    most = np.maximum(1, HELD // (b1 - b0))
    pieces = -(-(a1 - a0) // most)
    k = np.repeat(np.arange(len(i)), pieces)
    at = np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a0, a1 = a0[k] + at * most[k], np.minimum(a1[k], a0[k] + (at + 1) * most[k])
    b0, b1 = b0[k], b1[k]
    n = (a1 - a0) * (b1 - b0)
    total = np.cumsum(n)
    start = 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + HELD, "right")))
        m = n[start:end]
        k = np.repeat(np.arange(start, end), m)
        within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        wide = (b1 - b0)[k]
        yield a0[k] + within // wide, b0[k] + within % wide
        start = end


def traverse(a: Tree, b: Tree, ma: np.ndarray, mb: np.ndarray, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(links of a's rows, links of b's rows, forest of (row of a, row of b)), rows in tree order, weighted by multiplicity.

    same: a and b are one tree; each pair is then seen from both sides, and only a's counts matter.
    """
    far = reach(cosine) + SLACK
    sure = reach(cosine) - SLACK
    la, lb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    offset = 0 if same else len(a.x)
    forest = Forest(offset + len(b.x))
    sum_a, sum_b = np.concatenate([[0], np.cumsum(ma)]), np.concatenate([[0], np.cumsum(mb)])

    def whole(level: int, i: np.ndarray, j: np.ndarray) -> None:
        sa, ea = a.levels[level][:2]
        sb, eb = b.levels[level][:2]
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            s, e, t, f = int(sa[p]), int(ea[p]), int(sb[q]), int(eb[q])
            la[s:e] += sum_b[f] - sum_b[t]
            lb[t:f] += sum_a[e] - sum_a[s]
            forest.add(np.arange(s, e), np.full(e - s, t + offset))
            forest.add(np.full(f - t, s), np.arange(t, f) + offset)

    def visit(level: int, i: np.ndarray, j: np.ndarray) -> None:
        ca, ra = a.levels[level][2:]
        cb, rb = b.levels[level][2:]
        bottom = level == len(a.levels) - 1
        for at in range(0, len(i), 50_000):
            p, q = i[at : at + 50_000], j[at : at + 50_000]
            dot = np.einsum("ij,ij->i", ca[p], cb[q])
            if bottom:
                hit = dot >= cosine
                np.add.at(la, p[hit], mb[q[hit]])
                np.add.at(lb, q[hit], ma[p[hit]])
                forest.add(p[hit], q[hit] + offset)
                continue
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))
            all_in = d + ra[p] + rb[q] <= sure
            if same:
                all_in &= (p != q) | (2 * ra[p] <= sure)
            whole(level, p[all_in], q[all_in])
            near = (d <= far + ra[p] + rb[q]) & ~all_in
            if near.any():
                for x, y in _children(a, b, level, p[near], q[near]):
                    visit(level + 1, x, y)

    ca, ra = a.levels[0][2:]
    cb, rb = b.levels[0][2:]
    # a first look in single precision, with room for its error; single vectors apart from nodes that spread
    low_a, low_b = ca.astype(np.float32), cb.astype(np.float32)
    for part in (np.nonzero(rb == 0)[0], np.nonzero(rb > 0)[0]):
        if not len(part):
            continue
        rows = max(1, 10 * HELD // len(part))
        for at in range(0, len(ca), rows):
            room = np.minimum(far + ra[at : at + rows] + rb[part].max(), 2.0)
            p, q = np.nonzero(low_a[at : at + rows] @ low_b[part].T >= (1.0 - room**2 / 2.0 - 1e-4).astype(np.float32)[:, None])
            visit(0, p + at, part[q])
    return la, lb, [(p, q - offset) for p, q in forest.links]


def grouped(counts: np.ndarray, centres: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block of each cell, group of each block, number of groups): blocks of neighbouring cells share groups of about `limit` vectors."""
    blocks = -(-counts // BLOCK)
    first = np.cumsum(blocks) - blocks
    group = np.zeros(int(blocks.sum()), np.int64)
    labels = net(centres, UPPER)
    now, held = 0, 0
    for c in np.lexsort(labels.T[::-1]).tolist():
        for k in range(int(blocks[c])):
            n = counts[c] / blocks[c]
            if held and held + n > limit:
                now, held = now + 1, 0
            group[first[c] + k] = now
            held += n
    return first, group, now + 1


def links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing;
    vectors of different lengths are never linked. Equal vectors link with each other. vec_id
    should be unique; rows that repeat it count as vectors of their own and share a component; rows without
    one link with nothing (no component, kept null). Vectors of any length are compared whole.
    An empty table gives an empty result; other columns are ignored.
    """
    wide = vectors.schema[embedding].dataType.elementType != T.FloatType()
    code = "<f8" if wide else "<f4"

    def units(rows: list) -> tuple:
        good = [usable(v) for v in rows]
        return [len(v) if g else 0 for v, g in zip(rows, good, strict=True)], [np.asarray(v, code).tobytes() if g else None for v, g in zip(rows, good, strict=True)]

    given = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("_e"))
    base = stored(mapped(given, ["vec_id"], ["_e"], [T.StructField("dim", T.IntegerType()), T.StructField("unit", T.BinaryType())], units), "vectors")
    reps = base.where("dim > 0 and vec_id is not null").groupBy("dim", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    reps = stored(reps, "vector-classes")
    # centres: for each vector length a bounded number, by hash of the id
    sizes = reps.groupBy("dim").agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(F.col("n") / BLOCK)))
    share = (F.pmod(F.xxhash64("rep"), F.lit(1 << 40)) + 1) / float(1 << 40)
    drawn = reps.join(sizes, "dim").where(share <= wanted / F.col("n") + 3 / F.col("n")).select("dim", "rep", "unit")
    vectors_of: dict[int, list[tuple[int, bytes]]] = {}
    for r in drawn.collect():
        vectors_of.setdefault(r["dim"], []).append((r["rep"], r["unit"]))
    for r in sizes.join(drawn.select("dim").distinct(), "dim", "left_anti").join(reps, "dim").groupBy("dim").agg(F.min(F.struct("rep", "unit")).alias("x")).collect():
        vectors_of[r["dim"]] = [tuple(r["x"])]
    pivots = {dim: rows_of([u for _, u in sorted(v)[: PIVOTS + 3]], dim, wide) for dim, v in vectors_of.items()}

    def nearest(dims: list[int], vs: list[bytes]) -> tuple:
        cell, dist = [0] * len(dims), [0.0] * len(dims)
        for dim in set(dims):
            at = [k for k, d in enumerate(dims) if d == dim]
            x = rows_of([vs[k] for k in at], dim, wide)
            dots = x @ pivots[dim].T
            best = dots.argmax(axis=1)
            for k, c, v in zip(at, best.tolist(), dots.max(axis=1).tolist(), strict=True):
                cell[k], dist[k] = c, math.sqrt(max(0.0, 2.0 - 2.0 * v))
        return cell, dist

    located = mapped(reps, ["dim", "unit", "rep", "m"], ["dim", "unit"], [T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())], nearest)
    located = stored(located, "vector-cells")
    counts = {dim: np.zeros(len(x), np.int64) for dim, x in pivots.items()}
    radius = {dim: np.full(len(x), -np.inf) for dim, x in pivots.items()}
    for r in located.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("far")).collect():  # a row a centre
        counts[r["dim"]][r["cell"]], radius[r["dim"]][r["cell"]] = r["n"], r["far"]
    within = {dim: radius[dim] + reach(cosine) + SLACK for dim in pivots}
    plan = {dim: grouped(counts[dim], x, min(GROUP_NUMBERS // dim, max(BLOCK, int(counts[dim].sum()) // GROUPS))) for dim, x in pivots.items()}

    def block_of(dims: list[int], cs: list[int], drawn: list[int]) -> tuple:
        return ([h % max(1, -(-int(counts[d][c]) // BLOCK)) for d, c, h in zip(dims, cs, drawn, strict=True)],)

    blocks = located.withColumn("_h", F.pmod(F.xxhash64("rep"), F.lit(1 << 40)))
    blocks = mapped(blocks, ["dim", "unit", "rep", "m", "cell"], ["dim", "cell", "_h"], [T.StructField("block", T.IntegerType())], block_of)

    def nets(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        ids = b["rep"].to_numpy()
        centres = net(rows_of(b["unit"].tolist(), int(b["dim"].iloc[0]), wide), RADII)
        return pd.DataFrame({"dim": b["dim"], "unit": b["unit"], "rep": ids, "m": b["m"], "cell": b["cell"], "block": b["block"], **{f"net{k}": ids[centres[:, k]] for k in range(len(RADII))}})

    fields = "dim int, unit binary, rep long, m long, cell int, block int" + "".join(f", net{k} long" for k in range(len(RADII)))
    blocks = stored(blocks.groupBy("dim", "cell", "block").applyInPandas(nets, fields), "vector-blocks")

    def meetings(dims: list[int], vs: list[bytes], cs: list[int], bs: list[int]) -> tuple:
        """Each row goes to the pairs of its group with every group it may have links in: row, pair, and whether it is the first side."""
        rows, pair, first = [], [], []
        for dim in set(dims):
            start, group, n_groups = plan[dim]
            at = np.array([k for k, d in enumerate(dims) if d == dim])
            x = rows_of([vs[k] for k in at], dim, wide)
            own = group[start[[cs[k] for k in at]] + np.array([bs[k] for k in at])]
            # cells by group, each once
            held = np.unique(np.stack([group, np.repeat(np.arange(len(start)), np.diff([*start, len(group)]))]), axis=1)
            near = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots[dim].T))) <= within[dim]
            goes = np.logical_or.reduceat(near[:, held[1]], np.searchsorted(held[0], np.arange(n_groups)), axis=1)
            goes[np.arange(len(at)), own] = True
            for k, other in zip(*np.nonzero(goes), strict=True):
                low, high = sorted((int(own[k]), int(other)))
                rows.append(int(at[k]))
                pair.append(f"{dim}:{low}:{high}")
                first.append(int(own[k]) == low)
        return rows, pair, first

    nets_of = [f"net{k}" for k in range(len(RADII))]
    pairs = mapped(blocks, ["dim", "unit", "rep", "m", "cell", "block", *nets_of], ["dim", "unit", "cell", "block"], [T.StructField("pair", T.StringType()), T.StructField("first", T.BooleanType())], meetings, rows=True)

    def dual(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        def trees(d: pd.DataFrame) -> list[tuple[Tree, np.ndarray, np.ndarray]]:
            out = []
            for _, g in d.groupby(["cell", "block"]):
                tree = Tree(rows_of(g["unit"].tolist(), int(g["dim"].iloc[0]), wide), g[nets_of].to_numpy())
                out.append((tree, g["rep"].to_numpy()[tree.order], g["m"].to_numpy()[tree.order]))
            return out

        _, low, high = key[0].split(":")
        one = low == high
        left = trees(b[b["first"]])
        right = left if one else trees(b[~b["first"]])
        counts: Counter[int] = Counter()
        ids = np.sort(b["rep"].unique())
        forest = Forest(len(ids))
        for k, (ta, ia, ma) in enumerate(left):
            for tb, ib, mb in right[k if one else 0 :]:
                la, lb, links_ = traverse(ta, tb, ma, mb, cosine, ta is tb)
                if ta is tb:
                    la, lb = la - ma, lb[:0]  # a vector is no link of itself; its copies count elsewhere
                for rep, n in ((ia, la), (ib, lb)):
                    some = np.nonzero(n)[0]
                    counts.update(dict(zip(rep[some].tolist(), n[some].tolist(), strict=True)))
                if links_:
                    p, q = np.array(links_).T
                    forest.add(np.searchsorted(ids, ia[p]), np.searchsorted(ids, ib[q]))
        rows = [*((r, n, -1) for r, n in counts.items()), *((int(ids[p]), 0, int(ids[q])) for p, q in forest.links)]
        return pd.DataFrame(rows, columns=["rep", "n", "other"]).astype("int64")

    found = stored(pairs.groupBy("pair").applyInPandas(dual, "rep long, n long, other long"), "vector-links")
    counts = found.where("n <> 0").groupBy("rep").agg(F.sum("n").alias("n"))
    at = components(found.where("n = 0 and rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_class = reps.join(counts, "rep", "left").join(at.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("dim", "unit", "m", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_class = stored(of_class, "vector-results")
    discard(reps, located, blocks, found)
    # a vector that very many rows repeat stays where its rows are; rows without a vector or an id ask for none
    known = F.col("vec_id").isNotNull()
    linked = known & (F.col("dim") > 0)
    out = join_one(base.where(linked), of_class, ["dim", "unit"], n="m")
    none = {c: F.lit(None).cast("long") for c in ("n_links", "component_id")}
    out = out.unionByName(base.where(~linked | F.col("dim").isNull()).withColumns(none))
    out = out.select("vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
