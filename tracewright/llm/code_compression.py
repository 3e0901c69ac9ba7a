"""Vector code compression: product codes whose codebooks are fitted by Elkan's form of Lloyd's rounds.

Vectors are integers, cut into equal parts; each part position has a codebook of its own. A row keeps, beside
its codes, one upper bound a part (on the distance to the entry it is assigned to) and one lower bound a part and entry.
When entries move, bounds are shifted by how far they moved, and an entry's distance is looked at only where
the bounds leave it open: the upper bound must lie strictly below the entry's lower bound, or strictly below half the
distance between the two entries, to rule it out. What is looked at is compared as integers, so that ties go to
the lower index exactly.

The bounds travel with the rows from round to round as stored tables. They are kept as one byte a lower
bound, rounded down in steps of the part's range, and four an upper bound, rounded up; both stay bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches, discard, join_one, stored

SCALE = 256
#: Components up to this size have exact squared distances in 64 bits; larger ones are reckoned as Python integers.
PLAIN = 1 << 26
#: Rounding of sums and roots in doubles is far below this share.
SLACK = 1e-9


@dataclass
class Codebooks:
    """entries[part, entry, position]; half_gaps: half the distances between entries of a part; moved: how far each came last."""

    entries: np.ndarray
    moved: np.ndarray
    half_gaps: np.ndarray
    step: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None, step: np.ndarray) -> Codebooks:
        gap = squared(entries[:, :, None, :], entries[:, None, :, :])
        half = np.sqrt(gap.astype(np.float64)) / 2
        moved = np.zeros(entries.shape[:2]) if before is None else np.sqrt(squared(entries, before).astype(np.float64))
        return cls(entries, moved, half, step)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.reshape(-1)).encode()).hexdigest()


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the lists of this size in an array of lists without nulls, and their values as rows."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = lengths == size
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.nonzero(fits)[0], values[np.repeat(fits, lengths)].reshape(-1, size)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: 64-bit integers, or Python's where a component is larger than PLAIN."""
    x = np.floor(np.asarray(values, np.float64) * SCALE)
    if x.size and np.abs(x).max() > PLAIN:
        return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)
    return x.astype(np.int64)


def assign(parts: np.ndarray, books: Codebooks, codes: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, upper, lower, squared distances, distances looked at) of parts[row, part, position] for the moved codebooks.

    Without bounds, all entries are looked at. Codes are the nearest entries, ties to the lower index.
    """
    n, n_parts, _ = parts.shape
    n_entries = books.entries.shape[1]
    row, part = np.arange(n)[:, None], np.arange(n_parts)[None, :]
    if codes is None:
        exact = np.stack([squared(parts, books.entries[None, :, e, :]) for e in range(n_entries)], 2)
        codes = exact.argmin(2)
        lower = np.sqrt(exact.astype(np.float64))
        best = exact[row, part, codes]
        return codes, lower[row, part, codes], lower, best, exact.size
    upper = upper + books.moved[part, codes]
    lower = np.maximum(lower - books.moved[None], 0)
    own = np.arange(n_entries) == codes[:, :, None]
    bound = np.maximum(lower, books.half_gaps[part, codes]) * (1 - SLACK)
    open_ = (upper[:, :, None] * (1 + SLACK) >= bound) & ~own
    # the upper bound is made tight where anything is open, which closes most of it
    best = squared(parts, books.entries[part, codes])
    tight = np.sqrt(best.astype(np.float64))
    asked = open_.any(2)
    upper = np.where(asked, tight, upper)
    open_ &= upper[:, :, None] * (1 + SLACK) >= bound
    looked = int(asked.sum())
    codes = codes.copy()
    start = codes.copy()
    for e in range(n_entries):
        i, p = np.nonzero(open_[:, :, e])
        if not len(i):
            continue
        # a better entry found meanwhile may rule this one out
        free = upper[i, p] * (1 + SLACK) >= np.maximum(lower[i, p, e], books.half_gaps[p, codes[i, p], e]) * (1 - SLACK)
        i, p = i[free], p[free]
        looked += len(i)
        d = squared(parts[i, p], books.entries[p, e])
        root = np.sqrt(d.astype(np.float64))
        lower[i, p, e] = root
        better = (d < best[i, p]) | ((d == best[i, p]) & (e < codes[i, p]))
        i, p = i[better], p[better]
        codes[i, p], best[i, p], upper[i, p] = e, d[better], root[better]
    moved_off = codes != start
    lower[row, part, start] = np.where(moved_off | asked, tight, lower[row, part, start])
    return codes, upper, lower, best, looked


def _packed(codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Codes, upper bounds rounded up, lower bounds rounded down, as bytes a row."""
    up = np.nextafter(upper.astype(np.float32), np.float32(np.inf)).astype("<f4")
    low = np.minimum(np.floor(lower / step[None, :, None] * (1 - SLACK)), 255).astype(np.uint8)
    return [c.tobytes() for c in codes.astype(np.uint8)], [u.tobytes() for u in up], [x.tobytes() for x in low]


def _pass(df: DataFrame, books: Codebooks, last: bool) -> DataFrame:
    """One assignment of all rows (vec_id, label, v and, after the first pass, codes, upper, lower), in batches."""
    n_parts, n_entries, width = books.entries.shape
    has_bounds = "codes" in df.columns
    bound_batches(df.sparkSession, 2048)
    shared = df.sparkSession.sparkContext.broadcast(books)
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    ids = [f"{c} {kind[c]}" for c in ("vec_id", "label")]
    schema = ", ".join([*ids, "code string, error long"] if last else [*ids, "v array<double>, codes binary, upper binary, lower binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            parts = integers(matrix(v, n_parts * width)[1]).reshape(b.num_rows, n_parts, width)
            bounds = (None, None, None)
            if has_bounds:
                read = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind)
                codes = read("codes", np.uint8).reshape(-1, n_parts).astype(np.int64)
                upper = read("upper", "<f4").reshape(-1, n_parts).astype(np.float64)
                lower = read("lower", np.uint8).reshape(-1, n_parts, n_entries) * books.step[None, :, None]
                bounds = (codes, upper, lower)
            codes, upper, lower, best, _ = assign(parts, books, *bounds)
            kept = [b.column("vec_id"), b.column("label")]
            if last:
                error = [e if abs(e) < 1 << 63 else None for e in map(int, best.sum(1))]
                new = [pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)]), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=["vec_id", "label", "code", "error"])
            else:
                new = [pa.array(x, pa.binary()) for x in _packed(codes, upper, lower, books.step)]
                yield pa.RecordBatch.from_arrays([*kept, v, *new], names=["vec_id", "label", "v", "codes", "upper", "lower"])

    return df.mapInArrow(run, schema)


def _means(assigned: DataFrame, books: Codebooks) -> np.ndarray:
    """Entries as the componentwise floors of their parts' means; unused ones stay. A task adds its rows up first."""
    n_parts, n_entries, width = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_parts, n_entries), np.int64)
        totals = np.zeros((n_parts, n_entries, width), object)
        for b in batches:
            parts = integers(matrix(b.column("v"), n_parts * width)[1]).reshape(b.num_rows, n_parts, width)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, n_parts)
            some = np.zeros((n_parts, n_entries, width), parts.dtype)
            for p in range(n_parts):
                np.add.at(some[p], codes[:, p], parts[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=n_entries)
            totals += some
        p, e = np.nonzero(counts)
        names = ["part", "entry", "n", "total"]
        text = [[str(x) for x in totals[i, j]] for i, j in zip(p, e, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()), pa.array(text, pa.list_(pa.string()))], names=names)

    # totals are decimals of 38 digits: beyond any sum of 64-bit products' roots
    partial = assigned.select("v", "codes").mapInArrow(sums, "part int, entry int, n long, total array<string>")
    each = [F.sum(F.element_at("total", i + 1).cast("decimal(38,0)")).cast("string").alias(f"t{i}") for i in range(width)]
    entries = books.entries.copy()
    if entries.dtype != object:
        entries = entries.astype(object)
    for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
        entries[r["part"], r["entry"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return entries if np.abs(entries).max(initial=0) > PLAIN else entries.astype(np.int64)


def compress(vectors: DataFrame, n_parts: int = 16, n_entries: int = 64, rounds: int = 2, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error, label_error) of every vector, and the fitted codebooks.

    Components are floor(256 * x) in double precision. Codebooks start as the parts of the n_entries smallest ids (equal
    ids by their components, rows without id last; all, if there are fewer). `rounds` times every part goes to its nearest entry and entries become the floors of their parts'
    means; then parts are assigned once more. code: two hex digits a part; error: squared distances summed over the parts;
    label_error: errors summed over equal labels, nulls together.

    Rows with a null vector or a null or non-finite component go. So do vectors that are not as long as the one of
    smallest id, or whose length is no multiple of n_parts. Repeated rows count each by itself. Components of any size are exact; an error beyond 64 bits is null.
    An empty table gives an empty result, with codebooks of no entries. Columns beside the three named are left out.
    At most 256 entries; what goes through the driver is the codebooks: n_entries vectors.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("a code has two hex digits")
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(f"`{id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), v.cast("array<double>").alias("v"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    size = len(first[0]["v"]) if first else 0
    fits = rows.where((F.size("v") == size) & F.lit(size > 0 and size % n_parts == 0))
    start = [r["v"] for r in fits.orderBy(F.asc_nulls_last("vec_id"), "v").limit(n_entries).collect()]
    width = size // n_parts if start else 1
    entries = integers(np.array(start)).reshape(-1, n_parts, width).transpose(1, 0, 2) if start else np.zeros((n_parts, 0, width), np.int64)
    if not start:
        none = rows.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none, Codebooks.of(entries, None, np.ones(n_parts))
    # one byte spans the distances between entries that there are at first; larger lower bounds count as the largest
    books = Codebooks.of(entries, None, np.ones(n_parts))
    books.step = np.maximum(books.half_gaps.max((1, 2)) * 2, 1) / 255
    now = fits
    for _ in range(rounds):
        spent, now = now, stored(_pass(now, books, False), "codes")
        discard(spent)
        books = Codebooks.of(_means(now, books), books.entries, books.step)
    out = stored(_pass(now, books, True), "codes-last")
    discard(now)
    totals = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_rows"))
    return join_one(out, totals, ["label"], n="_rows", nulls=True), books
