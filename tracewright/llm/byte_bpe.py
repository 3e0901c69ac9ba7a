"""Byte-level BPE encoding and decoding with a rank queue.

A pre-token's bytes form a linked list; every adjacent pair that has a merge rank lies in the
bucket of that rank (a heap of positions). Which buckets hold anything is kept in a two-level
bitmap, so that find-first-set gives the next rank at once; entries whose pair has changed
meanwhile are skipped. Cost per pre-token: proportional to its length, times a logarithm only
where one rank occurs many times, so pre-tokens of any length are fine.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import Memo, bound_batches

#: Distinct pre-tokens that one worker remembers at least.
MEMO = 500_000
#: The bitmap's words have 2 ** BITS bits.
BITS = 8
LOW = (1 << BITS) - 1


class RankBpe:
    """The merges of a rank file, and the pattern that splits texts first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.of_byte = [ranks[bytes([b])] for b in range(256)]
        # rank of every pair of ids that is an id again, by both ids in one number
        self.pairs = {}
        for b, i in ranks.items():
            for at in range(1, len(b)):
                left, right = ranks.get(b[:at]), ranks.get(b[at:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = i
        self.memo = Memo(self.packed, MEMO)

    @classmethod
    def load(cls, path: str, pattern: str) -> RankBpe:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.

        The queue lies in three local tables, as calls would cost more than the work: `buckets` holds the
        positions of each rank (a single one, or a heap once the rank occurs more than once at a
        time), `words` and `top` are the bitmap of ranks that have a bucket.
        """
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        get = self.pairs.get
        n = len(piece)
        part = list(map(self.of_byte.__getitem__, piece))
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        now = [get(a << 32 | b, -1) for a, b in pairwise(part)]  # rank of the pair that starts here
        now.append(-1)
        buckets: dict[int, int | list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        fresh = [(r, i) for i, r in enumerate(now) if r >= 0]
        while True:
            for r, at in fresh:
                had = buckets.get(r)
                if had is None:
                    buckets[r] = at
                    high = r >> BITS
                    word = words.get(high, 0)
                    words[high] = word | 1 << (r & LOW)
                    if not word:
                        top |= 1 << high
                elif had.__class__ is int:
                    buckets[r] = [had, at] if had < at else [at, had]
                else:
                    heappush(had, at)
            if not top:
                break
            # find-first-set on both levels gives the least rank
            high = (top & -top).bit_length() - 1
            word = words[high]
            low = word & -word
            rank = high << BITS | low.bit_length() - 1
            i = buckets[rank]
            if i.__class__ is int:
                del buckets[rank]
                words[high] = word = word ^ low
                if not word:
                    top &= top - 1
            else:
                had, i = i, heappop(i)
                if len(had) == 1:
                    buckets[rank] = had[0]
            if now[i] != rank:  # stale
                fresh = ()
                continue
            j = after[i]
            part[i] = rank  # a merged pair's id is its rank
            k = after[i] = after[j]
            now[j] = -1
            fresh = []
            if k < n:
                before[k] = i
                r = now[i] = get(rank << 32 | part[k], -1)
                if r >= 0:
                    fresh.append((r, i))
            else:
                now[i] = -1
            h = before[i]
            if h >= 0:
                r = now[h] = get(part[h] << 32 | rank, -1)
                if r >= 0:
                    fresh.append((r, h))
        ids, i = [], 0
        while i < n:
            ids.append(part[i])
            i = after[i]
        return ids

    def packed(self, piece: str) -> bytes:
        return np.array(self.merge(piece.encode()), dtype="<i4").tobytes()

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text as int32."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.pattern.findall(text))), dtype="<i4")


@lru_cache(maxsize=1)
def _loaded(path: str, pattern: str) -> RankBpe:
    return RankBpe.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replaces column `text` by `ids` (array of int): every match of `pattern` is merged on its own, no special tokens.

    Null and empty texts give an empty array. Other columns stay as they are; one named like
    `ids` is replaced. Rows are independent, so repeats and ties need no rule.
    """
    bound_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern)
        for batch in batches:
            out = [bpe.ids(x or "") for x in batch.column(len(rest)).to_pylist()]
            offsets = np.zeros(len(out) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in out], out=offsets[1:])
            values = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
            kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists], names=[*rest, ids])

    return docs.select(*rest, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds `data` (binary): the bytes of the ids. Null and empty arrays give empty bytes; unknown ids are an error."""
    bound_batches(encoded.sparkSession)
    rest = [c for c in encoded.columns if c != data]
    at = rest.index(ids)
    schema = T.StructType([*[encoded.schema[c] for c in rest], T.StructField(data, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _loaded(path, pattern).bytes_of.__getitem__
        for batch in batches:
            lists = batch.column(at)
            out = []
            for row in lists:
                values = row.values
                out.append(b"" if values is None else b"".join(map(of, values.to_numpy().tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*rest, data])

    return encoded.select(*rest).mapInArrow(run, schema)
