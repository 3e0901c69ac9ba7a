"""Harmonic packing of token sequences.

Capacity C and the classes k = 1, 2, 3, ... of pieces with at most C/k tokens: a bin of class k
takes k pieces, whatever their exact lengths, so a bin is known from a row's number alone and
every worker fills its bins independently. Documents are cut so that little is padded: a piece
whose class would waste over TOLERANCE of a bin gives off a head of exactly floor(C/(k+1))
tokens, which fills class k+1 to the brim, and the tail is classed again. Bins that stay short
of k pieces at the end of a worker's rows are packed once more, first fit by decreasing
length, over all classes of that worker: a bounded number of pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped, stored

CAPACITY = 4096
TOLERANCE = 0.01
#: Pieces this short are never cut.
SHORTEST = 64
#: Pieces that one worker numbers, about.
GROUP_PIECES = 10_000
#: Parts that a worker remembers at least.
MEMO = 500_000
# The normaliser and splitter under which blanks part words and are dropped.
BLANKS_DROPPED = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
#: Latin letters that lower-case to one letter each (so not U+0130), and the ASCII signs that may follow; the apostrophe starts endings.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_WORD = re.compile(f"[{_LETTER}]+")
_BEFORE_SIGN = re.compile(rf"(?<=[{_LETTER}])(?=[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~])")


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if rest <= SHORTEST or capacity - k * rest <= TOLERANCE * capacity:
            out.append(rest)
            break
        head = capacity // (k + 1)
        out.append(head)
        rest -= head
    return out


class _Ids:
    """The ids (little-endian 32-bit bytes) of texts, by the tokenizer itself, with a memory for the parts between blanks.

    A vocabulary that normalises and splits as in BLANKS_DROPPED gives a text the ids of its parts one
    by one, also where a blank more stands between a letter and a sign. Parts of letters only are one
    word each, so many of them go through the tokenizer together and their ids are told apart
    by the word ends. Any other vocabulary encodes whole texts.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        suffix = kind["model"].get("end_of_word_suffix")
        self.apart = [kind["normalizer"], kind["pre_tokenizer"]] == BLANKS_DROPPED and suffix == "</w>" and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in kind["added_tokens"])
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: set[str]) -> None:
        known, old, words = self.known, self.old, []
        for x in parts:
            if (got := old.get(x)) is not None:
                known[x] = got
            elif _WORD.fullmatch(x):
                words.append(x)
            else:
                known[x] = self.whole(x)
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(self.is_end[ids])[0] + 1
            if len(ends) == len(some):
                data = ids.tobytes()
                starts = [0, *ends[:-1].tolist()]
                known.update(zip(some, [data[4 * i : 4 * j] for i, j in zip(starts, ends.tolist(), strict=True)], strict=True))
            else:
                known.update((x, self.whole(x)) for x in some)

    def of_texts(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 64):
            some = [t or "" for t in texts[at : at + 64]]
            if not self.apart:
                yield from map(self.whole, some)
                continue
            # ASCII letters are lowered for good by the vocabulary; its special tokens are not
            some = [t.lower() if t.isascii() and "<|" not in t else t for t in some]
            split = [(t if "<|" in t else _BEFORE_SIGN.sub(" ", t)).replace("\n", " ").split(" ") for t in some]
            if len(self.known) >= MEMO:
                self.old, self.known = self.known, {}
            self.learn(set().union(*split).difference(self.known))
            for parts in split:
                yield b"".join(map(self.known.__getitem__, parts))


@lru_cache(maxsize=1)
def _ids(path: str) -> _Ids:
    return _Ids(path)


def tokens(docs: DataFrame, path: str, end_id: int, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian 32 bits each), doc_tokens.

    Ids are those of the tokenizer for each whole text, without special tokens added. Null and empty texts
    have end_id alone; very long ones become many pieces; equal rows equal pieces. Columns other than
    doc_id are left out.
    """

    def work(texts: list[str]) -> tuple:
        end = end_id.to_bytes(4, "little")
        at, starts, lengths, parts, totals = [], [], [], [], []
        for i, ids in enumerate(_ids(path).of_texts(texts)):
            data, start = ids + end, 0
            for length in cuts(len(data) // 4, capacity):
                at.append(i)
                starts.append(start)
                lengths.append(length)
                parts.append(data[4 * start : 4 * (start + length)])
                totals.append(len(data) // 4)
                start += length
        return at, starts, lengths, parts, totals

    kinds = {"start": T.LongType(), "length": T.LongType(), "ids": T.BinaryType(), "doc_tokens": T.LongType()}
    return mapped(docs, ["doc_id"], [text], [T.StructField(n, k) for n, k in kinds.items()], work, rows=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset (tokens before it in its sequence, gapless from 0) to pieces (doc_id, start, length, ...).

    Ties and repeated rows: pieces of one class are interchangeable; each row gets its own place.
    An empty table gives an empty result.
    """
    p = stored(pieces.drop("sequence_id", "offset"), "packing-pieces")
    groups = max(1, -(-p.count() // GROUP_PIECES))
    p = p.withColumn("_k", F.floor(F.lit(capacity) / F.col("length")).cast("long"))
    p = p.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    own = Window.partitionBy("_g", "_k")
    p = p.withColumn("_r", F.row_number().over(own.orderBy("doc_id", "start")) - 1).withColumn("_n", F.count("*").over(own))
    p = p.withColumn("_bin", F.floor(F.col("_r") / F.col("_k")))
    p = stored(p, "packing-bins")
    full = p.where((F.col("_bin") + 1) * F.col("_k") <= F.col("_n"))
    # worker, class and bin in one number: bits 62-40 the worker, 39-27 the class, 26-0 the bin; class 0 holds leftovers
    base = F.shiftleft(F.col("_g").cast("long"), 40)
    full = full.withColumn("sequence_id", base + F.shiftleft(F.col("_k"), 27) + F.col("_bin").cast("long"))
    in_bin = Window.partitionBy("sequence_id").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long")).drop("_k", "_g", "_r", "_n", "_bin")
    short = p.where((F.col("_bin") + 1) * F.col("_k") > F.col("_n")).drop("_r", "_n", "_bin", "_k")

    def leftovers(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        free: list[int] = []
        where, offset = [], []
        for n in b["length"]:
            i = next((i for i, f in enumerate(free) if f >= n), len(free))
            if i == len(free):
                free.append(capacity)
            where.append(i)
            offset.append(capacity - free[i])
            free[i] -= n
        b = b.assign(sequence_id=[(int(key[0]) << 40) + i for i in where], offset=offset)
        return b.drop(columns=["_g"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in short.drop("_g").schema) + ", sequence_id long, offset long"
    return full.unionByName(short.groupBy("_g").applyInPandas(leftovers, schema))
