"""Token counts by a compiled tokenizer: a deterministic transducer over bytes.

What a vocabulary of merges makes of a word is fixed by its neighbours alone: a sequence of tokens is the
tokenizer's own exactly if every two that meet would stay apart by themselves. So each beginning of a
word has one last token, and a state needs no more than the words' ends that may still grow into a
token, each with the token before it. `Transducer` compiles these states as texts need them; a
transition carries the number of tokens that it adds to (or takes from) those emitted so far, and the last
byte of a word, a symbol of its own, leads back to the start.

A text is cut into chunks of about equal length. A chunk that begins with a word has a constant map: whatever came before,
it is entered at the start state. One that begins within a long word has a map from the states that it may be entered in to
the states it leaves. All chunks run side by side, a symbol a step; then the maps compose by a parallel prefix scan, which
gives each chunk the state that it is really entered in. A state that no map holds yet is added and the scan is run again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .harmonic_packing import BLANKS_DROPPED
from .shared import mapped

#: Symbols of a chunk, about, and how far back a chunk's begin moves to find the begin of a word.
CHUNK = 48
REACH = 32
#: Symbols that run at once, and compiled states that a worker keeps from one such run to the next.
SPAN = 1 << 16
STATES = 1 << 16
#: Tokens below a node up to which a state names those that may still come instead of the token before.
FEW = 32
START = 0
#: In place of the tokens that a transition adds, where it is not compiled yet.
UNKNOWN = -128
SPACE, LETTER, NUMBER, OTHER, UNSEEN = range(5)
# The endings that the splitter takes as words of their own.
ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
#: Texts of these characters only are composed already, and lower-case one by one (so U+0130 is not among them).
_SETTLED = re.compile(
    "[\\x00-įı-˿Ѐ-҂Ҋ-ԯ‐-‧‰-⁞₠-₿、-〩ぁ-ゖァ-ヺ一-鿿가-힣！-～]*"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Merges:
    """The tokens of a vocabulary as strings of symbols (a byte, plus 256 on a word's last), and which of them may meet."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], end: str) -> None:
        byte = {c: b for b, c in enumerate(byte_letters())}

        def symbols(token: str) -> list[int]:
            last = token.endswith(end)
            out = [byte[c] for c in (token[: -len(end)] if last else token)]
            return [*out[:-1], out[-1] + 256] if last else out

        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pair, made = (vocabulary[a], vocabulary[b]), vocabulary[a + b]
            self.rank[pair] = rank
            self.halves[made] = pair
            self.made_at[made] = rank
        #: (node, symbol) -> node; token_at[node]: the token spelled by the way to the node, or -1
        self.child: dict[tuple[int, int], int] = {}
        self.token_at, self.grows = [-1], [False]
        self.known: dict[tuple[int, int], bool] = {}
        for token, i in vocabulary.items():
            if i in self.halves and not self.whole(i):
                continue
            node = 0
            for s in symbols(token):
                self.grows[node] = True
                nxt = self.child.get((node, s))
                if nxt is None:
                    nxt = self.child[node, s] = len(self.token_at)
                    self.token_at.append(-1)
                    self.grows.append(False)
                node = nxt
            self.token_at[node] = i
        #: tokens below each node, where they are few; children have greater numbers than their parents
        self.below: list[list[int] | None] = [[] for _ in self.token_at]
        for (above, _), node in sorted(self.child.items(), key=lambda x: -x[1]):
            own, deeper = self.below[above], self.below[node]
            if own is None or deeper is None or len(own) + len(deeper) >= FEW:
                self.below[above] = None
            else:
                own.extend(deeper if self.token_at[node] < 0 else [*deeper, self.token_at[node]])
        self.classes: dict[tuple[int, int], tuple[bool, int | tuple[int, ...]]] = {}

    def whole(self, token: int) -> bool:
        """The token is what the merges make of its own spelling: its halves are, and meet at no earlier merge than this one."""
        a, b = self.halves[token]
        return all(x not in self.halves or self.whole(x) for x in (a, b)) and self._apart(a, b, self.made_at[token])

    def apart(self, a: int, b: int) -> bool:
        """Tokens a and b, one after the other, stay as they are."""
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 1 << 20:
                self.known.clear()
            got = self.known[a, b] = self._apart(a, b, len(self.rank))
        return got

    def still(self, node: int, before: int) -> tuple[bool, int | tuple[int, ...]]:
        """Whether a token below the node may follow the token `before`, and what stands for `before` there: tokens that forbid
        the same ones are alike, and those that forbid none are like no token (-1)."""
        got = self.classes.get((node, before))
        if got is None:
            if len(self.classes) > 1 << 20:
                self.classes.clear()
            under = self.below[node]
            if under is None:
                got = True, before
            else:
                may = tuple(t for t in under if self.apart(before, t))
                got = bool(may), -1 if len(may) == len(under) else may
            self.classes[node, before] = got
        return got

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge of a rank below `before` ever joins something across the border of a and b.

        The parts beside the border are taken back in time, the younger first. While x and y stand beside it, from their own
        making until `until`, their merge must not come up. Equal merges go from the left: one that makes
        the part on the left of the border wins over the one across it, which wins over one on its right.
        """
        x, y = a, b
        until = (before, 0)
        while True:
            rank = self.rank.get((x, y))
            if rank is not None and (rank, 1) < until:
                return False
            made_x, made_y = self.made_at.get(x, -1), self.made_at.get(y, -1)
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                until, x = (made_x, 0), self.halves[x][1]
            else:
                until, y = (made_y, 2), self.halves[y][0]


class Transducer:
    """States and transitions, compiled where they are first met.

    A state is the list of (node, before, ahead): a way into the tokens' tree that the last symbols went, the last token
    before these symbols (-1: none that matters; or the tokens below the node that may follow it) and how many tokens fewer
    there were. The state of no symbols is START.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: START}
        self.next = np.full((1024, 256), -1, np.int32)
        self.adds = np.full((1024, 512), UNKNOWN, np.int8)

    def add(self, key: tuple) -> int:
        """A new state's number."""
        to = self.number[key] = len(self.states)
        self.states.append(key)
        if to == len(self.next):
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.adds = np.concatenate([self.adds, np.full_like(self.adds, UNKNOWN)])
        return to

    def compile(self, state: int, symbol: int) -> None:
        """The transition of a state by a symbol: the one token that may end here tells how many there are now."""
        m = self.merges
        found, ways = None, []
        for node, before, ahead in self.states[state]:
            node = m.child.get((node, symbol))
            if node is None:
                continue
            token, listed = m.token_at[node], isinstance(before, tuple)
            if found is None and token >= 0 and (token in before if listed else before < 0 or m.apart(before, token)):
                found = (token, ahead + 1)
            if not m.grows[node]:
                continue
            if listed:
                under = m.below[node]
                may = tuple(t for t in under if t in before)
                goes, before = bool(may), -1 if len(may) == len(under) else may
            else:
                goes, before = m.still(node, before) if before >= 0 else (True, -1)
            if goes:
                ways.append((node, before, ahead))
        if found is None:
            raise ValueError("a symbol that is no token of the vocabulary")
        token, adds = found
        self.adds[state, symbol] = adds
        if symbol < 256:
            key = (*((n, b, a - adds) for n, b, a in ways), (0, token, 0))
            self.next[state, symbol] = self.number[key] if key in self.number else self.add(key)

    def run(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Lanes begins[i]:ends[i] from states[i], side by side: the states they leave, and by step the tokens added, lanes in the order returned (longest first)."""
        order = np.argsort(begins - ends, kind="stable")
        at, left, now = begins[order], (ends - begins)[order], states[order].astype(np.int32)
        added = []
        alive = len(at)
        for step in range(int(left[0]) if len(left) else 0):
            while left[alive - 1] <= step:
                alive -= 1
            s, y = now[:alive], symbols[at[:alive] + step]
            while ((adds := self.adds[s, y]) == UNKNOWN).any():
                new = adds == UNKNOWN
                for a, b in {*zip(s[new].tolist(), y[new].tolist(), strict=True)}:
                    self.compile(a, b)
            added.append(adds)
            now[:alive] = np.where(y < 256, self.next[s, y & 255], START)
        out = np.empty_like(now)
        out[order] = now
        return out, added, order

    def emitted(self, symbols: np.ndarray, entry: tuple) -> tuple[np.ndarray, tuple]:
        """The tokens that each symbol adds from the state `entry` on, and the state behind the last one (states by their content)."""
        if entry not in self.number:
            self.add(entry)
        n = len(symbols)
        ends = symbols >= 256
        # word_at[i]: where the word of symbol i begins
        first = np.concatenate([[True], ends[:-1]])
        word_at = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        begins = np.arange(0, n, CHUNK)
        begins = np.unique(np.where(begins - word_at[begins] <= REACH, word_at[begins], begins))
        stops = np.append(begins[1:], n)
        aligned = first[begins]
        # of chunks within a word: the states that short looks back lead to
        lane_chunk = list(np.nonzero(aligned)[0])
        entries = [self.number[entry], *[START] * (len(lane_chunk) - 1)]
        inside = np.nonzero(~aligned)[0]
        if len(inside):
            back = np.repeat(begins[inside], 2)
            seen, _, _ = self.run(symbols, np.maximum(back - np.tile([REACH, REACH - 1], len(inside)), 0), back, np.zeros(len(back), np.int32))
            for i, k in enumerate(inside):
                for e in {int(seen[2 * i]), int(seen[2 * i + 1])}:
                    lane_chunk.append(k)
                    entries.append(e)
        lane_chunk, entries = np.array(lane_chunk), np.array(entries, np.int32)
        exits, added, order = self.run(symbols, begins[lane_chunk], stops[lane_chunk], entries)
        runs = [(lane_chunk, entries, exits, added, order)]
        while True:
            true = composed(len(begins), aligned, lane_chunk, entries, exits)
            missing = np.nonzero(true < 0)[0]
            if not len(missing):
                break
            # the first chunk without a lane for its real entry gets one; what is behind it may then be known as well
            k = missing[0]
            entry = exits[true[k - 1]]
            one = np.array([k]), np.array([entry], np.int32)
            got = self.run(symbols, begins[one[0]], stops[one[0]], one[1])
            runs.append((*one, *got))
            lane_chunk, entries, exits = np.append(lane_chunk, k), np.append(entries, entry), np.append(exits, got[0])
        out = np.zeros(n, np.int8)
        at = 0
        for chunk, _, _, added, order in runs:
            use = true[chunk[order]] == at + order
            start = begins[chunk[order]]
            for step, a in enumerate(added):
                lanes = use[: len(a)]
                out[start[: len(a)][lanes] + step] = a[lanes]
            at += len(chunk)
        return out, self.states[exits[true[-1]]]


def composed(chunks: int, aligned: np.ndarray, lane_chunk: np.ndarray, entries: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """The lane that each chunk is really run in, or -1 where its map lacks the entry: maps of slots composed by doubling.

    A chunk's lanes are its slots; its map tells which slot of it the slots of the chunk before lead to. The first chunk is aligned.
    """
    order = np.argsort(lane_chunk, kind="stable")
    n = np.bincount(lane_chunk, minlength=chunks)
    slot = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
    lanes = np.full((chunks, int(n.max())), -1)
    lanes[lane_chunk[order], slot] = order
    width = lanes.shape[1]
    # the last column is what a missing slot leads to: a constant map has its value there too
    leads = np.full((chunks, width + 1), -1)
    leads[aligned] = 0
    odd = np.nonzero(~aligned)[0]
    if len(odd):
        of = np.where(lanes >= 0, exits[lanes], -1)[odd - 1]
        into = np.where(lanes >= 0, entries[lanes], -2)[odd]
        same = of[:, :, None] == into[:, None, :]
        leads[odd, :width] = np.where(same.any(2), same.argmax(2), -1)
        gap = 1
        while gap < chunks:
            through = np.take_along_axis(leads[gap:], leads[:-gap] % (width + 1), 1)
            leads = np.concatenate([leads[:gap], through])
            gap *= 2
    slots = leads[:, 0]
    return np.where(slots >= 0, lanes[np.arange(chunks), np.maximum(slots, 0)], -1)


class Counter:
    """Counts the tokens of texts by one vocabulary file of the kind BLANKS_DROPPED."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if [file["normalizer"], file["pre_tokenizer"]] != BLANKS_DROPPED or model["type"] != "BPE" or model["end_of_word_suffix"] is None:
            raise ValueError("a vocabulary of another kind")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in file["added_tokens"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("special tokens of another kind")
        added = {t["content"] for t in file["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.transducer = Transducer(Merges({t: i for t, i in model["vocab"].items() if t not in added}, merges, model["end_of_word_suffix"]))
        self.kind = np.full(0x110000, UNSEEN, np.uint8)

    def settled(self, text: str) -> str:
        """The text as the tokenizer's normaliser leaves it, but for the kind of blanks."""
        if text.isascii() or _SETTLED.fullmatch(text):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The splitter's classes of code points; a new one is shown to the splitter between a letter and a sign."""
        out = self.kind[points]
        if (out == UNSEEN).any():
            for c in np.unique(points[out == UNSEEN]).tolist():
                pieces = [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}!")]
                seen = {((0, 1), (2, 3)): SPACE, ((0, 2), (2, 3)): LETTER, ((0, 1), (1, 2), (2, 3)): NUMBER, ((0, 1), (1, 3)): OTHER}
                self.kind[c] = seen[tuple(pieces)]
            out = self.kind[points]
        return out

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of a settled text, and for each the code point it belongs to."""
        data = text.encode("utf-32-le")
        points = np.frombuffer(data, "<u4")
        kind = self.kinds(points)
        # cut[i]: a word ends before code point i
        cut = np.ones(len(points) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        for at in np.nonzero(points == 39)[0].tolist():
            if at and kind[at - 1] == OTHER:
                continue
            for e in ENDINGS:
                if text.startswith(e, at):
                    cut[at + 1 : at + len(e)] = False
                    cut[at + len(e)] = True
                    break
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        out = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.int16)
        out[np.cumsum(width)[cut[1:]] - 1] += 256
        of = np.repeat(np.arange(len(points)), width)
        keep = (kind != SPACE)[of]
        return out[keep], of[keep]

    def of_texts(self, texts: list[str | None]) -> Iterator[int]:
        """Texts side by side, up to SPAN characters together; a longer one by itself."""
        some, size = [], 0
        for t in texts:
            some.append(t or "")
            size += len(some[-1])
            if size >= SPAN:
                yield from self._counts(some)
                some, size = [], 0
        yield from self._counts(some)

    def _counts(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        specials = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            for s in self.special:
                if s in t:
                    specials[i] += t.count(s)
                    t = t.replace(s, "\n")
            parts.append(self.settled(t))
            owner.append(len(parts[-1]) + 1)
        symbols, of = self.symbols("\n".join([*parts, ""]))
        text_of = np.repeat(np.arange(len(texts)), owner)[of]
        total = np.zeros(len(texts), np.int64)
        state = self.transducer.states[START]
        for at in range(0, len(symbols), SPAN):
            if len(self.transducer.states) > STATES:
                self.transducer.clear()
            added, state = self.transducer.emitted(symbols[at : at + SPAN], state)
            total += np.bincount(text_of[at : at + SPAN], added, len(texts)).astype(np.int64)
        return (total + specials).tolist()


@lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """The columns of docs, then n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    n_tokens is what the tokenizer of the file gives for the whole text, special strings within it included as one
    token each, none added. Null and empty texts: 0, 0 and false. Equal and repeated rows count each by itself; an empty table gives an
    empty one. Very long texts and words run in parts of SPAN symbols, each from the state that the one before left, so
    a worker holds a text, its symbols and at most STATES + SPAN states. Columns of docs with the names of results are replaced.
    """
    fresh = {"n_bytes", "n_tokens", "over_limit"}
    keep = [c for c in docs.columns if c not in fresh]
    out = mapped(docs, keep, [text], [T.StructField("n_tokens", T.LongType())], lambda texts: (list(_counter(path).of_texts(texts)),))
    n_bytes = F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long")
    columns = [F.col(f"`{c}`") for c in keep]
    return out.select(*columns, n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
