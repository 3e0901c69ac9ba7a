"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are all stretches of up to ceil(n / share) words of a text for a template of n words, as sets of words, wherever
lines end: a notice is found wrapped or not, words scattered over a long text are not. The templates'
words are ranked by their frequency in the whole corpus, rarest first; words of no template can
match nothing and count nowhere. To hold `share` of a template of n words a block needs o =
ceil(share * n) of them, so it must hold one of the template's n - o + 1 rarest words (its prefix): an
inverted index leads from those words to templates and the words' places in them. A text with
fewer than o ranked words falls to the length filter. If the first common word stands at place i of the
template and at place j of the text's m ranked words, no more than 1 + min(n - i, m - j) can be common: the
positional filter drops the pair if that is less than o. What is left is looked at around each prefix word and counted exactly,
stretch by stretch. The index is flat arrays, the same for all rows, of a size that is checked; the
join is native column work on each row, without a shuffle.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a template's words that a block must hold.
SHARE = 0.8
WORDS_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Words that all templates together may have: the index goes to every task.
INDEX_WORDS = 2_000_000
#: Template of each of the method's labels; grants, conditions and disclaimers as the licenses word them (fixed values).
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "rights-reserved": "all rights reserved",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mit-conditions": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache-disclaimer": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
}


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, WORDS_APART), "")


def template_frequencies(docs: DataFrame, templates: dict[str, str] = TEMPLATES, text: str = "text") -> dict[str, int]:
    """How often each template word occurs in the whole corpus."""
    vocabulary = sorted({w for t in templates.values() for w in t.split()})
    words = docs.select(F.explode_outer(words_of(lowered(F.col(text)))).alias("word")).where(F.col("word").isin(vocabulary))
    found = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row a template word
    return {w: found.get(w, 0) for w in vocabulary}


def _ints(values: list[int]) -> Column:
    """An array of whole numbers as one literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


@dataclass
class Index:
    """Ranked template words and their postings as flat arrays; [starts[k], starts[k + 1]) is the run of k."""

    labels: list[str]
    words: list[str]  # by rank
    sizes: list[int]  # of each template
    needs: list[int]
    starts: list[int]  # of each template's ranks
    ranks: list[int]
    posting_starts: list[int]  # of each rank's postings
    posting_template: list[int]
    posting_place: list[int]  # from 1

    @classmethod
    def of(cls, templates: dict[str, str], frequencies: dict[str, int], share: float) -> Index:
        labels = sorted(templates)
        sets = [set(templates[x].split()) for x in labels]
        if sum(map(len, sets)) > INDEX_WORDS:
            raise ValueError(f"templates of more than {INDEX_WORDS} words: scan them in several runs")
        words = sorted(set().union(*sets), key=lambda w: (frequencies.get(w, 0), w))
        rank = {w: i for i, w in enumerate(words)}
        ordered = [sorted(rank[w] for w in s) for s in sets]
        needs = [math.ceil(share * len(s) - 1e-9) for s in sets]
        postings: list[list[tuple[int, int]]] = [[] for _ in words]
        for t, (ranks, need) in enumerate(zip(ordered, needs, strict=True)):
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                postings[r].append((t, i + 1))
        upto = lambda lists: [0, *accumulate(map(len, lists))]
        flat = [p for x in postings for p in x]
        return cls(labels, words, list(map(len, sets)), needs, upto(ordered), [r for x in ordered for r in x], upto(postings), [t for t, _ in flat], [i for _, i in flat])

    def prefix_words(self) -> list[str]:
        return [w for i, w in enumerate(self.words) if self.posting_starts[i] < self.posting_starts[i + 1]]

    def rank_of(self, word: Column) -> Column:
        """Rank of a template word, 0-based; -1 of any other: words lie in as many buckets as there are words, by their hash."""
        buckets: list[list[str]] = [[] for _ in self.words]
        for i, w in enumerate(self.words):
            buckets[zlib.crc32(w.encode()) % len(buckets)].append(f"{w}={i}")
        table = F.split(F.lit(",".join(" " + " ".join(b) for b in buckets)), ",")
        bucket = F.get(table, F.pmod(F.crc32(word.cast("binary")), F.lit(len(buckets))).cast("int"))
        key = F.concat(F.lit(" "), word, F.lit("="))
        behind = F.substring_index(F.call_function("substring_index", bucket, key, F.lit(-1)), " ", 1)
        return F.when(F.contains(bucket, key), behind.cast("int")).otherwise(-1)

    def leads(self, rank: Column) -> Column:
        """Whether postings hang on the word of this rank."""
        return (rank >= 0) & (F.get(_ints(self.posting_starts), rank) < F.get(_ints(self.posting_starts), rank + 1))

    def template(self, t: Column) -> Column:
        """Ranks of template t."""
        start = F.get(_ints(self.starts), t)
        return F.slice(_ints(self.ranks), start + 1, F.get(_ints(self.starts), t + 1) - start)

    def postings(self, rank: Column) -> Column:
        """(t, i) of every template whose prefix holds the word of this rank, at its place i."""
        start = F.get(_ints(self.posting_starts), rank)
        many = F.get(_ints(self.posting_starts), rank + 1) - start
        ts, places = F.slice(_ints(self.posting_template), start + 1, many), F.slice(_ints(self.posting_place), start + 1, many)
        return F.transform(ts, lambda t, k: F.struct(t.alias("t"), F.get(places, k).alias("i")))

    def candidates(self, ranks: Column) -> Column:
        """Templates that a block with these ascending ranks may hold, by prefix, length and positional filter."""
        n, need = (lambda t: F.get(_ints(self.sizes), t)), (lambda t: F.get(_ints(self.needs), t))
        left = lambda p, j: 1 + F.least(n(p["t"]) - p["i"], F.size(ranks) - (j + 1))
        near = lambda r, j: F.filter(self.postings(r), lambda p: (F.size(ranks) >= need(p["t"])) & (left(p, j) >= need(p["t"])))
        return F.array_distinct(F.transform(F.flatten(F.transform(ranks, near)), lambda p: p["t"]))

    def overlap(self, ranks: Column, t: Column) -> Column:
        return F.size(F.array_intersect(ranks, self.template(t)))


def scan(docs: DataFrame, frequencies: dict[str, int], templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = SHARE, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and blocks.

    blocks: array of (line, label, containment) for every template and line in which a stretch starts that holds `share`
    of the template: the greatest containment of these stretches. A stretch starts with a word of the template.
    score: the greatest containment (at least 1.0 where a base phrase stands, at most 1.0), else 0.
    Null and empty texts have no words: zero counts, null positions, empty labels. Equal templates
    both count; ties in frequency go by spelling. Texts are scanned whole, however long; equal rows get equal
    results. Columns named like an added one are replaced.
    """
    index = Index.of(templates, frequencies, share)
    d = docs.withColumn("_low", lowered(F.col(text)))
    d = d.withColumn("_words", words_of(F.col("_low")))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))
    counts, firsts, lasts, found = [], [], [], []
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    for phrase, label in phrases.items():
        has = F.contains(F.col("_line"), F.lit(f" {phrase} "))
        # a look-ahead, since neighbours share the blank between them
        counts.append(F.when(has, F.regexp_count("_line", F.lit(f" (?={phrase} )"))).otherwise(0))
        firsts.append(F.when(has, spaces(F.substring_index("_line", f" {phrase} ", 1))))
        lasts.append(F.when(has, spaces(F.expr(f"substring(_line, 1, length(_line) - length(substring_index(_line, ' {phrase} ', -1)) - {len(phrase) + 2})"))))
        found.append(F.when(has, F.lit(label)))
    pick = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    d = d.withColumns(
        {
            "n_base": sum(counts[1:], counts[0]).cast("long"),
            "first_word": pick(F.least, firsts).cast("long"),
            "last_word": pick(F.greatest, lasts).cast("long"),
            "_base": F.array_compact(F.array(*found)),
        }
    ).drop("_line")
    prefix = index.prefix_words()
    # only texts with a prefix word are looked at; their words as ranks in order, with their lines
    some = F.arrays_overlap("_words", F.split(F.lit(",".join(prefix)), ","))
    line_words = lambda x, i: F.transform(words_of(x), lambda w: F.struct(index.rank_of(w).alias("r"), i.alias("line")))
    nothing = F.array().cast("array<struct<r:int,line:int>>")
    d = d.withColumn("_seen", F.when(some, F.flatten(F.transform(F.split("_low", "\n"), line_words))).otherwise(nothing)).drop("_low", "_words")
    ranks = lambda a: F.transform(a, lambda x: x["r"])
    d = d.withColumn("_ranks", F.array_sort(F.array_distinct(F.filter(ranks("_seen"), lambda r: r >= 0))))
    d = d.withColumn("_may", index.candidates(F.col("_ranks"))).drop("_ranks")
    containment = lambda n, t: n / F.get(_ints(index.sizes), t)
    enough = lambda n, t: n >= F.get(_ints(index.needs), t)
    width = lambda t: F.ceil(F.get(_ints(index.sizes), t) / F.lit(share) - 1e-9).cast("int")
    # the surroundings of prefix words that can hold enough
    at = F.filter(F.transform("_seen", lambda s, i: F.struct(i.alias("i"), s["r"].alias("r"))), lambda s: index.leads(s["r"]))
    d = d.withColumn("_at", F.when(F.size("_may") > 0, at).otherwise(F.array().cast("array<struct<i:int,r:int>>")))
    led = lambda s: F.filter(index.postings(s["r"]), lambda p: F.array_contains("_may", p["t"]))
    places = F.flatten(F.transform("_at", lambda s: F.transform(led(s), lambda p: F.struct(p["t"].alias("t"), F.greatest(s["i"] - width(p["t"]) + 1, F.lit(0)).alias("i")))))
    d = d.withColumn("_places", F.array_distinct(places)).drop("_at", "_may")
    around = F.transform("_places", lambda p: F.struct(p["t"].alias("t"), p["i"].alias("i"), ranks(F.slice("_seen", p["i"] + 1, 2 * width(p["t"]) - 1)).alias("r")))
    d = d.withColumn("_near", F.filter(around, lambda s: enough(index.overlap(s["r"], s["t"]), s["t"]))).drop("_places")

    def stretches(s: Column) -> Column:
        """(t, line, -n) of every stretch that starts at a word of the template."""
        goal = index.template(s["t"])
        starts = F.filter(F.sequence(F.lit(0), F.size(s["r"]) - 1), lambda k: F.array_contains(goal, F.get(s["r"], k)))
        return F.transform(starts, lambda k: F.struct(s["t"].alias("t"), F.get(F.col("_seen"), s["i"] + k)["line"].alias("line"), (-index.overlap(F.slice(s["r"], k + 1, width(s["t"])), s["t"])).alias("n")))

    d = d.withColumn("_runs", F.flatten(F.transform("_near", stretches))).drop("_near", "_seen")
    d = d.withColumn("_runs", F.array_sort(F.filter("_runs", lambda x: enough(-x["n"], x["t"]))))
    # of each template and line the greatest overlap comes first
    new = lambda x, k: (k == 0) | (F.get(F.col("_runs"), k - 1)["t"] != x["t"]) | (F.get(F.col("_runs"), k - 1)["line"] != x["line"])
    d = d.withColumn("_all", F.transform(F.filter("_runs", new), lambda x: F.struct(x["line"].cast("long").alias("line"), x["t"].alias("t"), containment(-x["n"], x["t"]).alias("containment")))).drop("_runs")
    named = F.split(F.lit(",".join(index.labels)), ",")
    d = d.withColumn("blocks", F.transform("_all", lambda b: F.struct(b["line"].alias("line"), F.get(named, b["t"]).alias("label"), b["containment"].alias("containment")))).drop("_all")
    added = F.transform("blocks", lambda b: b["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    top = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    d = d.withColumns({"base_labels": joined(F.col("_base")), "labels": joined(F.concat("_base", added)), "score": F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(top).cast("double")})
    return d.drop("_base")
