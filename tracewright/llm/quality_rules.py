"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Texts are cut into runs of punctuation and runs of other non-space characters, lower-cased;
one-grams and two-grams of these are hashed into a fixed number of buckets. The multinomial
of the raw corpus counts every document; that of the target counts trusted documents (at most
``target_bound`` of them, those with the least hash of their id). A document's score is its
mean log ratio per n-gram, and a document is kept if the score reaches a fixed threshold.
Everything is built from DataFrame functions; the ratio table has ``buckets`` numbers and is
the only thing that passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NON_SPACE, words_of

BUCKETS = 10_000
TARGET_BOUND = 20_000
SMOOTHING = 0.5
#: Mean log ratio that a kept document reaches.
THRESHOLD = -0.25


def _covered(positions: Column) -> Column:
    """Words covered by three-word windows at these sorted positions."""
    steps = F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(positions, i + 1) - p, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed (names that docs has are replaced).

    Null and empty texts have no words: all counts 0, base_failed true.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_words", words_of(F.col(text)))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(NON_SPACE)))
    d = d.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    d = d.withColumn(
        "_win",
        F.when(
            F.size("_words") >= 3,
            F.transform(F.slice("_h", 1, F.size("_h") - 2), lambda h, i: F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2))),
        ).otherwise(F.expr("array_remove(array(0L), 0L)")),
    )
    # most texts repeat no window; only the others sort. Hashes order the windows, words decide where hashes are equal
    word = lambda i, k: F.get("_words", i + k)
    window = lambda h, i: F.struct(h.alias("h"), word(i, 0).alias("a"), word(i, 1).alias("b"), word(i, 2).alias("c"), i.alias("i"))
    repeats = F.size(F.array_distinct("_win")) < F.size("_win")
    d = d.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_win", window))))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    twice = F.filter("_sorted", lambda x, k: same(x, F.get("_sorted", k - 1)) | same(x, F.get("_sorted", k + 1)))
    d = d.withColumn("_at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    n_words = F.size("_words").cast("long")
    n_repeat = F.when(F.col("_at").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("_at")))
    added = {
        "n_words": n_words,
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": n_repeat,
        "base_failed": (n_words < 50) | (n_repeat * 100 > n_words * 50),
    }
    return _fenced(d, added).drop("_words", "_lines", "_h", "_win", "_sorted", "_at")


def _fenced(d: DataFrame, added: dict[str, Column]) -> DataFrame:
    """d with these columns, as a generator's output: no filter on them moves below, into the lambdas that make them.

    Spark pushes a filter through a projection by repeating the projection's expressions; arrays
    would then be worked out anew for each of their own elements.
    """
    rest = [F.col(f"`{c}`") for c in d.columns if c not in added]
    return d.select(*rest, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in added.items()]))))


def _with_grams(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Adds _grams: the bucket of each one-gram, then of each two-gram."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[^\s\p{Punct}]+|\p{Punct}+"), F.lit(0))
    d = docs.withColumn("_g1", F.transform(tokens, lambda t: F.xxhash64(t)))
    pair = F.transform(F.slice("_g1", 2, F.greatest(F.size("_g1") - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(F.get("_g1", i), h), F.lit(buckets)).cast("int"))
    d = d.withColumn("_grams", F.concat(F.transform("_g1", lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pair))
    return d.drop("_g1")


def trusted_ids(labels: DataFrame, bound: int = TARGET_BOUND) -> DataFrame:
    """At most bound ids of trusted documents (quality 1), by hash of the id."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def ratio_table(docs: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, text: str = "text") -> list[float]:
    """log(target share / raw share) of each bucket, smoothed. No trusted documents: all zero."""
    trusted = F.broadcast(target_ids.withColumn("_trusted", F.lit(1)))  # at most TARGET_BOUND ids
    grams = _with_grams(docs.select("doc_id", text).join(trusted, "doc_id", "left"), text, buckets)
    rows = (
        # the outer form: for the inner one Spark pushes a filter down that works the array out within its own lambdas
        grams.select("_trusted", F.explode_outer("_grams").alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_trusted").alias("target"))
        .collect()  # at most `buckets` rows
    )
    import math

    raw, target = [0] * buckets, [0] * buckets
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0.0] * buckets
    n_raw, n_target = sum(raw) + SMOOTHING * buckets, sum(target) + SMOOTHING * buckets
    return [math.log((t + SMOOTHING) / n_target) - math.log((r + SMOOTHING) / n_raw) for r, t in zip(raw, target, strict=True)]


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """Adds the base columns, score (double) and kept.

    Null and empty texts have no n-gram: score 0, base_failed true, kept false. Equal texts get equal
    verdicts; extra columns stay, but those named like an added column are replaced.
    """
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    d = _with_grams(docs, text, len(ratios))
    total = F.aggregate("_grams", F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    d = _fenced(d, {"score": F.when(F.size("_grams") > 0, total / F.size("_grams")).otherwise(F.lit(0.0))}).drop("_grams")
    d = base_rules(d, text)
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
