"""The queries op1 to op13 and the pipeline, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe,
    code_compression,
    cover_tree,
    hard_negatives,
    harmonic_packing,
    hilbert_shards,
    license_scans,
    line_dedup,
    minhash_dedup,
    quality_rules,
    token_counts,
    toxicity,
    url_filters,
)
from .shared import read

END_ID = 2
TOKEN_LIMIT = 2048
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: The method's own list, for urls that no rule fits.
URL_BLOCKED = ["casino-win.example.com/", "free-bets.example.com/", "cheap-pills.example.com/", "ads-track.example.com/"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words, signs, lines and repeated windows, and the log-likelihood ratio, of every document."""
    docs = read(spark, sf_dir, "documents")
    ratios = quality_rules.ratio_table(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))
    out = quality_rules.judge(docs.select("doc_id", "text"), ratios)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of every document, and digest of what they decode to."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    both = byte_bpe.decode(encoded, path, pattern)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards of equal row counts, along the curve over size, source and language."""
    docs = read(spark, sf_dir, "documents")
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), "lang", "source")
    dims = {"size": F.col("size"), "source": F.col("source"), "lang": F.col("lang")}
    out = hilbert_shards.shards(rows, 8, dims, ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, learned from labelled rows that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    costs, evidence, prior = toxicity.fitted(docs, read(spark, sf_dir, "labels"))
    out = toxicity.score(docs, costs, evidence, prior)
    held_out = F.coalesce(toxicity.remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "score", "predicted", F.size("toxic_words").cast("long").alias("n_toxic_words"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    out = url_filters.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, URL_BLOCKED)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them went, and a digest of what is left."""
    out = line_dedup.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    t = F.coalesce(F.col("text"), F.lit(""))
    removed = F.coalesce(F.size("removed_lines"), F.lit(0))
    return out.select(
        "doc_id",
        "n_lines",
        F.when(removed > 0, removed).otherwise(0).cast("long").alias("n_removed"),
        F.length(t).cast("long").alias("left_chars"),
        F.crc32(t.cast("binary")).alias("left_crc32"),
    )


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.95."""
    return cover_tree.links(read(spark, sf_dir, "embeddings"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document at a similarity of 0.75."""
    return minhash_dedup.groups(read(spark, sf_dir, "documents"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens."""
    import public_tokenizers

    pieces = harmonic_packing.tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return harmonic_packing.pack(digests)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scans.scan(docs, license_scans.template_frequencies(docs))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of each anchor and positive, every vector against every anchor."""
    vec_id, label = F.col("vec_id"), F.col("label").cast("long")
    relabelled = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.usable(read(spark, sf_dir, "embeddings"), vec_id, relabelled, F.col("embedding"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op12_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector under codebooks of two rounds."""
    out, books = code_compression.compress(read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count(docs, public_tokenizers.path("word_bpe_49k.json"), TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_byte_bpe,
        op3_hilbert_shards,
        op4_toxicity,
        op5_url_filters,
        op6_line_dedup,
        op7_cover_tree,
        op8_minhash_dedup,
        op9_harmonic_packing,
        op10_license_scans,
        op11_hard_negatives,
        op12_code_compression,
        op13_token_counts,
    )
}
_UP, _LOW = license_scans.UPPER, license_scans.LOWER


def _fits(pattern: str) -> str:
    host, path = pattern[: pattern.index("/")], pattern[pattern.index("/") :]
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _url_sql() -> str:
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = " ".join(f"WHEN {_fits(k)} THEN '{k}'" for k, _ in ordered)
    what = " ".join(f"WHEN rule = '{k}' THEN '{v}'" for k, v in ordered)
    blocked = " OR ".join(f"({_fits(k)})" for k in URL_BLOCKED)
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UP}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 r AS (SELECT *, CASE {rule} END AS rule FROM h)
 SELECT page_id, host, path, rule, CASE {what} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def _components_sql(nodes: str, links: str) -> str:
    """component(id, component_id) over links(a, b), both ways round."""
    return f"""both_ways AS (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}),
 reach(a, b) AS (SELECT id, id FROM {nodes} UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.b),
 component AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""


_VECTOR_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 l AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
 {_components_sql('v', 'l')}, n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
 SELECT v.id AS vec_id, coalesce(n, 0) AS n_links, component_id, v.id = component_id AS kept FROM v JOIN component USING (id) LEFT JOIN n USING (id)"""

_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
 c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
 l AS (SELECT a, b FROM c JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
 {_components_sql('w', 'l')}
 SELECT w.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, w.id = component_id AS kept FROM w JOIN component USING (id) LEFT JOIN n USING (id)"""


def _license_sql() -> str:
    phrases = list(license_scans.PHRASES.items())
    wide = lambda p: " " + p.replace(" ", "  ") + " "
    count = " + ".join(f"(length(d) - length(replace(d, '{wide(p)}', ''))) // {len(wide(p))}" for p, _ in phrases)
    before = lambda x: f"length({x}) - length(replace({x}, ' ', ''))"
    first = ", ".join(f"CASE WHEN contains(s, ' {p} ') THEN {before(f'substr(s, 1, strpos(s, {chr(39)} {p} {chr(39)}) - 1)')} END" for p, _ in phrases)
    last = ", ".join(f"CASE WHEN contains(s, ' {p} ') THEN {before(f'substr(s, 1, length(s) - strpos(reverse(s), {chr(39)} {p[::-1]} {chr(39)}) - {len(p) + 1})')} END" for p, _ in phrases)
    base = ", ".join(f"CASE WHEN contains(s, ' {p} ') THEN '{label}' END" for p, label in phrases)
    templates = ", ".join(f"('{label}', {sorted(set(t.split()))})" for label, t in license_scans.TEMPLATES.items())
    split = "list_filter(string_split_regex({0}, '[^0-9a-z\\x{{0080}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"
    return f"""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS low FROM documents),
 w AS (SELECT doc_id, {split.format('low')} AS w FROM d), j AS (SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s, ' ' || array_to_string(w, '  ') || ' ' AS d FROM w),
 b AS (SELECT doc_id, n_words, {count} AS n_base, least({first}) AS first_word, greatest({last}) AS last_word, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM j),
 t(label, words) AS (VALUES {templates}),
 p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
 x AS (SELECT p.doc_id, t.label, len(list_intersect(list_distinct(p.w[p.i:p.i + CAST(ceil(len(t.words) / {license_scans.SHARE} - 1e-9) AS INT) - 1]), t.words)) / len(t.words) AS c FROM p JOIN (SELECT label, words, unnest(words) AS word FROM t) t ON t.word = p.w[p.i]),
 y AS (SELECT doc_id, label, max(c) AS c FROM x WHERE c >= {license_scans.SHARE} - 1e-9 GROUP BY 1, 2),
 z AS (SELECT doc_id, list(label) AS labels, max(c) AS c FROM y GROUP BY doc_id)
 SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
 CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score FROM b LEFT JOIN z USING (doc_id)"""


_USABLE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

_MINED_SQL = f"""WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE label IS NOT NULL AND {_USABLE_SQL}),
 s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM r a JOIN r c ON c.id <> a.id WHERE a.id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
 SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id)
 WHERE NOT alike AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5"""


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def assigned(book: str) -> str:
        distance = "list_sum(list_transform(list_zip(x.v, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        best = f"SELECT x.vec_id, x.part, any_value(x.v) AS v, min((CAST({distance} AS BIGINT), b.entry)) AS m FROM x JOIN {book} b ON b.part = x.part GROUP BY 1, 2"
        return f"SELECT vec_id, part, v, m[1] AS d, m[2] AS entry FROM ({best})"

    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED ({assigned(f'b{i}')})")
        if i < rounds:
            sums = f"SELECT part, entry, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS i FROM a{i}) GROUP BY 1, 2, 3"
            means = f"SELECT part, entry, list(c ORDER BY i) AS e FROM ({sums}) GROUP BY 1, 2"
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM b{i} b LEFT JOIN ({means}) m ON m.part = b.part AND m.entry = b.entry)")
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_USABLE_SQL}),
 x AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM (SELECT vec_id, v, unnest(range({parts})) AS part FROM k)),
 f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}),
 b0 AS MATERIALIZED (SELECT x.part, f.entry, x.v AS e FROM f JOIN x USING (vec_id)),
 {', '.join(steps)},
 h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
 c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


ORACLES: dict[str, str] = {
    "op5_url_filters": _url_sql(),
    "op7_cover_tree": _VECTOR_SQL,
    "op8_minhash_dedup": _NEAR_SQL,
    "op10_license_scans": _license_sql(),
    "op11_hard_negatives": _MINED_SQL,
    "op12_code_compression": _codes_sql(),
}
