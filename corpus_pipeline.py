"""A training corpus from the documents table: toxicity, quality rules, line dedup, near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import harmonic_packing, line_dedup, minhash_dedup, quality_rules, toxicity
from tracewright.llm.queries import END_ID
from tracewright.llm.shared import NON_SPACE, read, stored


def _bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no column's name meets one that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(rest or [F.lit(0)])).alias("_rest"))


def _as_before(d: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return d.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator does not predict toxic; those without text stay, as do rows of equal id, each by its own text."""
    costs, evidence, prior = toxicity.fitted(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return _as_before(toxicity.score(_bundled(docs), costs, evidence, prior).where("predicted = 0"), docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; those without text or of few words go."""
    ratios = quality_rules.ratio_table(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))
    return _as_before(quality_rules.judge(_bundled(docs), ratios).where("kept"), docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one holds; those of which nothing is left go. n_chars counts what is left."""
    out = line_dedup.without_repeats(_bundled(docs))
    cut = F.col("removed_lines").isNotNull()
    left = out.where(~cut | F.col("text").rlike(NON_SPACE)).withColumn("_cut", cut)
    back = left.select("_cut", "doc_id", "text", "_rest")
    n_chars = docs.schema["n_chars"].dataType
    columns = {c: F.col(f"_rest.`{c}`") for c in docs.columns if c not in ("doc_id", "text")}
    columns["n_chars"] = F.when(F.col("_cut"), F.length("text").cast(n_chars)).otherwise(columns["n_chars"])
    return back.select(*[(columns[c] if c in columns else F.col(c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest doc_id. Rows of equal id count once."""
    kept = minhash_dedup.groups(docs).where("kept or doc_id is null").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")), "left_semi")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a document without text is its end id alone."""
    import public_tokenizers

    pieces = harmonic_packing.tokens(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return harmonic_packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("line dedup", cut_repeated_lines),
    ("MinHash near-dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: Learned scores, hashes and tokenizers are beyond SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each stored and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
