"""Scalar functions on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instructions as ins
from ..functions import text as tx
from ..sources.adapters import TRACE_SQL, table, trace_lines
from .registry import query

W = f"WITH {TRACE_SQL}"


@query("SELECT DISTINCT l_orderkey AS k, upper(to_hex(l_orderkey)) AS h, lpad(upper(to_hex(l_orderkey)), 8, '0') AS h4, substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2) AS swapped FROM (SELECT l_orderkey, lpad(upper(to_hex(l_orderkey)), 8, '0') AS x FROM lineitem)")
def hex_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    h4 = tx.to_hex(F.col("k"), 4)
    return k.select("k", tx.to_hex(F.col("k")).alias("h"), h4.alias("h4"), tx.swap_bytes(h4).alias("swapped"))


FL = "f AS (SELECT DISTINCT (k * 37) % 4096 AS f FROM t)"
LETTERS = " || ".join(f"CASE WHEN (f & {b}) <> 0 THEN '{c}' ELSE '' END" for c, b in ins.FLAG_BITS.items())


@query(f"{W}, {FL} SELECT f, {LETTERS} AS letters, f & {sum(ins.FLAG_BITS.values())} AS bits FROM f")
def flags_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = trace_lines(spark, sf_dir).select((F.col("flags") * 37 % 4096).alias("f")).distinct()
    letters = ins.flag_letters(F.col("f"))
    return f.select("f", letters.alias("letters"), ins.flags_of_letters(letters).cast("long").alias("bits"))


@query(f"{W} SELECT line, CAST(line * 7919 % 4294967296 AS BIGINT) AS u32, CAST(CASE WHEN line * 7919 % 65536 >= 32768 THEN line * 7919 % 65536 - 65536 ELSE line * 7919 % 65536 END AS BIGINT) AS s16 FROM t")
def register_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tx.to_hex(F.col("line") * 7919, 8)
    return trace_lines(spark, sf_dir).select("line", tx.unsigned(F.right(h, F.lit(8))).cast("long").alias("u32"), tx.signed(F.right(h, F.lit(4)), 16).alias("s16"))


@query()
def register_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit patterns as floats: Arrow batches, since no built-in reads a float from its bits. Held against struct in the tests."""
    h = tx.to_hex(F.col("line") * 7919 + 4607182418800017408, 8)
    return trace_lines(spark, sf_dir).select("line", tx.float64_of_hex(h).alias("f64"), tx.float32_of_hex(F.substring(h, 1, 8)).alias("f32"), tx.shortened(tx.float64_of_hex(h).cast("string")).alias("shown"))


M = "m AS (SELECT unnest(['jo','jno','js','jns','je','jz','jne','jnz','jb','jbe','ja','jl','jge','jp','jnp','jmp','call','ret','mov','jle','jae']) AS m)"


@query(
    f"""{W}, {M}, f AS (SELECT DISTINCT (k * 37) % 4096 AS f FROM t),
 b AS (SELECT m, f, (f & 1) <> 0 AS c, (f & 4) <> 0 AS p, (f & 64) <> 0 AS z, (f & 128) <> 0 AS s, (f & 2048) <> 0 AS o FROM m, f)
 SELECT m, f, CASE m WHEN 'jo' THEN o WHEN 'jno' THEN NOT o WHEN 'js' THEN s WHEN 'jns' THEN NOT s WHEN 'je' THEN z WHEN 'jz' THEN z WHEN 'jne' THEN NOT z WHEN 'jnz' THEN NOT z WHEN 'jb' THEN c WHEN 'jbe' THEN c OR z WHEN 'ja' THEN NOT c AND NOT z WHEN 'jl' THEN s <> o WHEN 'jge' THEN s = o WHEN 'jp' THEN p WHEN 'jnp' THEN NOT p ELSE false END AS taken,
 m LIKE 'j%' AND m <> 'jmp' AS branch, m IN ('jmp', 'call', 'ret') AS certain, m LIKE 'j%' OR m IN ('call', 'ret') AS ends FROM b"""
)
def branch_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["jo", "jno", "js", "jns", "je", "jz", "jne", "jnz", "jb", "jbe", "ja", "jl", "jge", "jp", "jnp", "jmp", "call", "ret", "mov", "jle", "jae"]
    f = trace_lines(spark, sf_dir).select((F.col("flags") * 37 % 4096).alias("f")).distinct()
    d = f.select("f", F.explode(F.array(*[F.lit(x) for x in names])).alias("m"))
    m = F.col("m")
    return d.select("m", "f", ins.would_branch(m, F.col("f")).alias("taken"), ins.is_branch(m).alias("branch"), ins.is_guaranteed_jump(m).alias("certain"), ins.ends_block(m).alias("ends"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS base, regexp_replace(p_name, '^[a-zA-Z0-9]* ', '') AS masked, upper(hex(encode(p_brand))) AS brand_hex FROM part")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.substring_index("p_name", " ", 1).alias("base"), tx.without_first_token(F.col("p_name")).alias("masked"), tx.hex_of_ascii(F.col("p_brand")).alias("brand_hex"))


@query("SELECT p_partkey, p_brand AS shown, p_brand AS message FROM part")
def hex_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex of a name shown as characters and as a message again."""
    h = tx.hex_of_ascii(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.ascii_of_hex(h).alias("shown"), tx.message_text(F.concat(h, F.lit("0A7878"))).alias("message"))


@query(f"{W} SELECT line, 1000000000 + line // 1000000000 AS l1, 1001000000 + line // 1000000 AS l2, 1001001000 + line // 1000 AS l3, line % 1000 AS d0, line // 1000 % 1000 AS d1 FROM t")
def tree_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line")
    return trace_lines(spark, sf_dir).select("line", tx.tree_id(1, n).alias("l1"), tx.tree_id(2, n).alias("l2"), tx.tree_id(3, n).alias("l3"), tx.digit(n, 0).alias("d0"), tx.digit(n, 1).alias("d1"))


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS base, right(lpad(upper(to_hex(o_orderkey)), 16, '0'), 8) <> '00000000' AS ok FROM orders")
def names_and_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.substring_index("o_orderpriority", "-", 1).alias("base"), tx.succeeded(tx.to_hex(F.col("o_orderkey"), 8)).alias("ok"))


@query(
    f"""{W}, x AS (SELECT line, instruction_id AS s, k FROM t)
 SELECT line, list_aggregate(string_split(replace(s, ':', ':|'), '|'), 'string_agg', '/') AS parts, lpad(CAST(line AS VARCHAR), 19, '0') AS offset_text, k & (4294967295 - 42) AS flags,
 regexp_replace(upper(hex(s)), '(..)', '00\\1', 'g') AS wide, s AS narrow FROM x"""
)
def text_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with their delimiters, offsets of fixed width, flags without reserved bits, texts of two-byte characters and back."""
    s = F.col("instruction_id")
    wide = tx.hex_of_ascii(s, wide=True)
    return trace_lines(spark, sf_dir).select(
        "line",
        F.array_join(tx.split_keeping(s, ":"), "/").alias("parts"),
        tx.offset_text(F.col("line")).alias("offset_text"),
        tx.without_reserved(F.col("flags")).alias("flags"),
        wide.alias("wide"),
        tx.ascii_of_hex(F.substring(wide, F.lit(3), F.length(wide)), every_second=True).alias("narrow"),
    )
