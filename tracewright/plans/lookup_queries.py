"""Point, range and name lookups, joins of the index tables, counts and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotations, memory, names
from ..operators import control_flow as flow
from ..operators.ordered import running_total
from ..operators.search import lines_with, search
from ..operators.sequence_diff import diff_regions, merged_regions
from ..sources.adapters import TRACE_SQL, table, trace_lines
from .flow_queries import BLOCKS_SQL, CALLS_SQL, JUMPS_SQL
from .memory_queries import APART
from .registry import query

W = f"WITH {TRACE_SQL}"
INST_SQL = "inst AS (SELECT instruction_id, min(line) AS first_line, min_by(module, line) AS module, min_by(k, line) AS o FROM t GROUP BY instruction_id)"
FUNC_SQL = f"fs AS (SELECT *, lag(mnemonic) OVER (PARTITION BY thread ORDER BY line) AS pm FROM t), func AS (SELECT instruction_id, min(line) AS fl FROM fs WHERE pm = 'call' GROUP BY 1), {INST_SQL}"


@query(f"{W} SELECT line, thread, instruction_id FROM t WHERE line BETWEEN 2000 AND 2100")
def line_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_lines(spark, sf_dir).where("line BETWEEN 2000 AND 2100").select("line", "thread", "instruction_id")


@query(f"{W} SELECT line, thread, instruction_id FROM t WHERE line = 1234")
def line_by_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_lines(spark, sf_dir).where("line = 1234").select("line", "thread", "instruction_id")


@query(f"{W} SELECT count(*) AS n_lines, CAST(sum(length(instruction_id)) AS BIGINT) AS n_chars FROM t")
def line_count_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_lines(spark, sf_dir).agg(F.count("*").alias("n_lines"), F.sum(F.length("instruction_id")).alias("n_chars"))


LONG = "SELECT doc_id AS line, CASE WHEN length(text) > 2000 THEN substr(text, 1, 120) || '...' ELSE text END AS contents, CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM documents"


@query(LONG)
def line_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored lines: long ones are cut to 120 characters and dots, offsets count the whole text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "text")
    d = running_total(d, "line", F.length("text"), "block_offset", wide=True)
    cut = F.when(F.length("text") > 2000, F.concat(F.substring("text", 1, 120), F.lit("..."))).otherwise(F.col("text"))
    return d.select("line", cut.alias("contents"), "block_offset")


@query("SELECT doc_id AS line FROM documents WHERE text ILIKE '%idiot%'")
def line_search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").ilike("%idiot%")).select(F.col("doc_id").alias("line"))


@query("SELECT page_id AS line, regexp_extract(url, '([a-z]+)[.]example', 1) AS hit, strpos(url, regexp_extract(url, '([a-z]+)[.]example', 0)) AS at FROM pages WHERE regexp_matches(url, '([a-z]+)[.]example')")
def line_search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a pattern is found in, with the hit and its place."""
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike("([a-z]+)[.]example"))
    return p.select(F.col("page_id").alias("line"), F.regexp_extract("url", "([a-z]+)[.]example", 1).alias("hit"), F.regexp_instr("url", F.lit("([a-z]+)[.]example")).cast("long").alias("at"))


@query("SELECT doc_id AS line FROM documents WHERE text LIKE '%the%' ORDER BY doc_id LIMIT 10001")
def search_result_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 10001 hits: one more than is shown without asking."""
    return lines_with(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "text"), "the").select("line")


@query(f"{W}, {INST_SQL} SELECT instruction_id, module, o FROM inst WHERE instruction_id = 'click:42'")
def instruction_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = flow.instructions(trace_lines(spark, sf_dir).where("instruction_id = 'click:42'"))
    return i.select("instruction_id", "module", F.col("offset").alias("o"))


@query(f"{W}, {INST_SQL} SELECT instruction_id, o FROM inst WHERE module = 'click.dll' AND o BETWEEN 10 AND 30")
def instruction_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = flow.first_per_key(trace_lines(spark, sf_dir).where("module = 'click.dll' AND offset BETWEEN 10 AND 30").select("instruction_id", "line", "offset"), ["instruction_id"])
    return i.select("instruction_id", F.col("offset").alias("o")).orderBy("o")


@query(f"{W} SELECT line FROM t WHERE instruction_id = 'view:17'")
def instruction_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_lines(spark, sf_dir).where("instruction_id = 'view:17'").select("line")


@query(f"{W}, m AS (SELECT module, dense_rank() OVER (ORDER BY min(line)) AS r FROM t GROUP BY module) SELECT module FROM m WHERE module <> 'NO_MODULE'")
def modules_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_lines(spark, sf_dir).where("module <> 'NO_MODULE'").select("module").distinct().orderBy("module")


@query(f"{W} SELECT count(*) AS n_lines, count(DISTINCT thread) AS n_threads, count(DISTINCT module) AS n_modules, count(DISTINCT instruction_id) AS n_instructions, max(line) AS max_line FROM t")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace_lines(spark, sf_dir)
    return t.agg(
        F.count("*").alias("n_lines"), F.countDistinct("thread").alias("n_threads"), F.countDistinct("module").alias("n_modules"), F.countDistinct("instruction_id").alias("n_instructions"), F.max("line").alias("max_line")
    )


@query(f"{W}, {BLOCKS_SQL}, {INST_SQL} SELECT start_instruction, end_instruction, length, a.o AS start_offset, b.o AS end_offset FROM blocks LEFT JOIN inst a ON a.instruction_id = start_instruction LEFT JOIN inst b ON b.instruction_id = end_instruction")
def disconnected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with the offsets of their two ends."""
    lines = trace_lines(spark, sf_dir)
    inst = flow.first_per_key(lines.select("instruction_id", "line", "offset"), ["instruction_id"])
    a = inst.select(F.col("instruction_id").alias("start_instruction"), F.col("offset").alias("start_offset"))
    b = inst.select(F.col("instruction_id").alias("end_instruction"), F.col("offset").alias("end_offset"))
    d = flow.basic_blocks(lines).join(a, "start_instruction", "left").join(b, "end_instruction", "left")
    return d.select("start_instruction", "end_instruction", "length", "start_offset", "end_offset")


@query(f"{W}, {BLOCKS_SQL}, {JUMPS_SQL} SELECT jump_instruction, start_instruction, end_instruction, branch_taken FROM jumps JOIN blocks ON start_instruction = target_instruction")
def block_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    j = flow.jumps(lines).select("jump_instruction", F.col("target_instruction").alias("start_instruction"), "branch_taken")
    return flow.basic_blocks(lines).join(j, "start_instruction").select("jump_instruction", "start_instruction", "end_instruction", "branch_taken")


@query(f"{W}, {BLOCKS_SQL}, {JUMPS_SQL} SELECT target_instruction, min(start_instruction) AS first_predecessor FROM jumps JOIN blocks ON end_instruction = jump_instruction GROUP BY 1")
def first_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every jump target one block that leads to it: the first by spelling."""
    lines = trace_lines(spark, sf_dir)
    b = flow.basic_blocks(lines).select(F.col("end_instruction").alias("jump_instruction"), "start_instruction")
    return flow.jumps(lines).join(b, "jump_instruction").groupBy("target_instruction").agg(F.min("start_instruction").alias("first_predecessor"))


@query(f"{W}, {FUNC_SQL} SELECT func.instruction_id, o FROM func JOIN inst USING (instruction_id) WHERE module = 'view.dll'")
def functions_of_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    inst = flow.first_per_key(lines.where("module = 'view.dll'").select("instruction_id", "line", "offset"), ["instruction_id"])
    return flow.function_starts(lines).join(inst, "instruction_id").select("instruction_id", F.col("offset").alias("o")).orderBy("o")


@query(f"{W}, {FUNC_SQL} SELECT func.instruction_id, fl AS first_line FROM func JOIN inst USING (instruction_id) WHERE module = 'view.dll' AND o = 12")
def function_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    inst = lines.where("module = 'view.dll' AND offset = 12").select("instruction_id").distinct()
    return flow.function_starts(lines).join(inst, "instruction_id").select("instruction_id", "first_line")


@query(f"{W}, {INST_SQL} SELECT t.line, inst.instruction_id, inst.module, inst.first_line FROM t JOIN inst USING (instruction_id) WHERE t.line = 777")
def line_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    one = lines.where("line = 777").select("line", "instruction_id")
    inst = flow.first_per_key(lines.select("instruction_id", F.col("line").alias("first_line"), "module"), ["instruction_id"], "first_line")
    return one.join(inst, "instruction_id").select("line", "instruction_id", "module", "first_line")


@query(f"{W}, {FUNC_SQL}, f AS (SELECT instruction_id, min_by(thread, line) AS th FROM t GROUP BY 1) SELECT DISTINCT instruction_id FROM fs WHERE pm IS NULL")
def top_level_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that start a thread: instructions of each thread's first line."""
    return flow.first_per_key(trace_lines(spark, sf_dir).select("thread", "line", "instruction_id"), ["thread"]).select("instruction_id").distinct()


# a part is a function of its brand's library at its size, a supplier an export of a brand at a place
EXPORTS_SQL = "x AS (SELECT 'BRAND#' || (10 * (s_suppkey % 5 + 1) + s_nationkey % 5 + 1) AS module, s_suppkey % 50 AS rva, s_name AS name FROM supplier), f AS (SELECT p_partkey, upper(p_brand) AS module, p_size AS o FROM part)"


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.lit(10) * (F.col("s_suppkey") % 5 + 1) + F.col("s_nationkey") % 5 + 1).cast("int").cast("string")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("Brand#"), place).alias("module"), (F.col("s_suppkey") % 50).alias("rva"), F.col("s_name").alias("name"))


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_brand").alias("module"), F.col("p_size").alias("offset"))


@query(f"WITH {EXPORTS_SQL}, y AS (SELECT module, rva, min(name) AS name FROM x GROUP BY 1, 2) SELECT f.p_partkey, f.module, f.o, y.name AS export FROM f LEFT JOIN y ON y.module = f.module AND y.rva = f.o")
def export_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with their exported names; named ones first, by name, then by module and offset."""
    return names.named_functions(_functions(spark, sf_dir), _exports(spark, sf_dir)).select("p_partkey", "module", F.col("offset").alias("o"), F.col("name").alias("export"))


@query(
    f"""WITH {EXPORTS_SQL}, d AS (SELECT 'm' || (s_suppkey % 3) AS method, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'send' ELSE 'receive' END AS type FROM supplier WHERE s_suppkey % 4 <> 0)
 SELECT DISTINCT d.method, d.name, d.type, f.p_partkey FROM d JOIN x ON x.name = d.name JOIN f ON f.module = x.module AND f.o = x.rva"""
)
def descriptor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the trace that the channel descriptors name, by way of the exports."""
    d = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0")
    d = d.select(F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")).alias("method"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "send").otherwise("receive").alias("type"))
    return names.described_functions(d, _exports(spark, sf_dir), _functions(spark, sf_dir)).select("method", "name", "type", "p_partkey")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most")
    )


@query(f"{W} SELECT thread, string_agg(CAST(byte AS VARCHAR), '' ORDER BY line) AS text FROM t GROUP BY thread")
def string_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace_lines(spark, sf_dir)
    return t.groupBy("thread").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "byte"))), lambda x: x["byte"].cast("string")), "").alias("text"))


@query(f"{W} SELECT line, thread, lag(line) OVER w AS prev_line, lead(line) OVER w AS next_line FROM t WINDOW w AS (PARTITION BY thread ORDER BY line)")
def line_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.neighbours(trace_lines(spark, sf_dir).select("line", "thread")).select("line", "thread", "prev_line", "next_line")


# two traces that differ here and there: the same lines, one with some texts changed
DIFF = f"""{W}, a AS (SELECT line, instruction_id AS s FROM t), b AS (SELECT line, CASE WHEN line % 97 < 3 THEN 'x' ELSE instruction_id END AS s FROM t),
 d AS (SELECT a.line, a.s = b.s AS same FROM a JOIN b USING (line)), n AS (SELECT *, CASE WHEN lag(same) OVER (ORDER BY line) IS NOT DISTINCT FROM same THEN 0 ELSE 1 END AS new FROM d),
 g AS (SELECT *, sum(new) OVER (ORDER BY line) AS g FROM n) SELECT min(line) AS start_line, max(line) AS end_line, bool_and(same) AS is_match FROM g GROUP BY g"""


@query(DIFF)
def diff_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching and differing regions of two traces that are compared line by line."""
    a = trace_lines(spark, sf_dir).select("line", F.col("instruction_id").alias("text"))
    b = a.select("line", F.when(F.col("line") % 97 < 3, "x").otherwise(F.col("text")).alias("text"))
    return diff_regions(a, b)


@query(DIFF + " ORDER BY start_line")
def diff_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching regions and differing regions read apart and merged in order again."""
    a = trace_lines(spark, sf_dir).select("line", F.col("instruction_id").alias("text"))
    b = a.select("line", F.when(F.col("line") % 97 < 3, "x").otherwise(F.col("text")).alias("text"))
    r = diff_regions(a, b)
    return merged_regions(r.where("is_match"), r.where("NOT is_match"))


@query(f"{W}, {CALLS_SQL} SELECT count(*) AS n_calls, count(DISTINCT caller) AS n_callers FROM calls")
def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.call_associations(trace_lines(spark, sf_dir)).agg(F.count("*").alias("n_calls"), F.countDistinct("caller").alias("n_callers"))


@query(
    f"""{W}, z AS (SELECT CAST(max(line) AS BIGINT) * 2 // 3 * {APART} AS at_line FROM t), s AS (SELECT at_line, (at_line + 1) // 1000000 * 1000000 AS top, (at_line + 1) // 1000 * 1000 AS mid FROM z)
 SELECT CASE WHEN line * {APART} < top THEN 2 WHEN line * {APART} < mid THEN 1 ELSE 0 END AS level, count(*) AS n FROM t, s WHERE line * {APART} <= at_line GROUP BY 1"""
)
def tier_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which level of snapshots serves the lines up to one two thirds through the trace, lines standing apart: whole large buckets, whole small ones, single lines."""
    t = trace_lines(spark, sf_dir).select(F.col("line") * APART)
    at = (t.agg(F.max(t.columns[0])).first()[0] or 0) // APART * 2 // 3 * APART
    level = memory.serving_level(F.col(f"`{t.columns[0]}`"), at)
    return t.groupBy(level.alias("level")).agg(F.count("*").alias("n")).where("level IS NOT NULL")


@query("SELECT page_id AS line, CAST(p AS BIGINT) AS at, CAST(2 AS BIGINT) AS length FROM (SELECT page_id, url, unnest(generate_series(0, length(url) - 2)) AS p FROM pages) WHERE regexp_full_match(substr(url, p + 1, 2), '[aeiou][rln]')")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a pattern is found."""
    return search(table(spark, sf_dir, "pages").select(F.col("page_id").alias("line"), F.col("url").alias("text")), "[aeiou][rln]")


@query("WITH d AS (SELECT doc_id, text, CAST(coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o FROM documents) SELECT doc_id AS line, CAST(p AS BIGINT) AS at, CAST(4 AS BIGINT) AS length, CAST(o + p AS BIGINT) AS file_offset FROM (SELECT doc_id, text, o, unnest(generate_series(0, length(text) - 4)) AS p FROM d WHERE text ILIKE '%mit %') WHERE lower(substr(text, p + 1, 4)) = 'mit '")
def search_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of a plain text in any case, also as an offset in the file."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line"), "text")
    return search(running_total(d, "line", F.length("text"), "offset", wide=True), "mit ", regex=False, case_sensitive=False)


TAGS = "SELECT l_suppkey AS tag, l_orderkey AS start_line, l_linenumber AS start_char, l_orderkey + l_partkey % 5 AS end_line, CAST(l_quantity AS BIGINT) AS end_char FROM lineitem"


@query(f"WITH a AS ({TAGS}) SELECT *, row_number() OVER (PARTITION BY tag ORDER BY start_line, start_char, end_line, end_char) AS place FROM a")
def annotation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of each tag in the order of their places."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a = l.select(F.col("l_suppkey").alias("tag"), F.col("l_orderkey").alias("start_line"), F.col("l_linenumber").alias("start_char"), (F.col("l_orderkey") + F.col("l_partkey") % 5).alias("end_line"), F.col("l_quantity").cast("long").alias("end_char"))
    return annotations.in_order(a, ["tag"])
