"""Sequence operators: runs, function starts, blocks, jumps, calls, call stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control_flow as flow
from ..operators import markers as mk
from ..operators.graph import reachable
from ..operators.ordered import runs, with_next_start
from ..sources.adapters import TRACE_SQL, table, trace_lines
from ..sources.trace_text import thread_events
from .registry import query

W = f"WITH {TRACE_SQL}"
WR = f"WITH RECURSIVE {TRACE_SQL}"
RUNS_SQL = """
 c AS (SELECT line, {key} AS key, CASE WHEN lag({key}) OVER (ORDER BY line) IS NOT DISTINCT FROM {key} THEN 0 ELSE 1 END AS new FROM t),
 i AS (SELECT line, key, sum(new) OVER (ORDER BY line) AS run FROM c),
 r AS (SELECT run, min(key) AS key, min(line) AS start, max(line) AS last FROM i GROUP BY run),
 s AS (SELECT run, key, start, coalesce(lead(start) OVER (ORDER BY run), last + 1) - start AS n_lines FROM r)"""
P = "lag(mnemonic) OVER (PARTITION BY thread ORDER BY line)"
ENDS = "coalesce({0} IN ('call', 'ret') OR {0} LIKE 'j%', false)"


@query(f"{W}, {RUNS_SQL.format(key='split_part(module, $$.$$, 1)')} SELECT start AS start_line, n_lines, key AS module FROM s")
def assembly_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir).withColumn("base", F.substring_index("module", ".", 1))
    return with_next_start(runs(lines, "line", "base")).select(F.col("start").alias("start_line"), "n_lines", F.col("key").alias("module"))


@query(
    f"""{W}, {RUNS_SQL.format(key='module')}, w AS (SELECT *, greatest(n_lines // 20, 13) AS width FROM s)
 SELECT start AS start_line, CAST(width AS BIGINT) AS width, CAST(coalesce(sum(width) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS view_start FROM w"""
)
def assembly_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.markers(trace_lines(spark, sf_dir), "line", "module").select(F.col("start").alias("start_line"), "width", "view_start")


THREAD_MARKS = f"{W}, {RUNS_SQL.format(key='thread')}, w AS (SELECT start, n_lines, key, greatest(n_lines // 20, 13) AS width FROM s), v AS (SELECT *, CAST(coalesce(sum(width) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS view_start FROM w)"


def thread_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.markers(trace_lines(spark, sf_dir), "line", "thread")


@query(f"{THREAD_MARKS} SELECT start, key AS tid, n_lines FROM v WHERE start BETWEEN 2000 AND 2600")
def thread_events_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.by_line(thread_marks(spark, sf_dir), 2000, 2600).select("start", F.col("key").alias("tid"), "n_lines")


@query(f"{THREAD_MARKS} SELECT start, key AS tid, n_lines FROM v WHERE start <= 2345 AND 2345 <= start + n_lines")
def thread_event_containing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.containing(thread_marks(spark, sf_dir), 2345).select("start", F.col("key").alias("tid"), "n_lines")


@query(f"{THREAD_MARKS} SELECT start, key AS tid, view_start FROM v WHERE view_start <= 9000 AND view_start + width >= 8000")
def thread_events_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.by_pixel(thread_marks(spark, sf_dir), 8000, 9000).select("start", F.col("key").alias("tid"), "view_start")


@query(f"{THREAD_MARKS} SELECT max(view_start + width) AS max_pixel, max(start + n_lines - 1) AS max_line FROM v")
def thread_events_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.extent(thread_marks(spark, sf_dir))


@query(
    f"""{W}, {RUNS_SQL.format(key='thread')}, f AS (SELECT thread, min(line) AS first FROM t GROUP BY thread)
 SELECT key AS tid, start AS line, n_lines, CASE WHEN first = start THEN 0 ELSE 3 END AS type_id FROM s JOIN f ON f.thread = s.key"""
)
def thread_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    s = with_next_start(runs(lines, "line", "thread"))
    first = lines.groupBy(F.col("thread").alias("key")).agg(F.min("line").alias("_first"))
    kind = F.when(F.col("_first") == F.col("start"), 0).otherwise(3)
    return s.join(first, "key").select(F.col("key").alias("tid"), F.col("start").alias("line"), "n_lines", kind.alias("type_id"))


@query(
    f"""{W}, m AS (SELECT module, CAST(dense_rank() OVER (ORDER BY min(line)) - 1 AS INT) AS module_id FROM t GROUP BY module),
 f AS (SELECT instruction_id, min(line) AS first_line FROM t GROUP BY instruction_id)
 SELECT f.instruction_id, f.first_line, t.module, t.mnemonic, t.k AS offset_raw, t.k - m.module_id AS offset_stored, m.module_id FROM f JOIN t ON t.line = f.first_line JOIN m USING (module)"""
)
def instructions_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = flow.instructions(trace_lines(spark, sf_dir))
    return i.select("instruction_id", "first_line", "module", "mnemonic", F.col("offset").alias("offset_raw"), (F.col("offset") - F.col("module_id")).alias("offset_stored"), "module_id")


@query(f"{W}, p AS (SELECT *, {P} AS p FROM t) SELECT instruction_id, min(line) AS first_line FROM p WHERE p = 'call' GROUP BY instruction_id")
def function_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.function_starts(trace_lines(spark, sf_dir))


@query(
    f"""{W}, p AS (SELECT *, CASE WHEN {P} = 'call' THEN instruction_id END AS s FROM t)
 SELECT line, thread, last_value(s IGNORE NULLS) OVER (PARTITION BY thread ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM p"""
)
def parent_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.parent_function(trace_lines(spark, sf_dir)).select("line", "thread", "parent")


BLOCKS_SQL = f"""p AS (SELECT *, {P} AS p FROM t),
 i AS (SELECT *, sum(CASE WHEN {ENDS.format('p')} THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY line) AS i FROM p),
 one AS (SELECT thread, i, min(line) AS first_line, min_by(instruction_id, line) AS start_instruction, max_by(instruction_id, line) AS end_instruction, count(*) AS length FROM i GROUP BY thread, i),
 blocks AS (SELECT start_instruction, min(first_line) AS first_line, min_by(end_instruction, first_line) AS end_instruction, min_by(length, first_line) AS length FROM one GROUP BY start_instruction)"""


@query(f"{W}, {BLOCKS_SQL} SELECT start_instruction, first_line, end_instruction, length FROM blocks")
def basic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.basic_blocks(trace_lines(spark, sf_dir))


JUMPS_SQL = f"""q AS (SELECT line, instruction_id AS target_instruction, {P} AS m, lag(instruction_id) OVER (PARTITION BY thread ORDER BY line) AS jump_instruction, lag(k) OVER (PARTITION BY thread ORDER BY line) AS f FROM t),
 jumps AS (SELECT jump_instruction, target_instruction, m = 'jz' AND (f & 64) <> 0 AS branch_taken, min(line) AS first_line FROM q WHERE {ENDS.format('m')} GROUP BY 1, 2, 3)"""


@query(f"{W}, {JUMPS_SQL} SELECT jump_instruction, target_instruction, branch_taken, first_line FROM jumps")
def jumps_branch_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.jumps(trace_lines(spark, sf_dir))


STEPS_SQL = f"s1 AS (SELECT *, {P} AS p, lag(instruction_id) OVER (PARTITION BY thread ORDER BY line) AS pid FROM t), s2 AS (SELECT *, CASE p WHEN 'call' THEN 1 WHEN 'ret' THEN -1 ELSE 0 END AS st FROM s1)"
CALLS_SQL = f"""{STEPS_SQL},
 c1 AS (SELECT *, sum(st) OVER (PARTITION BY thread ORDER BY line) AS w FROM s2),
 c2 AS (SELECT *, w + greatest(0, -min(w) OVER (PARTITION BY thread ORDER BY line)) AS l FROM c1),
 c3 AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY thread ORDER BY line), 0) AS pl FROM c2),
 c4 AS (SELECT *, CASE WHEN p = 'ret' THEN pl ELSE l END AS kk FROM c3),
 c5 AS (SELECT *, last_value(CASE WHEN p = 'call' THEN line END IGNORE NULLS) OVER (PARTITION BY thread, kk ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS frame FROM c4),
 c6 AS (SELECT *, CASE WHEN p = 'call' AND pl > 0 THEN line WHEN p = 'ret' AND pl > 0 THEN frame END AS pv FROM c5),
 c7 AS (SELECT *, coalesce(last_value(pv IGNORE NULLS) OVER (PARTITION BY thread ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(line) OVER (PARTITION BY thread)) AS caller_line FROM c6),
 c8 AS (SELECT c7.pid AS call_instruction, c7.line, o.instruction_id AS caller, c7.instruction_id AS callee FROM c7 JOIN t o ON o.line = c7.caller_line WHERE c7.p = 'call' AND c7.pl > 0),
 calls AS (SELECT call_instruction, min(line) AS first_line, min_by(caller, line) AS caller, min_by(callee, line) AS callee FROM c8 GROUP BY call_instruction)"""


@query(f"{W}, {CALLS_SQL} SELECT call_instruction, first_line, caller, callee FROM calls")
def call_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.call_associations(trace_lines(spark, sf_dir))


@query(f"{W}, {CALLS_SQL}, i AS (SELECT instruction_id, min(k) AS o FROM t GROUP BY 1) SELECT caller, callee, o AS callee_offset, count(*) AS n_sites FROM calls JOIN i ON i.instruction_id = callee GROUP BY caller, callee, o")
def callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trace_lines(spark, sf_dir)
    calls = flow.call_associations(lines)
    inst = lines.groupBy(F.col("instruction_id").alias("callee")).agg(F.min("offset").alias("callee_offset"))
    return calls.join(inst, "callee").groupBy("caller", "callee", "callee_offset").agg(F.count("*").alias("n_sites"))


@query(f"{W}, {CALLS_SQL} SELECT DISTINCT t.line, calls.callee FROM t JOIN calls ON calls.caller = t.instruction_id")
def callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each caller's first instruction, per called function (the traced tool's reading)."""
    lines = trace_lines(spark, sf_dir)
    calls = flow.call_associations(lines).select(F.col("caller").alias("instruction_id"), "callee").distinct()
    return lines.select("line", "instruction_id").join(calls, "instruction_id").select("line", "callee")


@query(f"{W}, {CALLS_SQL} SELECT DISTINCT t.line, calls.callee FROM t JOIN calls ON calls.call_instruction = t.instruction_id")
def caller_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the call sites themselves, per called function."""
    lines = trace_lines(spark, sf_dir)
    calls = flow.call_associations(lines).select(F.col("call_instruction").alias("instruction_id"), "callee")
    return lines.select("line", "instruction_id").join(calls, "instruction_id").select("line", "callee")


TFB_SQL = f"""{STEPS_SQL},
 b1 AS (SELECT *, 1 + sum(st) OVER (PARTITION BY thread ORDER BY line) AS w FROM s2),
 b2 AS (SELECT *, w + greatest(0, 1 - min(w) OVER (PARTITION BY thread ORDER BY line)) AS l FROM b1),
 b3 AS (SELECT *, lag(l) OVER (PARTITION BY thread ORDER BY line) AS pl FROM b2),
 b4 AS (SELECT *, last_value(CASE WHEN p IS NULL OR p = 'call' OR (p = 'ret' AND pl = 1) THEN line END IGNORE NULLS) OVER (PARTITION BY thread, l ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner_line FROM b3),
 b5 AS (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY line) - 1 AS x, sum(CASE WHEN p IN ('call', 'ret') THEN 1 ELSE 0 END) OVER (PARTITION BY thread ORDER BY line) AS i FROM b4),
 b6 AS (SELECT thread, i, min(line) AS start_line, min_by(instruction_id, line) AS start_instruction, max_by(instruction_id, line) AS end_instruction, min(owner_line) AS owner_line, min(x) AS x_offset, count(*) AS width FROM b5 GROUP BY thread, i),
 tfb AS (SELECT b6.thread, start_line, start_instruction, end_instruction, o.instruction_id AS function_start, x_offset, width, x_offset + width AS x_end FROM b6 JOIN t o ON o.line = b6.owner_line)"""


@query(f"{W}, {TFB_SQL} SELECT * FROM tfb")
def thread_function_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.thread_function_blocks(trace_lines(spark, sf_dir))


@query(f"{W} SELECT thread, count(*) AS length FROM t GROUP BY thread")
def thread_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.thread_lengths(trace_lines(spark, sf_dir))


@query(f"{W}, {TFB_SQL}, i AS (SELECT instruction_id, min(k) AS o FROM t GROUP BY 1) SELECT tfb.*, a.o AS start_offset, b.o AS end_offset FROM tfb LEFT JOIN i a ON a.instruction_id = start_instruction LEFT JOIN i b ON b.instruction_id = end_instruction WHERE thread = 7 AND x_offset <= 40 AND x_end >= 10")
def blocks_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one thread that overlap a span of its instructions, with both ends' offsets."""
    lines = trace_lines(spark, sf_dir)
    blocks = flow.thread_function_blocks(lines.where("thread = 7")).where("x_offset <= 40 AND x_end >= 10")
    inst = lines.groupBy("instruction_id").agg(F.min("offset").alias("_o"))
    a = inst.select(F.col("instruction_id").alias("start_instruction"), F.col("_o").alias("start_offset"))
    b = inst.select(F.col("instruction_id").alias("end_instruction"), F.col("_o").alias("end_offset"))
    return blocks.join(a, "start_instruction", "left").join(b, "end_instruction", "left").orderBy("x_offset")


@query(f"{W}, {TFB_SQL} SELECT thread, start_line, function_start FROM tfb WHERE start_line <= 5000 AND start_line + width - 1 >= 5000 ORDER BY start_line DESC, thread LIMIT 1")
def block_for_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block that covers a line, of all threads the one that starts last."""
    blocks = flow.thread_function_blocks(trace_lines(spark, sf_dir)).where("start_line <= 5000 AND start_line + width - 1 >= 5000")
    return blocks.orderBy(F.desc("start_line"), "thread").limit(1).select("thread", "start_line", "function_start")


@query(f"{W}, {TFB_SQL} SELECT t.line, min(tfb.start_line) AS next_start FROM t LEFT JOIN tfb ON tfb.thread = t.thread AND tfb.start_line > t.line GROUP BY t.line")
def next_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line the first block of its thread that starts after it: an as-of join forward, without a join."""
    return flow.next_block(trace_lines(spark, sf_dir))


@query(
    f"""{W}, {TFB_SQL}, {RUNS_SQL.format(key='module')},
 c AS (SELECT line FROM t WHERE mnemonic = 'call'),
 b AS (SELECT c.line, max(tfb.start_line) AS start FROM c LEFT JOIN tfb ON tfb.start_line < c.line GROUP BY c.line),
 m AS (SELECT b.line, t.module FROM b JOIN t ON t.line = b.start)
 SELECT m.line AS call_line, m.module, min(s.start) AS return_line FROM m LEFT JOIN s ON s.key = m.module AND s.start > m.line GROUP BY m.line, m.module""".replace(" c AS (SELECT line, module AS key", " cc AS (SELECT line, module AS key").replace("AS run FROM c)", "AS run FROM cc)").replace(" i AS (SELECT line, key, sum(new)", " ii AS (SELECT line, key, sum(new)").replace("max(line) AS last FROM i GROUP", "max(line) AS last FROM ii GROUP")
)
def function_ret_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every call: the module of the block before it, and the first later run of that module. Two as-of joins."""
    return flow.return_lines(trace_lines(spark, sf_dir))


# a purchase, so that edges are followed
REACH = "SELECT min(jump_instruction) FROM jumps WHERE jump_instruction LIKE 'purchase:%'"


@query(
    f"""{WR}, {JUMPS_SQL}, e AS (SELECT DISTINCT jump_instruction AS a, target_instruction AS b FROM jumps WHERE jump_instruction NOT LIKE 'error:%'),
 reach(node) AS (SELECT ({REACH}) UNION SELECT e.b FROM reach JOIN e ON e.a = reach.node) SELECT node FROM reach"""
)
def cfg_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions reached from the first conditional jump, not past a return."""
    j = flow.jumps(trace_lines(spark, sf_dir))
    edges = j.where(~F.col("jump_instruction").startswith("error:")).select(F.col("jump_instruction").alias("a"), F.col("target_instruction").alias("b"))
    return reachable(edges, j.where(F.col("jump_instruction").startswith("purchase:")).agg(F.min("jump_instruction").alias("node")))


@query(
    f"""{W}, {BLOCKS_SQL}, {JUMPS_SQL} SELECT jump_instruction, target_instruction, CASE WHEN jump_instruction LIKE 'purchase:%' THEN CASE WHEN branch_taken THEN 'taken' ELSE 'not taken' END ELSE 'unconditional' END AS edge
 FROM jumps JOIN blocks a ON a.end_instruction = jump_instruction JOIN blocks b ON b.start_instruction = target_instruction GROUP BY 1, 2, 3"""
)
def cfg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the control-flow graph whose two ends are both known blocks, by kind."""
    lines = trace_lines(spark, sf_dir)
    blocks = flow.basic_blocks(lines)
    j = flow.jumps(lines)
    kind = F.when(F.col("jump_instruction").startswith("purchase:"), F.when(F.col("branch_taken"), "taken").otherwise("not taken")).otherwise("unconditional")
    e = j.select("jump_instruction", "target_instruction", kind.alias("edge")).distinct()
    e = e.join(blocks.select(F.col("end_instruction").alias("jump_instruction")).distinct(), "jump_instruction", "left_semi")
    return e.join(blocks.select(F.col("start_instruction").alias("target_instruction")), "target_instruction", "left_semi").select("jump_instruction", "target_instruction", "edge")


# a text line an event: its number and thread in hex, and a mark on signups, errors and some purchases; every eleventh line names no thread
TEXT_SQL = """x AS (SELECT event_id AS line, CASE WHEN event_id % 11 <> 0 THEN lower(to_hex(user_id % 4)) END AS tid, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 0 WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 WHEN event_type = 'purchase' AND event_id % 17 = 0 THEN 4 END AS mark FROM events)"""


@query(
    f"""WITH {TEXT_SQL}, h AS (SELECT *, last_value(tid IGNORE NULLS) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM x),
 s AS (SELECT *, CASE WHEN mark IS NOT NULL THEN mark WHEN tid IS NOT NULL AND (held IS NULL OR held <> tid) THEN 3 WHEN tid IS NOT NULL THEN -1 END AS k FROM h),
 y AS (SELECT *, last_value(k IGNORE NULLS) OVER (ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
 e AS (SELECT line, coalesce(tid, held) AS tid, CASE WHEN k >= 0 THEN k ELSE 3 END AS type_id FROM y WHERE k >= 0 OR (k = -1 AND before = 0))
 SELECT line, tid, type_id, coalesce(lead(line) OVER (ORDER BY line), (SELECT max(line) + 1 FROM x)) - line AS n_lines, line - min(line) OVER () AS view_start FROM e"""
)
def thread_events_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins, ends and switches of threads by what the lines of a text trace say."""
    e = table(spark, sf_dir, "events")
    mark = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0), "ThreadBegin |").when((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0), "ThreadEnd |")
    mark = F.coalesce(mark.when((F.col("event_type") == "purchase") & (F.col("event_id") % 17 == 0), "ApplicationEnd |"), F.lit("mov eax, ebx |"))
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.hex("event_id"), F.lit(" I:1 a.dll+1 nop |"))).otherwise(F.concat(F.hex("event_id"), F.lit(" "), F.lower(F.hex(F.col("user_id") % 4)), F.lit(" {64 OFF} "), mark))
    return thread_events(e.select(F.col("event_id").alias("line"), text.alias("text")))
