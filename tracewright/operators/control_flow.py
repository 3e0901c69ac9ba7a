"""Control structure that follows from the order of lines: functions, blocks, jumps, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.instructions import ends_block, would_branch
from .ordered import carried_after, carried_before, previous, scan, scans, settled

#: Threads are groups of the scans, so that one thread of very many lines is spread over many tasks.
THREAD = ("thread",)


def first_per_key(df: DataFrame, keys: list[str], order: str = "line") -> DataFrame:
    """The first row of each key: one aggregation with map-side combine instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return got.select(*keys, "_r.*")


def instructions(lines: DataFrame) -> DataFrame:
    """First occurrence of each instruction, with modules numbered by first appearance."""
    first = first_per_key(lines.select("instruction_id", "line", "module", "mnemonic", "offset"), ["instruction_id"])
    modules = first.groupBy("module").agg(F.min("line").alias("module_line"))
    numbered = modules.select("module", (F.dense_rank().over(Window.orderBy("module_line")) - 1).cast("int").alias("module_id"))
    return first.join(numbered, "module").withColumnRenamed("line", "first_line")


def function_starts(lines: DataFrame) -> DataFrame:
    """First line of each instruction that follows a call in its thread."""
    d = previous(lines.select("line", "thread", "instruction_id", "mnemonic"), "line", {"_p": "mnemonic"}, THREAD)
    return d.where("_p = 'call'").groupBy("instruction_id").agg(F.min("line").alias("first_line"))


def parent_function(lines: DataFrame) -> DataFrame:
    """Each line with the function started last in its thread before it; its own start does not count."""
    d = previous(lines, "line", {"_p": "mnemonic"}, THREAD)
    return scan(d, "line", F.when(F.col("_p") == "call", F.col("instruction_id")), "parent", "last", THREAD).drop("_p")


def basic_blocks(lines: DataFrame) -> DataFrame:
    """(start_instruction, end_instruction, length, first_line): the first block seen from each start; all threads' tails count."""
    d = lines.select("line", "thread", "instruction_id", "mnemonic")
    # a block's number: the ends of blocks before the line
    d = scan(d, "line", F.coalesce(ends_block(F.col("mnemonic")), F.lit(False)).cast("int"), "_i", "sum", THREAD)
    one = d.groupBy("thread", "_i").agg(
        F.min("line").alias("first_line"),
        F.min_by("instruction_id", "line").alias("start_instruction"),
        F.max_by("instruction_id", "line").alias("end_instruction"),
        F.count("*").alias("length"),
    )
    return first_per_key(one.select("start_instruction", "first_line", "end_instruction", "length"), ["start_instruction"], "first_line")


def jumps(lines: DataFrame, strict: bool = True) -> DataFrame:
    """(jump_instruction, target_instruction, branch_taken, first_line), each combination once."""
    d = lines.select("line", "thread", F.col("instruction_id").alias("target_instruction"), "mnemonic", "flags")
    d = previous(d, "line", {"_m": "mnemonic", "jump_instruction": "target_instruction", "_f": "flags"}, THREAD).where(ends_block(F.col("_m")))
    d = d.withColumn("branch_taken", would_branch(F.col("_m"), F.col("_f"), strict))
    return d.groupBy("jump_instruction", "target_instruction", "branch_taken").agg(F.min("line").alias("first_line"))


def _stack(lines: DataFrame, floor: int) -> DataFrame:
    """Adds _p and _pid (mnemonic and instruction before), _i (calls and returns before), _l (height of the call stack, never under floor) and _pl (height before).

    The height is the running sum of calls and returns, reflected at the floor.
    """
    step = F.when(F.col("mnemonic") == "call", 1).when(F.col("mnemonic") == "ret", -1).otherwise(0)
    before = F.struct(F.col("mnemonic").alias("p"), F.col("instruction_id").alias("id"))
    d = scans(lines, "line", {"_before": (before, "last"), "_w": (step, "sum"), "_i": (F.abs(step), "sum")}, THREAD)
    d = settled(d.withColumns({"_p": F.col("_before.p"), "_pid": F.col("_before.id")}).drop("_before"))
    d = scans(d, "line", {"_pw": (F.col("_w"), "last"), "_pleast": (F.col("_w"), "min")}, THREAD)
    height = lambda w, least: floor + w + F.greatest(F.lit(0), -least)
    d = d.withColumns({"_l": height(F.col("_w"), F.least("_w", "_pleast")), "_pl": F.when(F.col("_pw").isNotNull(), height(F.col("_pw"), F.col("_pleast")))})
    return settled(d.drop("_w", "_pw", "_pleast"))


def with_block_starts(lines: DataFrame) -> DataFrame:
    """lines with starts_block: whether a thread's function block starts here, on its first line or behind a call or return."""
    # a line without a mnemonic ends its block
    ends = F.coalesce(F.col("mnemonic").isin("call", "ret"), F.lit(True))
    d = scan(lines, "line", ends, "_ended", "last", THREAD)
    return d.withColumn("starts_block", F.coalesce("_ended", F.lit(True))).drop("_ended")


def next_block(lines: DataFrame) -> DataFrame:
    """(line, next_start): for every line the first block of its thread that starts after it: an as-of join forward, without a join."""
    d = with_block_starts(lines.select("line", "thread", "mnemonic"))
    return carried_after(d, "line", F.when(F.col("starts_block"), F.col("line")), "next_start", group=THREAD).select("line", "next_start")


def return_lines(lines: DataFrame) -> DataFrame:
    """(call_line, module, return_line): for every call the module of the block before it, and where the next run of that module starts.

    Calls before any block are left out. Two as-of steps: back to the block, forward among the module's runs. Only starts of
    blocks, calls and starts of runs take part in them.
    """
    d = with_block_starts(lines.select("line", "thread", "module", "mnemonic")).where("starts_block OR mnemonic = 'call'")
    d = settled(d.drop("thread"))
    d = carried_before(d, "line", F.when(F.col("starts_block"), F.col("module")), "_m")
    calls = d.where("mnemonic = 'call' AND _m IS NOT NULL").select(F.col("_m").alias("module"), "line", F.lit(None).cast("long").alias("_s"), F.lit(1).alias("_call"))
    segments = carried_before(lines.select("line", "module").where("module IS NOT NULL"), "line", F.col("module"), "_last")
    segments = segments.where(~F.col("module").eqNullSafe(F.col("_last"))).select("module", "line", F.col("line").alias("_s"), F.lit(0).alias("_call"))
    # a run that starts on the call's own line stands before it, so it does not count
    both = settled(calls.unionByName(segments).withColumn("_order", F.col("line") * 2 + F.col("_call")))
    both = carried_after(both, "_order", F.col("_s"), "return_line", group=("module",))
    return both.where("_call = 1").select(F.col("line").alias("call_line"), "module", "return_line")


def _owned(lines: DataFrame) -> DataFrame:
    """function_owner's lines, with _p and _i of the stack."""
    d = _stack(lines, 1)
    enters = F.col("_p").isNull() | (F.col("_p") == "call") | ((F.col("_p") == "ret") & (F.col("_pl") == 1))
    d = scan(d, "line", F.when(enters, F.col("line")), "owner_line", "last", (*THREAD, "_l"), inclusive=True)
    return settled(d.drop("_pid", "_l", "_pl"))


def function_owner(lines: DataFrame) -> DataFrame:
    """Each line with the line that entered the frame it runs in (a stack that never empties: a bare return enters anew)."""
    return _owned(lines).drop("_i")


def thread_function_blocks(lines: DataFrame) -> DataFrame:
    """Runs of lines between calls and returns, with the function that owns them and their place in the thread."""
    d = _owned(lines.select("line", "thread", "instruction_id", "mnemonic"))
    blocks = d.groupBy("thread", "_i").agg(
        F.min("line").alias("start_line"),
        F.min_by("instruction_id", "line").alias("start_instruction"),
        F.max_by("instruction_id", "line").alias("end_instruction"),
        F.min("owner_line").alias("owner_line"),
        F.count("*").alias("width"),
    )
    blocks = settled(blocks)
    # a block's place: the lines of the thread's blocks before it
    blocks = scan(blocks, "start_line", F.col("width"), "x_offset", "sum", THREAD)
    names = lines.select(F.col("line").alias("owner_line"), F.col("instruction_id").alias("function_start"))
    return blocks.join(names, "owner_line").select(
        "thread", "start_line", "start_instruction", "end_instruction", "function_start", "x_offset", "width", (F.col("x_offset") + F.col("width")).alias("x_end")
    )


def call_associations(lines: DataFrame) -> DataFrame:
    """(call_instruction, caller, callee, first_line): first association of each call instruction.

    After a return the caller is the start of the function that was returned from, as in the traced tool.
    """
    d = _stack(lines.select("line", "thread", "instruction_id", "mnemonic"), 0)
    below = F.coalesce("_pl", F.lit(0))
    d = d.withColumn("_level", F.when(F.col("_p") == "ret", below).otherwise(F.col("_l")))
    d = settled(scan(d, "line", F.when(F.col("_p") == "call", F.col("line")), "_frame", "last", (*THREAD, "_level"), inclusive=True))
    start = F.when((F.col("_p") == "call") & (below > 0), F.col("line")).when((F.col("_p") == "ret") & (below > 0), F.col("_frame"))
    d = scan(d, "line", start, "_start", "last", THREAD).where(F.col("_p") == "call").where(below > 0)
    first = lines.groupBy("thread").agg(F.min("line").alias("_first"))
    d = d.join(first, "thread").withColumn("_caller", F.coalesce("_start", "_first"))
    names = lines.select(F.col("line").alias("_caller"), F.col("instruction_id").alias("caller"))
    rows = d.join(names, "_caller").select(F.col("_pid").alias("call_instruction"), "line", "caller", F.col("instruction_id").alias("callee"))
    return first_per_key(rows, ["call_instruction"]).withColumnRenamed("line", "first_line")


def neighbours(lines: DataFrame) -> DataFrame:
    """lines with prev_line and next_line of their thread."""
    d = previous(lines, "line", {"prev_line": "line"}, THREAD)
    return carried_after(d, "line", F.col("line"), "next_line", group=THREAD)


def thread_lengths(lines: DataFrame) -> DataFrame:
    return lines.groupBy("thread").agg(F.count("*").alias("length"))
