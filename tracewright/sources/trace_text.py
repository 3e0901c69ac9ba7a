"""Text traces: lines, instructions, threads and the memory or register changes they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import carried_after, carried_before, running_total, scan, settled

# The traced tool's patterns.
INSTRUCTION = r"^([0-9a-fA-F]+) I:([0-9a-fA-F]*) ([^\s+]+)\+([0-9a-fA-F]+)(?: \(([0-9a-fA-F]+)\))? ([a-zA-Z0-9]+) ?([^|]*?) *(?:\||$)"
THREAD = r"(?:T: ?|TID=)(\d+)"
THREAD_BEFORE_BRACE = r"^[0-9a-fA-F]+\s([0-9a-fA-F]+)\s\{"
CHANGE = r"(?:\[([0-9A-Za-z]+)\]|(\w+))=([0-9A-Za-z]*)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a text file, or of several one behind the other by path, numbered from 0 in file order.

    Lines are counted per part of a file, and each part numbers its own behind the parts before it, so
    no task sees the whole file.
    """
    d = spark.read.text(path).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"))
    counts = d.groupBy("_f", "_s").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    ahead = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    offsets = counts.select("_f", "_s", "_first", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"))
    return d.join(offsets, ["_f", "_s"]).select((F.col("_o") + F.col("_id") - F.col("_first")).cast("long").alias("line"), "text")


def read_lines_with_ends(spark: SparkSession, path: str) -> DataFrame:
    """(line, text, terminator, ended) of a text file, or of several one behind the other by path, numbered from 0: the lines with what ends them.

    A line ends in \\n, \\r\\n or \\r, the last one of a file perhaps in nothing (then `ended` is false); texts with their terminators behind them
    give the file again, but for a byte order mark. Spark splits files at \\n only, in parts of any size, so what is left to tell is
    where else a line ends, and, by the bytes of all its lines, whether a file's last one ends at all. Files must not be compressed.
    """
    d = spark.read.option("lineSep", "\n").text(path)
    d = d.select(F.col("value"), F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.col("_metadata.file_size").alias("_size"))
    pieces = lambda v: F.size(F.split(v, "\r", -1)) - F.when(v.endswith("\r"), 1).otherwise(0)
    d = d.withColumn("_pieces", pieces(F.col("value")))
    parts = d.groupBy("_f", "_s").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("_size").alias("_size"))
    ahead = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    whole = Window.partitionBy("_f").orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the bytes with an end each are one too many where the last line has none; a mark of three bytes is not among them
    open_ = ~(F.col("_size") - F.sum("_bytes").over(whole)).isin(0, 3)
    parts = parts.select("_f", "_s", "_first", "_last", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_o"), (open_ & (F.max("_s").over(whole) == F.col("_s"))).alias("_open"))
    d = d.join(parts, ["_f", "_s"]).withColumn("_row", F.col("_o") + F.col("_id") - F.col("_first"))
    d = d.withColumn("_open", F.col("_open") & (F.col("_id") == F.col("_last")))
    d = running_total(d.select("value", "_row", "_pieces", "_open"), "_row", F.col("_pieces"), "_before")
    d = d.select("_before", "_open", F.col("value").endswith("\r").alias("_cr"), "_pieces", F.posexplode(F.slice(F.split("value", "\r", -1), F.lit(1), F.col("_pieces"))).alias("_i", "text"))
    last = F.col("_i") == F.col("_pieces") - 1
    end = F.when(~last, "\r").when(F.col("_cr") & F.col("_open"), "\r").when(F.col("_cr"), "\r\n").when(F.col("_open"), "").otherwise("\n")
    return d.select((F.col("_before") + F.col("_i")).cast("long").alias("line"), "text", end.alias("terminator"), (end != "").alias("ended"))


def thread_events(lines: DataFrame) -> DataFrame:
    """(line, tid, type_id, n_lines, view_start): where threads of a text trace begin (0), end (1), are switched to by name (2) or by their id (3), or all end (4).

    lines: (line, text). An id change is a line that names another thread than the lines before it, or the first line that names one after
    a begin, though it names the same. tid: the thread named on the line or else last before it. n_lines: lines up to the next event, for the last
    one up to the end; view_start: lines of the events before.

    Whether a line that names the same thread is an event hangs on the last line before it that is an event of another kind or
    names the same thread: only a begin makes it one. So two scans of last values do, and no state goes from line to line.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    braced = F.nullif(F.regexp_extract(t, THREAD_BEFORE_BRACE, 1), F.lit(""))
    old = F.substring(t, 1, 1).isin("T", "S") | F.substring(F.expr("substring(text, locate(' ', text) + 1)"), 1, 1).isin("T", "S")
    marked = F.when(F.contains(t, F.lit("} ThreadBegin ")), 0).when(F.contains(t, F.lit("} ThreadEnd ")), 1).when(F.contains(t, F.lit("} ApplicationEnd ")), 4)
    legacy = F.when(old & t.rlike(".+ThreadBegin"), 0).when(old & t.rlike(".+ThreadEnd"), 1).when(old & F.contains(t, F.lit("switch")), 2)
    named = F.when(marked == 0, F.coalesce(F.nullif(F.regexp_extract(t, r"(?:^|\s)TID=(\S+)", 1), F.lit("")), braced))
    named = named.when(marked.isNull() & braced.isNull() & (legacy == 0), F.nullif(F.regexp_extract(t, r"(?:^|\s)TID=(\S+)", 1), F.lit("")))
    named = named.when(marked.isNull() & braced.isNull() & (legacy == 2), F.trim(F.regexp_extract(t, r"^[^:]*:(.*?).switch", 1)))
    d = lines.select("line", marked.alias("_marked"), braced.alias("_braced"), legacy.alias("_legacy"), F.coalesce(named, braced).alias("_tid"))
    d = settled(scan(d, "line", F.col("_tid"), "_held", "last"))
    other = F.col("_braced").isNotNull() & (F.col("_held").isNull() | (F.col("_braced") != F.col("_held")))
    sure = F.coalesce("_marked", F.when(other, 3), F.when(F.col("_braced").isNull(), F.col("_legacy")))
    d = d.withColumns({"_sure": sure, "_same": sure.isNull() & F.col("_braced").isNotNull()})
    seen = F.when(F.col("_sure").isNotNull() | F.col("_same"), F.struct("_sure"))
    d = scan(d, "line", seen, "_y", "last")
    kind = F.coalesce("_sure", F.when(F.col("_same") & (F.col("_y._sure") == 0), 3))
    e = settled(d.select("line", F.coalesce("_tid", "_held").alias("tid"), kind.cast("int").alias("type_id")).where("type_id IS NOT NULL"))
    last, first = d.agg(F.max("line")).first()[0], e.agg(F.min("line")).first()[0]
    e = carried_after(e, "line", F.col("line"), "_next")
    behind = F.lit(None if last is None else last + 1).cast("long")
    return e.select("line", "tid", "type_id", (F.coalesce("_next", behind) - F.col("line")).alias("n_lines"), (F.col("line") - F.lit(first).cast("long")).alias("view_start"))


def kind_of(text: Column) -> Column:
    """instruction, begin, end, application end, entry, exit, context switch, skipped, thread switch or other."""
    marks = {" I:": "instruction", " S:ThreadBegin": "begin", " S:ThreadEnd": "end", " S:ApplicationEnd": "application end", " S:SyscallEntry": "entry", " S:SyscallExit": "exit", " S:ContextSwitch": "context switch", " S:SyscallSkipped": "skipped", " T:": "thread switch"}
    c = None
    for mark, name in marks.items():
        hit = F.substring_index(text, " ", 1).rlike("^[0-9a-fA-F]+$") & F.contains(F.substring(text, 1, 60), F.lit(mark))
        c = F.when(hit, name) if c is None else c.when(hit, name)
    return c.otherwise("other")


def parse(lines: DataFrame) -> DataFrame:
    """Typed trace lines of (line, text).

    The thread of a line is the last one that a thread mark at or before it names; lines of the newer form name theirs in
    hex before a brace. Lines that are
    no instruction have null instruction columns. refs: changes on the line, with is_before true
    left of the bar sign. Null texts give kind `other` and no refs.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    x = lambda i: F.regexp_extract(t, INSTRUCTION, i)
    ok = t.rlike(INSTRUCTION)
    d = lines.withColumn("kind", kind_of(t))
    braced = F.conv(F.regexp_extract(t, THREAD_BEFORE_BRACE, 1), 16, 10).cast("int")
    named = F.when(t.rlike(THREAD_BEFORE_BRACE), braced).when(t.rlike(THREAD) & (F.col("kind") != "instruction"), F.regexp_extract(t, THREAD, 1).cast("int"))
    d = d.withColumn("_named", named)
    d = carried_before(d, "line", F.col("_named"), "_thread")
    d = d.withColumn("thread", F.coalesce("_named", "_thread"))
    number = lambda c: F.conv(c, 16, 10).cast("decimal(20,0)")
    before, after = F.substring_index(t, "|", 1), F.expr("CASE WHEN locate('|', text) > 0 THEN substring(text, locate('|', text) + 1) ELSE '' END")

    def changes(part: Column, is_before: bool) -> Column:
        found = F.regexp_extract_all(part, F.lit(CHANGE), F.lit(0))
        return F.transform(
            found,
            lambda m: F.struct(
                F.when(m.startswith("["), "memory").otherwise("register").alias("kind"),
                F.nullif(F.regexp_extract(m, CHANGE, 2), F.lit("")).alias("reg"),
                F.when(m.startswith("["), number(F.regexp_extract(m, CHANGE, 1))).alias("addr"),
                F.regexp_extract(m, CHANGE, 3).alias("value_hex"),
                F.lit(is_before).alias("is_before"),
            ),
        )

    mine = F.regexp_replace(before, r"^[0-9a-fA-F]+ S:Thread.*$", "")
    refs = F.concat(F.when(F.contains(t, F.lit("|")), changes(mine, True)).otherwise(changes(F.lit(""), True)), changes(F.coalesce(after, F.lit("")), False))
    return d.select(
        "line",
        "text",
        "kind",
        "thread",
        F.when(ok, x(3)).alias("module"),
        F.when(ok, F.conv(x(4), 16, 10).cast("long")).alias("module_offset"),
        F.when(ok & (x(5) != ""), number(x(5))).alias("address"),
        F.when(ok, F.lower(x(6))).alias("mnemonic"),
        F.when(ok, F.trim(F.concat_ws(" ", x(6), x(7)))).alias("instruction_text"),
        refs.alias("refs"),
    )


def with_instruction_ids(parsed: DataFrame) -> DataFrame:
    """Adds module_id (modules numbered by first appearance) and instruction_id (module_id:offset)."""
    seen = parsed.where("module is not null").groupBy("module").agg(F.min("line").alias("_f"))
    ids = seen.select("module", (F.row_number().over(Window.orderBy("_f")) - 1).cast("int").alias("module_id"))  # a row per module
    return parsed.join(ids, "module", "left").withColumn("instruction_id", F.concat_ws(":", F.col("module_id").cast("string"), F.when(F.col("module_id").isNotNull(), F.col("module_offset").cast("string"))))
