"""State, windows, search and roll-ups of memory and registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..operators.ordered import carried_after
from ..sources.adapters import TRACE_SQL, trace_lines
from . import flow_queries  # noqa: F401
from .registry import ORACLES, query

W = f"WITH {TRACE_SQL}"
#: Two-byte writes at even and odd addresses, so that writes overlap.
REFS_SQL = "refs AS (SELECT line, thread, k AS addr, lpad(upper(to_hex(byte)), 2, '0') || lpad(upper(to_hex((byte * 7) % 256)), 2, '0') AS v FROM t), b AS (SELECT line, addr, substr(v, 1, 2) AS byte FROM refs UNION ALL SELECT line, addr + 1, substr(v, 3, 2) FROM refs)"
STATE_SQL = "st AS (SELECT addr, max_by(byte, line) AS byte, max(line) AS line FROM b WHERE line <= 4321 GROUP BY addr)"
#: Lines stand this far apart for the snapshots, so that both levels take part at the line two thirds through the trace.
APART = 997
LATE_SQL = f"z AS (SELECT CAST(max(line) AS BIGINT) * 2 // 3 * {APART} AS at_line FROM t), st AS (SELECT addr, max_by(byte, line * {APART}) AS byte, max(line * {APART}) AS line FROM b, z WHERE line * {APART} <= at_line GROUP BY addr)"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda c: F.lpad(F.hex(c), 2, "0")
    t = trace_lines(spark, sf_dir)
    return t.select("line", F.lit(0).alias("seq"), "thread", F.col("addr").cast("decimal(20,0)").alias("addr"), F.concat(h(F.col("byte")), h((F.col("byte") * 7) % 256)).alias("value_hex"))


@query(f"{W}, {REFS_SQL}, {STATE_SQL} SELECT CAST(addr AS BIGINT) AS addr, byte, line FROM st")
def memory_state_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.state_at(memory.bytes_of(refs(spark, sf_dir)), 4321).withColumn("addr", F.col("addr").cast("long"))


@query(f"{W}, {REFS_SQL}, {STATE_SQL} SELECT r.addr, coalesce(st.byte, '??') AS byte FROM (SELECT unnest(generate_series(90, 120)) AS addr) r LEFT JOIN st ON st.addr = r.addr")
def hex_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.window_of(memory.state_at(memory.bytes_of(refs(spark, sf_dir)), 4321), 90, 120)


@query(f"{W}, {REFS_SQL}, {STATE_SQL} SELECT CAST(a.addr AS BIGINT) AS addr FROM st a WHERE a.byte = (SELECT byte FROM st WHERE addr = 20)")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the byte that stands at address 20 occurs."""
    state = memory.state_at(memory.bytes_of(refs(spark, sf_dir)), 4321)
    needle = state.where("addr = 20").first()
    return memory.search(state, needle["byte"]) if needle else state.where("false").select(F.col("addr").cast("long").alias("addr"))


@query(f"{W}, {REFS_SQL} SELECT line // 1000 AS bucket, CAST(addr AS BIGINT) AS addr, max_by(byte, line) AS byte, max(line) AS line FROM b GROUP BY 1, 2")
def delta_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-level snapshots: the newest byte of each address within blocks of 1000 lines."""
    s = memory.snapshot(memory.bytes_of(refs(spark, sf_dir)), ["addr"], "byte", 1)
    return s.select("bucket", F.col("addr").cast("long").alias("addr"), "byte", "line")


@query(f"{W}, {REFS_SQL}, {LATE_SQL} SELECT CAST(addr AS BIGINT) AS addr, byte, line FROM st")
def state_from_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at a line by way of two levels of snapshots; equal to the plain aggregation."""
    b = memory.bytes_of(refs(spark, sf_dir)).withColumn("line", F.col("line") * APART)
    line = b.agg(F.floor(F.floor(F.max("line") / APART) * 2 / 3) * APART).first()[0]
    first, second = memory.snapshot(b, ["addr"], "byte", 1), memory.snapshot(b, ["addr"], "byte", 2)
    return memory.state_from_snapshots(b, first, second, ["addr"], "byte", line or 0).withColumn("addr", F.col("addr").cast("long"))


REG_SQL = "g AS (SELECT line, 'R' || (k % 8) AS reg, lpad(upper(to_hex(k)), 16, '0') AS v, line % 2 = 0 AS before FROM t)"


@query(f"{W}, {REG_SQL} SELECT reg, max_by(v, line) AS value_hex, max(line) AS line FROM g GROUP BY reg")
def register_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace_lines(spark, sf_dir)
    g = t.select("line", F.lit(0).alias("seq"), F.concat(F.lit("R"), (F.col("addr") % 8).cast("string")).alias("reg"), F.lpad(F.hex("addr"), 16, "0").alias("value_hex"), (F.col("line") % 2 == 0).alias("is_before"))
    return memory.merged_registers(g)


@query(f"{W} SELECT line, lpad(upper(to_hex(k)), 4, '0') AS low, substr('1122334455667788', 1, 14) || lpad(upper(to_hex(k % 256)), 2, '0') AS part8, '112233445566' || lpad(upper(to_hex(k % 256)), 2, '0') || '88' AS part8h, '00000000' || lpad(upper(to_hex(k)), 8, '0') AS part32 FROM t")
def register_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.lit("1122334455667788")
    new = F.lpad(F.hex("addr"), 16, "0")
    return trace_lines(spark, sf_dir).select(
        "line",
        F.right(new, F.lit(4)).alias("low"),
        memory.spliced(old, new, 8).alias("part8"),
        memory.spliced(old, new, 8, high_byte=True).alias("part8h"),
        memory.spliced(old, new, 32).alias("part32"),
    )


@query(f"{W}, {REFS_SQL} SELECT line, CAST(addr AS BIGINT) AS addr, byte FROM b WHERE line >= 1000 AND line < 1100")
def mem_refs_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = refs(spark, sf_dir).where("line >= 1000 AND line < 1100")
    return memory.bytes_of(r).select("line", F.col("addr").cast("long").alias("addr"), "byte")


@query(f"{W}, {REFS_SQL}, w AS (SELECT * FROM (VALUES (5), (50), (5000)) v(addr)), {STATE_SQL} SELECT CAST(w.addr AS BIGINT) AS addr, coalesce(byte, '??') AS byte FROM w LEFT JOIN st USING (addr)")
def watch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = spark.createDataFrame([(5,), (50,), (5000,)], "addr long")
    state = memory.state_at(memory.bytes_of(refs(spark, sf_dir)), 4321).withColumn("addr", F.col("addr").cast("long"))
    return watched.join(state, "addr", "left").select("addr", F.coalesce("byte", F.lit("??")).alias("byte"))


@query(f"{W}, {REFS_SQL} SELECT CAST(max(addr) + 1 AS BIGINT) AS extent, CAST((max(addr) + 16) // 16 AS BIGINT) AS rows_of_16 FROM b")
def memory_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = memory.bytes_of(refs(spark, sf_dir)).agg((F.max("addr") + 1).cast("long").alias("extent"))
    return top.select("extent", F.ceil(F.col("extent") / 16).cast("long").alias("rows_of_16"))


# a call's pointer, and the line on which its thread returns next
POINTERS_SQL = """rr AS (SELECT line, thread FROM t WHERE mnemonic = 'ret'), calls AS (SELECT t.line, t.k AS buffer, rr.line AS ret FROM t ASOF LEFT JOIN rr ON rr.thread = t.thread AND rr.line > t.line WHERE t.mnemonic = 'call'),
 asked AS (SELECT line, buffer, 0 AS late, line AS seen FROM calls UNION ALL SELECT line, buffer, 1, ret FROM calls WHERE ret IS NOT NULL),
 held AS (SELECT asked.line, asked.late, b.addr, max_by(b.byte, b.line) AS byte FROM asked JOIN b ON b.addr >= buffer AND b.addr < buffer + 256 AND b.line <= seen GROUP BY 1, 2, 3)"""


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace_lines(spark, sf_dir)
    calls = carried_after(t, "line", F.when(F.col("mnemonic") == "ret", F.col("line")), "return_line", group=("thread",)).where("mnemonic = 'call'")
    return calls.select("line", F.col("addr").alias("buffer"), "return_line")


@query(f"{W}, {REFS_SQL}, {POINTERS_SQL} SELECT line, string_agg(byte, '' ORDER BY addr) AS payload FROM held WHERE late = 0 GROUP BY line")
def pointed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a call's buffer address points to when it is made, in address order."""
    return memory.pointed(_pointers(spark, sf_dir), memory.bytes_of(refs(spark, sf_dir)))


@query(
    f"""{W}, {REFS_SQL}, {POINTERS_SQL}, p AS (SELECT line, late, regexp_replace(split_part(string_agg(chr(CAST('0x' || byte AS INT)), '' ORDER BY addr), chr(10), 1), '^ +| +$', '', 'g') AS s FROM held GROUP BY 1, 2)
 SELECT line, coalesce(nullif(max(s) FILTER (late = 0), ''), max(s) FILTER (late = 1), max(s) FILTER (late = 0)) AS text FROM p GROUP BY line"""
)
def pointed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of the text behind a call's buffer address, trimmed, when it is made; where that is empty, when its thread returns."""
    return memory.pointed_texts(_pointers(spark, sf_dir), memory.bytes_of(refs(spark, sf_dir)))


# a write to a part of one of eight registers on every line
PARTS = [64, 32, 16, 8, -8]
PARTS_SQL = """pw AS (SELECT line, k % 8 AS r, (k // 8 + line) % 5 AS part, upper(printf('%016x', (k * 2654435761 + line * 40503) % 4611686018427387904)) AS v FROM t),
 lanes AS (SELECT line, r, CASE WHEN part = 0 THEN v[1:8] WHEN part = 1 THEN '00000000' END AS a, CASE WHEN part < 2 THEN v[9:12] END AS b, CASE WHEN part < 3 THEN v[13:14] WHEN part = 4 THEN v[15:16] END AS c, CASE WHEN part < 4 THEN v[15:16] END AS d FROM pw)"""


@query(
    f"""{W}, {PARTS_SQL} SELECT 'R' || r AS reg, line, coalesce(last_value(a IGNORE NULLS) OVER w, '00000000') || coalesce(last_value(b IGNORE NULLS) OVER w, '0000') || coalesce(last_value(c IGNORE NULLS) OVER w, '00') || coalesce(last_value(d IGNORE NULLS) OVER w, '00') AS value_hex
 FROM lanes WINDOW w AS (PARTITION BY r ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
)
def register_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full value of the register that each line writes a part of."""
    return memory.register_file(_part_writes(spark, sf_dir))


def _part_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, line = F.col("addr"), F.col("line")
    width = F.get(F.array(*map(F.lit, PARTS)), ((F.floor(k / 8) + line) % 5).cast("int"))
    value = F.lpad(F.hex((k * 2654435761 + line * 40503) % 4611686018427387904), 16, "0")
    return trace_lines(spark, sf_dir).select(F.concat(F.lit("R"), (k % 8).cast("string")).alias("reg"), "line", F.lit(0).alias("seq"), width.alias("width"), value.alias("value_hex"))


@query(
    f"""{W}, r AS (SELECT line, 0 AS seq, 'register' AS kind, 'R' || (k % 8) AS key, lpad(upper(to_hex(k)), 16, '0') AS value_hex, line % 2 = 0 AS is_before FROM t
 UNION ALL SELECT line, 1, 'memory', CAST(k AS VARCHAR), lpad(upper(to_hex(byte)), 2, '0'), false FROM t WHERE k <> 40)
 SELECT * FROM r"""
)
def leaf_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line changes, without the address of the thread's information block."""
    t = trace_lines(spark, sf_dir)
    none = F.lit(None)
    register = F.struct(F.lit("register").alias("kind"), F.concat(F.lit("R"), (F.col("addr") % 8).cast("string")).alias("reg"), none.cast("decimal(20,0)").alias("addr"), F.lpad(F.hex("addr"), 16, "0").alias("value_hex"), (F.col("line") % 2 == 0).alias("is_before"))
    cell = F.struct(F.lit("memory").alias("kind"), none.cast("string").alias("reg"), F.col("addr").cast("decimal(20,0)").alias("addr"), F.lpad(F.hex("byte"), 2, "0").alias("value_hex"), F.lit(False).alias("is_before"))
    return memory.leaf_deltas(t.select("line", F.array(register, cell).alias("refs")), skip=40)


@query(
    f"""{W}, s AS (SELECT line, k, (k & 4) <> 0 AS wide, mnemonic = 'call' AS entry FROM t WHERE mnemonic IN ('call', 'ret'))
 SELECT line, CASE WHEN wide THEN CASE WHEN entry THEN 'RSP' ELSE 'RAX' END ELSE CASE WHEN entry THEN 'ESP' ELSE 'EAX' END END AS reg, lpad(upper(to_hex(k)), CASE WHEN wide THEN 16 ELSE 8 END, '0') AS value_hex, entry AS is_before FROM s"""
)
def syscall_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers that system calls change, by execution mode."""
    t = trace_lines(spark, sf_dir).where("mnemonic IN ('call', 'ret')")
    reg = memory.syscall_register(F.col("flags"), F.col("mnemonic") == "call", F.col("addr"), wide_flag=4)
    return t.select("line", reg.alias("r")).select("line", "r.*")


@query(
    f"""{W}, {REFS_SQL}, r AS (SELECT line, thread FROM t WHERE mnemonic = 'ret'),
 c AS (SELECT t.line, t.line % 2 = 0 AS sends, r.line AS ret FROM t ASOF LEFT JOIN r ON r.thread = t.thread AND r.line > t.line WHERE t.mnemonic = 'call'),
 g AS (SELECT line, k % 8 AS reg, k FROM t), g1 AS (SELECT * FROM g WHERE reg = 1), g2 AS (SELECT * FROM g WHERE reg = 2),
 a AS (SELECT c.line, CASE WHEN sends THEN c.line ELSE ret END AS seen, g1.k AS buffer, g2.k % 8 + 1 AS length FROM c ASOF LEFT JOIN g1 ON g1.line <= c.line ASOF LEFT JOIN g2 ON g2.line <= c.line),
 x AS (SELECT line, seen, i, buffer + i AS addr FROM (SELECT *, unnest(generate_series(0, length - 1)) AS i FROM a WHERE seen IS NOT NULL) z),
 w AS (SELECT addr, line, max(byte) AS byte FROM b GROUP BY 1, 2), y AS (SELECT x.line, x.i, w.byte FROM x ASOF LEFT JOIN w ON w.addr = x.addr AND w.line <= x.seen),
 p AS (SELECT line, string_agg(byte, '' ORDER BY i) AS payload FROM y WHERE byte IS NOT NULL GROUP BY line)
 SELECT a.line, a.seen AS read_line, a.buffer, a.length, p.payload FROM a LEFT JOIN p ON p.line = a.line"""
)
def call_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls send, read where they are entered, and what they receive, read where their thread returns next."""
    t = trace_lines(spark, sf_dir)
    calls = carried_after(t, "line", F.when(F.col("mnemonic") == "ret", F.col("line")), "_ret", group=("thread",)).where("mnemonic = 'call'")
    calls = calls.select("line", F.when(F.col("line") % 2 == 0, F.col("line")).otherwise(F.col("_ret")).alias("at"), F.lit("R1").alias("buffer_reg"), F.lit("R2").alias("length_reg"))
    number = F.col("addr") % 8
    registers = t.select(F.concat(F.lit("R"), number.cast("string")).alias("reg"), "line", F.when(number == 2, F.col("addr") % 8 + 1).otherwise(F.col("addr")).alias("value"))
    written = memory.bytes_of(refs(spark, sf_dir)).groupBy(F.col("addr").cast("long").alias("addr"), "line").agg(F.max("byte").alias("byte"))
    return memory.call_messages(calls, registers, written).select("line", F.col("at").alias("read_line"), "buffer", "length", "payload")


# clicks execute the first instruction of described functions: of addresses under 30 sends, under 60 receives, under 90 checks; odd ones name
# a place for what they receive. R1 holds the buffer, R2 the length, R3 a value, R5 a pointer to a name, R4 the result
@query(
    f"""{W}, {REFS_SQL}, ret AS ({ORACLES["function_ret_line"]}),
 h AS (SELECT t.line, k, CASE WHEN k < 30 THEN 'send' WHEN k < 60 THEN 'receive' ELSE 'check' END AS type, k >= 30 AND k % 2 = 1 AS placed, ret.return_line FROM t LEFT JOIN ret ON ret.call_line + 1 = t.line WHERE t.instruction_id LIKE 'click:%' AND k < 90),
 g AS (SELECT line, k % 8 AS reg, CASE WHEN k % 8 = 2 THEN k // 8 + 1 ELSE k END AS v FROM t),
 g1 AS (SELECT * FROM g WHERE reg = 1), g2 AS (SELECT * FROM g WHERE reg = 2), g3 AS (SELECT * FROM g WHERE reg = 3), g4 AS (SELECT * FROM g WHERE reg = 4), g5 AS (SELECT * FROM g WHERE reg = 5),
 a AS (SELECT h.*, g1.v AS buffer, g2.v AS length, g3.v AS val, g5.v AS name_at, CASE WHEN h.return_line IS NOT NULL THEN g4.v END AS ret_value
  FROM h ASOF LEFT JOIN g1 ON g1.line <= h.line ASOF LEFT JOIN g2 ON g2.line <= h.line ASOF LEFT JOIN g3 ON g3.line <= h.line ASOF LEFT JOIN g5 ON g5.line <= h.line ASOF LEFT JOIN g4 ON g4.line <= coalesce(h.return_line, -1)),
 nt AS (SELECT a.line, x.late, b.addr, max_by(b.byte, b.line) AS byte FROM a, (VALUES (0), (1)) x(late), b WHERE a.type <> 'send' AND b.addr >= name_at AND b.addr < name_at + 256 AND b.line <= CASE WHEN late = 0 THEN a.line ELSE return_line END GROUP BY 1, 2, 3),
 ns AS (SELECT line, late, regexp_replace(split_part(string_agg(chr(CAST('0x' || byte AS INT)), '' ORDER BY addr), chr(10), 1), '^ +| +$', '', 'g') AS s FROM nt GROUP BY 1, 2),
 nn AS (SELECT line, coalesce(nullif(max(s) FILTER (late = 0), ''), max(s) FILTER (late = 1), max(s) FILTER (late = 0)) AS name FROM ns GROUP BY 1),
 c AS (SELECT a.*, CASE WHEN type = 'send' THEN upper(printf('%016x', val)) ELSE nn.name END AS input_value FROM a LEFT JOIN nn USING (line)),
 told AS (SELECT line, coalesce(input_value, '') AS key, buffer, length FROM c WHERE type = 'receive' AND placed),
 e AS (SELECT c.line, c.return_line, c.type, c.input_value, c.ret_value, CASE WHEN c.type = 'check' AND placed THEN told.buffer ELSE c.buffer END AS buffer, CASE WHEN c.type = 'check' AND placed THEN told.length ELSE c.length END AS length FROM c ASOF LEFT JOIN told ON told.key = coalesce(c.input_value, '') AND told.line < c.line),
 mt AS (SELECT e.line, b.addr, max_by(b.byte, b.line) AS byte FROM e JOIN b ON b.addr >= e.buffer AND b.addr < e.buffer + e.length AND b.line <= CASE WHEN e.type = 'send' THEN e.line ELSE e.return_line END GROUP BY 1, 2),
 ms AS (SELECT line, string_agg(chr(CAST('0x' || byte AS INT)), '' ORDER BY addr) AS s FROM mt GROUP BY 1)
 SELECT e.line, return_line, 'f-' || type AS func, type, input_value, upper(printf('%016x', ret_value)) AS ret_value, CAST(buffer AS BIGINT) AS buffer, CAST(length AS BIGINT) AS length,
  CASE WHEN type = 'send' THEN substr(s, 1, CAST(greatest(length - 1, 0) AS INT)) ELSE regexp_replace(split_part(s, chr(10), 1), '^ +| +$', '', 'g') END AS message FROM e LEFT JOIN ms USING (line)"""
)
def call_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of described functions with their arguments, results and the texts they sent or received."""
    t = trace_lines(spark, sf_dir)
    k = F.col("addr")
    own = t.where("instruction_id LIKE 'click:%' AND addr < 90").select("instruction_id", "addr").distinct()
    kind = F.when(k < 30, "send").when(k < 60, "receive").otherwise("check")
    reg = lambda c, name: F.when(c, F.lit(name)).alias
    sends = k < 30
    d = own.select(
        "instruction_id",
        F.concat(F.lit("f-"), kind).alias("func"),
        kind.alias("type"),
        F.lit("R4").alias("ret_reg"),
        F.when(sends, "R3").otherwise("R5").alias("value_reg"),
        sends.alias("value_is_value"),
        reg(sends, "R1")("in_reg"),
        reg(sends, "R2")("in_len_reg"),
        reg(~sends, "R1")("out_reg"),
        reg(~sends, "R2")("out_len_reg"),
        F.when(~sends & (k % 2 == 1), "p").alias("data_index"),
    )
    value = F.when(k % 8 == 2, F.floor(k / 8) + 1).otherwise(k)
    registers = t.select(F.concat(F.lit("R"), (k % 8).cast("string")).alias("reg"), "line", F.lpad(F.hex(value), 16, "0").alias("value_hex"))
    out = memory.call_events(t, d, registers, memory.bytes_of(refs(spark, sf_dir)))
    return out.withColumn("buffer", F.col("buffer").cast("long"))
