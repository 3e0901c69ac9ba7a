"""Region trees, call events and inherited channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import intervals as iv
from ..operators.ordered import carried_after
from ..sources.adapters import TRACE_SQL, table, trace_lines
from .interval_queries import ORD, spans
from .registry import query

W = f"WITH {TRACE_SQL}"
PARENT_SQL = """c AS (SELECT a.cust, a.id, p.id AS pid, row_number() OVER (PARTITION BY a.cust, a.id ORDER BY p.e - p.s, p.id) AS r FROM k a JOIN k p ON p.cust = a.cust AND p.s <= a.s AND p.e >= a.e AND (p.s < a.s OR p.e > a.e))
 SELECT k.cust, k.id, c.pid AS parent_id FROM k LEFT JOIN c ON c.cust = k.cust AND c.id = k.id AND c.r = 1"""


@query(f"{ORD}, k AS (SELECT * FROM o WHERE id % 3 <> 0), {PARENT_SQL}")
def region_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents after every third region went: children move up to the next region that encloses them."""
    return iv.parents(spans(spark, sf_dir).where("id % 3 <> 0"), ["cust"]).select("cust", "id", "parent_id")


@query(f"{ORD} SELECT a.cust, a.id, count(*) AS depth, max(p.e - p.s + 1) AS widest FROM o a JOIN o p ON p.cust = a.cust AND p.s <= a.s AND p.e >= a.e AND (p.s < a.s OR p.e > a.e) GROUP BY 1, 2")
def region_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many regions lie around each region, and the widest of them."""
    o = spans(spark, sf_dir)
    p = o.select("cust", F.col("s").alias("_s"), F.col("e").alias("_e"))
    around = o.join(p, "cust").where(iv.strictly_encloses(F.col("_s"), F.col("_e"), F.col("s"), F.col("e")))
    return around.groupBy("cust", "id").agg(F.count("*").alias("depth"), F.max(F.col("_e") - F.col("_s") + 1).alias("widest"))


@query(f"{ORD}, p AS (SELECT cust, 2500 + cust % 200 AS line FROM (SELECT DISTINCT cust FROM o) x), h AS (SELECT p.cust, p.line, o.id, row_number() OVER (PARTITION BY p.cust ORDER BY o.e - o.s, o.id) AS r FROM p JOIN o ON o.cust = p.cust AND o.s <= p.line AND p.line <= o.e) SELECT cust, line, id FROM h WHERE r = 1")
def deepest_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost region around one line of each customer."""
    o = spans(spark, sf_dir)
    lines = o.select("cust").distinct().withColumn("line", 2500 + F.col("cust") % 200)
    hit = o.join(lines, "cust").where("s <= line AND line <= e")
    return hit.groupBy("cust", "line").agg(F.min_by("id", F.struct(F.col("e") - F.col("s"), "id")).alias("id"))


@query(
    f"""{W}, c AS (SELECT line, thread, instruction_id, k FROM t WHERE mnemonic = 'call')
 SELECT c.line, c.instruction_id, (SELECT max(r.line) FROM t r WHERE r.k = c.k AND r.line < c.line) AS input_line, (SELECT min(r.line) FROM t r WHERE r.thread = c.thread AND r.mnemonic = 'ret' AND r.line > c.line) AS return_line FROM c"""
)
def call_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the last write to their buffer before them and their thread's next return: two windows, no range join."""
    t = trace_lines(spark, sf_dir)
    by_address = Window.partitionBy("addr").orderBy("line")
    t = t.withColumn("input_line", F.lag("line").over(by_address))
    t = carried_after(t, "line", F.when(F.col("mnemonic") == "ret", F.col("line")), "return_line", group=("thread",))
    return t.where("mnemonic = 'call'").select("line", "instruction_id", "input_line", "return_line")


@query("SELECT c_custkey AS child, c_nationkey AS parent, r_name AS channel_id FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def inherited_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted sockets (customers) take the channel of the socket that listened (nations)."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    listeners = n.select(F.lit("a").alias("trace"), F.col("n_nationkey").cast("long").alias("handle"), F.lit(0).alias("line"), F.lit("open").alias("type"), F.col("r_name").alias("channel_id"))
    # handles of customers stand behind those of nations
    c = table(spark, sf_dir, "customer").withColumn("handle", F.col("c_custkey").cast("long") + 25)
    accepted = c.select(F.lit("a").alias("trace"), "handle", F.lit(1).alias("line"), F.lit("open").alias("type"), F.lit(None).cast("string").alias("channel_id"))
    links = c.select(F.lit("a").alias("trace"), F.col("c_nationkey").cast("long").alias("parent"), F.col("handle").alias("child"))
    e = ch.child_channels(listeners.unionByName(accepted), links).where("line = 1")
    return e.join(links.select(F.col("child").alias("handle"), "parent"), "handle").select((F.col("handle") - 25).alias("child"), F.col("parent").cast("int").alias("parent"), "channel_id")
