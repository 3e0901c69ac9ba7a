"""Interval predicates, joins and set operations on call blocks and order spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..sources.adapters import table
from .registry import query

# orders: a customer's order key spans; day numbers are exact in both engines
ORD = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust, CAST(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS BIGINT) AS s,
 CAST(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) + 5 + o_orderkey % 40 AS BIGINT) AS e FROM orders)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), day.alias("s"), (day + 5 + F.col("o_orderkey") % 40).alias("e"))


@query(f"{ORD} SELECT l.id AS id_l, r.id AS id_r FROM o l JOIN o r ON r.cust = l.cust AND l.s <= r.e AND r.s <= l.e")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of spans of one customer that intersect, each span with itself too."""
    o = spans(spark, sf_dir)
    a = o.select("cust", F.col("id").alias("id_l"), F.col("s").alias("s_l"), F.col("e").alias("e_l"))
    b = o.select("cust", F.col("id").alias("id_r"), F.col("s").alias("s_r"), F.col("e").alias("e_r"))
    return iv.overlaps(a, b, 32, ("cust",)).select("id_l", "id_r")


@query(f"{ORD}, p AS (SELECT unnest(generate_series(0, 4000, 90)) AS p) SELECT p.p, o.id FROM p JOIN o ON o.s <= p.p AND p.p <= o.e")
def interval_stab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans that contain one of the days on which quarters of 90 days end."""
    return iv.stab(spans(spark, sf_dir), spark.range(0, 4001, 90).withColumnRenamed("id", "p"), 32).select("p", "id")


@query(f"{ORD} SELECT a.cust, a.id, b.id AS other FROM o a JOIN o b ON b.cust = a.cust AND a.id < b.id AND a.s <= b.e AND b.s <= a.e AND NOT (a.s <= b.s AND a.e >= b.e) AND NOT (b.s <= a.s AND b.e >= a.e)")
def region_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of one customer that overlap in part, which a region tree rejects."""
    return iv.partial_overlaps(spans(spark, sf_dir), ["cust"], 32)


DAYS = f"{ORD}, n AS (SELECT cust, s, e FROM o WHERE id % 2 = 0), q AS (SELECT cust, s, e FROM o WHERE id % 2 = 1)"


@query(
    f"""{DAYS}, d AS (SELECT DISTINCT cust, s, e, unnest(generate_series(s, e)) AS day FROM n),
 x AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.cust = d.cust AND q.s <= day AND day <= q.e)),
 g AS (SELECT *, day - row_number() OVER (PARTITION BY cust, s, e ORDER BY day) AS grp FROM x)
 SELECT cust, s AS ns, e AS ne, min(day) AS s, max(day) AS e FROM g GROUP BY cust, g.s, g.e, grp"""
)
def interval_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spans(spark, sf_dir)
    return iv.difference(o.where("id % 2 = 0"), o.where("id % 2 = 1"), ["cust"])


@query(
    f"""{DAYS}, u AS (SELECT DISTINCT cust, s AS ts, e AS te FROM n), d AS (SELECT *, unnest(generate_series(ts, te)) AS day FROM u)
 SELECT cust, ts, te, bool_and(EXISTS (SELECT 1 FROM q WHERE q.cust = d.cust AND q.s <= day AND day <= q.e)) AS covered FROM d GROUP BY cust, ts, te"""
)
def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spans(spark, sf_dir)
    targets = o.where("id % 2 = 0").select("cust", F.col("s").alias("ts"), F.col("e").alias("te")).distinct()
    return iv.covered(targets, o.where("id % 2 = 1"), ["cust"])


@query(
    f"""{ORD}, c AS (SELECT a.cust, a.id, p.id AS pid, row_number() OVER (PARTITION BY a.cust, a.id ORDER BY p.e - p.s, p.id) AS r FROM o a JOIN o p ON p.cust = a.cust AND p.s <= a.s AND p.e >= a.e AND (p.s < a.s OR p.e > a.e))
 SELECT o.cust, o.id, c.pid AS parent_id FROM o LEFT JOIN c ON c.cust = o.cust AND c.id = o.id AND c.r = 1"""
)
def interval_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region tree: each span's smallest strictly enclosing span of the same customer."""
    return iv.parents(spans(spark, sf_dir), ["cust"]).select("cust", "id", "parent_id")


@query(f"{DAYS} SELECT cust, s, e FROM n WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.cust = n.cust AND q.s <= n.s AND q.e >= n.e)")
def interval_anti_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spans(spark, sf_dir)
    return iv.not_contained(o.where("id % 2 = 0").select("cust", "s", "e"), o.where("id % 2 = 1"), ["cust"])


@query(f"{ORD} SELECT a.cust, a.id, b.id AS other, a.s <= b.s AND a.e >= b.e AS encloses, a.s <= b.s AND a.e >= b.e AND (a.s < b.s OR a.e > b.e) AS strictly, a.s <= b.e AND b.s <= a.e AS intersects, a.e - a.s + 1 AS length FROM o a JOIN o b ON b.cust = a.cust AND b.id <> a.id")
def interval_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spans(spark, sf_dir)
    b = o.select("cust", F.col("id").alias("other"), F.col("s").alias("bs"), F.col("e").alias("be"))
    x = (F.col("s"), F.col("e"), F.col("bs"), F.col("be"))
    return o.join(b, "cust").where("id <> other").select(
        "cust", "id", "other", iv.encloses(*x).alias("encloses"), iv.strictly_encloses(*x).alias("strictly"), iv.intersects(*x).alias("intersects"), (F.col("e") - F.col("s") + 1).alias("length")
    )


@query(f"{ORD}, d AS (SELECT DISTINCT cust, unnest(generate_series(s, e)) AS day FROM o) SELECT cust, count(*) AS covered_days FROM d GROUP BY cust")
def collapsed_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a customer's merged spans hide."""
    return iv.merged(spans(spark, sf_dir), ["cust"]).groupBy("cust").agg(F.sum(F.col("e") - F.col("s") + 1).alias("covered_days"))


@query(f"{ORD}, d AS (SELECT DISTINCT unnest(generate_series(s, e)) AS day FROM o WHERE cust = 7), v AS (SELECT day FROM (SELECT unnest(generate_series(0, 5000)) AS day) x WHERE day NOT IN (SELECT day FROM d) AND day < 3000 ORDER BY day DESC LIMIT 500) SELECT day AS line FROM v")
def page_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 visible lines before line 3000, skipping collapsed spans."""
    return iv.page(spans(spark, sf_dir).where("cust = 7"), 3000, 5000)


@query(f"{ORD}, d AS (SELECT DISTINCT unnest(generate_series(s, e)) AS day FROM o WHERE cust = 7), v AS (SELECT day FROM (SELECT unnest(generate_series(0, 5000)) AS day) x WHERE day NOT IN (SELECT day FROM d) AND day > 900 ORDER BY day LIMIT 500) SELECT day AS line FROM v")
def page_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 visible lines behind line 900, skipping collapsed spans."""
    return iv.page(spans(spark, sf_dir).where("cust = 7"), 900, 5000, left=False)


@query(f"{ORD}, d AS (SELECT DISTINCT unnest(generate_series(s, e)) AS day FROM o WHERE cust = 7) SELECT count(*) AS lines FROM (SELECT unnest(generate_series(800, 3000)) AS day) x WHERE day NOT IN (SELECT day FROM d)")
def uncovered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a span that no collapsed region hides."""
    return iv.visible_count(spans(spark, sf_dir).where("cust = 7"), 800, 3000)


@query(f"{ORD} SELECT id, s, e FROM o WHERE 2600 >= s AND e >= 2500")
def markers_by_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that overlap a window of pixels."""
    return spans(spark, sf_dir).where("s <= 2600 AND e >= 2500").select("id", "s", "e")


@query(f"{ORD} SELECT id, s, e FROM o WHERE s <= 2550 AND 2550 <= e")
def markers_containing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers around a line; the upper bound is inclusive, so a boundary line is in two."""
    return spans(spark, sf_dir).where("s <= 2550 AND e >= 2550").select("id", "s", "e")


@query(f"{ORD} SELECT id, s, e FROM o WHERE s BETWEEN 2500 AND 2510")
def markers_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).where("s BETWEEN 2500 AND 2510").select("id", "s", "e")


@query(f"{ORD} SELECT s // 1000 AS page, count(*) AS n FROM o GROUP BY 1")
def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers per page of 1000 pixels."""
    return spans(spark, sf_dir).groupBy(F.floor(F.col("s") / 1000).alias("page")).agg(F.count("*").alias("n"))


# a line a day that events happened on, collapsed where one of a few customers had orders
SHOWN_SQL = f"{ORD}, h AS (SELECT s, e FROM o WHERE cust % 300 = 7), c AS (SELECT DISTINCT unnest(generate_series(s, e)) AS day FROM h), l AS (SELECT DISTINCT event_id % 5000 AS line FROM events)"


@query(f"{SHOWN_SQL}, v AS (SELECT day AS line, row_number() OVER (ORDER BY day) - 1 AS shown FROM (SELECT unnest(generate_series(0, 4999)) AS day) x WHERE day NOT IN (SELECT day FROM c)) SELECT l.line, v.shown FROM l LEFT JOIN v ON v.line = l.line")
def shown_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line stands among those shown; hidden ones stand nowhere."""
    return iv.shown_positions(_lines(spark, sf_dir), spans(spark, sf_dir).where("cust % 300 = 7"))


@query(f"{SHOWN_SQL}, v AS (SELECT day AS line, row_number() OVER (ORDER BY day) - 1 AS shown FROM (SELECT unnest(generate_series(0, 4999)) AS day) x WHERE day NOT IN (SELECT day FROM c)) SELECT v.shown, v.line FROM v JOIN l ON l.line = v.shown")
def lines_shown_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line at each place of what is shown."""
    places = _lines(spark, sf_dir).withColumnRenamed("line", "shown")
    return iv.lines_shown_at(places, spans(spark, sf_dir).where("cust % 300 = 7"), 4999)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select((F.col("event_id") % 5000).alias("line")).distinct()
