"""Algebra of closed integer intervals: joins by levels of buckets, and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import previous, running_total, scan, scans, settled


def encloses(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b0) & (a1 >= b1)


def strictly_encloses(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return encloses(a0, a1, b0, b1) & ((a0 < b0) | (a1 > b1))


def intersects(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


#: Usual length of an interval; longer ones are kept by levels of doubled width.
WIDTH = 32


def stab(intervals: DataFrame, points: DataFrame, width: int = WIDTH, group: tuple[str, ...] = ()) -> DataFrame:
    """points(p, ...) with every interval (id, s, e) of equal group that contains them.

    An interval lies in buckets of the least width * 2 ** level that is not shorter than it, so in two of
    them at most however long it is; a point asks the buckets of the levels that occur.
    """
    n = F.col("e") - F.col("s") + 1
    level = F.greatest(F.ceil(F.log2(n / width)), F.lit(0)).cast("int")
    i = intervals.where("s <= e").withColumn("_level", level)
    levels = sorted(r[0] for r in i.select("_level").distinct().collect())  # 64 at most
    at = lambda c: F.floor(c / (F.lit(width) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    i = i.withColumn("_b", F.explode(F.array_distinct(F.array(at(F.col("s")), at(F.col("e"))))))
    q = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_b", at(F.col("p")))
    return i.join(q, [*group, "_level", "_b"]).where("s <= p AND p <= e").drop("_b", "_level")


def overlaps(left: DataFrame, right: DataFrame, width: int = WIDTH, group: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of left(id_l, s_l, e_l, ...) and right(id_r, s_r, e_r, ...) of equal group that intersect, each once.

    Of two that intersect one starts within the other: the later start, or both where they start together.
    """
    def later(inner: DataFrame, outer: DataFrame, x: str, y: str) -> DataFrame:
        o = outer.withColumnsRenamed({f"s_{y}": "s", f"e_{y}": "e"})
        return stab(o, inner.withColumn("p", F.col(f"s_{x}")), width, group).withColumnsRenamed({"s": f"s_{y}", "e": f"e_{y}"}).drop("p")

    names = [*group, *[c for c in left.columns if c not in group], *[c for c in right.columns if c not in group]]
    right_later = later(right, left, "r", "l").select(*names)
    return right_later.unionByName(later(left, right, "l", "r").where("s_r < s_l").select(*names))


def merged(d: DataFrame, group: list[str], touching: bool = True) -> DataFrame:
    """(group, s, e): unions of overlapping (and, if touching, adjacent) intervals within each group; ends inclusive, s whole numbers.

    The furthest end so far and the number of the union are scans over buckets of starts, so a group of any size
    is spread over many tasks, as is a table without groups.
    """
    gap = 1 if touching else 0
    # of intervals that start together the longest counts
    d = d.groupBy(*group, "s").agg(F.max("e").alias("e"))
    d = settled(scan(d, "s", F.col("e"), "_furthest", "max", tuple(group)))
    new = F.when(F.col("_furthest").isNull() | (F.col("s") > F.col("_furthest") + gap), 1).otherwise(0)
    d = scan(d, "s", new, "_g", "sum", tuple(group), inclusive=True)
    return d.groupBy(*group, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def difference(new: DataFrame, old: DataFrame, group: list[str]) -> DataFrame:
    """(group, s, e): what of new(group, s, e) no interval of old(group, s, e) covers; ends inclusive.

    Each new interval keeps its own identity: (group, ns, ne) tells which it came from.
    """
    m = merged(old.select(*group, "s", "e"), group).withColumnsRenamed({"s": "s_r", "e": "e_r"})
    n = new.select(*group, F.col("s").alias("ns"), F.col("e").alias("ne")).distinct()
    hit = overlaps(n.withColumns({"s_l": F.col("ns"), "e_l": F.col("ne")}), m, group=tuple(group))
    cuts = hit.groupBy(*group, "ns", "ne").agg(F.array_sort(F.collect_list(F.struct(F.col("s_r").alias("s"), F.col("e_r").alias("e")))).alias("_cuts"))
    touched = n.join(cuts, [*group, "ns", "ne"], "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<struct<s:bigint,e:bigint>>")))
    # gaps: before the first cut, between neighbours, behind the last
    starts = F.concat(F.array(F.col("ns")), F.transform("_cuts", lambda c: c["e"] + 1))
    ends = F.concat(F.transform("_cuts", lambda c: c["s"] - 1), F.array(F.col("ne")))
    out = touched.select(*group, "ns", "ne", F.explode(F.arrays_zip(starts.alias("s"), ends.alias("e"))).alias("_z"))
    return out.select(*group, "ns", "ne", F.col("_z.s").alias("s"), F.col("_z.e").alias("e")).where("s <= e")


def covered(targets: DataFrame, coverage: DataFrame, group: list[str]) -> DataFrame:
    """targets(group, ts, te) with `covered`: whether the union of coverage(group, s, e) encloses them."""
    m = merged(coverage.select(*group, "s", "e"), group)
    ok = stab(m, targets.withColumn("p", F.col("ts")), group=tuple(group)).where("te <= e").select(*group, "ts", "te").distinct().withColumn("covered", F.lit(True))
    return targets.join(ok, [*group, "ts", "te"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def parents(regions: DataFrame, group: list[str]) -> DataFrame:
    """regions(group, id, s, e) with parent_id: the smallest region of the group that strictly encloses each."""
    p = regions.select(*group, F.col("id").alias("_pid"), "s", "e")
    r = regions.select(*group, "id", F.col("s").alias("_rs"), F.col("e").alias("_re"), F.col("s").alias("p"))
    pairs = stab(p, r, group=tuple(group)).where("e >= _re AND (s < _rs OR e > _re)")
    best = pairs.groupBy(*group, "id").agg(F.min_by("_pid", F.struct(F.col("e") - F.col("s"), "_pid")).alias("parent_id"))
    return regions.join(best, [*group, "id"], "left")


def not_contained(new: DataFrame, current: DataFrame, group: list[str]) -> DataFrame:
    """new(group, s, e) without those that some interval of current(group, s, e) encloses."""
    n = new.select(*group, F.col("s").alias("_ns"), F.col("e").alias("_ne"), F.col("s").alias("p")).distinct()
    held = stab(current.select(*group, "s", "e"), n, group=tuple(group)).where("e >= _ne").select(*group, F.col("_ns").alias("s"), F.col("_ne").alias("e")).distinct()
    return new.join(held, [*group, "s", "e"], "left_anti")


def partial_overlaps(regions: DataFrame, group: list[str], width: int = WIDTH) -> DataFrame:
    """(group, id, other): regions(group, id, s, e) that cross: they intersect, and neither encloses the other. No tree takes both."""
    left = regions.select(*group, F.col("id").alias("id_l"), F.col("s").alias("s_l"), F.col("e").alias("e_l"))
    right = regions.select(*group, F.col("id").alias("id_r"), F.col("s").alias("s_r"), F.col("e").alias("e_r"))
    p = overlaps(left, right, width, tuple(group)).where("id_l < id_r")
    crosses = ~encloses(F.col("s_l"), F.col("e_l"), F.col("s_r"), F.col("e_r")) & ~encloses(F.col("s_r"), F.col("e_r"), F.col("s_l"), F.col("e_l"))
    return p.where(crosses).select(*group, F.col("id_l").alias("id"), F.col("id_r").alias("other"))


def gaps(hidden: DataFrame, low: int, high: int) -> DataFrame:
    """(s, e): what of low to high no interval of hidden(s, e) covers, from the merged intervals' neighbours."""
    m = settled(merged(hidden.where((F.col("s") <= high) & (F.col("e") >= low)).select("s", "e"), []))
    before = previous(m, "s", {"_before": "e"}).select(F.coalesce(F.col("_before") + 1, F.lit(low)).alias("s"), (F.col("s") - 1).alias("e"))
    behind = m.agg(F.max("e").alias("_last")).select(F.coalesce(F.col("_last") + 1, F.lit(low)).alias("s"), F.lit(high).alias("e"))
    z = before.unionByName(behind).select(F.greatest(F.col("s"), F.lit(low)).cast("long").alias("s"), F.least(F.col("e"), F.lit(high)).cast("long").alias("e"))
    return z.where("s <= e")


def page(hidden: DataFrame, line: int, last: int, radius: int = 500, left: bool = True) -> DataFrame:
    """(line): the `radius` visible lines before a line (or behind it), of 0 to last; hidden(s, e) are collapsed spans."""
    visible = gaps(hidden, 0, line - 1) if left else gaps(hidden, line + 1, last)
    # whole gaps up to the radius, counted from the line outwards; then single lines
    visible = visible.withColumn("_o", -F.col("s") if left else F.col("s"))
    near = running_total(visible, "_o", F.col("e") - F.col("s") + 1, "_n").where(F.col("_n") < radius)
    room = F.lit(radius) - F.col("_n")
    low = F.greatest(F.col("s"), F.col("e") - room + 1) if left else F.col("s")
    high = F.col("e") if left else F.least(F.col("e"), F.col("s") + room - 1)
    return near.select(F.explode(F.sequence(low, high)).alias("line"))


def visible_count(hidden: DataFrame, low: int, high: int) -> DataFrame:
    """(lines): how many of low to high are not collapsed."""
    return gaps(hidden, low, high).agg(F.coalesce(F.sum(F.col("e") - F.col("s") + 1), F.lit(0)).cast("long").alias("lines"))


def shown_positions(lines: DataFrame, hidden: DataFrame) -> DataFrame:
    """lines(line, ...) with `shown`: how many lines before it, from 0 on, no span of hidden(s, e) covers; null for lines that one covers.

    The hidden lines before a line are a running total over the merged spans, carried to the lines in one scan over both.
    """
    m = merged(hidden.where("e >= 0").select(F.greatest("s", F.lit(0)).cast("long").alias("s"), F.col("e").cast("long").alias("e")), [])
    rest = F.struct(*[F.col(f"`{c}`") for c in lines.columns])
    both = lines.select(F.col("line").alias("_at"), rest.alias("_row")).unionByName(m.select(F.col("s").alias("_at"), "e", (F.col("e") - F.col("s") + 1).alias("_n")), allowMissingColumns=True)
    # a span that starts on a line stands before it
    both = both.withColumn("_o", F.col("_at") * 2 + F.col("_row").isNotNull().cast("int"))
    both = scans(settled(both), "_o", {"_hidden": (F.col("_n"), "sum"), "_end": (F.col("e"), "last")}).where("_row IS NOT NULL")
    shown = F.when(F.col("_end").isNull() | (F.col("_end") < F.col("_at")), F.col("_at") - F.col("_hidden"))
    return both.select("_row.*", shown.alias("shown"))


def lines_shown_at(places: DataFrame, hidden: DataFrame, last: int) -> DataFrame:
    """places(shown, ...) with `line`: the line of 0 to last that stands at this place among those that no span of hidden(s, e) covers; others go."""
    g = gaps(hidden, 0, last)
    g = running_total(g, "s", F.col("e") - F.col("s") + 1, "_before")
    rest = F.struct(*[F.col(f"`{c}`") for c in places.columns])
    both = places.where("shown >= 0").select(F.col("shown").alias("_at"), rest.alias("_row")).unionByName(g.select(F.col("_before").alias("_at"), F.struct("s", "e", "_before").alias("_gap")), allowMissingColumns=True)
    both = both.withColumn("_o", F.col("_at") * 2 + F.col("_row").isNotNull().cast("int"))
    both = scan(settled(both), "_o", F.col("_gap"), "_in", "last").where("_row IS NOT NULL")
    line = F.col("_in.s") + F.col("_at") - F.col("_in._before")
    return both.withColumn("line", line).where("line <= _in.e").select("_row.*", "line")
