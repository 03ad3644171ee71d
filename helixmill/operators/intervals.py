"""Interval tables [start, end) by group: merging, intersection, coverage."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Positions within which intervals of a group are merged before the group's intervals meet.
STRETCH = 1 << 16


def merge(rows: DataFrame, group: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of each group's intervals; touching ones join. n: intervals that went into each.

    Intervals are merged in stretches of STRETCH positions first, so that a group with very many intervals brings together
    what is left of them, at most one for two positions, and no more."""
    near = rows.select(*group, start, end).withColumn("_stretch", F.floor(F.col(start) / STRETCH)).withColumn("n", F.lit(1).cast("long"))
    return _islands(_islands(near, [*group, "_stretch"], start, end).drop("_stretch"), group, start, end)


def _islands(rows: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(F.col(start) <= seen, 0).otherwise(1))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).drop("_island")


def starting_inside(reads: DataFrame, ranges: DataFrame, group: list[str], start: str = "start") -> DataFrame:
    """The reads whose start lies in one of the group's ranges (which do not overlap), with their own columns."""
    inside = containing(reads.select(*group, F.col(start).alias("_at")).distinct(), ranges, group, "_at").select(*group, F.col("_at").alias(start))
    return reads.join(inside, [*group, start], "left_semi")


def _level(length: Column) -> Column:
    """0 for lengths up to 1,024, and one more for each factor of 16."""
    return F.greatest(F.lit(0), F.ceil(F.log(16.0, length / 1024))).cast("int")


def _bins(first: Column, last: Column) -> Column:
    """The bins that positions first to last touch on the row's level, whose bins are 64 * 16 ** level wide: at most 18 for
    an interval of that level or a lower one."""
    width = F.pow(F.lit(16.0), F.col("_level")) * 64
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))


def _own(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval once for each bin that it touches on the level of its length."""
    return rows.withColumn("_level", _level(F.col(end) - F.col(start))).withColumn("_bin", _bins(F.col(start), F.col(end) - 1))


def _at_levels(rows: DataFrame, first: Column, last: Column, least: Column, *of: DataFrame) -> DataFrame:
    """rows once for each bin on each level from `least` that intervals of the tables `of` (_level) have: one row of a few numbers."""
    there = functools.reduce(DataFrame.union, [d.select("_level") for d in of]).agg(F.collect_set("_level").alias("_levels"))
    each = rows.join(F.broadcast(there)).withColumn("_least", least)
    each = each.withColumn("_level", F.explode(F.filter("_levels", lambda x: x >= F.col("_least")))).drop("_levels", "_least")
    return each.withColumn("_bin", _bins(first, last))


def intersect(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """Overlaps (start, end) of intervals of a with intervals of b, whatever their lengths.

    An interval is put into the bins of its own length's level and of the coarser levels that occur. A pair counts once: on the
    level of the longer one, in the bin where the overlap begins. Empty intervals overlap nothing."""

    def own(rows: DataFrame, s: str, e: str, level: str) -> DataFrame:
        return rows.filter("start < end").select(*group, F.col("start").alias(s), F.col("end").alias(e), _level(F.col("end") - F.col("start")).alias(level))

    x, y = own(a, "_s", "_e", "_m"), own(b, "_t", "_f", "_n")
    levels = [x.select(F.col("_m").alias("_level")), y.select(F.col("_n").alias("_level"))]
    x = _at_levels(x, F.col("_s"), F.col("_e") - 1, F.col("_m"), *levels)
    y = _at_levels(y, F.col("_t"), F.col("_f") - 1, F.col("_n"), *levels)
    both = x.join(y, [*group, "_level", "_bin"]).filter("_s < _f and _t < _e and _level = greatest(_m, _n)")
    both = both.withColumn("start", F.greatest("_s", "_t")).withColumn("end", F.least("_e", "_f"))
    begins = F.floor(F.col("start") / (F.pow(F.lit(16.0), F.col("_level")) * 64))
    return both.filter(begins == F.col("_bin")).select(*group, "start", "end")


def union(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    return merge(a.select(*group, "start", "end").union(b.select(*group, "start", "end")), group)


def sweep(rows: DataFrame, group: list[str]) -> DataFrame:
    """(start, end, coverage) of the stretches between which coverage changes, from +1 and -1 events in order.

    Events are added up by position, then by stretch of STRETCH positions; a group's window is over its stretches only, and
    positions are ordered within a stretch, so that one long group is many tasks."""
    steps = _events(rows, group).groupBy(*group, "at").agg(F.sum("d").alias("d")).filter("d <> 0")
    out = _swept(steps, group).filter("coverage > 0")
    return out.select(*group, F.col("at").alias("start"), "end", "coverage")


def _events(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, at, d): +1 where an interval starts and -1 where it ends; empty intervals have none."""
    change = lambda c, d: F.struct(F.col(c).alias("at"), F.lit(d).alias("d"))
    return rows.filter("start < end").select(*group, F.inline(F.array(change("start", 1), change("end", -1))))


def _swept(steps: DataFrame, group: list[str]) -> DataFrame:
    """steps (group, at, d, ...), positions of a group once, with coverage, the sum of d up to a position, and end, the next position."""
    steps = steps.withColumn("_stretch", F.floor(F.col("at") / STRETCH))
    over = Window.partitionBy(*group).orderBy("_stretch")
    parts = steps.groupBy(*group, "_stretch").agg(F.sum("d").alias("_d"), F.min("at").alias("_first"))
    before = F.coalesce(F.sum("_d").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*group, "_stretch", before.alias("_before"), F.lead("_first").over(over).alias("_next"))
    w = Window.partitionBy(*group, "_stretch").orderBy("at")
    coverage = F.col("_before") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    same = functools.reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_stretch"]])
    out = steps.alias("l").join(parts.alias("r"), same).select("l.*", "_before", "_next")
    return out.withColumn("coverage", coverage).withColumn("end", F.coalesce(F.lead("at").over(w), F.col("_next"))).drop("_stretch", "_before", "_next")


def runs(rows: DataFrame, group: list[str], coverage: int = 2, length: int = 30) -> DataFrame:
    """Maximal stretches whose coverage is at least `coverage`, of at least `length`."""
    covered = sweep(rows, group).filter(F.col("coverage") >= coverage)
    return merge(covered, group).filter(F.col("end") - F.col("start") >= length).select(*group, "start", "end")


def coverage_at(points: DataFrame, rows: DataFrame, group: list[str], point: str) -> DataFrame:
    """points with `coverage`: intervals of the group with start <= point < end. Points of a group are made distinct and take part in
    the sweep as events that change nothing, so no interval is met by a point, however deep they lie."""
    asked = points.select(*group, F.col(point).alias("at"), F.lit(0).alias("d"), F.lit(True).alias("asked"))
    steps = _events(rows, group).withColumn("asked", F.lit(False)).unionByName(asked).groupBy(*group, "at").agg(F.sum("d").alias("d"), F.bool_or("asked").alias("asked"))
    found = _swept(steps.filter("d <> 0 or asked"), group).filter("asked").select(*group, F.col("at").alias(point), "coverage")
    on = functools.reduce(Column.__and__, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, point]])
    return points.alias("l").join(found.alias("r"), on, "left").select("l.*", F.coalesce("coverage", F.lit(0)).cast("long").alias("coverage"))


def containing(points: DataFrame, ranges: DataFrame, group: list[str], point: str) -> DataFrame:
    """points with the range (start, end) of the group that holds each; ranges of a group do not overlap."""
    cut = _own(ranges.select(*group, "start", "end").filter("start < end"), "start", "end")
    asked = _at_levels(points, F.col(point), F.col(point), F.lit(0), cut)
    return asked.join(cut, [*group, "_level", "_bin"]).filter(F.col(point).between(F.col("start"), F.col("end") - 1)).drop("_level", "_bin")
