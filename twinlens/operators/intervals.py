"""Joins and algebra of half-open intervals (ctg, start, end), 0-based.

Range joins are equi joins on (ctg, bin): an interval is filed under every bin that it touches, a probe under its own,
and a pair counts in the first bin that both touch, so that no pair comes twice and no nested loop is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.operators.lineage import in_ranges, running

BIN = 1 << 10


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def range_join(left: DataFrame, right: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of left (ctg, start, end, ...) and right (ctg, rstart, rend, ...) that overlap. Empty intervals pair with
    nothing. Columns other than ctg must differ."""
    a = _binned(left.filter("start < end"), "start", "end", width)
    b = _binned(right.filter("rstart < rend"), "rstart", "rend", width)
    first = F.col("_bin") == F.floor(F.greatest("start", "rstart") / width)
    return a.join(b, ["ctg", "_bin"]).filter(first & (F.col("start") < F.col("rend")) & (F.col("rstart") < F.col("end"))).drop("_bin")


def point_join(points: DataFrame, intervals: DataFrame, width: int = BIN) -> DataFrame:
    """Pairs of points (ctg, pos 1-based, ...) and intervals (ctg, rstart, rend, ...) with pos - 1 in [rstart, rend)."""
    b = _binned(intervals.filter("rstart < rend"), "rstart", "rend", width)
    a = points.withColumn("_bin", F.floor((F.col("pos") - 1) / width))
    return a.join(b, ["ctg", "_bin"]).filter((F.col("pos") > F.col("rstart")) & (F.col("pos") <= F.col("rend"))).drop("_bin")


def points_inside(points: DataFrame, intervals: DataFrame, key: list[str], inside: bool = True, width: int = BIN) -> DataFrame:
    """The points, told apart by key, that lie in an interval, or in none."""
    hits = point_join(points.select("ctg", "pos", *(k for k in key if k not in ("ctg", "pos"))), intervals.select("ctg", "rstart", "rend"), width)
    return points.join(hits.select(*key).distinct(), key, "left_semi" if inside else "left_anti")


def first_match(points: DataFrame, intervals: DataFrame, order: str, width: int = BIN) -> DataFrame:
    """Points with the first interval, by the column order, that has them; points in none are left out."""
    hits = point_join(points, intervals, width)
    rank = F.row_number().over(Window.partitionBy(*points.columns).orderBy(order))
    return hits.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def largest_overlap(left: DataFrame, right: DataFrame, key: str, width: int = BIN) -> DataFrame:
    """Each interval's partner with the largest overlap, of equal ones the first; none without an overlap."""
    overlap = F.least("end", "rend") - F.greatest("start", "rstart")
    return range_join(left, right, width).groupBy(key).agg(
        F.min(F.struct((-overlap).alias("o"), F.col("rstart"), F.col("rend"))).alias("m")
    ).select(key, F.col("m.rstart").alias("rstart"), F.col("m.rend").alias("rend"), (-F.col("m.o")).alias("overlap"))


def merge_overlaps(df: DataFrame, strict: bool = True, reducers: dict | None = None) -> DataFrame:
    """Unions of overlapping intervals; touching ones merge unless strict. reducers: new column -> aggregate.

    The largest end so far and the number of unions so far are running values over ranges of places.
    """
    order = ["start", "end"]
    d = running(in_ranges(df, ["ctg"], order), ["ctg"], order, "_top", "max", F.col("end"), before=True)
    apart = F.col("start") >= F.col("_top") if strict else F.col("start") > F.col("_top")
    new = F.when(F.col("_top").isNull() | apart, 1).otherwise(0)
    d = running(d.withColumn("_new", new), ["ctg"], order, "_g", "sum", F.col("_new"))
    aggs = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged"), *(f.alias(k) for k, f in (reducers or {}).items())]
    return d.groupBy("ctg", "_g").agg(*aggs).drop("_g")


def merge_equals(df: DataFrame, reducers: dict | None = None) -> DataFrame:
    return df.groupBy("ctg", "start", "end").agg(F.count("*").alias("merged"), *(v.alias(k) for k, v in (reducers or {}).items()))


def split_overlaps(df: DataFrame, width: int = BIN) -> DataFrame:
    """Every interval cut at every boundary of any interval of its contig, equal pieces once."""
    cuts = df.select("ctg", F.explode(F.array("start", "end")).alias("pos")).distinct()
    points = cuts.select("ctg", (F.col("pos") + 1).alias("pos"))
    own = df.select("ctg", F.col("start").alias("rstart"), F.col("end").alias("rend"))
    inside = point_join(points, own, width).select("ctg", "rstart", "rend", (F.col("pos") - 1).alias("cut"))
    ends = inside.unionByName(own.select("ctg", "rstart", "rend", F.col("rend").alias("cut"))).distinct()
    after = F.lead("cut").over(Window.partitionBy("ctg", "rstart", "rend").orderBy("cut"))
    return ends.withColumn("end", after).filter("end is not null").select("ctg", F.col("cut").alias("start"), "end").distinct()


def chop(df: DataFrame, begin: int, end: int) -> DataFrame:
    """The intervals less [begin, end): overhangs stay."""
    parts = F.array(
        F.when(F.col("start") < begin, F.struct(F.col("start").alias("s"), F.least("end", F.lit(begin).cast("long")).alias("e"))),
        F.when(F.col("end") > end, F.struct(F.greatest("start", F.lit(end).cast("long")).alias("s"), F.col("end").alias("e"))),
    )
    return df.withColumn("_p", F.explode(F.array_compact(parts))).withColumns({"start": F.col("_p.s"), "end": F.col("_p.e")}).drop("_p")


def slice_at(df: DataFrame, point: int) -> DataFrame:
    """Intervals with the point strictly inside become two."""
    p = F.lit(point).cast("long")
    inside = (F.col("start") < p) & (p < F.col("end"))
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    two = F.array(F.struct(F.col("start").alias("s"), p.alias("e")), F.struct(p.alias("s"), F.col("end").alias("e")))
    return df.withColumn("_p", F.explode(F.when(inside, two).otherwise(whole))).withColumns({"start": F.col("_p.s"), "end": F.col("_p.e")}).drop("_p")


def nested(df: DataFrame, width: int = BIN, key: str | None = None) -> DataFrame:
    """Pairs (outer, inner) of different intervals, one inside the other.

    Without a key, rows with equal ranges are one interval. With one, rows are told apart by it: of two with equal
    ranges the one with the smaller key is the outer one, and the pairs have key and rkey.
    """
    own = ["ctg", "start", "end", *([key] if key else [])]
    d = df.select(*own).distinct()
    inner = d.select("ctg", F.col("start").alias("rstart"), F.col("end").alias("rend"), *([F.col(key).alias("rkey")] if key else []))
    larger = (F.col("start") < F.col("rstart")) | (F.col("rend") < F.col("end"))
    if key:
        larger = larger | (F.col(key) < F.col("rkey"))
    return range_join(d, inner, width).filter((F.col("start") <= F.col("rstart")) & (F.col("rend") <= F.col("end")) & larger)


def envelop(df: DataFrame, begin: int, end: int) -> DataFrame:
    return df.filter((F.lit(begin) < end) & (F.col("start") >= begin) & (F.col("end") <= end))


def overlap(df: DataFrame, begin: int, end: int) -> DataFrame:
    return df.filter((F.lit(begin) < end) & (F.col("start") < end) & (F.col("end") > begin))


def at(df: DataFrame, point: int) -> DataFrame:
    return df.filter((F.col("start") <= point) & (F.col("end") > point))


def span(df: DataFrame) -> DataFrame:
    return df.groupBy("ctg").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def set_operation(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """union, intersection, difference or symmetric_difference of intervals as elements of sets."""
    keys = ["ctg", "start", "end"]
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    if how == "union":
        return a.union(b).distinct()
    if how == "intersection":
        return a.intersect(b)
    if how == "difference":
        return a.subtract(b)
    return a.subtract(b).union(b.subtract(a))


def distance(start, end, rstart, rend):
    """0 for intervals that overlap or touch, else the gap."""
    return F.greatest(rstart - end, start - rend, F.lit(0))


def pad_inward(df: DataFrame, padding: int) -> DataFrame:
    return df.withColumns({"start": F.col("start") + padding, "end": F.col("end") - padding}).filter("start < end")


def neighbours(points: DataFrame, others: DataFrame, flank: int) -> DataFrame:
    """Pairs of points (ctg, pos, ...) and others (ctg, opos, ...) with opos in (pos - flank, pos + flank], opos <> pos."""
    a = points.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("pos") - flank + 1) / flank), F.floor((F.col("pos") + flank) / flank))))
    b = others.withColumn("_bin", F.floor(F.col("opos") / flank))
    near = (F.col("opos") > F.col("pos") - flank) & (F.col("opos") <= F.col("pos") + flank) & (F.col("opos") != F.col("pos"))
    return a.join(b, ["ctg", "_bin"]).filter(near).drop("_bin")


def isolated(points: DataFrame, flank: int) -> DataFrame:
    """Points without one at another place within flank."""
    places = points.select("ctg", "pos").distinct()
    near = neighbours(places, places.withColumnRenamed("pos", "opos"), flank + 1).filter(F.abs(F.col("opos") - F.col("pos")) <= flank)
    return points.join(near.select("ctg", "pos").distinct(), ["ctg", "pos"], "left_anti")
