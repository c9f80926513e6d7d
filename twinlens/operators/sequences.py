"""Operators over ordered positions: windows of vectors, runs, medians, segments.

A partition of the windows is a contig's or track's positions; tracks are keyed, and none is collected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.operators.lineage import in_ranges, reliable, running, small


def feature_window(sites: DataFrame, vectors: DataFrame, width: int, flank: int = 16) -> DataFrame:
    """For each site (ctg, pos) the vectors (ctg, pos, channels) from pos - flank to pos + flank, on end; positions
    without one are zeros of the given width. Sites meet positions by an equi join."""
    wide = sites.select("ctg", "pos", F.explode(F.sequence(F.col("pos") - flank, F.col("pos") + flank)).alias("at"))
    v = vectors.select("ctg", F.col("pos").alias("at"), "channels")
    zero = F.array_repeat(F.lit(0).cast("long"), width)
    joined = wide.join(v, ["ctg", "at"], "left").withColumn("channels", F.coalesce("channels", zero))
    ordered = F.array_sort(F.collect_list(F.struct("at", "channels")))  # 2 * flank + 1 vectors
    return joined.groupBy("ctg", "pos").agg(F.flatten(F.transform(ordered, lambda x: x["channels"])).alias("features"))


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: run number, value, start, end, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    run = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_new", new).withColumn("run", run).groupBy(*keys, "run", value)
        .agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length"))
    )


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    named = right.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(named, on).drop(*(f"_{k}" for k in keys))


def homozygous_stretches(df: DataFrame, keys: list[str], order: str, flag: str, p: float = 0.001) -> DataFrame:
    """Runs of the flag so long that chance alone makes them with probability p at most: ceil(log p / log of the
    flag's share)."""
    share = df.groupBy(*keys).agg(F.avg(F.col(flag).cast("double")).alias("share"))
    least = F.when(F.col("share") >= 1, 1).when(F.col("share") <= 0, None).otherwise(F.ceil(F.lit(math.log(p)) / F.log("share")))
    found = _joined(runs(df, keys, order, flag).filter(F.col(flag)), share, keys)
    return found.filter(F.col("length") >= least).drop("share", flag)


def merge_segments(df: DataFrame, keys: list[str], state: list[str]) -> DataFrame:
    """Neighbouring segments (start, end) of equal state become one."""
    w = Window.partitionBy(*keys).orderBy("start", "end", *state)
    same = F.lit(True)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    new = F.when(same & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    group = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_new", new).withColumn("_g", group).groupBy(*keys, "_g", *state).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("merged")).drop("_g")


def running_median(df: DataFrame, keys: list[str], order: str, value: str, half: int = 25) -> DataFrame:
    """The median of the values from half before to half after, fewer at the ends, and the absolute deviation from it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("median", F.percentile(value, F.lit(0.5)).over(w)).withColumn("deviation", F.abs(F.col(value) - F.col("median")))


def numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with index, the row's number in its track by the order, from 0: a range-partitioned sort and the counts of the
    partitions before, so that no task holds a track. Null keys are a track."""
    ordered = reliable(
        df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    # a row for each track in a partition
    parts = ordered.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = reliable(parts.select(*keys, "_part", (before - F.col("_first")).alias("_shift")))
    joined = _joined(ordered, small(parts, parts.count()), [*keys, "_part"])
    return joined.withColumn("index", F.col("_at") + F.col("_shift")).select(*df.columns, "index")


def running_medians(x: np.ndarray, half: int, whole: bool = True) -> np.ndarray:
    """Medians of half values on each side, mirrored at the ends; fewer for whole tracks that are shorter than that."""
    half = min(half, (len(x) - 1) // 2) if whole else half
    if half < 1:
        return x.copy()
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="symmetric"), 2 * half + 1), axis=1)


def noise(x: np.ndarray, half: int = 25) -> float:
    """The median absolute deviation of what the running median leaves; zeros count as missing. Not a number if none are
    left."""
    x = x[x != 0]
    d = x - running_medians(x, half)
    return float(np.median(np.abs(d - np.median(d)))) if len(x) else math.nan


def winsorise(df: DataFrame, keys: list[str], order: str, value: str, half: int = 25, mads: float = 2.5, block: int = 10_000) -> DataFrame:
    """Values no farther from the running median than so many times the median absolute deviation of the rest, which is
    the track's own; the ends are mirrored.

    Tracks are cut into blocks that lend each other half the median's width, so that a long track is not one task.
    """
    d = reliable(numbered(df, keys, order))
    sizes = reliable(d.groupBy(*keys).agg(F.count("*").alias("_size")))
    d = _joined(d, small(sizes, sizes.count()), keys)
    home, short = F.floor(F.col("index") / block), F.col("_size") <= 2 * half + 1
    reach = F.array_distinct(F.array(home, F.floor((F.col("index") + half) / block), F.floor((F.col("index") - half) / block)))
    top = F.floor((F.col("_size") - 1) / block)
    wide = d.withColumn("_block", F.explode(F.when(short, F.array(home)).otherwise(reach))).filter((F.col("_block") >= 0) & (F.col("_block") <= top))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, _median double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        # only the ends of a track are mirrored: those of a block are cut off again
        out = running_medians(frame[value].to_numpy(float), half, bool(frame["_size"].iloc[0] <= 2 * half + 1))
        own = (frame["index"] // block == frame["_block"]).to_numpy()
        return frame[own].assign(_median=out[own]).drop(columns=["index", "_size", "_block"])

    medians = reliable(wide.groupBy(*keys, "_block").applyInPandas(run, schema))
    rest = F.col(value) - F.col("_median")
    centre = medians.groupBy(*keys).agg(F.percentile(rest, F.lit(0.5)).alias("_centre"))
    away = F.percentile(F.abs(rest - F.col("_centre")), F.lit(0.5))
    mad = _joined(medians, centre, keys).groupBy(*keys).agg(away.alias("_mad"))
    out = _joined(medians, mad, keys)
    limit = mads * F.col("_mad")
    return out.select(*df.columns, (F.col("_median") + F.greatest(F.least(rest, limit), -limit)).alias("winsorised"))


def neighbour_medians(df: DataFrame, keys: list[str], order: str, value: str, n: int = 100) -> DataFrame:
    """Medians of n values to the left, n to the right, and half as many on each side."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = lambda a, b: F.collect_list(value).over(w.rowsBetween(a, b))
    middle = lambda x: F.when(F.size(x) > 0, (F.get(F.array_sort(x), F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(F.array_sort(x), F.floor(F.size(x) / 2).cast("int"))) / 2)
    return df.withColumns({"left": middle(at(-n, -1)), "right": middle(at(1, n)), "around": middle(F.concat(at(-n // 2, -1), at(1, n // 2)))})


def interpolate(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Missing values on the line between their neighbours, and at the ends the nearest one."""
    w = Window.partitionBy(*keys).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("x"), F.col(value).alias("y")))
    before = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumns({"_b": before, "_a": after})
    line = F.col("_b.y") + (F.col("_a.y") - F.col("_b.y")) * (F.col(order) - F.col("_b.x")) / (F.col("_a.x") - F.col("_b.x"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_b").isNull(), F.col("_a.y")).when(F.col("_a").isNull(), F.col("_b.y")).otherwise(line)
    return d.withColumn("filled", filled).drop("_a", "_b")


def clusters(points: DataFrame, gap: int, pad: int) -> DataFrame:
    """Windows (ctg, start, end, n) around points that follow each other within gap. The last place before a point and
    the number of windows so far are running values over ranges of places."""
    d = running(in_ranges(points, ["ctg"], ["pos"]), ["ctg"], ["pos"], "_last", "max", F.col("pos"), before=True)
    new = F.when(F.col("pos") - F.col("_last") <= gap, 0).otherwise(1)
    d = running(d.withColumn("_new", new), ["ctg"], ["pos"], "_g", "sum", F.col("_new"))
    return d.groupBy("ctg", "_g").agg((F.min("pos") - pad).alias("start"), (F.max("pos") + pad).alias("end"), F.count("*").alias("n")).drop("_g")


def nearest_probe_mean(probes: DataFrame, values: DataFrame) -> DataFrame:
    """For each probe (ctg, pos), the mean of the values (ctg, at, value) nearer to it than to its neighbours, cut at
    the middle; one as far from both belongs to the left one."""
    w = Window.partitionBy("ctg").orderBy("pos")
    low, high = F.lag("pos").over(w), F.lead("pos").over(w)
    d = probes.withColumns({"rstart": F.coalesce(F.floor((low + F.col("pos")) / 2), F.lit(-1)), "rend": F.coalesce(F.floor((F.col("pos") + high) / 2), F.lit(1 << 40))})
    v = values.select("ctg", "at", "value", F.lit(1).alias("side")).unionByName(d.select("ctg", (F.col("rstart") + 1).alias("at"), F.lit(None).cast("double").alias("value"), F.lit(0).alias("side"), "pos"), allowMissingColumns=True)
    owner = F.last("pos", True).over(Window.partitionBy("ctg").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    return v.withColumn("pos", owner).filter("value is not null").groupBy("ctg", "pos").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def percentile_cut(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Rows above the track's q quantile (discrete)."""
    cut = df.groupBy(*keys).agg(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias("cut"))
    return _joined(df, cut, keys).filter(F.col(value) > F.col("cut"))


def local_minima(grid: DataFrame, x: str, y: str, value: str, reach: int = 3) -> DataFrame:
    """Cells of a grid that are smaller than all others within reach in both directions; cells so near to a border of
    the grid are none."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    moved = grid.select(F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(value).alias("_v")).withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).filter("_dx <> 0 or _dy <> 0")
    near = moved.groupBy((F.col("_x") + F.col("_dx")).alias(x), (F.col("_y") + F.col("_dy")).alias(y)).agg(F.min("_v").alias("_near"))
    ends = grid.agg(*(f(c).alias(f"_{k}_{c}") for c in (x, y) for k, f in (("low", F.min), ("high", F.max))))  # one row
    inner = [F.col(c).between(F.col(f"_low_{c}") + reach, F.col(f"_high_{c}") - reach) for c in (x, y)]
    found = grid.join(near, [x, y]).crossJoin(F.broadcast(ends)).filter(inner[0] & inner[1] & (F.col(value) < F.col("_near")))
    return found.drop("_near", *ends.columns)
