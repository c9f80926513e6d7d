"""Training examples: rows of read-level matrices, tensors of both samples side by side, their scale and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.operators.counts import SITE

#: Depth to which tensors are scaled down; empty rows between the samples of a read-level matrix.
DEPTH, BETWEEN = 50, 2


def read_rows(reads: DataFrame, cap: int, seed: int = 0) -> DataFrame:
    """Rows of a site's matrix: reads (ctg, pos, qname, start, hp) of a window, by haplotype and then in the order in
    which they were first seen, as row from 0. Beyond the cap a hash of site and name chooses, whatever the order."""
    once = reads.groupBy(*SITE, "qname").agg(F.min("start").alias("start"), F.max("hp").alias("hp"))
    drawn = once.withColumn("_u", F.xxhash64("qname", "pos", F.lit(seed)))
    kept = drawn.withColumn("_k", F.row_number().over(Window.partitionBy(*SITE).orderBy("_u", "qname"))).filter(F.col("_k") <= cap)
    row = F.row_number().over(Window.partitionBy(*SITE).orderBy("hp", "start", "qname")) - 1
    return kept.withColumn("row", row).drop("_u", "_k")


def paired_tensors(normal: DataFrame, tumor: DataFrame) -> DataFrame:
    """Every tensor of the normal at a site with every one of the tumor's (ctg, pos, features, alt_info): a site that
    has several, from samples of other purities, gives all combinations; one that lacks either gives none."""
    side = lambda d, name: d.select(*SITE, F.col("features").alias(name), F.col("alt_info").alias(f"{name}_info"))
    return side(normal, "normal").join(side(tumor, "tumor"), SITE)


def rescaled(features: Column, depth: Column, least: int = DEPTH) -> Column:
    """features times least / depth where the depth is above it."""
    return F.when(depth > least, F.transform(features, lambda x: x * F.lit(float(least)) / depth)).otherwise(F.transform(features, lambda x: x.cast("double")))


def padded(normal: Column, tumor: Column, rows: int, width: int, between: int = BETWEEN) -> Column:
    """A matrix of so many rows: the normal's and the tumor's with empty rows before, between and after; of an odd rest
    the larger half comes after."""
    zeros = lambda n: F.array_repeat(F.lit(0), (n * width).cast("int"))
    left = F.greatest(F.lit(rows - between) - (F.size(normal) + F.size(tumor)) / width, F.lit(0)).cast("int")
    before = F.floor(left / 2).cast("int")
    return F.concat(zeros(before), normal, zeros(F.lit(between)), tumor, zeros(left - before))


def last_of_position(rows: DataFrame, order: str) -> DataFrame:
    """is_last: the row is the last of its position in the order, where a batch may be cut."""
    w = Window.partitionBy("ctg").orderBy("pos", order)
    return rows.withColumn("is_last", F.coalesce(F.lead("pos").over(w) != F.col("pos"), F.lit(True)))


def validation_counts(predicted: DataFrame, label: str = "label", probabilities: str = "p", of: int = 2) -> DataFrame:
    """One row: tp, fp and fn of a class by the largest probability, of equal ones the first."""
    best = F.array_position(F.col(probabilities), F.array_max(probabilities)) - 1
    hit, true = best == of, F.col(label) == of
    return predicted.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))


def jittered(qualities: Column, pos: Column, scale: float = 5.0, seed: int = 0) -> Column:
    """Qualities less one normal draw for each position, rounded, kept within 1 to 90: two hashes of the position, by
    the method of Box and Muller."""
    u1, u2 = (F.shiftrightunsigned(F.xxhash64(pos.cast("long"), F.lit(2 * seed + k)), 11) / F.lit(2.0**53) for k in (0, 1))
    u1 = F.greatest(u1, F.lit(1e-12))
    noise = F.round(F.sqrt(-2 * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2) * scale)
    return F.transform(qualities, lambda q: F.greatest(F.lit(1), F.least(q - noise, F.lit(90))).cast("int"))
