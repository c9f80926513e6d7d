"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; a running sum finds the bucket in which a source's budget ends, and only
that bucket is refined, level by level, down to one hash value. What is taken is then a comparison with the source's
threshold; nothing is sorted, and a smaller budget takes a subset of what a larger one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.common import WORD, reliable, sheltered, small, table

#: Hashes have 60 bits, refined 15 bits a level.
LEVELS, LEVEL_BITS = 4, 15
#: No source may be taken more often than this.
MAX_REPEATS = 3


def source_weights(sizes: DataFrame) -> DataFrame:
    """Sources with their sums and the weights 1, 2, 3, 1, ... by code point, null last.

    The rank is a range-partitioned sort with the counts of the partitions before, so no task holds all sources.
    """
    sums = reliable(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ordered = reliable(
        sums.withColumn("none", F.col("source").isNull())
        .repartitionByRange("none", "source").sortWithinPartitions("none", "source")
        .withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    )
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = parts.select(
        "part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before")
    )
    rank = F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)
    return ordered.join(F.broadcast(before), "part").select(
        "source", "source_size", (rank % 3 + 1).cast("long").alias("weight")
    )


def source_targets(weighted: DataFrame) -> DataFrame:
    """target: each source's share of all sizes by weight, at most MAX_REPEATS times its size, the excess reshared.

    The level above which sources are capped is found by repeated sums over the table of sources; the driver sees
    three numbers a round.
    """
    cap = F.col("source_size") * MAX_REPEATS
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, weights, capped = total, None, -1
    over = F.lit(False)
    while True:
        n, held, rest = weighted.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        left, weights = total - held, rest
        if n == capped or not weights:
            break
        capped = n
        over = cap.cast("decimal(38,0)") * F.lit(weights) <= F.lit(left).cast("decimal(38,0)") * F.col("weight")
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(weights or 1))
    return weighted.withColumn("target", F.when(over, cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken.

    size counts words (null text: 0). A source is taken floor(target / source_size) times in full; of the rest, the
    rows whose hash of the id is up to the source's threshold once more. The threshold row itself is taken if that
    brings the sum nearer to the target. Rows with one id (repeated rows, null ids) have one hash and go together.
    Null is a source of its own; a source of size 0 has target 0. An empty table gives an empty result.
    """
    sizes = reliable(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), hash_of(F.col(id_col)).alias("h")))
    plan, sources = thresholds(sizes)
    return sizes.join(small(plan, sources), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times_of(F.col("h"))).cast("long").alias("taken")
    )


def size_of(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: Column) -> Column:
    """60 bits of a key's digest."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def times_of(h: Column) -> Column:
    """How often a row of this hash is taken, beside its source's row of thresholds()."""
    return F.col("times") + (h <= F.col("threshold")).cast("long")


def thresholds(sizes: DataFrame) -> tuple[DataFrame, int]:
    """A row for each source of (source, size, h): s, source_size, target, times, threshold; and the number of rows."""
    plan = source_targets(source_weights(sizes))
    plan = reliable(
        plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("budget", F.floor(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    )
    sources = plan.count()

    # sums before the boundary and the boundary's prefix of the hash, refined level by level
    edge = plan.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    rest = sizes.select("source", "size", "h")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        prefix = F.shiftright("h", shift)
        inside = small(edge.select(F.col("source").alias("s"), F.col("prefix").alias("up"), F.lit(True).alias("hit")), sources)
        rest = rest.join(inside, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("up"))).drop("s", "up", "hit")
        sums = rest.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("n"))
        running = Window.partitionBy("s").orderBy("prefix")  # at most 2**LEVEL_BITS rows a source
        found = (
            sums.withColumnRenamed("source", "s").withColumn("upto", F.sum("n").over(running))
            .join(small(edge.select("source", "budget", "before"), sources), F.col("s").eqNullSafe(F.col("source")))
            .filter(F.col("before") + F.col("upto") > F.col("budget"))
            .groupBy("source").agg(F.min_by(F.struct("prefix", "budget", (F.col("before") + F.col("upto") - F.col("n")).alias("before"), F.col("n")), "prefix").alias("e"))
            .select("source", "e.*")
        )
        edge = reliable(found)
    # at the last level a prefix is a whole hash; n is the size of its rows
    nearer = 2 * F.col("before") + F.col("n") < 2 * F.col("budget")
    edge = edge.select(F.col("source").alias("s"), F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))
    # a source without a boundary has budget for all of its rows
    plan = plan.join(small(edge, sources), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "times", F.coalesce("threshold", F.lit((1 << 60) - 1)).alias("threshold")
    )
    return plan, sources


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


@sheltered
def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a document stays as often as the mix takes it in full, none of them up to MAX_REPEATS times.

    A document without words has nothing to take and stays once. Repeated rows and rows with a null id stay each as often
    as the others of the same id and text. An empty table gives an empty result.
    """
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.xxhash64("text", "source").cast("string"))
    plan, sources = thresholds(reliable(docs.select("source", size_of(F.col("text")).alias("size"), hash_of(key).alias("h"))))
    rows = docs.withColumns({"_size": size_of(F.col("text")), "_h": hash_of(key)})
    joined = rows.join(small(plan, sources), F.col("source").eqNullSafe(F.col("s")))  # only sources are joined, no texts shuffled
    n = F.when(F.col("_size") > 0, times_of(F.col("_h"))).otherwise(1).cast("int")
    copies = F.when(n > 0, F.sequence(F.lit(1), n))
    return joined.withColumn("_copy", F.explode(copies)).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS n FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS HUGEINT) AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * n / w, source NULLS LAST) AS k FROM w),
p AS (SELECT *, coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone,
             sum(n) OVER () AS total, sum(w) OVER () AS weights FROM o),
f AS (SELECT min(k) AS k FROM p WHERE 3 * n * (weights - gone) > (total - held) * w),
l AS (SELECT total - held AS rest, weights - gone AS weights FROM p JOIN f USING (k)),
t AS (SELECT o.source, o.n, CASE WHEN f.k IS NULL OR o.k < f.k THEN CAST(3 * n AS DOUBLE)
             ELSE CAST(l.rest AS DOUBLE) * CAST(w AS DOUBLE) / CAST(l.weights AS DOUBLE) END AS target
      FROM o CROSS JOIN f LEFT JOIN l ON true),
b AS (SELECT *, CAST(CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS BIGINT) AS times FROM t),
c AS (SELECT *, CAST(floor(target - times * n) AS BIGINT) AS budget FROM b),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT r.source, min(r.h) AS edge, min_by(r.upto, r.h) AS upto, min_by(r.n, r.h) AS m, any_value(c.budget) AS budget
      FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source WHERE r.upto > c.budget GROUP BY r.source)
SELECT d.doc_id, d.size, CAST(c.n AS BIGINT) AS source_size, c.target,
       CAST(d.size * (c.times + CASE WHEN e.edge IS NULL OR d.h < e.edge OR (d.h = e.edge AND 2 * e.upto - e.m < 2 * e.budget) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
