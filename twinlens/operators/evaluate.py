"""Scoring calls against truth: confusion counts, precision, recall, F1, sweeps of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.alleles import variant_class
from twinlens.operators.lineage import in_ranges, running


def ratios(tp: Column, fp: Column, fn: Column, places: int = 4) -> dict[str, Column]:
    """precision, recall, f1; 0 where nothing can be divided."""
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(tp, tp + fp), zero)
    r = F.coalesce(F.try_divide(tp, tp + fn), zero)
    f = F.coalesce(F.try_divide(2 * p * r, p + r), zero)
    return {"precision": F.round(p, places), "recall": F.round(r, places), "f1": F.round(f, places)}


def classify(truth: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """The full outer join of truth and calls (keys, ref, alt, other columns of calls) with outcome tp, fp or fn.

    A call at a truth's place with other bases is a false positive and the truth a false negative: two rows.
    """
    t = truth.select(*keys, F.col("ref").alias("tref"), F.col("alt").alias("talt"))
    both = calls.join(t, keys, "full_outer")
    same = (F.col("ref") == F.col("tref")) & (F.col("alt") == F.col("talt"))
    outcomes = (
        F.when(F.col("alt").isNull(), F.array(F.lit("fn"))).when(F.col("talt").isNull(), F.array(F.lit("fp")))
        .when(same, F.array(F.lit("tp"))).otherwise(F.array(F.lit("fp"), F.lit("fn")))
    )
    d = both.withColumn("outcome", F.explode(outcomes))
    missed = F.col("outcome") == "fn"
    kind = variant_class(F.when(missed, F.col("tref")).otherwise(F.col("ref")), F.when(missed, F.col("talt")).otherwise(F.col("alt")))
    return d.withColumn("kind", kind)


def metrics(classified: DataFrame, places: int = 4) -> DataFrame:
    """Counts and ratios for SNV, INS, DEL, and both indels together as INDEL, by one rollup."""
    d = classified.filter("kind is not null").withColumn("family", F.when(F.col("kind") == "SNV", "SNV").otherwise("INDEL"))
    n = [F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")]
    r = d.rollup("family", "kind").agg(*n, F.grouping("kind").alias("g")).filter("family is not null and not (family = 'SNV' and g = 1)")
    return r.select(F.coalesce("kind", "family").alias("kind"), "tp", "fp", "fn", *(c.alias(k) for k, c in ratios(F.col("tp"), F.col("fp"), F.col("fn"), places).items()))


def sweep(scored: DataFrame, truths: int | None = None) -> DataFrame:
    """For each distinct score (score, truth 0/1) as a cut, counts and ratios of the rows at or above it.

    One sum by score, then running sums over ranges of the distinct scores, which may be as many as rows.
    """
    by = scored.groupBy("score").agg(F.sum("truth").alias("t"), F.count("*").alias("n"))
    order = [F.desc("score")]
    d = in_ranges(by, [], order)
    total = d.agg(F.sum("t").alias("truths")) if truths is None else d.sparkSession.range(1).select(F.lit(truths).alias("truths"))  # one row
    d = running(running(d, [], order, "tp", "sum", F.col("t")), [], order, "all", "sum", F.col("n")).crossJoin(F.broadcast(total))
    d = d.select("score", "tp", (F.col("all") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"))
    return d.select("*", *(c.alias(k) for k, c in ratios(F.col("tp"), F.col("fp"), F.col("fn"), 6).items()))


def best_cut(swept: DataFrame) -> DataFrame:
    """The cut with the largest f1; of equal ones, the highest score."""
    return swept.orderBy(F.desc("f1"), F.desc("score")).limit(1)


def metrics_by_bin(scored: DataFrame, edges: list[float], cut: float) -> DataFrame:
    """Counts and ratios of (af, score, truth) by bins [low, high) of af; the last bin has its upper end too."""
    edges = [*edges[:-1], edges[-1] + 0.01]
    low = F.lit(None).cast("double")
    for a, b in zip(edges, edges[1:], strict=False):
        low = F.when((F.col("af") >= a) & (F.col("af") < b), F.lit(float(a))).otherwise(low)
    hit, true = F.col("score") >= cut, F.col("truth") == 1
    d = scored.withColumn("bin", low).filter("bin is not null").groupBy("bin").agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn")
    )
    return d.select("*", *(c.alias(k) for k, c in ratios(F.col("tp"), F.col("fp"), F.col("fn"), 6).items()))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(variant_class(F.col("ref"), F.col("alt")).alias("kind")).agg(F.count("*").alias("n"))


def class_weights(counts: DataFrame, beta: float = 0.999) -> DataFrame:
    """(1 - beta) / (1 - beta ** n) for (label, n), scaled to a mean of 1."""
    w = (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n")))
    d = counts.withColumn("w", w)
    total = d.agg(F.avg("w").alias("mean"))
    return d.crossJoin(F.broadcast(total)).select("label", "n", (F.col("w") / F.col("mean")).alias("weight"))
