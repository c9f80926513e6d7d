"""Haplotype rules for calls: a call passes if no rule fails. Reads are rows (call, ...), so that all rules are joins
and sums by call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = ["ctg", "pos"]
HIGH_QUAL, LOW_AF, HOM_AF, SHARE = 0.9, 0.1, 0.75, 0.2


def base_rules(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """Per call (ctg, pos, af, qual) of reads (ctg, pos, qname, is_alt, bq, hp, edge): fail_bq, fail_edge, fail_both
    sides, and hap, the one haplotype that has the alternative reads (null if none or both)."""
    alt = F.col("is_alt")
    n = lambda c: F.count_if(c)
    s = reads.groupBy(*CALL).agg(
        n(F.lit(True)).alias("depth"), n(alt).alias("alt"), F.avg(F.when(alt, F.col("bq"))).alias("alt_bq"),
        n(F.col("edge")).alias("edges"), n(F.col("edge") & alt).alias("alt_edges"),
        n(F.col("hp") == 1).alias("h1"), n(F.col("hp") == 2).alias("h2"), n(alt & (F.col("hp") == 1)).alias("a1"), n(alt & (F.col("hp") == 2)).alias("a2"),
    )
    d = calls.join(s, CALL, "left")
    weak = F.col("qual") < HIGH_QUAL
    both = F.col("a1") * F.col("a2") > 0
    bulk = F.col("edges") >= 0.2 * F.col("depth")
    one = (F.col("h1") > 0) & (F.col("h2") > 0) & ((F.col("a1") > 0) != (F.col("a2") > 0)) & (F.greatest("a1", "a2") > 2)
    no = F.lit(False)
    return d.select(
        *calls.columns,
        F.coalesce((F.col("alt_bq") <= 20) & weak, no).alias("fail_bq"),
        F.coalesce(bulk & (F.col("alt_edges") >= 0.3 * F.col("alt")) & (F.col("alt") > 0), no).alias("fail_edge"),
        F.coalesce((F.col("af") < LOW_AF) & weak & both & (F.greatest("a1", "a2") <= 10 * F.least("a1", "a2")), no).alias("fail_sides"),
        F.when(one, F.when(F.col("a1") > 0, 1).otherwise(2)).alias("hap"),
    )


def neighbour_rules(calls: DataFrame, reads: DataFrame, near: DataFrame) -> DataFrame:
    """Per call: fail_het, fail_hom. near has (ctg, pos, opos, het, af, qname, hp), the reads that carry a germline
    allele within reach of the call, and cover: whether the read covers it at all, with carries for the allele.

    het: some neighbour on the call's haplotype, at least half of whose carriers are on it, shares no read with the
    call's. hom: some homozygous neighbour is carried by under SHARE of the call's reads that cover it.
    """
    own = reads.filter("is_alt").select(*CALL, "qname", F.lit(True).alias("own")).distinct()
    d = near.join(own, [*CALL, "qname"], "left").join(calls.select(*CALL, "hap"), CALL)
    mine = F.coalesce("own", F.lit(False))
    by = d.groupBy(*CALL, "opos", "het", "hap").agg(
        F.max("af").alias("af"), F.count_if("carries").alias("carriers"), F.count_if(F.col("carries") & (F.col("hp") == F.col("hap"))).alias("same"),
        F.count_if(F.col("carries") & mine).alias("shared"), F.count_if(F.col("cover") & mine).alias("covered"),
    )
    het = F.col("het") & F.col("hap").isNotNull() & (F.col("same") > 0) & (2 * F.col("same") >= F.col("carriers")) & (F.col("shared") == 0)
    hom = ~F.col("het") & (F.col("af") >= HOM_AF) & (F.col("covered") > 0) & (F.col("shared") < SHARE * F.col("covered"))
    return by.groupBy(*CALL).agg(F.coalesce(F.bool_or(het), F.lit(False)).alias("fail_het"), F.coalesce(F.bool_or(hom), F.lit(False)).alias("fail_hom"))


def coexisting(calls: DataFrame, reads: DataFrame, mismatches: DataFrame, most: int = 2) -> DataFrame:
    """Per call: fail_together, if more than so many neighbouring mismatches (ctg, pos, opos, allele, qname, carried) are
    carried by about as many of the call's reads as the call has, and by hardly any others."""
    own = reads.filter("is_alt").select(*CALL, "qname").distinct()
    n = own.groupBy(*CALL).agg(F.count("*").alias("alt"))
    hit = mismatches.join(own.withColumn("own", F.lit(True)), [*CALL, "qname"], "left")
    by = hit.groupBy(*CALL, "opos", "allele").agg(F.count_if("own").alias("mine"), F.count("*").alias("all")).join(n, CALL)
    near = (F.abs(F.col("mine") - F.col("alt")) <= 0.2 * F.col("alt")) & (F.col("mine") > 0) & (F.col("all") <= 1.2 * F.col("mine"))
    return by.groupBy(*CALL).agg((F.count_if(near) > most).alias("fail_together"))


def long_insertions(calls: DataFrame, reads: DataFrame, around: DataFrame, flank: int = 100, least: int = 3, most: float = 6.0) -> DataFrame:
    """Per call: fail_insertions, if reads at neighbouring places without germline variants (ctg, pos, opos, indel) insert
    more than so many bases for each read of the call, counting insertions of least bases up to twice the flank, and
    the call is of no high quality."""
    n = F.length("indel") - 1
    long = around.filter(F.col("indel").startswith("+") & (n >= least)).groupBy(*CALL).agg(F.sum(F.least(n, F.lit(2 * flank))).alias("inserted"))
    depth = reads.groupBy(*CALL).agg(F.count("*").alias("depth"))
    found = calls.select(*CALL, "qual").join(long, CALL).join(depth, CALL, "left")
    share = F.col("inserted") / F.greatest(F.coalesce("depth", F.lit(0)), F.lit(1))
    return found.select(*CALL, ((share > most) & (F.col("qual") < HIGH_QUAL)).alias("fail_insertions"))


def judge(*rules: DataFrame) -> DataFrame:
    """All rules' flags by call: pass, qual 0 and LowQual for calls that fail, phased for those on one haplotype."""
    d = rules[0]
    for r in rules[1:]:
        d = d.join(r, CALL, "left")
    fails = [F.coalesce(c, F.lit(False)) for c in d.columns if c.startswith("fail_")]
    bad = F.lit(False)
    for f in fails:
        bad = bad | f
    return d.select(*CALL, F.when(bad, 0.0).otherwise(F.col("qual")).alias("qual"), F.when(bad, "LowQual").otherwise("PASS").alias("filter"), F.col("hap").isNotNull().alias("phased"))


def realigned(before: DataFrame, after: DataFrame, max_qual: float = 0.95) -> DataFrame:
    """Calls (ctg, pos, qual, depth, alt) that lose support in the counts after realignment: fewer alternative reads
    and a smaller share of them; calls above max_qual are not looked at."""
    a = after.select(*CALL, F.col("depth").alias("d2"), F.col("alt").alias("a2"))
    d = before.join(a, CALL, "left")
    lost = (F.col("alt") * F.col("d2") > F.col("a2") * F.col("depth")) & (F.col("a2") < F.col("alt"))
    return d.withColumn("filter", F.when((F.col("qual") < max_qual) & F.coalesce(lost, F.lit(False)), "LowQual").otherwise("PASS")).drop("d2", "a2")
