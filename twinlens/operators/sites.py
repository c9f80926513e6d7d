"""Which contigs and sites take part: eligibility, given sites, truth sets, and what both samples have at a truth site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.alleles import KARYOTYPE
from twinlens.operators.counts import SITE

#: Insertions and deletions up to this length count.
MAX_INDEL = 60


def eligible_contigs(index: DataFrame, names: list[str] | None = None, regions: DataFrame | None = None, given: DataFrame | None = None, every: bool = False) -> DataFrame:
    """The contigs of an index (ctg, length) to work on.

    Without names, regions and given sites these are the chromosomes of the karyotype, with or without chr, or all
    contigs if every is set. Otherwise a contig must be in each of those that are there; given sites without names add
    no condition to that of the regions beyond being in one of the two.
    """
    d = index
    if names is None and regions is None and given is None:
        return d if every else d.filter(F.col("ctg").isin(*KARYOTYPE))
    if names is not None:
        d = d.filter(F.col("ctg").isin(*names))
    if regions is not None:
        d = d.join(regions.select("ctg").distinct(), "ctg", "left_semi")
    if given is not None and (names is not None or regions is None):
        d = d.join(given.select("ctg").distinct(), "ctg", "left_semi")
    return d


def distinct_positions(calls: DataFrame) -> DataFrame:
    """Each position once, in order within its contig."""
    return calls.select(*SITE).distinct().orderBy(*SITE)


def with_given(sites: DataFrame, given: DataFrame) -> DataFrame:
    """Candidates and given sites: hybrid marks the given ones, found the candidates among all."""
    a = sites.select(*SITE).distinct().withColumn("found", F.lit(True))
    b = given.select(*SITE).distinct().withColumn("hybrid", F.lit(True))
    no = F.lit(False)
    return a.join(b, SITE, "full").select(*SITE, F.coalesce("found", no).alias("found"), F.coalesce("hybrid", no).alias("hybrid"))


def keep_given(marked: DataFrame, kept: DataFrame, normal: DataFrame) -> DataFrame:
    """Sites of with_given after the paired filter: what it kept, and given sites whatever it says, but for those at
    which the normal (ctg, pos, depth) has no reads."""
    depth = normal.groupBy(*SITE).agg(F.max("depth").alias("ndepth"))
    stays = kept.select(*SITE).distinct().withColumn("kept", F.lit(True))
    d = marked.join(stays, SITE, "left").join(depth, SITE, "left")
    return d.filter(F.when(F.col("hybrid"), F.coalesce("ndepth", F.lit(0)) > 0).otherwise(F.coalesce("kept", F.lit(False)))).drop("kept", "ndepth")


def capped_indels(obs: DataFrame, most: int = MAX_INDEL) -> DataFrame:
    """Observations without longer indels. A deletion's mark counts as a character of it, an insertion's does not."""
    n = F.length("indel")
    return obs.filter(F.when(F.col("indel").startswith("+"), n - 1 <= most).when(F.col("indel").startswith("-"), n <= most).otherwise(True))


def without_truth(sites: DataFrame, truth: DataFrame, add_truths: bool = False) -> DataFrame:
    """Sites that are no truth, for examples of the reference; all sites with add_truths."""
    return sites if add_truths else sites.join(truth.select(*SITE).distinct(), SITE, "left_anti")


def truth_overlaps(sites: DataFrame, truth: DataFrame, normal_truth: DataFrame) -> DataFrame:
    """One row: numbers of sites in the normal's truth, in the tumor's, and in both."""
    mark = lambda d, name: d.select(*SITE).distinct().withColumn(name, F.lit(True))
    d = sites.select(*SITE).distinct().join(mark(truth, "t"), SITE, "left").join(mark(normal_truth, "n"), SITE, "left")
    return d.agg(F.count_if("n").alias("in_normal"), F.count_if("t").alias("in_tumor"), F.count_if(F.col("n") & F.col("t")).alias("in_both"))


def allele_name(ref: Column, alt: Column) -> Column:
    """How a pileup shows a variant: the base, the base with + and what is inserted, or the base with - and an N for
    each deleted one; null for substitutions of several bases."""
    r, a = F.length(ref), F.length(alt)
    return (
        F.when((r == 1) & (a == 1), F.upper(alt))
        .when((r == 1) & (a > 1), F.upper(F.concat(F.substring(alt, 1, 1), F.lit("+"), F.substring(alt, F.lit(2), a))))
        .when((r > 1) & (a == 1), F.concat(F.upper(F.substring(ref, 1, 1)), F.lit("-"), F.repeat(F.lit("N"), r - 1)))
    )


def indel_fraction(alleles: Column, mark: str) -> Column:
    """The sum of the fractions of all insertions (+) or deletions (-) of a map from allele to fraction."""
    return F.aggregate(F.map_entries(alleles), F.lit(0.0), lambda s, e: s + F.when(F.contains(e["key"], F.lit(mark)), e["value"]).otherwise(0.0))


def truth_in_normal(truth: DataFrame, normal_truth: DataFrame, fractions: DataFrame) -> DataFrame:
    """kind and n: truth sites (ctg, pos, ref, alt, hom) that are not in the normal's truth (total), and how many of the
    homozygous ones the normal's fractions (ctg, pos, alleles: a map) show: as snp, ins or del by their own allele, as
    signal by any other."""
    d = truth.join(normal_truth.select(*SITE).distinct(), SITE, "left_anti").join(fractions.select(*SITE, "alleles"), SITE, "left")
    own = allele_name(F.col("ref"), F.col("alt"))
    kind = F.when(F.contains(own, F.lit("+")), "ins").when(F.contains(own, F.lit("-")), "del").otherwise("snp")
    hit = F.when(F.col("hom") & F.map_contains_key(F.col("alleles"), F.coalesce(own, F.lit(""))), kind).when(F.col("hom") & (F.size("alleles") > 0), "signal")
    return d.select(F.explode(F.array_compact(F.array(F.lit("total"), hit))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def allele_support(truth: DataFrame, called: DataFrame, obs: DataFrame) -> DataFrame:
    """Per truth (ctg, pos, ref, alt): ndp, tdp, nalt, talt, and for sites that were not called the tumor's reads of the
    allele and of all by haplotype, hp0 to hp2 and all0 to all2. Two truths at one site are two rows.

    A called site has its numbers from the call (depth, af, normal_depth, normal_af); another one is counted in the
    observations, which a semi join cuts to these sites first.
    """
    t = truth.select(*SITE, "ref", "alt")
    c = called.select(*SITE, F.col("normal_depth").alias("ndp"), F.col("depth").alias("tdp"), F.round(F.col("normal_af") * F.col("normal_depth")).cast("long").alias("nalt"), F.round(F.col("af") * F.col("depth")).cast("long").alias("talt"))
    hps = [f"{k}{i}" for k in ("hp", "all") for i in range(3)]
    known = t.join(c, SITE).select(*SITE, "ref", "alt", "ndp", "tdp", "nalt", "talt", *(F.lit(None).cast("long").alias(x) for x in hps))
    rest = t.join(called.select(*SITE).distinct(), SITE, "left_anti").withColumn("own", allele_name(F.col("ref"), F.col("alt")))
    b, mark = F.upper("base"), F.substring("indel", 1, 1)
    shown = F.when(mark == "+", F.concat(b, F.upper("indel"))).when(mark == "-", F.concat(b, F.lit("-"), F.repeat(F.lit("N"), F.length("indel") - 1))).otherwise(b)
    there = obs.join(rest.select(*SITE).distinct(), SITE, "left_semi").select(*SITE, "sample", shown.alias("shown"), F.when(F.col("hp").isin(1, 2), F.col("hp")).otherwise(0).alias("hp"))
    d = rest.join(there, SITE, "left")
    hit, tumor = F.col("shown") == F.col("own"), F.col("sample") == "tumor"
    counted = d.groupBy(*SITE, "ref", "alt").agg(
        F.count_if(F.col("sample") == "normal").alias("ndp"), F.count_if(tumor).alias("tdp"), F.count_if((F.col("sample") == "normal") & hit).alias("nalt"), F.count_if(tumor & hit).alias("talt"),
        *(F.count_if(tumor & hit & (F.col("hp") == i)).alias(f"hp{i}") for i in range(3)), *(F.count_if(tumor & (F.col("hp") == i)).alias(f"all{i}") for i in range(3)),
    )
    return known.unionByName(counted)


def confirmed(full: DataFrame, first: DataFrame) -> DataFrame:
    """Passing calls of the full model that pass in the first one as well; all of them if that has none."""
    passing = lambda d: d.filter("filter = 'PASS'")
    some = passing(first).select(*SITE).distinct()
    any_ = some.agg((F.count("*") > 0).alias("_any"))
    marked = passing(full).join(some.withColumn("_in", F.lit(True)), SITE, "left").join(F.broadcast(any_))  # one row
    return marked.filter(~F.col("_any") | F.col("_in")).drop("_in", "_any")
