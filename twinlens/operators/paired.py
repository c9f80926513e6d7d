"""Comparing two samples: what a tumor site has that its normal has not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.functions.alleles import BASES
from twinlens.operators.counts import SITE
from twinlens.operators.intervals import neighbours
from twinlens.operators.sampling import uniform
from twinlens.operators.sequences import numbered
from twinlens.operators.sites import allele_name

#: How much larger the tumor's fraction must be, above and below the normal fraction NAF.
NAF, HIGH, LIQUID, LOW = 0.05, 6, 5, 4


def paired_filter(tumor: DataFrame, counts: DataFrame, min_depth: int = 4, liquid: bool = False) -> DataFrame:
    """Tumor sites (candidates) that stay after a look at the normal's allele_counts, with naf and indel_naf.

    The best base and the best indel are judged each by its own count in the normal, and snv and indel are unset where
    theirs fails; a site with neither goes. An allele stays if the normal is too shallow or lacks it; with a normal
    fraction of NAF or more, if the tumor's is HIGH times as large; below, if it is more than LOW times. liquid: with
    NAF or more, LIQUID times is enough as well for an allele with fewer than two normal reads.
    """
    normal = counts.filter("sample = 'normal'").groupBy(*SITE).agg(F.map_from_entries(F.collect_list(F.struct("allele", "n"))).alias("by"), F.max("depth").alias("ndepth"))
    both = tumor.join(normal, SITE, "left")  # a site has a handful of alleles

    def stays(allele: str, taf: str, naf: str):
        reads = F.coalesce(F.try_element_at("by", F.col(allele)), F.lit(0))
        enough = F.col(taf) >= F.round(HIGH * F.col(naf), 6)
        if liquid:
            enough = enough | ((F.col(taf) >= F.round(LIQUID * F.col(naf), 6)) & (reads < 2))
        return (
            F.when(F.col(allele).isNull(), False).when(F.coalesce("ndepth", F.lit(0)) <= min_depth, True).when((F.col(naf) <= 0) | (F.col(taf) <= 0), True)
            .when(F.col(naf) >= NAF, enough).otherwise(F.col(taf) > F.round(LOW * F.col(naf), 6))
        )

    share = lambda allele: F.coalesce(F.round(F.try_divide(F.try_element_at("by", F.col(allele)), "ndepth"), 3), F.lit(0.0))
    both = both.withColumns({"naf": share("top_allele"), "indel_naf": share("top_indel")})
    both = both.withColumns({"snv": F.col("snv") & stays("top_allele", "top_af", "naf"), "indel": F.col("indel") & stays("top_indel", "indel_af", "indel_naf")})
    return both.filter("snv or indel").drop("by", "ndepth")


def allele_fractions(counts: DataFrame) -> DataFrame:
    """taf and naf of every alternative base of a site; a sample without reads of it has 0."""
    alt = counts.filter(F.col("allele").isin(*BASES) & (F.col("allele") != F.col("ref")))
    af = F.col("n") / F.col("depth")
    return alt.groupBy(*SITE, "ref", "allele").agg(
        F.coalesce(F.max(F.when(F.col("sample") == "tumor", af)), F.lit(0.0)).alias("taf"),
        F.coalesce(F.max(F.when(F.col("sample") == "normal", af)), F.lit(0.0)).alias("naf"),
    )


def best_alleles(fractions: DataFrame) -> DataFrame:
    """A site's somatic allele, with the largest positive taf - naf, and its germline one, with the largest sum;
    of equal ones, the first by name."""
    gap, total = F.round(F.col("taf") - F.col("naf"), 9), F.round(F.col("taf") + F.col("naf"), 9)
    return fractions.groupBy(*SITE, "ref").agg(
        F.min(F.when(gap > 0, F.struct(-gap, F.col("allele").alias("allele"))))["allele"].alias("somatic"),
        F.min(F.struct(-total, F.col("allele").alias("allele")))["allele"].alias("germline"),
    )


def hetero_selection(tumor: DataFrame, normal: DataFrame, min_qual: float) -> DataFrame:
    """Heterozygous tumor sites that the normal lacks and are good enough, or that it has with the same bases."""
    n = normal.select(*SITE, F.col("ref").alias("nref"), F.col("alt").alias("nalt"))
    both = tumor.join(n, SITE, "left")
    return both.filter((F.col("nref").isNull() & (F.col("qual") >= min_qual)) | ((F.col("ref") == F.col("nref")) & (F.col("alt") == F.col("nalt")))).drop("nref", "nalt")


def phasing_sites(normal: DataFrame, tumor: DataFrame, normal_indels: DataFrame, tumor_indels: DataFrame, min_qual: float, low_part: float = 0.0, from_tumor: bool = True) -> DataFrame:
    """Heterozygous sites (ctg, pos, ref, alt, source) to phase reads by.

    normal and tumor have heterozygous bases (ctg, pos, ref, alt, qual). Sites of hetero_selection that both have count
    unless they are in the lowest part of a contig's qualities in either sample. from_tumor: these and those of the tumor
    alone. Else: all bases of the normal, with the tumor's rows where they are confirmed, and the normal's indels that
    are lost, kept or fixed.
    """
    sides = ((normal, "_n"), (tumor, "_t"))
    low = None
    for d, _ in sides if low_part > 0 else ():
        ranked = numbered(d.select("ctg", "pos", F.struct("qual", "pos").alias("by")), ["ctg"], "by")
        size = ranked.groupBy("ctg").agg(F.count("*").alias("size"))
        own = ranked.join(size, "ctg").filter(F.col("index") < F.floor(F.col("size") * low_part)).select(*SITE)
        low = own if low is None else low.unionByName(own)
    chosen = hetero_selection(tumor, normal, min_qual)
    chosen = chosen if low is None else chosen.join(low.distinct(), SITE, "left_anti")
    chosen = chosen.select(*SITE, "ref", "alt", F.lit("tumor").alias("source"))
    if from_tumor:
        return chosen
    rest = normal.join(chosen.select(*SITE), SITE, "left_anti").select(*SITE, "ref", "alt", F.lit("normal").alias("source"))
    indels = indel_transitions(normal_indels, tumor_indels).filter("transition is not null").select(*SITE, "ref", "alt", F.lit("indel").alias("source"))
    bases = chosen.unionByName(rest)
    # an indel takes the place of a base
    return bases.join(indels.select(*SITE), SITE, "left_anti").unionByName(indels)


def indel_transitions(normal: DataFrame, tumor: DataFrame, depth: int = 15, het: float = 0.1, hom: float = 0.9) -> DataFrame:
    """How heterozygous indels of the normal (ctg, pos, ref, alt, dp, af, alts) go on in the tumor: lost, kept, fixed, or
    null. alts is the number of alternative alleles in the genotype.

    One is lost only where the tumor has no call at all; a call of other bases, or too shallow, says nothing. A
    heterozygous tumor call keeps it whatever its fraction, a homozygous one fixes it from the fraction hom on.
    """
    t = tumor.select(*SITE, F.col("ref").alias("_ref"), F.col("alt").alias("_alt"), F.col("dp").alias("_dp"), F.col("af").alias("_af"), F.col("alts").alias("_alts"), F.lit(True).alias("_there"))
    n = normal.filter((F.col("alts") == 1) & (F.col("dp") >= depth) & F.col("af").between(0.5 - het, 0.5 + het)).join(t, SITE, "left")
    same = (F.col("ref") == F.col("_ref")) & (F.col("alt") == F.col("_alt")) & (F.col("_dp") >= depth)
    kind = F.when(F.col("_there").isNull(), "lost").when(same & (F.col("_alts") == 1), "kept").when(same & (F.col("_alts") == 2) & (F.col("_af") >= hom), "fixed")
    return n.withColumn("transition", kind).drop("_ref", "_alt", "_dp", "_af", "_alts", "_there")


def training_labels(fractions: DataFrame, depth: DataFrame) -> DataFrame:
    """germline, reference and somatic alleles for training: equal and high fractions; a low and small normal one next
    to the tumor's; a tumor fraction of 0.03 with three reads next to a normal one of at most 0.03."""
    x = fractions.join(depth.filter("sample = 'tumor'").select(*SITE, F.col("depth").alias("tdepth")).distinct(), SITE)
    t, n = F.col("taf"), F.col("naf")
    kind = (
        F.when((t >= 0.03) & (F.round(t * F.col("tdepth")) >= 3) & (n <= 0.03), "somatic")
        .when((F.abs(t - n) <= 0.1) & (t >= 0.1) & (n >= 0.1), "germline")
        .when((n < 0.05) & (n <= 0.2 * t), "reference")
    )
    return x.withColumn("label", kind).filter("label is not null")


#: Rules of truths for training: the gap and least fraction of germline alleles, the most that a normal may have of a
#: reference site's best allele, by itself and beside the tumor's, and fractions and reads of somatic ones.
GERMLINE_GAP, GERMLINE_AF, REFERENCE_AF, REFERENCE_PART, SOMATIC_AF, SOMATIC_NORMAL_AF, SOMATIC_READS = 0.1, 0.1, 0.05, 0.2, 0.03, 0.03, 3


def training_truths(truths: DataFrame, tumor: DataFrame, normal: DataFrame, indels: bool = False) -> DataFrame:
    """truths (ctg, pos, ref, alt, kind) with reason, null for those that are good to train with.

    tumor has (ctg, pos, depth, alleles, tumor_alleles), maps of an allele, as pileups show it, to its fraction: among all
    reads and, in a mixture, among the tumor's; normal has (ctg, pos, alleles). Each kind has its own rule. germline:
    both samples show the allele, with about the same fraction, not a small one. reference: the tumor's best allele is
    rare in the normal, by itself and beside the tumor. somatic: no allele but few reads in what stands for the normal,
    enough in the tumor. indels: only truths that are, and sites' best alleles may be.
    """
    t = tumor.select(*SITE, "depth", F.col("alleles").alias("_t"), F.col("tumor_alleles").alias("_own"), F.lit(True).alias("_there"))
    n = normal.select(*SITE, F.col("alleles").alias("_n"), F.lit(True).alias("_paired"))
    d = truths.join(t, SITE, "left").join(n, SITE, "left")
    own = allele_name(F.col("ref"), F.col("alt"))
    of = lambda m, k: F.try_element_at(m, F.coalesce(k, F.lit("")))
    top = lambda m: F.array_max(F.map_values(m))
    entries = F.filter(F.map_entries("_t"), lambda e: (e["key"] != F.col("ref")) & (F.lit(indels) | (F.length(e["key"]) == 1)))
    best = F.array_min(F.transform(entries, lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("key"))))
    d = d.withColumns({"_af": of("_t", own), "_naf": of("_n", own), "_best": best["key"], "_top": -best["s"], "_taf": of("_own", own)})
    d = d.withColumn("_other", of("_n", F.col("_best")))
    small_ = F.lit(indels) & (F.length("ref") == 1) & (F.length("alt") == 1)
    apart = F.abs(F.round(F.col("_af") - F.col("_naf"), 9)) > GERMLINE_GAP
    germline = (
        F.when(F.col("_paired").isNull(), "not_in_normal").when(small_, "no_indel").when(F.col("_af").isNull() | F.col("_naf").isNull(), "not_in_both")
        .when(apart | (F.col("_af") < GERMLINE_AF) | (F.col("_naf") < GERMLINE_AF), "af_gap")
    )
    reference = F.when(F.col("_top").isNull(), "no_allele").when(F.col("_other").isNotNull() & ((F.col("_other") >= REFERENCE_AF) | (F.col("_other") > F.col("_top") * REFERENCE_PART)), "af_gap")
    some = F.coalesce(F.size("_own"), F.lit(0)) > 0
    somatic = (
        F.when(F.col("_paired") & small_, "no_indel").when(F.col("_paired") & (F.coalesce(top("_t"), F.lit(0.0)) > SOMATIC_NORMAL_AF), "in_normal")
        .when(some & (F.coalesce("_taf", F.lit(0.0)) < SOMATIC_AF), "low_af").when(some & (F.col("depth") * F.col("_taf") < SOMATIC_READS), "low_coverage")
    )
    rule = F.when(F.col("kind") == "germline", germline).when(F.col("kind") == "reference", reference).otherwise(somatic)
    return d.select(*truths.columns, F.when(F.col("_there").isNull(), "no_reads").otherwise(rule).alias("reason"))


def apart_from(points: DataFrame, others: DataFrame, flank: int, part: float = 0.7, seed: int = 0) -> DataFrame:
    """Points (ctg, pos, ...) without another truth within flank; of those that have one, the part that a draw by the
    place lets go leaves, and the rest stays."""
    near = neighbours(points.select(*SITE).distinct(), others.select("ctg", F.col("pos").alias("opos")), flank + 1)
    near = near.filter(F.abs(F.col("opos") - F.col("pos")) <= flank).select(*SITE).distinct()
    return points.join(near.filter(uniform(F.col("pos"), seed) <= part), SITE, "left_anti")


def one_hot(label: str = "label"):
    """reference, germline, somatic as 0 and 1."""
    return F.array(*((F.col(label) == k).cast("int") for k in ("reference", "germline", "somatic")))
