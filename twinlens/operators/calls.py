"""From class probabilities to calls, and from several call sets to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions import quality as Q
from twinlens.functions.alleles import alt_bases, call_genotype, contig_rank, variant_class

KEY = ["ctg", "pos"]
KINDS = ("reference", "germline", "somatic")


def call_rows(scored: DataFrame, show_reference: bool = False, show_germline: bool = False, indels: bool = False, threshold: float | None = None) -> DataFrame:
    """Calls of scored sites: ctg, pos, ref, p (three probabilities), depth, normal_depth, alleles as a map of an
    allele code to struct(t, n), the reads in tumor and normal.

    The class is the last largest probability. A somatic call takes the allele with the largest positive difference of
    fractions, a germline call the one with the largest sum; without one there is no call. ad and nad are the reads of
    the reference and of the call's allele in tumor and normal; of a reference call, its reads alone.
    """
    k = Q.argmax(F.col("p"))
    entries = F.map_entries("alleles")
    alt = F.filter(entries, lambda e: ~e["key"].startswith("R"))
    t = lambda e: F.coalesce(F.try_divide(e["value"]["t"], F.col("depth")), F.lit(0.0))
    n = lambda e: F.coalesce(F.try_divide(e["value"]["n"], F.col("normal_depth")), F.lit(0.0))
    ranked = lambda score: F.array_min(F.transform(alt, lambda e: F.struct((-F.round(score(e), 9)).alias("s"), e["key"].alias("code"))))
    somatic, germline = ranked(lambda e: t(e) - n(e)), ranked(lambda e: t(e) + n(e))
    d = scored.withColumn("kind", F.element_at(F.array(*(F.lit(x) for x in KINDS)), (k + 1).cast("int")))
    code = F.when(F.col("kind") == "germline", germline["code"]).when((F.col("kind") == "somatic") & (somatic["s"] < 0) & (F.col("depth") > 0), somatic["code"])
    d = d.withColumn("code", code).withColumn("b", F.when(F.col("code").isNotNull(), alt_bases(F.col("code"), F.col("ref"))))
    reads = F.coalesce(F.try_element_at("alleles", F.coalesce("code", F.concat(F.lit("R"), F.col("ref"))))["t"], F.lit(0))
    on = lambda side: F.coalesce(F.try_element_at("alleles", F.concat(F.lit("R"), F.col("ref")))[side], F.lit(0))
    normal_reads = F.coalesce(F.try_element_at("alleles", F.coalesce("code", F.concat(F.lit("R"), F.col("ref"))))["n"], F.lit(0))
    pair = lambda side, own: F.when(F.col("kind") == "reference", F.array(own)).otherwise(F.array(on(side), own))
    naf = F.coalesce(F.try_divide(normal_reads, F.col("normal_depth")), F.lit(0.0))
    af = F.least(F.coalesce(F.try_divide(reads, F.col("depth")), F.lit(0.0)), F.lit(1.0))
    qual = F.array_max("p")
    out = d.select(
        *KEY, F.coalesce("b.ref", "ref").alias("ref"), F.when(F.col("kind") == "reference", ".").otherwise(F.col("b.alt")).alias("alt"),
        F.round(qual, 4).alias("qual"), Q.filter_value(F.col("kind"), qual, threshold).alias("filter"), "kind",
        call_genotype(F.col("kind"), af).alias("gt"), F.col("depth").alias("dp"), F.round(af, 4).alias("af"), pair("t", reads).alias("ad"),
        F.col("normal_depth").alias("ndp"), F.round(naf, 4).alias("naf"), pair("n", normal_reads).alias("nad"),
    )
    shown = (F.col("kind") == "somatic") | (F.lit(show_germline) & (F.col("kind") == "germline")) | (F.lit(show_reference) & (F.col("kind") == "reference"))
    wanted = F.when(F.col("alt") == ".", True).when(F.lit(indels), variant_class(F.col("ref"), F.col("alt")).isin("INS", "DEL")).otherwise(variant_class(F.col("ref"), F.col("alt")) == "SNV")
    return out.filter(shown & F.col("alt").isNotNull() & (F.col("ref") != F.col("alt")) & wanted)


def merge_calls(first: DataFrame, second: DataFrame, max_qual: float = 0.8, keep_confident: bool = False, prefer_recall: bool = False, min_qual: float = 0.0, max_naf: float | None = None) -> DataFrame:
    """One call set of two (ctg, pos, ref, alt, qual as a probability, filter, naf): one full outer join and a rule.

    Both pass: the first's row with the mean's score. Only the first passes: kept above max_qual if keep_confident, and
    below it if prefer_recall. Else the second's row: scored for germline, reference and, if prefer_recall, any; 0
    otherwise. Rows of the first alone that do not pass: likewise without recall.
    """
    cols = ["ref", "alt", "qual", "filter", "naf"]
    a = first.select(*KEY, F.struct(*cols).alias("a"))
    b = second.select(*KEY, F.struct(*cols).alias("b"))
    d = a.join(b, KEY, "full_outer")
    pa, pb = (F.coalesce(F.col(f"{x}.filter") == "PASS", F.lit(False)) for x in "ab")
    score = lambda c: Q.call_quality(c)
    fixed = lambda x: F.col(f"{x}.filter").isin("Germline", "RefCall")
    row = lambda x, q: F.struct(*(F.col(f"{x}.{c}").alias(c) if c != "qual" else q.alias("qual") for c in cols))
    alone = F.lit(keep_confident) & (F.col("a.qual") > max_qual) | (F.lit(prefer_recall) & (F.col("a.qual") <= max_qual))
    zero = F.lit(0.0)
    chosen = (
        F.when(pa & pb, row("a", score((F.col("a.qual") + F.col("b.qual")) / 2)))
        .when(pa & alone, row("a", score(F.col("a.qual"))))
        .when(F.col("b").isNotNull(), row("b", F.when(fixed("b") | F.lit(prefer_recall), score(F.col("b.qual"))).otherwise(zero)))
        .when(~pa, row("a", F.when(fixed("a"), score(F.col("a.qual"))).otherwise(zero)))
    )
    out = d.withColumn("c", chosen).filter("c is not null").select(*KEY, "c.*")
    out = out.withColumn("filter", Q.mark_low(F.col("filter"), F.col("qual"), min_qual))
    if max_naf is not None:
        out = out.withColumn("m", Q.mark_normal(F.col("filter"), F.col("qual"), F.col("naf"), max_naf)).withColumns({"filter": F.col("m.filter"), "qual": F.col("m.qual")}).drop("m")
    return out


def genome_order(df: DataFrame, last: str | None = None) -> DataFrame:
    """Rows in karyotype order; with last, one row of a place, the one that is last by that column."""
    if last:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(last)))).filter("_r = 1").drop("_r")
    return df.orderBy(contig_rank(F.col("ctg")), "ctg", "pos")


def backfill(calls: DataFrame, sites: DataFrame, info: DataFrame, only_sites: bool) -> DataFrame:
    """Calls with a ./. row for each given site (ctg, pos, ref, alt) that has none, with depths (ctg, pos, dp, ndp);
    only_sites leaves other calls out."""
    missing = sites.join(calls.select(*KEY), KEY, "left_anti").join(info, KEY, "left")
    rows = missing.select(*KEY, "ref", "alt", F.lit("./.").alias("gt"), F.coalesce("dp", F.lit(0)).cast("long").alias("dp"), F.coalesce("ndp", F.lit(0)).cast("long").alias("ndp"))
    own = calls.join(sites.select(*KEY).distinct(), KEY, "left_semi") if only_sites else calls
    return own.select(*KEY, "ref", "alt", "gt", "dp", "ndp").unionByName(rows)


def supported(variants: DataFrame, reads: DataFrame) -> DataFrame:
    """Variants (ctg, pos, alt) with the genotype gone where no read (ctg, pos, allele) has them."""
    seen = reads.select(*KEY, F.col("allele").alias("alt"), F.lit(True).alias("seen")).distinct()
    return variants.join(seen, [*KEY, "alt"], "left").withColumn("gt", F.when(F.col("seen"), F.col("gt"))).drop("seen")
