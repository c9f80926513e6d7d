"""Composed plans: each is one lazy graph from tables to a result; stages may be written and read between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.operators import calls, copynumber, counts, evaluate, intervals, kernels, lineage, paired, sequences, sites


def pair_candidates(tumor: DataFrame, normal: DataFrame, regions: DataFrame | None = None, given: DataFrame | None = None, most_indel: int = sites.MAX_INDEL, **thresholds) -> DataFrame:
    """Candidate sites of a pair of observations: counted in the tumor without longer indels, gated, kept to the regions,
    and compared with the normal, which is counted at candidate sites only (a semi join before its sums).

    given: sites that are candidates whatever the gate and the comparison say, if the normal has reads there; hybrid
    marks them, and their columns from the counts are null where they did not pass.
    """
    t = counts.candidates(counts.allele_counts(sites.capped_indels(tumor, most_indel)), **thresholds)
    if regions is not None:
        t = intervals.points_inside(t, regions, ["ctg", "pos"])
    wanted = t.select("ctg", "pos") if given is None else t.select("ctg", "pos").union(given.select("ctg", "pos"))
    n = counts.allele_counts(sites.capped_indels(normal.join(wanted.distinct(), ["ctg", "pos"], "left_semi"), most_indel))
    kept = paired.paired_filter(t, n)
    if given is None:
        return kept
    return sites.keep_given(sites.with_given(t, given), kept, n.filter("sample = 'normal'")).drop("found").join(kept, ["ctg", "pos"], "left")


def pair_features(sites: DataFrame, tumor: DataFrame, normal: DataFrame, flank: int = 16) -> DataFrame:
    """A site's windows of both samples, the normal's first: (ctg, pos, features)."""
    width = len(counts.CHANNELS)
    own = lambda o, name: sequences.feature_window(sites, counts.channels(o), width, flank).withColumnRenamed("features", name)
    return own(normal, "n").join(own(tumor, "t"), ["ctg", "pos"]).select("ctg", "pos", F.concat("n", "t").alias("features"))


def call_pair(tumor: DataFrame, normal: DataFrame, model: Callable, flank: int = 16, threshold: float | None = None, **thresholds) -> DataFrame:
    """Calls of a pair: candidates, features, scores, rows."""
    found = pair_candidates(tumor, normal, **thresholds)
    features = pair_features(found.select("ctg", "pos"), tumor, normal, flank)
    p = kernels.score(features, model, (2 * (2 * flank + 1), len(counts.CHANNELS)))
    there = tumor.unionByName(normal).join(found.select("ctg", "pos"), ["ctg", "pos"], "left_semi")
    c = counts.allele_counts(there)
    code = F.when(F.col("allele").startswith("D"), F.concat(F.lit("D"), F.col("ref"), F.expr("substring(allele, 2)"))).when(F.length("allele") > 1, F.col("allele")).when(F.col("allele") == F.col("ref"), F.concat(F.lit("R"), F.col("allele"))).otherwise(F.concat(F.lit("X"), F.col("allele")))
    by = c.filter("allele <> '*'").withColumn("code", code).groupBy("ctg", "pos", "ref", "code").agg(
        F.coalesce(F.sum(F.when(F.col("sample") == "tumor", F.col("n"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("sample") == "normal", F.col("n"))), F.lit(0)).alias("n"),
        F.max(F.when(F.col("sample") == "tumor", F.col("depth"))).alias("d"), F.max(F.when(F.col("sample") == "normal", F.col("depth"))).alias("nd"),
    )
    counted = by.groupBy("ctg", "pos", "ref").agg(F.map_from_entries(F.collect_list(F.struct("code", F.struct("t", "n")))).alias("alleles"), F.coalesce(F.max("d"), F.lit(0)).alias("depth"), F.coalesce(F.max("nd"), F.lit(0)).alias("normal_depth"))
    rows = calls.call_rows(p.join(counted, ["ctg", "pos"]), threshold=threshold)
    return rows.join(counts.strand_tags(there).drop("ref"), ["ctg", "pos"], "left")


def evaluate_calls(truth: DataFrame, called: DataFrame, regions: list[DataFrame] | None = None) -> DataFrame:
    """Precision, recall and F1 of calls against truth, both kept to all of the regions."""
    for r in regions or []:
        truth = intervals.points_inside(truth, r, ["ctg", "pos"])
        called = intervals.points_inside(called, r, ["ctg", "pos"])
    return evaluate.metrics(evaluate.classify(truth, called, ["ctg", "pos"]))


def fit_purity(segs: DataFrame, rhos: list[float] = copynumber.RHOS, psis: list[float] = copynumber.PSIS, shift: tuple[float, float] = copynumber.SHIFT) -> DataFrame:  # noqa: B006
    """The best purity and ploidy of segments: a local minimum of the grid, one row at most."""
    return copynumber.best_purity(copynumber.purity_grid(segs, rhos, psis, shift))


def copy_number_track(tumor: DataFrame, normal: DataFrame, alleles: DataFrame, covariates: DataFrame | None = None, min_normal: int = 10) -> DataFrame:
    """(ctg, pos, logr, baf, hom) from base counts of both samples and a table of alleles: the ratio of depths, without
    what splines of the covariates (ctg, pos, ...) explain of it, the tumor's share of an allele, and if the normal is
    homozygous there."""
    t, n = copynumber.allele_pairs(tumor, alleles), copynumber.allele_pairs(normal, alleles)
    track = copynumber.depth_ratios(t, n, min_normal)
    if covariates is not None:
        named = [c for c in covariates.columns if c not in ("ctg", "pos")]
        track = copynumber.spline_residuals(track.join(covariates, ["ctg", "pos"]), "logr", named)
        track = track.select("ctg", "pos", F.col("corrected").alias("logr"), "baf")
    genotype = copynumber.homozygous(copynumber.depth_ratios(n)).select("ctg", "pos", "hom")
    return track.join(genotype, ["ctg", "pos"])


def tag_by_counts(called: DataFrame, tumor: DataFrame, normal: DataFrame, alleles: DataFrame, covariates: DataFrame | None = None, penalty: float = 70.0) -> DataFrame:
    """Calls with a verdict, from base counts of both samples on: the whole plan."""
    track = lineage.reliable(copy_number_track(tumor, normal, alleles, covariates))
    het = track.filter("not hom")
    calm = sequences.winsorise(het.withColumn("high", F.greatest("baf", 1 - F.col("baf"))), ["ctg"], "pos", "high").select("ctg", "pos", "logr", F.col("winsorised").alias("baf"))
    calm = sequences.winsorise(calm, ["ctg"], "pos", "logr").select("ctg", "pos", F.col("winsorised").alias("logr"), "baf")
    return _tagged(called, copynumber.segments(calm, penalty))


def tag_by_copies(called: DataFrame, tumor: DataFrame, normal: DataFrame, rhos: list[float] = copynumber.RHOS, psis: list[float] = copynumber.PSIS) -> DataFrame:  # noqa: B006
    """Calls (ctg, pos, alt, depth) with a verdict by copy numbers: ratios, segments, purity, whole copies, verdicts.

    tumor and normal have ctg, pos, a, b. A call outside of all segments has no verdict.
    """
    return _tagged(called, copynumber.segments(copynumber.depth_ratios(tumor, normal)), rhos, psis)


def _tagged(called: DataFrame, segs: DataFrame, rhos: list[float] = copynumber.RHOS, psis: list[float] = copynumber.PSIS) -> DataFrame:  # noqa: B006
    segs = lineage.reliable(segs)
    best = fit_purity(segs, rhos, psis).first()
    if best is None:
        return called.withColumn("verdict", F.lit(None).cast("string"))
    whole = copynumber.whole_copies(segs, best.rho, best.psi).select("ctg", F.col("start").alias("rstart"), (F.col("end") + 1).alias("rend"), "major", "minor")
    at = intervals.first_match(called.select("ctg", "pos").distinct(), whole.withColumn("rstart", F.col("rstart") - 1), "rstart")
    judged = copynumber.verdicts(called.join(at, ["ctg", "pos"], "left").withColumn("purity", F.lit(best.rho)))
    return judged.withColumn("verdict", F.when(F.col("major").isNotNull(), F.col("verdict")))
