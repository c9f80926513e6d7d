"""Sampling that gives the same rows on every run: by hashes of keys, never by the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: a discretised Beta distribution; entry i is the probability of an allele fraction up to i percent
BETA_CDF = [
    0.00000, 0.00288, 0.00842, 0.01639, 0.02658, 0.03880, 0.05285, 0.06856, 0.08576, 0.10427,
    0.12396, 0.14466, 0.16625, 0.18860, 0.21157, 0.23506, 0.25896, 0.28317, 0.30758, 0.33212,
    0.35669, 0.38123, 0.40566, 0.42992, 0.45394, 0.47767, 0.50105, 0.52406, 0.54663, 0.56873,
    0.59034, 0.61142, 0.63195, 0.65189, 0.67125, 0.68999, 0.70810, 0.72559, 0.74243, 0.75863,
    0.77418, 0.78908, 0.80333, 0.81695, 0.82993, 0.84228, 0.85401, 0.86513, 0.87566, 0.88560,
    0.89497, 0.90379, 0.91207, 0.91982, 0.92707, 0.93384, 0.94013, 0.94598, 0.95139, 0.95639,
    0.96099, 0.96522, 0.96910, 0.97264, 0.97586, 0.97879, 0.98143, 0.98381, 0.98595, 0.98786,
    0.98956, 0.99107, 0.99239, 0.99355, 0.99457, 0.99545, 0.99620, 0.99685, 0.99740, 0.99786,
    0.99824, 0.99855, 0.99881, 0.99902, 0.99918, 0.99931, 0.99941, 0.99949, 0.99954, 0.99958,
    0.99961, 0.99963, 0.99964, 0.99964, 0.99965, 0.99965, 0.99965, 0.99965, 0.99965, 1.00000,
]

#: A hash that any SQL engine can compute: a multiplicative one, modulo a prime.
PRIME, FACTOR = 2_147_483_647, 48_271


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a whole number key."""
    h = F.pmod(F.pmod(key.cast("long") + 1 + seed * 7919, F.lit(PRIME)) * FACTOR, F.lit(PRIME))
    h = F.pmod(h * FACTOR, F.lit(PRIME))
    return h / F.lit(float(PRIME))


def sample_part(df: DataFrame, key: str, part: float, seed: int = 0) -> DataFrame:
    """About so large a part of the rows; no shuffle, and a smaller part is a subset of a larger one."""
    return df.filter(uniform(F.col(key), seed) < part)


def cap_ratio(df: DataFrame, label: str, base: str, ratios: dict[str, float], key: str, seed: int = 0) -> DataFrame:
    """At most ratio times as many rows of each other label as of the base label, those with the smallest hashes.

    A label's limit is found by its hash threshold: rows are ranked within buckets only after whole buckets were
    counted, so that no label is sorted in one task. Rows with a null label have no limit unless the base is null;
    rows with a null key rank last in their label.
    """
    d = df.withColumn("_u", F.coalesce(uniform(F.col(key), seed), F.lit(1.0))).withColumn("_b", F.floor(F.col("_u") * 4096))
    counts = d.groupBy(label, "_b").agg(F.count("*").alias("n"))
    n = F.sum(F.when(F.col(label).eqNullSafe(F.lit(base)), F.col("n")).otherwise(0)).over(Window.partitionBy())
    ratio = F.try_element_at(F.create_map(*(F.lit(x) for k, v in ratios.items() for x in (k, float(v)))), F.col(label))
    plan = counts.withColumn("_most", F.floor(n * ratio))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = plan.withColumn("_before", before).select(F.col(label).alias("_label"), F.col("_b").alias("_bucket"), F.col("n").alias("_n"), "_most", "_before")  # 4097 rows a label
    rank = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_u", key))
    d = d.join(plan, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_b") == F.col("_bucket")))
    sure = d.filter(F.col("_most").isNull() | (F.col("_before") + F.col("_n") <= F.col("_most")))
    edge = d.filter((F.col("_before") < F.col("_most")) & (F.col("_before") + F.col("_n") > F.col("_most"))).withColumn("_r", rank).filter(F.col("_before") + F.col("_r") <= F.col("_most"))
    return sure.select(*df.columns).unionByName(edge.select(*df.columns))


def round_robin(df: DataFrame, order: str, bins: int) -> DataFrame:
    """bin: the dense number of a row, from 0, modulo bins. order must be such a number or a hash."""
    return df.withColumn("bin", F.pmod(F.col(order), F.lit(bins)))


def beta_fraction(u: Column, table: list[float] = BETA_CDF) -> Column:  # noqa: B006
    """The allele fraction of a uniform number, by the inverse of the table: the last entry that is not above it."""
    hit = F.array_max(F.transform(F.array(*(F.lit(x) for x in table)), lambda c, i: F.when(c <= u, i)))
    return hit / 100.0


def beta_subsamples(reads: DataFrame, draws: int = 4, least: int = 3, seed: int = 0) -> DataFrame:
    """Reads (ctg, pos, qname, is_alt, reverse) of sites in nested samples: (ctg, pos, size, qname), each with size reads.

    A site gives all its reads and, for each draw, as many as bring the share of alternative reads to a Beta fraction,
    if that is between least and all of them; equal sizes count once. Reads are ranked by a hash of their name and the
    seed, so that a smaller sample is part of a larger one. A sample stays if it has least alternative reads, of both
    strands.
    """
    site = ["ctg", "pos"]
    sums = reads.groupBy(*site).agg(F.count("*").alias("n"), F.count_if("is_alt").alias("alts")).filter("alts > 0")
    fractions = [beta_fraction(uniform(F.col("pos") * (draws + 1) + k, seed)) for k in range(draws)]
    wanted = F.array(F.col("n"), *(F.floor(F.round(F.col("n") * f / (F.col("alts") / F.col("n")), 9)) for f in fractions))
    sizes = sums.select(*site, F.explode(F.array_distinct(F.filter(wanted, lambda x: x.between(least, F.col("n"))))).alias("size"))
    rank = F.row_number().over(Window.partitionBy(*site).orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), "qname")), "qname"))
    sampled = reads.withColumn("_rank", rank).join(sizes, site).filter(F.col("_rank") <= F.col("size"))
    back = F.count_if(F.col("is_alt") & F.col("reverse"))
    fine = sampled.groupBy(*site, "size").agg(F.count_if("is_alt").alias("alts"), back.alias("back")).filter((F.col("alts") >= least) & (F.col("back") > 0) & (F.col("back") < F.col("alts")))
    return sampled.join(fine.select(*site, "size"), [*site, "size"]).select(*site, "size", "qname")


#: Bins of a mixture are so deep.
BIN_COVERAGE = 4


def normal_share(ctg: Column) -> Column:
    """How deep the normal of a mixture is, as a share of its tumor, by the number of the contig."""
    n = F.regexp_extract(ctg, "([0-9]+)$", 1).try_cast("int")
    return F.when(n <= 6, 1.0).when(n <= 8, 1.25).when(n > 16, 0.5).when(n.isNotNull(), 0.75)


def mixing_plan(contigs: DataFrame, proportion: float, coverage: int | None = None, depth: int = BIN_COVERAGE) -> DataFrame:
    """Numbers of bins of contigs (ctg, normal_coverage, tumor_coverage, share): normal_bins and tumor_bins there are,
    and tumor_in_tumor, normal_in_tumor and normal_in_normal that a mixture with so large a tumor proportion takes. Its
    coverage is the wanted one or, if that is less, the most that both samples allow."""
    whole = lambda c: F.floor(F.round(c, 9)).cast("long")
    most = F.least(whole(F.col("tumor_coverage") / proportion), whole(F.col("normal_coverage") / (1 + F.col("share") - proportion)))
    d = contigs.withColumn("coverage", most if coverage is None else F.least(most, F.lit(coverage)))
    tumor = whole(F.col("coverage") * proportion)
    d = d.withColumns({"normal_bins": whole(F.col("normal_coverage") / depth), "tumor_bins": whole(F.col("tumor_coverage") / depth), "tumor_in_tumor": whole(tumor / depth), "normal_in_tumor": whole((F.col("coverage") - tumor) / depth)})
    return d.withColumn("normal_in_normal", whole((F.col("tumor_in_tumor") + F.col("normal_in_tumor")) * F.col("share")))


def mixed_bins(plan: DataFrame, seed: int = 0) -> DataFrame:
    """(ctg, sample, bin, part) for each bin of mixing_plan's contigs that goes into the mixture's tumor or its normal.

    Bins are drawn without replacement, by hash. The normal takes bins that the tumor has not; when these are used up, it
    takes others again. A contig has a handful of bins, and contigs are dealt out.
    """
    drawn = lambda sample, n: plan.select("*", F.lit(sample).alias("sample"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("bin")).filter(F.col(n) > 0)
    both = drawn("tumor", "tumor_bins").unionByName(drawn("normal", "normal_bins"))
    rank = F.row_number().over(Window.partitionBy("ctg", "sample").orderBy(uniform(F.col("bin"), seed), "bin"))
    both = both.withColumn("rank", rank)
    tumor = F.when(F.col("sample") == "tumor", F.col("tumor_in_tumor")).otherwise(F.col("normal_in_tumor"))
    rest = F.col("normal_bins") - F.col("normal_in_tumor")
    # first what the tumor left, then what it took
    place = F.when(F.col("rank") > F.col("normal_in_tumor"), F.col("rank") - F.col("normal_in_tumor")).otherwise(F.col("rank") + rest)
    part = F.array_compact(F.array(F.when(F.col("rank") <= tumor, "tumor"), F.when((F.col("sample") == "normal") & (place <= F.col("normal_in_normal")), "normal")))
    return both.select("ctg", "sample", "bin", F.explode(part).alias("part"))


def mixed_reads(reads: DataFrame, bins: DataFrame) -> DataFrame:
    """Reads (ctg, sample, bin, ...) of the bins of a mixture, with part."""
    return reads.join(bins, ["ctg", "sample", "bin"])


def mixture_coverage(tumor: float, normal: float, part: float, contamination: float = 0.0) -> float:
    """The largest coverage of a mixture with so large a tumor part, from bins of both samples without reuse."""
    other = 1 + contamination - part
    return min(tumor / part if part else float("inf"), normal / other if other else float("inf"))


def contamination_parts(tumor: float, normal: float, purity: float, want: float) -> tuple[float, float]:
    """The parts of the tumor and normal reads for a mixture of the purity and coverage, to 3 places."""
    return round(want * purity / tumor, 3), round(want * (1 - purity) / normal, 3)


def mix_reads(tumor: DataFrame, normal: DataFrame, key: str, tumor_part: float, normal_part: float, seed: int = 0) -> DataFrame:
    """Reads of both samples in such parts, duplicates and all."""
    return sample_part(tumor, key, tumor_part, seed).unionByName(sample_part(normal, key, normal_part, seed + 1))
