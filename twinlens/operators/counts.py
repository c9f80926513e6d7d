"""Counting observations of alleles at sites.

Observations have one row per read and position: ctg, pos, ref, sample, base (case gives the strand, * and # are
deletions), indel (+SEQ, -SEQ or empty), bq, mq, hp, qname. Sums and counts are partial before the shuffle on the site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.alleles import BASES

SITE = ["ctg", "pos"]

#: Channels of a site's feature vector, in order: bases by strand, longest indel counts, deletions; then low mapping and
#: base qualities of the bases.
CHANNELS = (
    [*"ACGT", "I", "I1", "D", "D1", "*", *"acgt", "i", "i1", "d", "d1", "#"]
    + [f"{b}LMQ" for b in "ACGTacgt"] + [f"{b}LBQ" for b in "ACGTacgt"]
)
LOW_MQ, LOW_BQ = 20, 30


def allele(base: Column, indel: Column) -> Column:
    """A, C, G, T, I with the base and the inserted ones, D with an N for each deleted base, or * for any deletion mark.

    Deletions of one length are one allele, whatever the base before them."""
    b = F.upper(base)
    seq = F.upper(F.substring(indel, F.lit(2), F.length(indel)))
    kind = F.substring(indel, 1, 1)
    return F.when(kind == "+", F.concat(F.lit("I"), b, seq)).when(kind == "-", F.concat(F.lit("D"), F.repeat(F.lit("N"), F.length(seq)))).when(b.isin("*", "#"), "*").otherwise(b)


def allele_counts(obs: DataFrame, keys: list[str] = [*SITE, "ref", "sample"]) -> DataFrame:  # noqa: B006
    """Reads of each allele of a site and sample, and the depth: all but N. A base with an indel counts for both."""
    base = F.upper("base")
    own = F.when(base.isin(*BASES), base).when(base.isin("*", "#"), "*")
    both = F.array(own, F.when(F.coalesce("indel", F.lit("")) != "", allele(F.col("base"), F.col("indel"))))
    per = obs.select(*keys, F.explode(F.array_compact(both)).alias("allele")).groupBy(*keys, "allele").agg(F.count("*").alias("n"))
    depth = F.sum(F.when(F.length("allele") == 1, F.col("n")).otherwise(0)).over(Window.partitionBy(*keys))
    return per.select(*keys, "allele", "n", depth.alias("depth"))


def site_counts(obs: DataFrame) -> DataFrame:
    """A row per site and sample: depth, counts of the bases, and reads by strand and haplotype."""
    b = F.upper("base")
    forward = F.col("base").isin(*BASES, "*")
    return obs.groupBy(*SITE, "ref", "sample").agg(
        F.count_if(b.isin(*BASES, "*", "#")).alias("depth"),
        *(F.count_if(b == x).alias(f"n_{x.lower()}") for x in BASES),
        F.count_if(forward).alias("forward"),
        F.count_if(~forward & b.isin(*BASES, "#")).alias("reverse"),
        *(F.count_if(F.col("hp") == h).alias(f"hp{h}") for h in (0, 1, 2)),
        *(F.count_if((F.col("hp") == h) & (b != F.upper("ref"))).alias(f"alt_hp{h}") for h in (0, 1, 2)),
        F.avg(F.when(b != F.upper("ref"), F.col("bq"))).alias("alt_bq"),
    )


def strand_tags(obs: DataFrame) -> DataFrame:
    """A row per site: au to tu, reads of each base in the tumor, nau to ntu in the normal, and of the tumor's fau to ftu
    forward and rau to rtu reverse. The reference base's number is what the others leave of the depth."""
    b = F.upper("base")
    forward = F.col("base").isin(*BASES, "*")
    counted = b.isin(*BASES, "*", "#")
    parts = {"": F.col("sample") == "tumor", "n": F.col("sample") == "normal", "f": (F.col("sample") == "tumor") & forward}
    sums = [F.count_if(c & counted).alias(f"_{k}depth") for k, c in parts.items()]
    sums += [F.count_if(c & (b == x)).alias(f"_{k}{x.lower()}") for k, c in parts.items() for x in BASES]
    d = obs.groupBy(*SITE, F.upper("ref").alias("ref")).agg(*sums)
    out = {}
    for k in parts:
        for x in BASES:
            others = sum((F.col(f"_{k}{y.lower()}") for y in BASES if y != x), F.lit(0))
            out[f"{k}{x.lower()}u"] = F.when(F.col("ref") == x, F.col(f"_{k}depth") - others).otherwise(F.col(f"_{k}{x.lower()}"))
    d = d.withColumns(out)
    return d.withColumns({f"r{x.lower()}u": F.col(f"{x.lower()}u") - F.col(f"f{x.lower()}u") for x in BASES}).drop(*(c for c in d.columns if c.startswith("_")))


def reference_by_difference(counts: DataFrame) -> DataFrame:
    """Base counts in which the reference's is the depth less the others'."""
    others = lambda x: sum((F.col(f"n_{y.lower()}") for y in BASES if y != x), F.lit(0))
    return counts.withColumns({f"n_{x.lower()}": F.when(F.col("ref") == x, F.col("depth") - others(x)).otherwise(F.col(f"n_{x.lower()}")) for x in BASES})


def candidates(counts: DataFrame, min_depth: int = 4, min_reads: int = 3, snv_af: float = 0.05, indel_af: float = 0.1) -> DataFrame:
    """Sites of allele_counts with an allele that passes: snv and indel tell which kind; top_af, second_af and
    top_allele of the alternative bases, top_indel and indel_af of insertions and deletions, equal counts by name. Depth
    must be above min_depth."""
    af = F.try_divide("n", "depth")
    base, indel = F.col("allele").isin(*BASES) & (F.col("allele") != F.col("ref")), F.substring("allele", 1, 1).isin("I", "D") & (F.length("allele") > 1)
    enough = F.col("n") >= min_reads
    ranked = F.array_sort(F.collect_list(F.when(base, F.struct((-F.col("n")).alias("m"), F.col("allele").alias("allele")))))  # four bases at most
    site = counts.filter((F.col("depth") > min_depth) & F.col("ref").isin(*BASES)).groupBy(*SITE, "ref", "sample", "depth").agg(
        F.coalesce(F.bool_or(base & enough & (af >= snv_af)), F.lit(False)).alias("snv"),
        F.coalesce(F.bool_or(indel & enough & (af >= indel_af)), F.lit(False)).alias("indel"),
        ranked.alias("r"), F.min(F.when(indel, F.struct((-F.col("n")).alias("m"), F.col("allele").alias("allele")))).alias("i"),
    )
    share = lambda k: F.round(-F.get("r", k)["m"] / F.col("depth"), 3)
    return site.filter("snv or indel").select(
        *SITE, "ref", "sample", "depth", "snv", "indel",
        F.get("r", 0)["allele"].alias("top_allele"), share(0).alias("top_af"), share(1).alias("second_af"),
        F.col("i.allele").alias("top_indel"), F.round(-F.col("i.m") / F.col("depth"), 3).alias("indel_af"),
    )


def channels(obs: DataFrame) -> DataFrame:
    """A site's feature vector: counts by channel, with the reference base's channels holding their strand's depth.

    I1, D1 (and i1, d1) count the most frequent insertion and deletion of their strand. Bases of low mapping quality
    count in the LMQ channels only. Two sums: by allele, then by site with a fixed list of channels.
    """
    low = F.col("mq") < LOW_MQ
    base = F.col("base")
    upper = base.rlike("^[ACGT*]")
    kind = F.substring("indel", 1, 1)
    mark = F.when(kind == "+", "I").when(kind == "-", "D")
    per = obs.groupBy(*SITE, "ref", "sample", base.alias("b"), F.when(upper, mark).otherwise(F.lower(mark)).alias("mark"), F.upper("indel").alias("indel")).agg(
        F.count_if(~low).alias("n"), F.count_if(low).alias("lmq"), F.count_if(~low & (F.col("bq") < LOW_BQ)).alias("lbq")
    )
    by_indel = per.groupBy(*SITE, "ref", "sample", "mark", "indel").agg(
        F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("b", F.struct("n", "lmq", "lbq")))).alias("by")
    )
    count = lambda b, f: F.sum(F.coalesce(F.try_element_at("by", F.lit(b))[f], F.lit(0)))
    cells = {b: count(b, "n") for b in "ACGT*acgt#"}
    for m in "IDid":
        cells[m] = F.sum(F.when(F.col("mark") == m, F.col("n")).otherwise(0))
        cells[f"{m}1"] = F.max(F.when(F.col("mark") == m, F.col("n")).otherwise(0))
    cells |= {f"{b}LMQ": count(b, "lmq") for b in "ACGTacgt"} | {f"{b}LBQ": count(b, "lbq") for b in "ACGTacgt"}
    wide = by_indel.groupBy(*SITE, "ref", "sample").agg(*(cells[c].cast("long").alias(f"c{i}") for i, c in enumerate(CHANNELS)))
    at = {c: F.col(f"c{i}") for i, c in enumerate(CHANNELS)}
    out = []
    for c in CHANNELS:
        b, suffix = c[0], c[1:]
        strand = "ACGT" if b.isupper() else "acgt"
        if b in "ACGTacgt" and suffix in ("", "LMQ", "LBQ"):
            total = sum((at[x + suffix] for x in strand), F.lit(0))
            out.append(F.when(F.upper("ref") == b.upper(), total).otherwise(at[c]))
        else:
            out.append(at[c])
    return wide.select(*SITE, "ref", "sample", F.array(*out).alias("channels"))


def unique_fragment_counts(obs: DataFrame, keys: list[str] = SITE) -> DataFrame:  # noqa: B006
    """Base counts in which overlapping mates that agree count once: a read name and base count once a site.

    With a barcode among the keys these are counts by cell.
    """
    once = obs.filter(F.upper("base").isin(*BASES)).select(*keys, "qname", F.upper("base").alias("base")).distinct()
    return once.groupBy(*keys).agg(*(F.count_if(F.col("base") == b).alias(f"count_{b.lower()}") for b in BASES), F.count("*").alias("good_depth"))


def usable(obs: DataFrame, min_mq: int = 20, min_bq: int = 0, flags: int = 2316) -> DataFrame:
    """Observations with none of the flags and the least qualities."""
    return obs.filter((F.col("mq") >= min_mq) & (F.col("bq") >= min_bq) & (F.col("flag").bitwiseAND(flags) == 0))
