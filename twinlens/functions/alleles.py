"""Columns for alleles, genotypes, regions and codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")

# fixed values: the codes of bases, strands and haplotypes in feature matrices
BASE_CODES = {"A": 100, "C": 25, "G": 75, "T": 50, "+": -50, "-": -100, "*": -100, "#": -100, "N": 100}
STRAND_CODE = 100
HAPLOTYPE_CODES = {"normal": {1: -90, 0: -60, 2: -30}, "tumor": {1: 30, 0: 60, 2: 90}}

# fixed values: IUPAC codes and the base that stands for each
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "A", "Y": "C", "S": "C", "W": "A", "K": "G", "M": "A",
    "B": "C", "D": "A", "H": "A", "V": "A", "N": "A",
}

# fixed values: contigs in karyotype order
KARYOTYPE = [f"chr{c}" for c in [*range(1, 23), "X", "Y"]] + [str(c) for c in [*range(1, 23), "X", "Y"]]


def variant_class(ref: Column, alt: Column) -> Column:
    """SNV, INS or DEL by lengths; null for substitutions of several bases."""
    r, a = F.length(ref), F.length(alt)
    return F.when((r == 1) & (a == 1), "SNV").when(r < a, "INS").when(r > a, "DEL")


def allele_key(ref: Column, alt: Column) -> Column:
    """A+TC for an insertion after A, A-NN for a deletion of two, the alternative base otherwise."""
    r, a = F.length(ref), F.length(alt)
    first = F.substring(ref, 1, 1)
    return (
        F.when(r < a, F.concat(first, F.lit("+"), F.substring(alt, F.lit(2), a)))
        .when(r > a, F.concat(first, F.lit("-"), F.repeat(F.lit("N"), r - 1)))
        .otherwise(alt)
    )


def suffix_trim(ref: Column, alt: Column) -> Column:
    """struct(ref, alt) without their common ending; a base of each stays."""
    n = F.least(F.length(ref), F.length(alt)) - 1
    at = lambda s, k: F.substring(s, F.length(s) - k, F.lit(1))
    same = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda k, i: F.when((k == i) & (at(ref, i) == at(alt, i)), k + 1).otherwise(k),
    )
    cut = lambda s: F.substring(s, F.lit(1), F.length(s) - same)
    return F.struct(cut(ref).alias("ref"), cut(alt).alias("alt"))


def to_base(c: Column) -> Column:
    """IUPAC codes to bases, in the letter's own case."""
    src = "".join(IUPAC)
    dst = "".join(IUPAC.values())
    return F.translate(c, src + src.lower(), dst + dst.lower())


def base_code(base: Column) -> Column:
    """The feature code of a base or indel mark, either case; 0 for anything else."""
    codes = F.create_map(*(F.lit(x) for pair in BASE_CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(codes, F.upper(base)), F.lit(0))


def haplotype_code(sample: Column, hp: Column) -> Column:
    out = F.lit(0)
    for s, codes in HAPLOTYPE_CODES.items():
        for h, code in codes.items():
            out = F.when((sample == s) & (hp == h), code).otherwise(out)
    return out


def call_genotype(kind: Column, af: Column) -> Column:
    """0/0 for reference calls; germline: 0/1 up to AF 0.75; somatic: 0/1 below AF 1; else 1/1."""
    return (
        F.when(kind == "reference", "0/0")
        .when(kind == "germline", F.when(af <= 0.75, "0/1").otherwise("1/1"))
        .when(kind == "somatic", F.when(af < 1, "0/1").otherwise("1/1"))
    )


def parse_genotype(gt: Column) -> Column:
    """The two alleles of a genotype, ascending; a dot counts as 0, either separator."""
    parts = F.split(F.regexp_replace(gt, r"\|", "/"), "/")
    return F.array_sort(F.transform(parts, lambda x: F.when(x == ".", 0).otherwise(x.try_cast("int"))))


def parse_region(region: Column) -> Column:
    """struct(ctg, start, end) of ctg:start-end, 1-based and inclusive; the interval is half-open and its last base
    goes. Without positions, both are null."""
    start, end = (F.regexp_extract(region, r"^(.+?)(?::(\d+)-(\d+))?$", k) for k in (2, 3))
    num = lambda s: F.when(s != "", s.cast("long") - 1)
    return F.struct(F.regexp_extract(region, r"^(.+?)(?::(\d+)-(\d+))?$", 1).alias("ctg"), num(start).alias("start"), num(end).alias("end"))


def region_string(ctg: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull() | end.isNull(), ctg).otherwise(F.concat(ctg, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string")))


def contig_rank(ctg: Column) -> Column:
    """The place in karyotype order; other contigs come after, by name."""
    ranks = F.create_map(*(F.lit(x) for i, c in enumerate(KARYOTYPE) for x in (c, i)))
    return F.coalesce(F.try_element_at(ranks, ctg), F.lit(len(KARYOTYPE)))


def alt_bases(code: Column, ref: Column) -> Column:
    """struct(ref, alt) of an allele code: X and a base; I and the inserted string with its anchor, # for the anchor on
    the other strand; D and the deleted string with its anchor."""
    kind, rest = F.substring(code, 1, 1), F.substring(code, F.lit(2), F.length(code))
    inserted = F.when(F.substring(rest, 1, 1) == "#", F.concat(ref, F.substring(rest, F.lit(2), F.length(rest)))).otherwise(rest)
    deleted = F.concat(ref, F.substring(rest, F.lit(2), F.length(rest)))
    return F.struct(
        F.when(kind == "D", deleted).otherwise(ref).alias("ref"),
        F.when(kind == "X", rest).when(kind == "I", inserted).when(kind == "D", ref).alias("alt"),
    )
