"""Columns for qualities, probabilities and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What keeps the odds of certain calls finite, and what is added to the score.
EPSILON, OFFSET = 1e-10, 2.0


def call_quality(p: Column) -> Column:
    """The log-odds score of a probability: 3 places, 0 at least."""
    odds = (1.0 - p + EPSILON) / (p + EPSILON)
    return F.greatest(F.round(F.lit(-10.0) * F.log10(odds) + OFFSET, 3), F.lit(0.0))


def genotype_quality(qual: Column, gq: Column) -> Column:
    """The score as a whole number if it is above 0, else that of the earlier probability."""
    return F.when(qual > 0, F.floor(qual)).otherwise(F.floor(call_quality(gq))).cast("int")


def scaled_base_quality(bq: Column, platform: Column) -> Column:
    """0 to 100: short reads by tens of 40, long reads of 60."""
    short = F.least(F.floor(bq / 10) * 10, F.lit(40)) / 40
    return F.floor(F.when(platform == "ilmn", short).otherwise(F.least(bq, F.lit(60)) / 60) * 100).cast("int")


def mapping_bucket(mq: Column) -> Column:
    return F.when(mq <= 20, 0).when(mq <= 40, 20).otherwise(60)


def softmax(logits: Column) -> Column:
    """Of an array of doubles."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(p: Column) -> Column:
    """The index of the largest value; of equal ones, the last."""
    return F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), i.alias("i"))))["i"]


def filter_value(kind: Column, qual: Column, threshold: float | None) -> Column:
    ok = F.lit(True) if threshold is None else qual >= threshold
    return F.when(kind == "reference", "RefCall").when(kind == "germline", "Germline").when(ok, "PASS").otherwise("LowQual")


def mark_low(filt: Column, qual: Column, threshold: float) -> Column:
    """LowQual up to the threshold, but for germline and reference calls; 0 turns it off."""
    if not threshold:
        return filt
    return F.when((qual <= threshold) & ~filt.isin("Germline", "RefCall"), "LowQual").otherwise(filt)


def mark_normal(filt: Column, qual: Column, naf: Column, most: float) -> Column:
    """struct(filter, qual): a passing call with a normal allele fraction above most is LowQual with quality 0."""
    over = (filt == "PASS") & (naf > most)
    return F.struct(F.when(over, "LowQual").otherwise(filt).alias("filter"), F.when(over, 0.0).otherwise(qual).alias("qual"))


def caller_score(caller: Column, info: Column, fmt: Column, sample: Column) -> Column:
    """The score that other callers write: SomaticEVC, TLOD or SCORE in INFO, SSC in the sample."""
    info_key = lambda k: F.regexp_extract(info, rf"(?:^|;){k}=([-0-9.eE]+)", 1).try_cast("double")
    ssc = F.try_element_at(F.map_from_arrays(F.split(fmt, ":"), F.split(sample, ":")), F.lit("SSC")).try_cast("double")
    return (
        F.when(caller == "strelka2", info_key("SomaticEVC")).when(caller == "mutect2", info_key("TLOD"))
        .when(caller == "varnet", info_key("SCORE")).when(caller == "somaticsniper", ssc)
    )


def expected_fractions(purity: Column, major: Column, minor: Column) -> Column:
    """struct(germline, somatic): expected allele fractions with the major copies; the minor ones if there are none."""
    copies = F.when(major == 0, minor).otherwise(major)
    total = purity * (major + minor) + 2 * (1 - purity)
    return F.struct(((purity * copies + (1 - purity)) / total).alias("germline"), (purity * copies / total).alias("somatic"))


def fold(baf: Column) -> Column:
    return F.least(baf, 1 - baf)
