"""Hand-computed cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from twinlens.functions import alleles as A
from twinlens.functions import quality as Q
from twinlens.functions import text as T
from twinlens.operators.copynumber import binomial_p


def one(spark, column, **values):
    d = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return d.select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [
    ("A+2ACgT$^IC-3NNNa*#", ["A+AC", "g", "T", "C-NNN", "a", "*", "#"]), ("^]aA$", ["a", "A"]), ("A+12ACGTACGTACGTc", ["A+ACGTACGTACGT", "c"]), ("", []), ("^+A", ["A"]),
])
def test_tokens(spark, text, want):
    assert one(spark, T.pileup_tokens(F.col("b")), b=text) == want


def test_scores(spark):
    assert one(spark, Q.call_quality(F.col("p")), p=0.5) == 2.0
    assert one(spark, Q.call_quality(F.col("p")), p=0.9) == pytest.approx(11.542, abs=1e-3)
    assert one(spark, Q.call_quality(F.col("p")), p=0.0) == 0.0
    assert spark.range(1).select(Q.argmax(F.array(F.lit(0.4), F.lit(0.2), F.lit(0.4))).alias("x")).first().x == 2
    p = spark.range(1).select(Q.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("x")).first().x
    assert sum(p) == pytest.approx(1) and p[2] == pytest.approx(math.e**2 / (1 + math.e + math.e**2))
    e = spark.range(1).select(Q.expected_fractions(F.lit(0.5), F.lit(1), F.lit(1)).alias("x")).first().x
    assert (e.germline, e.somatic) == (0.5, 0.25)


def test_alleles(spark):
    d = spark.createDataFrame([("A", "G"), ("A", "AT"), ("AT", "A"), ("AC", "GT"), ("CAT", "GAT")], "ref string, alt string")
    got = [tuple(r) for r in d.select(A.variant_class(F.col("ref"), F.col("alt")), A.allele_key(F.col("ref"), F.col("alt")), A.suffix_trim(F.col("ref"), F.col("alt"))).collect()]
    assert [g[0] for g in got] == ["SNV", "INS", "DEL", None, None]
    assert got[1][1] == "A+T" and got[2][1] == "A-N" and tuple(got[4][2]) == ("C", "G")
    assert [one(spark, A.call_genotype(F.lit("somatic"), F.col("a")), a=x) for x in (0.5, 1.0)] == ["0/1", "1/1"]
    assert one(spark, A.parse_genotype(F.col("g")), g="1|.") == [0, 1]
    assert tuple(one(spark, A.parse_region(F.col("r")), r="chr1:11-20")) == ("chr1", 10, 19)
    assert tuple(one(spark, A.parse_region(F.col("r")), r="chrX")) == ("chrX", None, None)
    assert one(spark, A.to_base(F.col("b")), b="RyN") == "AcA"
    assert tuple(one(spark, A.alt_bases(F.lit("DACG"), F.lit("A")), x=1)) == ("ACG", "A")


def test_formats(spark):
    assert one(spark, T.format_value(F.lit("GT:GQ:DP:AF"), F.lit("0/1:9:30:0.2"), "AF"), x=1) == "0.2"
    assert one(spark, T.format_value(F.lit("GT"), F.lit("0/1"), "AF"), x=1) is None
    assert one(spark, T.info_value(F.lit("A=1;H"), "A"), x=1) == "1"
    assert one(spark, Q.caller_score(F.lit("mutect2"), F.lit("DP=3;TLOD=7.5"), F.lit("GT"), F.lit("0/1")), x=1) == 7.5
    assert one(spark, T.aligned_part(F.col("c")), c="5S8M2I1D10M") == pytest.approx(18 / 20)


def test_binomial(spark):
    def brute(k, n, p):
        probs = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        return min(1.0, sum(x for x in probs if x <= probs[k] * (1 + 1e-7)))

    cases = [(0, 10, 0.5), (3, 20, 0.25), (20, 20, 0.9), (50, 120, 0.35), (0, 0, 0.5)]
    d = spark.createDataFrame(cases, "k int, n int, p double")
    got = [r[0] for r in d.select(binomial_p(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got == pytest.approx([brute(*c) for c in cases], rel=1e-6)
