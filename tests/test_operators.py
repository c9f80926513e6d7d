"""Operators on small literal tables, and properties against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import calls, copynumber, counts, evaluate, examples, haplotype, intervals, kernels, paired, realignment, sampling, sequences, sites
from twinlens.plans import pipelines
from twinlens.sources import readers, writers

OBS = "ctg string, pos long, ref string, sample string, base string, indel string, bq int, mq int, hp int, qname string, flag int"


def reads(pos, ref, sample, bases):
    return [("chr1", pos, ref, sample, b, "", 40, 60, 0, f"{sample}{pos}-{i}", 0) for i, b in enumerate(bases)]


@pytest.mark.parametrize(("bases", "passes"), [("A" * 17 + "T" * 3, True), ("A" * 38 + "T" * 2, False), ("TTTA", False), ("A" * 9 + "t" * 3, True)])
def test_gate(spark, bases, passes):
    d = spark.createDataFrame(reads(1, "A", "tumor", bases), OBS)
    assert counts.candidates(counts.allele_counts(d)).count() == passes


SITES = "ctg string, pos long, ref string, sample string, depth long, snv boolean, indel boolean, top_allele string, top_af double, second_af double, top_indel string, indel_af double"


@pytest.mark.parametrize(("taf", "reads", "depth", "default", "liquid"), [(0.9, 2, 20, True, True), (0.3, 1, 20, True, True), (0.27, 1, 20, False, True), (0.27, 2, 40, False, False), (0.2, 1, 20, False, False)])
def test_paired_liquid(spark, taf, reads, depth, default, liquid):
    t = spark.createDataFrame([("chr1", 1, "A", "tumor", 20, True, False, "T", taf, 0.0, None, None)], SITES)
    n = spark.createDataFrame([("chr1", 1, "A", "normal", "T", reads, depth)], "ctg string, pos long, ref string, sample string, allele string, n long, depth long")
    assert (paired.paired_filter(t, n).count(), paired.paired_filter(t, n, liquid=True).count()) == (default, liquid)


def test_indel_only_candidate(spark):
    """8 of 20 reads with an insertion and no other base: a candidate that stays unless the normal has the insertion."""
    o = [("chr1", 1, "C", s, "C", "+CC" if i < k else "", 40, 60, 0, f"{s}{i}", 0) for s, k in (("tumor", 8), ("normal", 0)) for i in range(20)]
    c = counts.allele_counts(spark.createDataFrame(o, OBS))
    t = counts.candidates(c.filter("sample = 'tumor'"))
    r = paired.paired_filter(t, c).first()
    assert (r.snv, r.indel, r.top_indel, r.indel_af, r.top_allele) == (False, True, "ICCC", 0.4, None)
    more = c.union(spark.createDataFrame([("chr1", 1, "C", "normal", "ICCC", 5, 20)], c.schema))
    assert paired.paired_filter(t, more).count() == 0


def test_deletions_of_one_length_count_together(spark):
    o = [("chr1", 1, "C", "tumor", b, i, 40, 60, 0, f"t{k}", 0) for k, (b, i) in enumerate([("A", "-NN"), ("A", "-NN"), ("C", "-NN")] + [("C", "")] * 7)]
    c = counts.allele_counts(spark.createDataFrame(o, OBS))
    assert {r.allele: (r.n, r.depth) for r in c.collect()} == {"A": (2, 10), "C": (8, 10), "DNN": (3, 10)}
    r = counts.candidates(c).first()
    assert (r.indel, r.top_indel, r.indel_af) == (True, "DNN", 0.3)


def test_nested_equal_ranges(spark):
    d = spark.createDataFrame([("c", 1, 9, 1), ("c", 1, 9, 2), ("c", 2, 3, 3)], "ctg string, start long, end long, id int")
    assert intervals.nested(d).count() == 1
    assert {(r.id, r.rkey) for r in intervals.nested(d, key="id").collect()} == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize(("taf", "naf", "depth", "keep"), [(0.6, 0.1, 20, True), (0.4, 0.1, 20, False), (0.15, 0.04, 25, False), (0.4, 0.25, 4, True)])
def test_paired(spark, taf, naf, depth, keep):
    t = spark.createDataFrame([("chr1", 1, "A", "tumor", 20, True, False, "T", taf, 0.0, None, None)], SITES)
    n = spark.createDataFrame([("chr1", 1, "A", "normal", "T", round(naf * depth), depth)], "ctg string, pos long, ref string, sample string, allele string, n long, depth long")
    assert paired.paired_filter(t, n).count() == keep


def test_best_allele(spark):
    d = spark.createDataFrame([("c", 1, "A", "T", 0.3, 0.1), ("c", 1, "A", "C", 0.25, 0.0)], "ctg string, pos long, ref string, allele string, taf double, naf double")
    r = paired.best_alleles(d).first()
    assert (r.somatic, r.germline) == ("C", "T")


def test_evaluator(spark):
    s = "pos long, ref string, alt string"
    truth, called = spark.createDataFrame([(1, "A", "G"), (2, "C", "T"), (3, "G", "A")], s), spark.createDataFrame([(1, "A", "G"), (2, "C", "A"), (4, "T", "C")], s)
    r = evaluate.metrics(evaluate.classify(truth, called, ["pos"])).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (1, 2, 2, 0.3333, 0.3333, 0.3333)
    assert evaluate.metrics(evaluate.classify(truth.limit(0), called.limit(0), ["pos"])).count() == 0


def test_range_joins_against_nested_loops(spark):
    r = random.Random(3)
    a = [("c", x := r.randrange(300), x + r.randrange(40)) for _ in range(80)]
    b = [("c", x := r.randrange(300), x + r.randrange(90)) for _ in range(60)]
    left, right = spark.createDataFrame(a, "ctg string, start long, end long"), spark.createDataFrame(b, "ctg string, rstart long, rend long")
    got = sorted(tuple(x) for x in intervals.range_join(left, right, 16).select("start", "end", "rstart", "rend").collect())
    assert got == sorted((s, e, u, v) for _, s, e in a for _, u, v in b if s < e and u < v and s < v and u < e)
    points = spark.createDataFrame([("c", p) for p in (10, 11, 20, 21)], "ctg string, pos long")
    one = spark.createDataFrame([("c", 10, 20)], "ctg string, rstart long, rend long")
    assert sorted(x.pos for x in intervals.points_inside(points, one, ["ctg", "pos"]).collect()) == [11, 20]


def test_interval_algebra(spark):
    d = spark.createDataFrame([("c", 1, 5), ("c", 4, 8), ("c", 10, 12)], "ctg string, start long, end long")
    pairs = lambda x: sorted((r.start, r.end) for r in x.collect())
    assert pairs(intervals.merge_overlaps(d)) == [(1, 8), (10, 12)]
    assert pairs(intervals.split_overlaps(d, 4)) == [(1, 4), (4, 5), (5, 8), (10, 12)]
    assert pairs(intervals.chop(d, 2, 11)) == [(1, 2), (11, 12)]
    assert pairs(intervals.slice_at(d, 2)) == [(1, 2), (2, 5), (4, 8), (10, 12)]
    assert pairs(intervals.at(d, 4)) == [(1, 5), (4, 8)] and pairs(intervals.overlap(d, 5, 5)) == []
    assert pairs(intervals.envelop(d, 0, 9)) == [(1, 5), (4, 8)]


def test_runs(spark):
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 0, 1, 1, 1, 0])], "k int, i int, v int")
    assert [r.length for r in sequences.runs(d, ["k"], "i", "v").orderBy("run").collect()] == [2, 3, 1]
    assert sequences.runs(d.limit(0), ["k"], "i", "v").count() == 0


def test_window_of_gaps_is_zero(spark):
    v = spark.createDataFrame([("c", 5, [1, 2]), ("c", 7, [3, 4])], "ctg string, pos long, channels array<long>")
    got = sequences.feature_window(v.filter("pos = 5"), v, 2, 2).first().features
    assert got == [0, 0, 0, 0, 1, 2, 0, 0, 3, 4]


def test_winsorised_outlier(spark):
    d = spark.createDataFrame([(1, i, 100.0 if i == 30 else float(i % 3)) for i in range(60)], "k int, i int, v double")
    assert sequences.winsorise(d, ["k"], "i", "v").agg(F.max("winsorised")).first()[0] < 10


def test_segments_and_ratios(spark):
    g = np.random.default_rng(4)
    x = np.concatenate([g.normal(0, 0.05, 80), g.normal(1, 0.05, 60)])
    baf = np.full(140, 0.4) + g.normal(0, 0.01, 140)
    assert copynumber.segment(x, baf, (0.05, 0.01), 20.0).tolist() == [0, 80]
    rows = [("c", int(i), float(v), float(w)) for i, (v, w) in enumerate(zip(x, baf, strict=True))]
    got = copynumber.segments(spark.createDataFrame(rows, "ctg string, pos long, logr double, baf double"), 60.0, width=50, margin=10).orderBy("start").collect()
    assert [(r.start, r.n) for r in got] == [(0, 80), (80, 60)]
    t = spark.createDataFrame([("c", 1, 20, 0), ("c", 2, 0, 0)], "ctg string, pos long, a long, b long")
    assert copynumber.depth_ratios(t).first().logr == 0.0


def brute_segments(x, y, scales, penalty, least):
    """All starts for each end, without dropping any."""
    best, back = {0: -penalty}, {}
    cost = lambda a, b: sum(((t[a:b] - t[a:b].mean()) ** 2).sum() / s**2 for t, s in ((x, scales[0]), (y, scales[1])))
    for end in range(least, len(x) + 1):
        best[end], back[end] = min((best[s] + cost(s, end) + penalty, s) for s in range(end - least + 1) if s in best)
    cuts, at = [], len(x)
    while at:
        at = back[at]
        cuts.append(at)
    return cuts[::-1]


@pytest.mark.parametrize("penalty", [3.0, 12.0, 60.0])
def test_dropped_starts_are_never_best(penalty):
    g = np.random.default_rng(int(penalty))
    for least in (1, 2, 6):
        x, y = np.repeat(g.normal(0, 2, 12), 9) + g.normal(0, 0.5, 108), np.repeat(g.normal(0, 1, 9), 12) + g.normal(0, 0.5, 108)
        assert copynumber.segment(x, y, (0.5, 0.6), penalty, least).tolist() == brute_segments(x, y, (0.5, 0.6), penalty, least)


def test_windows_agree_with_one_search(spark):
    """Cuts near window borders, in a last window that begins early, and none that only a window's end suggests."""
    g = np.random.default_rng(12)
    for n in (330, 415, 620):
        level = np.concatenate([np.full(37, v) for v in g.permutation(n // 37 + 1)])[:n].astype(float)
        x, y = level + g.normal(0, 0.05, n), 0.4 + g.normal(0, 0.01, n)
        d = spark.createDataFrame([("c", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "ctg string, pos long, logr double, baf double")
        want = [k for k in range(n) if k == 0 or level[k] != level[k - 1]]
        assert [r.start for r in copynumber.segments(d, 70.0, width=200, margin=30).orderBy("start").collect()] == want


def test_running_medians_of_blocks(spark):
    g = np.random.default_rng(13)
    rows = [(k, i, float(v)) for k, n in (("a", 400), ("b", 51), ("c", 30), ("d", 1), (None, 263)) for i, v in enumerate(g.normal(0, 1, n))]
    got = sequences.winsorise(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v", block=60).collect()
    assert len(got) == len(rows)
    for k in ("a", "b", "c", "d", None):
        x = np.array([v for q, _, v in rows if q == k])
        half = min(25, (len(x) - 1) // 2)
        m = np.array([np.median(np.pad(x, half, mode="symmetric")[i : i + 2 * half + 1]) for i in range(len(x))])
        z = 2.5 * np.median(np.abs(x - m - np.median(x - m)))
        want = m + np.clip(x - m, -z, z)
        assert np.allclose([r.winsorised for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)], want)


@pytest.mark.parametrize("block", [50, 80, 1000])
def test_segments_by_the_second_track(spark, block):
    g = np.random.default_rng(8)
    logr, baf = g.normal(0, 0.05, 200), np.concatenate([g.normal(0.42, 0.01, 80), g.normal(0.1, 0.01, 120)])
    rows = [(c, 10 * i, float(x), float(y)) for c in ("a", "b") for i, (x, y) in enumerate(zip(logr, baf if c == "a" else np.full(200, 0.4) + g.normal(0, 0.01, 200), strict=True))]
    got = copynumber.segments(spark.createDataFrame(rows, "ctg string, pos long, logr double, baf double"), 70.0, width=block, margin=block // 5).orderBy("ctg", "start").collect()
    assert [(r.ctg, r.start, r.end, r.n) for r in got] == [("a", 0, 790, 80), ("a", 800, 1990, 120), ("b", 0, 1990, 200)]


def test_segments_by_both_tracks_together(spark):
    step, noise = np.repeat([0.0, 1.0], 40), np.tile([1.0, -1.0], 40)

    def sizes(x, y):
        rows = [("c", i, float(a), float(b)) for i, (a, b) in enumerate(zip(0.1 * noise + x * step, 0.2 + 0.01 * noise + y * step, strict=True))]
        return [r.n for r in copynumber.segments(spark.createDataFrame(rows, "ctg string, pos long, logr double, baf double"), 200.0).collect()]

    assert sizes(0.27, 0.0) == [80] and sizes(0.0, 0.027) == [80] and sizes(0.27, 0.027) == [40, 40]


def test_places_are_numbered_by_contig(spark):
    rows = [(c, int(p)) for c in "ab" for p in np.random.default_rng(10).permutation(500)]
    got = copynumber.numbered(spark.createDataFrame(rows, "ctg string, pos long")).collect()
    assert len(got) == 1000 and all(r["index"] == r.pos for r in got)


def test_spline_residuals_remove_a_trend(spark):
    g = np.random.default_rng(5)
    rows = [(float(x), float(np.sin(x) + e)) for x, e in zip(g.uniform(0, 3, 400), g.normal(0, 0.01, 400), strict=True)]
    got = copynumber.spline_residuals(spark.createDataFrame(rows, "x double, y double"), "y", ["x"]).agg(F.stddev("corrected")).first()[0]
    assert got < 0.02


def test_sampling(spark):
    d = spark.range(20_000)
    few, more = (sampling.sample_part(d, "id", p) for p in (0.1, 0.3))
    assert abs(few.count() - 2000) < 300 and few.join(more, "id", "left_anti").count() == 0
    labelled = d.withColumn("l", F.when(F.col("id") % 10 == 0, "s").otherwise("r"))
    assert dict((r.l, r["count"]) for r in sampling.cap_ratio(labelled, "l", "s", {"r": 2.0}, "id").groupBy("l").count().collect()) == {"s": 2000, "r": 4000}
    assert sampling.mixture_coverage(60, 40, 0.5) == 80 and sampling.contamination_parts(80, 40, 0.5, 40) == (0.25, 0.5)


def test_merge_precedence(spark):
    s = "ctg string, pos long, ref string, alt string, qual double, filter string, naf double"
    a = spark.createDataFrame([("c", p, "A", "T", 0.9, f, 0.0) for p, f in ((1, "PASS"), (2, "PASS"), (3, "Germline"), (4, "LowQual"))], s)
    b = spark.createDataFrame([("c", p, "A", "C", 0.7, f, 0.0) for p, f in ((1, "PASS"), (2, "LowQual"), (5, "PASS"))], s)
    got = {r.pos: r for r in calls.merge_calls(a, b).collect()}
    assert got[1].alt == "T" and got[2].alt == "C" and got[2].qual == 0 and got[3].qual > 0 and got[4].qual == 0 and got[5].qual == 0
    assert got[1].qual == pytest.approx(8.021, abs=1e-3)
    assert calls.merge_calls(a, b, keep_confident=True).filter("pos = 2").first().alt == "T"


def test_haplotype_rules(spark):
    rows = [("c", 1, f"r{i}", i < 6, 10 if i < 6 else 30, 1 if i < 6 else 2, False) for i in range(12)]
    d = spark.createDataFrame(rows, "ctg string, pos long, qname string, is_alt boolean, bq int, hp int, edge boolean")
    c = spark.createDataFrame([("c", 1, 0.5, 0.5)], "ctg string, pos long, af double, qual double")
    base = haplotype.base_rules(c, d)
    assert base.first().fail_bq and base.first().hap == 1
    near = spark.createDataFrame([("c", 1, 9, True, 0.5, f"x{i}", 1, True, True) for i in range(3)], "ctg string, pos long, opos long, het boolean, af double, qname string, hp int, carries boolean, cover boolean")
    assert haplotype.neighbour_rules(base, d, near).first().fail_het
    r = haplotype.judge(base, haplotype.neighbour_rules(base, d, near)).first()
    assert (r.qual, r["filter"], r.phased) == (0.0, "LowQual", True)
    gone = spark.createDataFrame([("c", 1, 12, 1)], "ctg string, pos long, depth long, alt long")
    was = spark.createDataFrame([("c", 1, 0.5, 12, 6)], "ctg string, pos long, qual double, depth long, alt long")
    assert haplotype.realigned(was, gone).first()["filter"] == "LowQual"


READS = "window long, qname string, seq string, quals array<int>, rank int, pos long, cigar string"


def test_realignment(spark):
    """A base and a gap that reads share are found, reads beyond the bounds stay as they are, and none is lost."""
    ref = "ACGTTGCAAGGCTTAACCGGATCTTAGACCATGCAACTGATTCAGGCATACCTGAGATTACAGCGTATCGGCATTA"
    alt, gap = ref[:30] + "T" + ref[31:], ref[:44] + ref[49:]
    rows = [(1, f"r{i}", (alt, gap, ref)[i % 3], i, 100, "70M") for i in range(9)] + [(1, "late", alt, 50, 7, "3M"), (9, "none", alt, 1, 8, "4M"), (2, "wide", alt, 1, 9, "5M")]
    rows = [(w, q, x, [40] * len(x), *more) for w, q, x, *more in rows]
    w = spark.createDataFrame([(1, 100, ref), (2, 5, ref * 9)], "window long, start long, ref string")
    got = {r.qname: (r.haplotype, r.pos, r.cigar) for r in realignment.realign(spark.createDataFrame(rows, READS), w, most_reads=40, most_bases=400).collect()}
    assert len(got) == len(rows) and [got[k] for k in ("late", "none", "wide")] == [(None, 7, "3M"), (None, 8, "4M"), (None, 9, "5M")]
    assert got["r0"] == (alt, 100, f"{len(ref)}M") and got["r2"] == (ref, 100, f"{len(ref)}M")
    assert got["r1"][0] == gap and got["r1"][1] == 100 and sorted(re.findall(r"\d+D", got["r1"][2])) == ["5D"]
    assert realignment.align(["ACGTTTACGA"], "GGACGTACGACC")[0][2] == "3M2I5M"


def slow_score(q, t):
    h, e, best = [0] * (len(t) + 1), [-(10**9)] * (len(t) + 1), 0
    for x in q:
        f, diagonal = -(10**9), 0
        for j, y in enumerate(t, 1):
            above, left = h[j], h[j - 1]
            e[j], f = max(above - 8, e[j] - 2), max(left - 8, f - 2)
            h[j], diagonal = max(0, diagonal + (4 if x == y else -6), e[j], f), above
            best = max(best, h[j])
    return best


def walked(q, t, at, cigar):
    """The score of a CIGAR, base by base."""
    i, score = 0, 0
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)(.)", cigar)):
        if op == "M":
            score += sum(4 if a == b else -6 for a, b in zip(q[i : i + n], t[at : at + n], strict=True))
        score -= 8 + 2 * (n - 1) if op in "ID" else 0
        i, at = i + n * (op != "D"), at + n * (op in "MD")
    assert i == len(q)
    return score


def mutated(r, t):
    q = list(t)
    for _ in range(r.randint(0, 4)):
        k, x = r.randrange(len(q)), r.random()
        if x < 0.4:
            q[k] = r.choice("ACGTN")
        elif x < 0.7:
            q[k:k] = [r.choice("ACGT") for _ in range(r.randint(1, 4))]
        elif len(q) > 5:
            del q[k : k + 3]
    return "".join(q)


def test_alignment_against_all_cells():
    r = random.Random(1)
    for _ in range(40):
        t = "".join(r.choice("ACGT") for _ in range(r.randint(2, 80)))
        queries = [mutated(r, t[a : a + r.randint(1, 60)]) for a in (r.randrange(len(t)) for _ in range(7))]
        for q, (score, at, cigar) in zip(queries, realignment.align(queries, t), strict=True):
            assert score == slow_score(q, t) == walked(q, t, at, cigar)


def slow_places(hap, reads_, bare):
    """Every k-mer of the haplotype in order, every read that has it."""
    best = {}
    cover = [0] * len(hap)
    for i in range(len(hap) - 31):
        for k, q in enumerate(reads_):
            for p in [p for p in range(len(q) - 31) if len(q) > 32 and q[p : p + 32] == hap[i : i + 32]]:
                start = max(0, i - p)
                if start + len(q) > len(hap):
                    continue
                off = sum(a != b and "N" not in (a, b) for a, b in zip(q, hap[start:], strict=False))
                if off <= 2:
                    for x in range(start, start + len(q)):
                        cover[x] += 1
                    best.setdefault(k, set()).add((4 * (len(q) - off) - 6 * off, -start))
        if bare and bare[0] <= i < len(hap) - bare[1] and not cover[i]:
            return {}
    return {k: max(v) for k, v in best.items()}


@pytest.mark.parametrize("bare", [None, (0, 0), (30, 25)])
def test_places_against_all_k_mers(bare):
    r = random.Random(4)
    full = 0
    for _ in range(40):
        hap = "".join(r.choice("ACGT") for _ in range(90)) + "ACG" * r.choice([0, 20])
        queries = [mutated(r, hap[a : a + r.randint(20, 80)]) for a in (r.randrange(60) for _ in range(9))] + [hap[:50], hap[20:], "", "ACGT"]
        score, place = realignment.places(hap, queries, realignment._mers([q if len(q) > 32 else "" for q in queries], 32), bare)
        want = slow_places(hap, queries, bare)
        assert {k: (int(score[k]), -int(place[k])) for k in range(len(queries)) if score[k] > 0} == {k: v for k, v in want.items() if v[0] > 0}
        full += bool(want)
    assert full > 5


def test_projection_keeps_bases_in_place():
    r = random.Random(7)
    for _ in range(200):
        ref = "".join(r.choice("ACGT") for _ in range(70))
        hap = mutated(r, ref[r.randrange(9) : 70 - r.randrange(9)])
        read = mutated(r, hap[r.randrange(20) : len(hap) - r.randrange(20)])
        (_, a, first), (_, b, second) = realignment.align([read], hap)[0], realignment.align([hap], ref)[0]
        found = realignment.project(first, a, second, b)
        own = {}  # the reference place of each read base, by two walks
        for x, y in pairs_of(first, a):
            own[x] = dict(pairs_of(second, b)).get(y)
        want = [(x, y) for x, y in own.items() if y is not None]
        if not want:
            assert found is None
            continue
        assert pairs_of(found[1], found[0]) == want and found[0] == want[0][1]
        assert sum(int(n) for n, op in re.findall(r"(\d+)(.)", found[1]) if op != "D") == len(read)
    assert realignment.project("10M", 2, "5M3I9M", 40) == (42, "3M3I4M") and realignment.project("4M3D4M", 1, "5M3I9M", 0) == (1, "8M")
    assert realignment.project("10M", 2, "5M4D9M", 40) == (42, "3M4D7M")
    assert realignment.project("2S3M", 5, "5M3I9M", 0) is None and realignment.project("2S5M", 5, "5M3I9M", 0) == (5, "5S2M")


def pairs_of(cigar, at):
    i, out = 0, []
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)(.)", cigar)):
        out += [(i + k, at + k) for k in range(n)] if op == "M" else []
        i, at = i + n * (op != "D"), at + n * (op in "MD")
    return out


def test_planted_variant_end_to_end(spark):
    rows = []
    for pos in range(100, 160):
        ref = "ACGT"[pos % 4]
        rows += reads(pos, ref, "normal", ref * 20) + reads(pos, ref, "tumor", (ref * 10 + "ACGT"[(pos + 1) % 4] * 10) if pos == 130 else ref * 20)
    d = spark.createDataFrame(rows, OBS)
    model = lambda x: np.tile([0.1, 0.1, 0.8], (len(x), 1))
    got = pipelines.call_pair(d.filter("sample = 'tumor'"), d.filter("sample = 'normal'"), model).collect()
    assert [(r.pos, r.ref, r.alt, r.gt, r.af, r["filter"]) for r in got] == [(130, "G", "T", "0/1", 0.5, "PASS")]
    truth = spark.createDataFrame([("chr1", 130, "G", "T")], "ctg string, pos long, ref string, alt string")
    assert pipelines.evaluate_calls(truth, spark.createDataFrame(got)).first().f1 == 1.0


def test_copy_number_tags(spark):
    g = np.random.default_rng(6)
    pairs = [("chr1", i, int(g.poisson(40)), int(g.poisson(20 if i > 200 else 40))) for i in range(400)]
    t = spark.createDataFrame(pairs, "ctg string, pos long, a long, b long")
    n = t.select("ctg", "pos", F.lit(20).cast("long").alias("a"), F.lit(20).cast("long").alias("b"))
    c = spark.createDataFrame([("chr1", 50, 20, 40), ("chr1", 300, 5, 60), ("chr1", 300, 5, 60), ("chr2", 7, 1, 9)], "ctg string, pos long, alt int, depth int")
    got = pipelines.tag_by_copies(c, t, n)
    found = [(r.ctg, r.pos, r.verdict is None) for r in got.orderBy("ctg", "pos").collect()]
    assert found == [("chr1", 50, False), ("chr1", 300, False), ("chr1", 300, False), ("chr2", 7, True)]


def made_segments(rho, psi, states):
    """(ctg, n, logr, baf) of segments (n, major, minor) at a purity and ploidy."""
    total = 2 * (1 - rho) + rho * psi
    rows = []
    for i, (n, major, minor) in enumerate(states):
        own = 2 * (1 - rho) + rho * (major + minor)
        rows.append((f"c{i}", n, float(np.log2(own / total)), float((1 - rho + rho * minor) / own)))
    return rows


def brute_purity(rows, shift=(0.01, 0.05), lowest=1.5, highest=5.5):
    """The four stages over the whole grid, by loops."""
    n, r, f = (np.array(x, float) for x in list(zip(*rows, strict=True))[1:])
    w = n * np.where(f == 0.5, 0.05, 1.0)
    loose = np.where(f == 0.5, 0.0, n)

    def both(p, q):
        t = 2.0**r * (2 * (1 - p) + p * q)
        return (p - 1 - (f - 1) * t) / p, (p - 1 + f * t) / p

    cells, info = {}, {}
    for i, p in enumerate(copynumber.RHOS):
        for j, q in enumerate(copynumber.PSIS):
            x, y = both(p, q)
            low = x if x.sum() < y.sum() else y
            cells[i, j] = ((low - np.maximum(np.round(low), 0)) ** 2 * w).sum()
            x, y = both(p + shift[0], q + shift[1])
            none = (np.round(x) == 0).astype(int) + (np.round(y) == 0)
            odd = np.round(x) % 2 != np.round(y) % 2
            info[i, j] = ((x + y) @ n / n.sum(), (1 - cells[i, j] / (0.25 * w).sum()) * 100, none @ n / n.sum(), none @ loose / loose.sum() if loose.sum() else 0.0, odd @ n / n.sum())
    aberrant = loose.sum() > 0.03 * n.sum() or loose.max() > 0.005 * n.sum()
    big_i, big_j = len(copynumber.RHOS), len(copynumber.PSIS)
    for stage in (1, 2, 3, 4):
        d = {c: 1e20 if stage > 2 and copynumber.RHOS[c[0]] + shift[0] > 1.000001 else v for c, v in cells.items()}
        found = []
        for (i, j), m in d.items():
            if not (3 <= i < big_i - 3 and 3 <= j < big_j - 3) or any(d[a, b] <= m for a in range(i - 3, i + 4) for b in range(j - 3, j + 4) if (a, b) != (i, j)):
                continue
            ploidy, good, zero, zero_loose, uneven = info[i, j]
            if good <= 60 or copynumber.RHOS[i] + shift[0] < 0.2:
                continue
            wide, narrow = aberrant and lowest < ploidy < highest, 1.7 < ploidy < 2.3
            if [wide and zero > 0.02, narrow and zero_loose > 0.1, wide and (zero_loose > 0.1 or zero > 0.02 or uneven > 0.05), narrow][stage - 1]:
                found.append((m, i, j))
        if found:
            m, i, j = min(found)
            return round(min(1.0, copynumber.RHOS[i] + shift[0]), 6), round(copynumber.PSIS[j] + shift[1], 6), stage, m
    return None


PURITIES = [
    (0.5, 2.5, [(300, 1, 1), (200, 1, 0), (400, 2, 1), (300, 3, 1), (150, 2, 0)]), (0.8, 2.0, [(900, 1, 1), (60, 2, 1), (40, 1, 0)]),
    (0.6, 3.1, [(300, 2, 2), (300, 3, 2), (300, 2, 1)]), (0.7, 2.0, [(5000, 1, 1)]), (0.98, 2.2, [(500, 1, 1), (200, 2, 1), (9, 1, 0)]),
]


@pytest.mark.parametrize(("rho", "psi", "states"), PURITIES)
def test_purity_stages(spark, rho, psi, states):
    rows = made_segments(rho, psi, states)
    got = pipelines.fit_purity(spark.createDataFrame(rows, "ctg string, n long, logr double, baf double")).first()
    want = brute_purity(rows)
    assert (got is None) == (want is None)
    if got:
        assert (got.rho, got.psi, got.stage) == want[:3] and got.distance == pytest.approx(want[3], abs=1e-9)


def test_purity_of_a_known_sample(spark):
    rows = made_segments(*PURITIES[0])
    got = copynumber.best_purity(copynumber.purity_grid(spark.createDataFrame(rows, "ctg string, n long, logr double, baf double"), copynumber.RHOS, copynumber.PSIS)).first()
    assert (got.rho, got.psi, got.stage) == (0.5, 2.5, 1) and got.ploidy == pytest.approx(sum(n * (a + b) for n, a, b in PURITIES[0][2]) / sum(n for n, *_ in PURITIES[0][2]))


def test_whole_copies(spark):
    d = spark.createDataFrame([("a", 0.0, 0.5), ("b", -3.0, 0.2), ("c", 0.58, 0.5), ("d", 0.3, 0.4)], "ctg string, logr double, baf double")
    rho, psi = 0.8, 2.0
    for r in copynumber.whole_copies(d, rho, psi).collect():
        t = 2**r.logr * (2 * (1 - rho) + rho * psi)
        x, y = (rho - 1 - (r.baf - 1) * t) / rho, (rho - 1 + r.baf * t) / rho
        x, y = (0, 0) if x + y < 0 else (0, x + y) if x < 0 else (x + y, 0) if y < 0 else (x, y)
        a, b = round(x), round(y)
        if r.baf == 0.5:
            a, b = a + (x + y > a + b + 0.5), b - (x + y < a + b - 0.5)
        assert (r.major, r.minor) == (max(a, b), min(a, b))


def test_calls_round_trip(spark, tmp_path):
    s = "ctg string, pos long, ref string, alt string, qual double, filter string, gt string, dp long, af double, naf double"
    d = spark.createDataFrame([("chr2", 5, "A", "T", 9.5, "PASS", "0/1", 30, 0.4, 0.0), ("chr10", 1, "C", "G", 3.0, "LowQual", "0/1", 10, 0.2, 0.1), ("chr1", 7, "G", ".", 1.0, "RefCall", "0/0", 9, 0.0, 0.0)], s)
    path = str(tmp_path / "calls.vcf")
    writers.write_vcf(d, path, {"GT": "gt", "DP": "dp", "AF": "af", "NAF": "naf"}, [("chr1", 100)])
    back = readers.vcf(spark, path)
    assert sorted((r.ctg, r.pos, r.alt, r.af) for r in back.collect()) == [("chr10", 1, "G", 0.2), ("chr2", 5, "T", 0.4)]
    assert [r.pos for r in readers.vcf(spark, path, filters=["PASS"], min_qual=5.0, max_naf=0.05).collect()] == [5]
    lines = [r.value for r in writers.vcf_lines(d, {"GT": "gt"}).collect()]
    assert [x.split("\t")[0] for x in lines] == ["chr2", "chr10"]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t5\t5\nchr1 10 20 t\n")
    got = [(r.start, r.end, r.tag) for r in readers.bed(spark, str(tmp_path / "a.bed")).orderBy("start").collect()]
    assert got == [(5, 6, None), (10, 20, "t")]
    (tmp_path / "a.fa").write_text(">chr1 x\nacgtacgt\nAC\n>chr2\nGG\n")
    ref = readers.fasta(spark, str(tmp_path / "a.fa"), 4)
    sites = spark.createDataFrame([("chr1", 6), ("chr1", 10), ("chr2", 9)], "ctg string, pos long")
    assert [r.ref for r in readers.bases_at(sites, ref, 4).orderBy("ctg", "pos").collect()] == ["C", "C", None]
    (tmp_path / "a.fai").write_text("chr1\t10\t6\t8\t9\n")
    assert [(r.start, r.end) for r in readers.chunks(readers.contigs(spark, str(tmp_path / "a.fai")), 6).orderBy("chunk").collect()] == [(0, 6), (6, 10)]
    (tmp_path / "a.pileup").write_text("chr1\t7\tN\t3\tA+2ACg*\tIII\nchr1\t8\tN\t2\tAC\tI\n")
    got = [(r.base, r.indel, r.bq) for r in readers.pileup(spark, str(tmp_path / "a.pileup"), "tumor").collect()]
    assert got == [("A", "+AC", 40), ("g", "", 40), ("*", "", 40)]


def test_reads_to_observations(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\nr1\t0\tchr1\t10\t60\t2M1I2M1D1M\t*\t0\t0\tACGTAC\tIIIIII\tHP:i:1\nr2\t4\tchr1\t10\t60\t3M\t*\t0\t0\tAAA\tIII\n")
    d = readers.sam(spark, str(tmp_path / "a.sam"))
    got = [(r.pos, r.base, r.indel, r.hp) for r in readers.observations(d, "tumor").orderBy("pos").collect()]
    assert got == [(10, "A", "", 1), (11, "C", "+G", 1), (12, "T", "", 1), (13, "A", "-N", 1), (14, "*", "", 1), (15, "C", "", 1)]
    assert readers.mapped_contigs(d).first().n == 1


def test_read_rows(spark):
    r = [("c", 1, f"q{k}", k % 7, k % 3) for k in range(30)]
    d = spark.createDataFrame([*r, *r], "ctg string, pos long, qname string, start int, hp int")
    got = examples.read_rows(d, 12).orderBy("row").collect()
    assert [x.row for x in got] == list(range(12)) and [(x.hp, x.start, x.qname) for x in got] == sorted((x.hp, x.start, x.qname) for x in got)
    assert {x.qname for x in got} == {x.qname for x in examples.read_rows(d.repartition(5), 12).collect()}
    assert examples.read_rows(d, 99).count() == 30


def test_given_sites_bypass_the_filter(spark):
    at = lambda *p: spark.createDataFrame([("c", k) for k in p], "ctg string, pos long")
    marked = sites.with_given(at(1, 2, 3), at(3, 4, 5))
    depth = spark.createDataFrame([("c", 4, 9), ("c", 3, 2), ("c", 1, 5)], "ctg string, pos long, depth int")
    assert sorted((r.pos, r.found, r.hybrid) for r in sites.keep_given(marked, at(1), depth).collect()) == [(1, True, False), (3, True, True), (4, False, True)]


def test_indel_cap(spark):
    d = spark.createDataFrame([("+" + "A" * n,) for n in (60, 61)] + [("-" + "N" * n,) for n in (59, 60)] + [("",)], "indel string")
    assert sorted(len(r.indel) for r in sites.capped_indels(d).collect()) == [0, 60, 61]


def test_jitter(spark):
    d = spark.range(2000).select(examples.jittered(F.array(F.lit(50), F.lit(1), F.lit(90)), F.col("id")).alias("q")).collect()
    x = np.array([r.q[0] for r in d])
    assert abs(x.mean() - 50) < 0.5 and 4.5 < x.std() < 5.5 and all(1 <= v <= 90 for r in d for v in r.q)


def test_beta_takes_the_last_entry_below(spark):
    d = spark.createDataFrame([(u,) for u in (0.0, 0.002, 0.00288, 0.05, 0.5, 0.9999)], "u double")
    assert [r[0] for r in d.select(sampling.beta_fraction(F.col("u"))).collect()] == [0.0, 0.0, 0.01, 0.05, 0.25, 0.98]


def test_indel_transitions(spark):
    s = "ctg string, pos long, ref string, alt string, dp int, af double, alts int"
    n = [("c", p, "A", "AT", 20, 0.5, 1) for p in range(8)] + [("c", 8, "A", "AT", 14, 0.5, 1), ("c", 9, "A", "AT", 20, 0.7, 1), ("c", 10, "A", "AT", 20, 0.5, 2), ("c", 11, "A", "AT", 15, 0.4, 1)]
    t = [("c", 1, "A", "AT", 20, 0.0, 1), ("c", 2, "A", "AT", 20, 0.8, 1), ("c", 3, "A", "AG", 20, 0.5, 1), ("c", 4, "A", "AT", 14, 0.5, 1), ("c", 5, "A", "AT", 20, 0.9, 2), ("c", 6, "A", "AT", 20, 0.89, 2), ("c", 7, "AT", "A", 20, 1.0, 2)]
    got = {r.pos: r.transition for r in paired.indel_transitions(spark.createDataFrame(n, s), spark.createDataFrame(t, s)).collect()}
    assert got == {0: "lost", 1: "kept", 2: "kept", 3: None, 4: None, 5: "fixed", 6: None, 7: None, 11: "lost"}


def test_two_truths_at_a_site(spark):
    truth = spark.createDataFrame([("chr1", 5, "A", "C"), ("chr1", 5, "A", "G")], "ctg string, pos long, ref string, alt string")
    obs = spark.createDataFrame(reads(5, "A", "normal", "AAAAAC") + reads(5, "A", "tumor", "ACGG"), OBS)
    none = spark.createDataFrame([], "ctg string, pos long, depth long, af double, normal_depth long, normal_af double")
    got = {r.alt: (r.ndp, r.tdp, r.nalt, r.talt) for r in sites.allele_support(truth, none, obs).collect()}
    assert got == {"C": (6, 4, 1, 1), "G": (6, 4, 0, 2)}


def test_germline_window_is_open_at_its_start(spark):
    p = spark.createDataFrame([("c", 500)], "ctg string, pos long")
    o = spark.createDataFrame([("c", x) for x in (400, 401, 500, 600, 601)], "ctg string, opos long")
    assert sorted(r.opos for r in intervals.neighbours(p, o, 100).collect()) == [401, 600]


def test_long_insertions_around_a_call(spark):
    calls_ = spark.createDataFrame([("c", 1, 0.5), ("c", 2, 0.95), ("c", 3, 0.5), ("c", 4, 0.5)], "ctg string, pos long, qual double")
    own = spark.createDataFrame([("c", p, f"r{k}") for p in (1, 2, 3, 4) for k in range(2)], "ctg string, pos long, qname string")
    seen = [(1, "+" + "A" * 13), (2, "+" + "A" * 13), (3, "+" + "A" * 12), (4, "+AA"), (4, "-" + "N" * 40), (4, "")]
    around = spark.createDataFrame([("c", p, p + 9, i) for p, i in seen], "ctg string, pos long, opos long, indel string")
    got = {r.pos: r.fail_insertions for r in haplotype.long_insertions(calls_, own, around).collect()}
    assert got == {1: True, 2: False, 3: False}
    wide = spark.createDataFrame([("c", 1, 9, "+" + "A" * 5000)], "ctg string, pos long, opos long, indel string")
    many = spark.createDataFrame([("c", 1, f"r{k}") for k in range(34)], "ctg string, pos long, qname string")
    assert not haplotype.long_insertions(calls_, many, wide).first().fail_insertions  # 200 bases count, of 34 reads


def test_rows_with_null_keys_stay(spark):
    d = spark.createDataFrame([("a", 1), ("a", None), (None, 2), ("b", 3), ("b", None)], "label string, k long")
    assert sorted(map(tuple, sampling.cap_ratio(d, "label", "a", {"b": 1.0}, "k").collect()), key=str) == sorted([("a", 1), ("a", None), (None, 2), ("b", 3), ("b", None)], key=str)
    assert sampling.cap_ratio(d, "label", "a", {"b": 0.5}, "k").filter("label = 'b'").collect() == [("b", 3)]
    x = spark.createDataFrame([(t, i, float(i), i > 2) for t in ("t", None) for i in range(10)], "t string, i int, v double, f boolean")
    assert sorted((r.t or "", r.i) for r in sequences.percentile_cut(x, ["t"], "v", 0.65).collect()) == sorted((t, i) for t in ("t", "") for i in (7, 8, 9))
    assert {(r.t, r.length) for r in sequences.homozygous_stretches(x, ["t"], "i", "f", 0.5).collect()} == {("t", 7), (None, 7)}


def test_copy_numbers_from_base_counts(spark):
    """A sample of purity 0.8 in which one contig has lost an allele: from counts of four bases to verdicts."""
    g = np.random.default_rng(15)
    rho = 0.8
    rows, table_ = [], []
    for ctg, (a, b), n in (("chr1", (1, 1), 900), ("chr2", (1, 0), 700), ("chr3", (2, 1), 500)):
        for i in range(n):
            first, second = g.choice([1, 2, 3, 4], 2, replace=False).tolist()
            share = (1 - rho + rho * (a if i % 2 else b)) / (2 * (1 - rho) + rho * (a + b))
            t, u = [0] * 4, [0] * 4
            depth = g.poisson(100 * (2 * (1 - rho) + rho * (a + b)) / 2)
            t[first - 1] = g.binomial(depth, share)
            t[second - 1] = depth - t[first - 1]
            u[first - 1], u[second - 1] = g.binomial(50, 0.5), 25
            rows.append((ctg, 10 * i, t, u))
            table_.append((ctg, 10 * i, first, second))
    c = "ctg string, pos long, count_a long, count_c long, count_g long, count_t long"
    side = lambda k: spark.createDataFrame([(ctg, pos, *map(int, x[k])) for ctg, pos, *x in rows], c)
    alleles_ = spark.createDataFrame(table_, "ctg string, pos long, first int, second int")
    track = pipelines.copy_number_track(side(0), side(1), alleles_)
    assert track.count() == len(rows) and track.filter("not hom").count() > 0.95 * len(rows)
    lost = calls_at = spark.createDataFrame([("chr2", 500, 20, 40), ("chr9", 1, 5, 50)], "ctg string, pos long, alt int, depth int")
    got = {r.ctg: (r.verdict is not None, r.purity, r.major, r.minor) for r in pipelines.tag_by_counts(calls_at, side(0), side(1), alleles_).collect()}
    assert got["chr2"][2:] == (1, 0) and abs(got["chr2"][1] - rho) < 0.06 and got["chr2"][0] and not got["chr9"][0] and lost.count() == 2


def test_coded_alleles(spark):
    k = spark.createDataFrame([("c", 1, 5, 6, 7, 8), ("c", 2, 1, 2, 3, 4), ("c", 3, 1, 1, 1, 1)], "ctg string, pos long, count_a long, count_c long, count_g long, count_t long")
    a = spark.createDataFrame([("c", 1, 1, 4), ("c", 2, 0, 5), ("c", 4, 1, 2)], "ctg string, pos long, first int, second int")
    assert sorted(map(tuple, copynumber.allele_pairs(k, a).collect())) == [("c", 1, 5, 8), ("c", 2, 0, 0)]


def test_given_sites_and_long_indels_in_the_plan(spark):
    """A given site stays without any alternative read if the normal has reads; an insertion over the cap is no candidate."""
    o = reads(1, "A", "tumor", "A" * 20) + reads(1, "A", "normal", "A" * 9) + reads(2, "A", "tumor", "A" * 20) + reads(3, "A", "tumor", "A" * 10 + "C" * 10) + reads(3, "A", "normal", "A" * 9)
    o += [("chr1", 4, "A", s, "A", "+" + "C" * 70 if s == "tumor" else "", 40, 60, 0, f"{s}4-{k}", 0) for s in ("tumor", "normal") for k in range(12)]
    d = spark.createDataFrame(o, OBS)
    t, n = d.filter("sample = 'tumor'"), d.filter("sample = 'normal'")
    given = spark.createDataFrame([("chr1", 1), ("chr1", 2), ("chr1", 3)], "ctg string, pos long")
    got = {r.pos: (r.hybrid, r.top_allele) for r in pipelines.pair_candidates(t, n, given=given).collect()}
    assert got == {1: (True, None), 3: (True, "C")}
    assert [r.pos for r in pipelines.pair_candidates(t, n).collect()] == [3] and {r.pos for r in pipelines.pair_candidates(t, n, most_indel=99).collect()} == {3, 4}


def test_call_rows_carry_reads_of_both_alleles(spark):
    s = "ctg string, pos long, ref string, p array<double>, depth long, normal_depth long, alleles map<string,struct<t:long,n:long>>"
    d = spark.createDataFrame([("c", 1, "A", [0.1, 0.1, 0.8], 20, 10, {"RA": (12, 9), "XT": (8, 1)}), ("c", 2, "A", [0.9, 0.05, 0.05], 20, 10, {"RA": (20, 10)}), ("c", 3, "A", [0.1, 0.1, 0.8], 20, 0, {"XT": (20, 0)})], s)
    got = {r.pos: (r.alt, r.ad, r.nad, r.naf, r.ndp) for r in calls.call_rows(d, show_reference=True).collect()}
    assert got == {1: ("T", [12, 8], [9, 1], 0.1, 10), 2: (".", [20], [10], 1.0, 10), 3: ("T", [0, 20], [0, 0], 0.0, 0)}


def test_bases_by_strand(spark):
    d = spark.createDataFrame(reads(1, "A", "tumor", "AAaCcT*#N") + reads(1, "A", "normal", "Ag"), OBS)
    r = counts.strand_tags(d).first()
    assert [r[f"{k}u"] for k in "acgt"] == [5, 2, 0, 1] and [r[f"f{k}u"] for k in "acgt"] == [3, 1, 0, 1] and [r[f"r{k}u"] for k in "acgt"] == [2, 1, 0, 0] and [r[f"n{k}u"] for k in "acgt"] == [1, 0, 1, 0]


def test_truths_for_training(spark):
    t = [("c", 1, "A", "C", "germline"), ("c", 2, "A", "C", "germline"), ("c", 3, "A", "C", "reference"), ("c", 4, "A", "C", "reference"), ("c", 5, "A", "C", "somatic"), ("c", 6, "A", "C", "somatic"), ("c", 7, "A", "C", "somatic"), ("c", 8, "A", "C", "somatic"), ("c", 9, "A", "AT", "germline")]
    tumor = [("c", 1, 40, {"C": 0.5}, {}), ("c", 2, 40, {"C": 0.5}, {}), ("c", 3, 40, {"G": 0.3}, {}), ("c", 4, 40, {"G": 0.3, "C": 0.1}, {}), ("c", 5, 40, {}, {"C": 0.2}), ("c", 6, 40, {"C": 0.04}, {"C": 0.2}), ("c", 7, 40, {}, {"C": 0.05}), ("c", 9, 40, {"A+T": 0.3}, {})]
    normal = [("c", 1, {"C": 0.45}), ("c", 2, {"C": 0.39}), ("c", 3, {"G": 0.05}), ("c", 4, {"C": 0.4}), ("c", 5, {"T": 0.5}), ("c", 6, {"T": 0.1}), ("c", 9, {"A+T": 0.4})]
    got = paired.training_truths(
        spark.createDataFrame(t, "ctg string, pos long, ref string, alt string, kind string"),
        spark.createDataFrame(tumor, "ctg string, pos long, depth long, alleles map<string,double>, tumor_alleles map<string,double>"),
        spark.createDataFrame(normal, "ctg string, pos long, alleles map<string,double>"),
    )
    assert {r.pos: r.reason for r in got.collect()} == {1: None, 2: "af_gap", 3: "af_gap", 4: None, 5: None, 6: "in_normal", 7: "low_coverage", 8: "no_reads", 9: None}


def test_draws_decide_on_near_truths(spark):
    p = spark.createDataFrame([("c", k) for k in range(0, 40_000, 10)] + [("c", 90_000)], "ctg string, pos long")
    o = spark.createDataFrame([("c", k) for k in range(0, 40_000, 10)], "ctg string, pos long")
    kept = paired.apart_from(p, o, 9).count(), paired.apart_from(p, o, 10).count()
    assert kept[0] == 4001 and 1050 < kept[1] < 1350 and paired.apart_from(p, o, 10).filter("pos = 90000").count() == 1


def test_unions_over_ranges_of_places(spark):
    """More partitions than a contig's rows need, equal rows, and unions across the borders of ranges."""
    r = random.Random(21)
    rows = [(c, a, a + r.choice([0, 1, 3, 9, 80])) for c in ("a", "b", None) for a in (r.randrange(3000) for _ in range(400))] + [("a", 5, 9)] * 5 + [("z", 0, 10**6), ("z", 7, 8)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame(rows, "ctg string, start long, end long")
        for strict in (True, False):
            want = []
            for c in {x[0] for x in rows}:
                own = []
                for s, e in sorted((s, e) for k, s, e in rows if k == c):
                    if own and (s < own[-1][1] if strict else s <= own[-1][1]):
                        own[-1] = (own[-1][0], max(own[-1][1], e), own[-1][2] + 1)
                    else:
                        own.append((s, e, 1))
                want += [(c, *x) for x in own]
            assert sorted(map(tuple, intervals.merge_overlaps(d, strict).collect()), key=str) == sorted(want, key=str)
        p = d.select("ctg", F.col("start").alias("pos"))
        want = []
        for c in {x[0] for x in rows}:
            own = []
            for s in sorted(s for k, s, _ in rows if k == c):
                if own and s - own[-1][1] <= 4:
                    own[-1] = (own[-1][0], s, own[-1][2] + 1)
                else:
                    own.append((s, s, 1))
            want += [(c, a - 2, b + 2, n) for a, b, n in own]
        assert sorted(map(tuple, sequences.clusters(p, 4, 2).collect()), key=str) == sorted(want, key=str)
        scored = spark.createDataFrame([(r.choice([0.1, 0.5, r.random()]), r.randrange(2)) for _ in range(500)], "score double, truth int")
        kept = scored.collect()
        for x in evaluate.sweep(scored).collect():
            tp, n = sum(k.truth for k in kept if k.score >= x.score), sum(k.score >= x.score for k in kept)
            assert (x.tp, x.fp, x.fn) == (tp, n - tp, sum(k.truth for k in kept) - tp)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pileup_strings_of_all_kinds(spark):
    from twinlens.functions import text

    r = random.Random(22)

    def slow(t):
        out, i = [], 0
        while i < len(t):
            if t[i] in "+-":
                n = re.match(r"[0-9]+", t[i + 1 :])[0]
                seq = t[i + 1 + len(n) : i + 1 + len(n) + int(n)]
                if out:
                    out[-1] += t[i] + seq
                i += 1 + len(n) + int(n)
                continue
            if t[i] == "^":
                i += 1
            elif t[i] in "ACGTNacgtn#*":
                out.append(t[i])
            i += 1
        return out

    def made():
        t = ""
        for _ in range(r.randrange(12)):
            t += r.choice(["A", "c", "*", "#", "g$", "^+T", "^1a", "^$N", "n"])
            if r.random() < 0.4:
                n = r.choice([1, 2, 9, 10, 12, 60, 61, 100, 234])
                t += r.choice("+-") + str(n) + "".join(r.choice("ACGTacgtnN") for _ in range(n))
        return t

    texts = [made() for _ in range(300)] + ["", "A", "$", "^]"]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {x.k: x.v for x in d.select("k", text.pileup_tokens(F.col("t")).alias("v")).collect()}
    assert got == {k: slow(t) for k, t in enumerate(texts)}
    first = d.limit(1).select(text.pileup_tokens(F.lit("+2ACg-1n*")).alias("v")).first()
    assert first.v == ["g-n", "*"]


def test_windows_of_a_task_are_aligned_at_once(monkeypatch):
    r = random.Random(8)
    windows = []
    for k in range(40):
        ref = "".join(r.choice("ACGT") for _ in range(120))
        own = [ref, ref[:60] + ref[63:], ref[:50] + "GATTA" + ref[50:]]
        seqs = [r.choice(own)[a : a + r.randint(50, 100)] for a in (r.randrange(20) for _ in range(r.randint(1, 12)))]
        windows.append((ref, 1000 * k, 20, 30, seqs, [[r.choice([10, 30, 30, 30]) for _ in s] for s in seqs]))
    each = [realignment.realign_window(*w) for w in windows]
    calls, aligned = [], realignment._aligned
    monkeypatch.setattr(realignment, "_aligned", lambda pairs: calls.append(len(pairs)) or aligned(pairs))
    assert realignment.realign_windows(windows) == each and any(x and "D" in x[3] for w in each for x in w)
    assert len(calls) < 5 and sum(calls) > 40


def test_a_task_gathers_whole_windows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(realignment, "READS_AT_ONCE", 20)
    monkeypatch.setattr(realignment, "WINDOWS_AT_ONCE", 4)
    w = [k for k in range(30) for _ in range(1 + k * 7 % 11)]
    rows = pa.RecordBatch.from_pydict({"window": w})
    for size in (1, 3, 7, 50, len(w)):
        got = [t.column("window").to_pylist() for t in realignment._gathered(rows.slice(a, size) for a in range(0, len(w), size))]
        assert sum(got, []) == w and all(not set(a) & set(b) for a, b in zip(got, got[1:])) and len(got) > 7


def test_realignment_of_reads_across_batches(spark):
    r = random.Random(9)
    win, rows = [], []
    for k in range(30):
        ref = "".join(r.choice("ACGT") for _ in range(100))
        win.append((f"w{k}", 500 * k, ref))
        for q in range(r.randint(1, 9)):
            a = r.randrange(30)
            seq = (ref if q % 2 else ref[:48] + ref[50:])[a : a + 60]
            rows.append((f"w{k}", f"q{q}", seq, [30] * len(seq), q, 500 * k + a, f"{len(seq)}M"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {(x.window, x.qname): (x.haplotype, x.score, x.pos, x.cigar) for x in realignment.realign(spark.createDataFrame(rows, READS.replace("window long", "window string")), spark.createDataFrame(win, "window string, start long, ref string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for w, start, ref in win:
        own = [x for x in rows if x[0] == w]
        for x, new in zip(own, realignment.realign_window(ref, start, 0, 0, [x[2] for x in own], [x[3] for x in own]), strict=True):
            assert got[w, x[1]] == (new or (None, None, x[5], x[6]))
