"""Read-level matrices, their scores, subsamples and mixtures against loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.functions.alleles import BASE_CODES, HAPLOTYPE_CODES
from twinlens.operators import kernels, matrices, sampling

OBS = "ctg string, pos long, ref string, sample string, base string, indel string, bq int, mq int, hp int, qname string, start long"


def some_reads(seed, n=60):
    """Reads of both samples over some places, with gaps, insertions that overlap others, and names of two places."""
    r = random.Random(seed)
    ref = [r.choice("ACGTN") for _ in range(200)]
    out = []
    for k in range(n):
        sample, at, reverse = r.choice(["normal", "tumor"]), r.randrange(140), r.random() < 0.5
        hp, name = r.choice([0, 1, 2, 3, None]), f"q{k}"
        for p in range(at, at + r.randrange(1, 50)):
            base = r.choice([ref[p], ref[p], r.choice("ACGTN"), "*"])
            base = {"*": "#"}.get(base, base.lower()) if reverse else base
            indel = "" if base in "*#" else r.choice(["", "", "", "", "+" + "".join(r.choice("ACGTacgtN") for _ in range(r.randint(1, 40))), "-NN", None])
            out.append(("c", p, ref[p] if r.random() < 0.9 else ref[p].lower(), sample, base, indel, r.randint(0, 70), r.choice([0, 20, 21, 40, 41, 60]), hp, name, at))
    return out


def slow_matrix(obs, site, sample, flank, most, platform, mask):
    reads, order = {}, {}
    for ctg, pos, ref, s, base, indel, bq, mq, hp, name, start in obs:
        if s != sample or abs(pos - site) > flank or ref.upper() not in "ACGT":
            continue
        if platform == "ilmn":
            name += "_1" if base == "#" or base.islower() else "_0"
        reads.setdefault(name, {})[pos - site + flank] = (ref.upper(), base, indel or "", bq, mq)
        old = order.get(name, (0, 99, start))
        order[name] = (max(old[0], hp if hp in (1, 2) else 0), min(old[1], pos - site + flank), start)
    kept = sorted(reads, key=lambda q: (hashlib.md5(f"0-{q}".encode()).hexdigest(), q))[:most]
    rows = []
    for q in sorted(kept, key=lambda q: (*order[q], q)):
        row = [[0] * 7 for _ in range(2 * flank + 1)]
        for at, (ref, base, indel, bq, mq) in reads[q].items():
            if base in "*#":
                row[at][1] = -100
                continue
            up = base.upper()
            alt = BASE_CODES[indel[0]] if indel else BASE_CODES[up] if up in "ACGT" and up != ref else 0
            bq = int(100 * min(bq // 10 * 10, 40) / 40) if platform == "ilmn" else int(100 * min(bq, 60) / 60)
            if mask and not indel and alt and bq < 33:
                alt = bq = 0
            mq = int(100 * (0 if mq <= 20 else 20 if mq <= 40 else 60) / 60)
            row[at][:6] = [BASE_CODES[ref], alt, -100 if base in "ACGT" else 100, bq, mq, HAPLOTYPE_CODES[sample][order[q][0]]]
        for at in sorted(reads[q]):
            indel = reads[q][at][2]
            if indel.startswith("+") and at < 2 * flank:
                for k, c in enumerate(indel[1:]):
                    if at + k <= 2 * flank:
                        row[at + k][6] = BASE_CODES[c.upper()]
        rows.append(row)
    return np.array(rows, int).reshape(len(rows), 2 * flank + 1, 7)


@pytest.mark.parametrize(("platform", "mask", "most"), [("ont", False, 100), ("ilmn", True, 100), ("hifi", True, 7)])
def test_matrices(spark, platform, mask, most):
    obs = some_reads(most, 120)
    sites = [3, 16, 40, 41, 70, 150, 199, 1000]
    d = spark.createDataFrame(obs, OBS).repartition(5)
    at = spark.createDataFrame([("c", p) for p in (*sites, 40)] + [("d", 40)], "ctg string, pos long")
    got = {(r.pos, r["sample"]): r for r in matrices.read_matrices(at, d, platform, reads={"normal": most, "tumor": most + 1}, mask=mask).collect()}
    want = {(p, s): slow_matrix(obs, p, s, 16, most + (s == "tumor"), platform, mask) for p in sites for s in ("normal", "tumor")}
    assert set(got) == {k for k, m in want.items() if len(m)}
    for k, r in got.items():
        assert r.n == len(want[k]) and np.array_equal(np.array(r.cells).reshape(want[k].shape), want[k])
    pairs = matrices.pair_matrices(at, d, platform, reads={"normal": most, "tumor": most + 1}, mask=mask).collect()
    assert {r.pos for r in pairs} == {p for p in sites if len(want[p, "normal"]) and len(want[p, "tumor"])}
    for r in pairs:
        m = np.array(r.features).reshape(2 * most + 3, 33, 7)
        left = 2 * most + 1 - len(want[r.pos, "normal"]) - len(want[r.pos, "tumor"])
        assert np.array_equal(m[left // 2 : left // 2 + len(want[r.pos, "normal"])], want[r.pos, "normal"]) and not m[: left // 2].any()


def test_training_matrices(spark):
    """Each sample's matrix is that of its reads alone; both strands of the variant are in it."""
    obs = [x for x in some_reads(31, 160) if x[2] in "ACGT"]
    sites = {}
    for _, p, ref, *_ in obs:
        sites.setdefault(p, ref)
    truths = [("c", p, r, {"A": "C", "C": "G", "G": "T", "T": "A"}[r]) for p, r in sorted(sites.items()) if p % 3 == 0]
    alts = {p: a for _, p, _, a in truths}
    r = random.Random(1)

    def planted(x):
        if x[1] not in alts or x[3] != "tumor" or x[4] in "*#" or r.random() < 0.5:
            return x
        return (*x[:4], alts[x[1]].lower() if x[4].islower() else alts[x[1]], "", *x[6:])

    obs = [planted(x) for x in obs]
    most = {"normal": 90, "tumor": 90}
    t = spark.createDataFrame(truths, "ctg string, pos long, ref string, alt string")
    got = matrices.training_matrices(t, spark.createDataFrame(obs, OBS).repartition(4), reads=most).collect()
    assert len({x.pos for x in got}) > 10 and len(got) > 1.3 * len({x.pos for x in got})
    for x in got:
        names = {}
        for o in obs:
            if o[3] == "tumor" and abs(o[1] - x.pos) <= 16:
                names.setdefault(o[9], None)
                if o[1] == x.pos and not o[5] and o[4].upper() == x.alt:
                    names[o[9]] = o[4].islower()
        kept = sorted(names, key=lambda q: (hashlib.md5(f"0-{q}".encode()).hexdigest(), q))[: x["size"]]
        strands = [names[q] for q in kept if names[q] is not None]
        assert len(strands) >= 3 and 0 < sum(strands) < len(strands)
        want = slow_matrix([o for o in obs if o[3] == "normal" or o[9] in kept], x.pos, "tumor", 16, 90, "ont", False)
        normal = slow_matrix(obs, x.pos, "normal", 16, 90, "ont", False)
        m = np.array(x.features).reshape(182, 33, 7)
        at = (180 - len(want) - len(normal)) // 2
        assert len(want) == x["size"] and np.array_equal(m[at : at + len(normal)], normal) and np.array_equal(m[at + len(normal) + 2 : at + len(normal) + 2 + len(want)], want)


def test_variants_that_reads_show(spark):
    d = spark.createDataFrame([("A", "", "G", "A"), ("a", "", "G", "A"), ("A", "+T", "G", "A"), ("G", "+tc", "G", "GTC"), ("G", "+t", "G", "GTC"), ("G", "-NN", "GTC", "G"), ("G", "-N", "GTC", "G"), ("C", None, "G", "C")], "b string, i string, r string, a string")
    assert [x[0] for x in d.select(matrices.shows(F.col("b"), F.col("i"), F.col("r"), F.col("a"))).collect()] == [True, True, False, True, False, True, False, True]


def test_convolution_against_loops():
    r = np.random.default_rng(2)
    x, w = r.normal(size=(2, 3, 7, 6)), r.normal(size=(4, 3, 3, 3))
    for stride in (1, 2):
        out = kernels.convolve(x, w, stride)
        assert out.shape == (2, 4, -(-7 // stride), -(-6 // stride))
        for n, o, i, j in np.ndindex(out.shape):
            total = 0.0
            for c, a, b in np.ndindex(3, 3, 3):
                y, z = i * stride + a - 1, j * stride + b - 1
                total += x[n, c, y, z] * w[o, c, a, b] if 0 <= y < 7 and 0 <= z < 6 else 0.0
            assert out[n, o, i, j] == pytest.approx(total)


def test_residual_network_against_loops():
    """The same layers written place by place."""
    r = np.random.default_rng(5)
    x, w = r.normal(size=(2, 9, 8, 3)), kernels.random_residual_weights((9, 8, 3), 1, (4, 5, 6), (7, 6, 3))

    def layer(h, k, stride):
        out = kernels.convolve(h, w[k], stride)
        for c in range(out.shape[1]):
            out[:, c] = (out[:, c] - w[f"{k}/mean"][c]) / np.sqrt(w[f"{k}/var"][c] + 1e-5) * w[f"{k}/scale"][c] + w[f"{k}/shift"][c]
        return out

    h = np.moveaxis(x, 3, 1)
    for k in ("c1", "c2", "c3"):
        h = np.clip(layer(h, k, 2), 0, None)
        h = np.clip(h + layer(np.clip(layer(h, k + "a", 1), 0, None), k + "b", 1), 0, None)
    h = h.reshape(2, -1)
    for k in ("d1", "d2", "d3"):
        h = np.array([[w[f"{k}/bias"][o] + w[k][o] @ row for o in range(len(w[k]))] for row in h])
        h = np.where(h > 0, 1.0507009873554805 * h, 1.0507009873554805 * 1.6732632423543772 * (np.exp(h) - 1))
    want = np.exp(h) / np.exp(h).sum(1, keepdims=True)
    assert np.allclose(kernels.residual_model(w)(x), want) and np.allclose(want.sum(1), 1)


def test_subsamples_are_nested(spark):
    r = random.Random(3)
    rows = [("c", p, f"q{k}", r.random() < 0.3, p % 5 > 0 and r.random() < 0.5) for p in range(30) for k in range(60)]
    got = sampling.beta_subsamples(spark.createDataFrame(rows, "ctg string, pos long, qname string, is_alt boolean, reverse boolean")).collect()
    kind = {(p, q): (a, b) for _, p, q, a, b in rows}
    by = {}
    for x in got:
        by.setdefault((x.pos, x["size"]), set()).add(x.qname)
    assert all(len(v) == size for (_, size), v in by.items()) and {p for p, _ in by} == {p for p in range(30) if p % 5}
    for (p, size), names in by.items():
        strands = [kind[p, q][1] for q in names if kind[p, q][0]]
        assert len(strands) >= 3 and 0 < sum(strands) < len(strands)
        assert all(names <= other for (q, more), other in by.items() if q == p and more >= size)
    assert len(by) > 40


def test_mixtures_use_bins_again_only_when_they_must(spark):
    c = spark.createDataFrame([("chr2", 40, 60), ("chr7", 40, 60), ("chr20", 41, 30), ("chrX", 40, 60)], "ctg string, normal_coverage long, tumor_coverage long")
    c = c.withColumn("share", F.coalesce(sampling.normal_share(F.col("ctg")), F.lit(1.0)))
    plan = {r.ctg: r for r in sampling.mixing_plan(c, 0.5).collect()}
    assert {k: r.share for k, r in plan.items()} == {"chr2": 1.0, "chr7": 1.25, "chr20": 0.5, "chrX": 1.0}
    assert plan["chr2"].coverage == 26 and (plan["chr2"].tumor_in_tumor, plan["chr2"].normal_in_tumor, plan["chr2"].normal_in_normal) == (3, 3, 6)
    assert sampling.mixing_plan(c, 0.5, coverage=10).first().coverage == 10
    forced = sampling.mixing_plan(c, 0.5).withColumn("normal_in_normal", F.col("normal_bins") - 1)
    for p, again in ((sampling.mixing_plan(c, 0.5), False), (forced, True)):
        bins = sampling.mixed_bins(p, seed=4).collect()
        for r in p.collect():
            own = lambda s, part: {x.bin for x in bins if (x.ctg, x["sample"], x.part) == (r.ctg, s, part)}  # noqa: B023, E731
            tumor, normal = own("normal", "tumor"), own("normal", "normal")
            assert len(own("tumor", "tumor")) == r.tumor_in_tumor and len(tumor) == r.normal_in_tumor and len(normal) == r.normal_in_normal
            assert len(tumor & normal) == max(0, r.normal_in_normal + r.normal_in_tumor - r.normal_bins) and (len(tumor & normal) > 0) == again
    reads = spark.createDataFrame([("chr2", s, b, k) for s in ("normal", "tumor") for b in range(15) for k in range(3)], "ctg string, sample string, bin long, k int")
    mixed = sampling.mixed_reads(reads, sampling.mixed_bins(sampling.mixing_plan(c, 0.5)))
    assert mixed.count() == 3 * (3 + 3 + 6)
