"""Allele-specific copy numbers: depth ratios, genotypes, segmentation, purity and ploidy, and what they say of calls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.quality import expected_fractions
from twinlens.operators import intervals, sequences
from twinlens.operators.lineage import reliable, small
from twinlens.operators.sequences import local_minima

SITE = ["ctg", "pos"]
#: The grid of the search for purity and ploidy, and how far beyond a cell its purity and ploidy are named.
RHOS, PSIS, SHIFT = [x / 100 for x in range(10, 105)], [x / 100 for x in range(100, 600, 5)], (0.01, 0.05)


def allele_pairs(counts: DataFrame, alleles: DataFrame) -> DataFrame:
    """(ctg, pos, a, b): reads of a place's two alleles, of its base counts (ctg, pos, count_a, ... count_t) and a table of
    alleles (ctg, pos, first, second) with 1 to 4 for A, C, G, T. Places that either lacks are left out; another code
    has no reads."""
    of = lambda c: F.coalesce(F.get(F.array(*(F.col(f"count_{x}") for x in "acgt")), F.col(c).cast("int") - 1), F.lit(0)).cast("long")
    return counts.join(alleles.select(*SITE, "first", "second"), SITE).select(*SITE, of("first").alias("a"), of("second").alias("b"))


def depth_ratios(tumor: DataFrame, normal: DataFrame | None = None, min_normal: int = 1) -> DataFrame:
    """logr = log2 of the tumor's depth over its mean, less the normal's; baf: the share of one of two alleles.

    tumor and normal have ctg, pos, a, b (reads of the two alleles). Which allele counts is a coin of the place, so
    that it is the same on each run. Places without reads are left out, and those with under min_normal in the normal.
    """
    t = tumor.select(*SITE, "a", "b", (F.col("a") + F.col("b")).alias("t")).filter("t > 0")
    if normal is not None:
        t = t.join(normal.select(*SITE, (F.col("a") + F.col("b")).alias("n")).filter(F.col("n") >= min_normal), SITE)
    means = t.agg(F.avg("t").alias("mt"), *([F.avg("n").alias("mn")] if normal is not None else []))
    d = t.crossJoin(F.broadcast(means))  # one row
    ratio = F.log2(F.col("t") / F.col("mt"))
    if normal is not None:
        ratio = F.log2((F.col("t") / F.col("mt")) / (F.col("n") / F.col("mn")))
    coin = F.pmod(F.col("pos") * 2_654_435_761, F.lit(97)) % 2 == 0
    return d.select(*SITE, ratio.alias("logr"), (F.when(coin, F.col("a")).otherwise(F.col("b")) / F.col("t")).alias("baf"))


def correlations(df: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """The correlation of the value with each column, and the largest in size: one row of sums."""
    r = df.agg(*(F.corr(value, c).alias(c) for c in columns))
    best = F.array_max(F.array(*(F.struct(F.abs(F.coalesce(c, F.lit(0.0))).alias("r"), F.lit(c).alias("name")) for c in columns)))["name"]
    return r.withColumn("best", best)


def _basis(x: np.ndarray, low: float, high: float, knots: list[float]) -> np.ndarray:
    """Cubic B-splines on the knots, without the first: as many columns as knots and three."""
    t = np.concatenate([[low] * 4, knots, [high] * 4])
    x = np.clip(x, low, high)
    b = np.array([(x >= t[i]) & (x < t[i + 1]) for i in range(len(t) - 1)], float)
    last = np.flatnonzero(t < high)[-1]
    b[last, x == high] = 1
    for k in range(1, 4):
        for i in range(len(t) - k - 1):
            left = (x - t[i]) / (t[i + k] - t[i]) * b[i] if t[i + k] > t[i] else 0
            right = (t[i + k + 1] - x) / (t[i + k + 1] - t[i + 1]) * b[i + 1] if t[i + k + 1] > t[i + 1] else 0
            b[i] = left + right
    return b[1 : len(t) - 4].T


def spline_residuals(df: DataFrame, value: str, covariates: list[str], knots: int = 2) -> DataFrame:
    """corrected: what a least-squares fit of the value on cubic splines of the covariates leaves.

    Knots are quantiles. The normal equations are sums over all rows, made in the tasks; the driver solves a system
    of a dozen unknowns.
    """
    q = [(i + 1) / (knots + 1) for i in range(knots)]
    edges = df.agg(*(F.percentile_approx(c, [0.0, *q, 1.0], 10_000).alias(c) for c in covariates)).first()
    size = 1 + len(covariates) * (knots + 3)

    def design(frame: pd.DataFrame) -> np.ndarray:
        parts = [np.ones((len(frame), 1))]
        for c in covariates:
            low, *mid, high = edges[c]
            parts.append(_basis(frame[c].to_numpy(float), low, high, mid))
        return np.concatenate(parts, axis=1)

    def sums(frames):
        a, b = np.zeros((size, size)), np.zeros(size)
        for f in frames:
            x = design(f)
            a += x.T @ x
            b += x.T @ f[value].to_numpy(float)
        yield pd.DataFrame({"i": np.arange(size * size + size), "v": np.concatenate([a.ravel(), b])})

    rows = df.select(value, *covariates).mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r.v for r in rows]) if rows else np.zeros(size * size + size)
    beta = np.linalg.lstsq(flat[: size * size].reshape(size, size), flat[size * size :], rcond=None)[0]
    schema = df.withColumn("corrected", F.lit(0.0)).schema

    def rest(frames):
        for f in frames:
            yield f.assign(corrected=f[value].to_numpy(float) - design(f) @ beta)

    return df.mapInPandas(rest, schema)


def homozygous(df: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """hom: the normal's share of one allele is near 0 or 1."""
    return df.withColumn("hom", (F.col("baf") < low) | (F.col("baf") > high))


def segment(logr: np.ndarray, baf: np.ndarray, scales: tuple[float, float], penalty: float = 1000.0, least: int = 6) -> np.ndarray:
    """The first index of each segment: the least sum of squares of both tracks around segment means, each by its own
    scale, and a penalty for each further segment; segments have so many points at least. Exact: all ends in order, for
    each one all starts that can still be best (a start that a later end beats by more than a segment costs is dropped
    for good)."""
    n = len(logr)
    if n < 2 * least:
        return np.array([0] if n else [], int)
    y = np.stack([(logr - logr.mean()) / scales[0], (baf - baf.mean()) / scales[1]])
    c = np.concatenate([np.zeros((2, 1)), np.cumsum(y, axis=1)], axis=1)
    squares = np.concatenate([[0], np.cumsum((y * y).sum(0))])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    starts, dropped = np.array([0]), {}
    for end in range(least, n + 1):
        if end - least >= least:
            starts = np.append(starts, end - least)
        starts = np.setdiff1d(starts, dropped.pop(end, np.array([], int)), assume_unique=True)
        cost = best[starts] + squares[end] - squares[starts] - ((c[:, end, None] - c[:, starts]) ** 2).sum(0) / (end - starts)
        k = int(np.argmin(cost))
        best[end], back[end] = cost[k] + penalty, starts[k]
        # beaten here by more than a cut costs: never best for an end from which a segment fits in between
        dropped[end + least] = np.union1d(dropped.get(end + least, np.array([], int)), starts[cost >= best[end]])
    cuts, at = [], n
    while at > 0:
        at = int(back[at])
        cuts.append(at)
    return np.array(cuts[::-1])


def numbered(df: DataFrame) -> DataFrame:
    """df with index, the row's number in its contig by place, from 0."""
    return sequences.numbered(df, ["ctg"], "pos")


#: Places of a window of the segmentation, and how many at its ends lend their context only.
WINDOW, MARGIN = 1000, 100


def segments(df: DataFrame, penalty: float = 70.0, least: int = 6, width: int = WINDOW, margin: int = MARGIN) -> DataFrame:
    """Segments (ctg, start, end, n, logr, baf) of heterozygous places (ctg, pos, logr, baf), by both tracks together.

    A contig is cut into windows that overlap by twice the margin; each is searched exactly, on its own scale, and cuts
    count where the window is not near its end. The last window of a contig begins early enough to have twice the
    margin, and gives only cuts beyond those of the windows before it. Windows are dealt out, so that a contig is not
    one task; segments meet their places again by a range join. baf is the mean distance from one half, below it, and
    one half where that is within noise.
    """
    step = width - 2 * margin + 1
    d = numbered(df.select("ctg", "pos", "logr", "baf"))
    sizes = reliable(d.groupBy("ctg").agg((F.max("index") + 1).alias("size")))
    d = reliable(d.join(small(sizes, sizes.count()), "ctg"))
    last = F.greatest(F.ceil((F.col("size") + 2 * margin - width) / step), F.lit(0)).cast("long")
    k = F.floor((F.col("index") + margin) / step)
    begin = lambda w: F.when((w == F.col("last")) & (w > 0), F.least(w * step - margin, F.col("size") - 2 * margin)).otherwise(w * step - margin)
    wide = d.withColumn("last", last).withColumn("window", F.explode(F.array_distinct(F.array(k, k - 1, F.col("last")))))
    wide = wide.filter((F.col("window") >= 0) & (F.col("window") <= F.col("last"))).withColumn("begin", begin(F.col("window")))
    wide = wide.filter((F.col("index") >= F.col("begin")) & (F.col("index") < F.col("begin") + width))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("index")
        x, y, at = frame["logr"].to_numpy(), frame["baf"].to_numpy(), frame["index"].to_numpy()
        flipped, begin, size = np.minimum(y, 1 - y), int(frame["begin"].iloc[0]), int(frame["size"].iloc[0])
        scales = (sequences.noise(x), sequences.noise(flipped))
        fine = bool(np.isfinite(scales).all() and min(scales) > 0)
        cuts = at[segment(x, flipped, scales, penalty, least)] if fine else np.array([], int)
        cuts = cuts[(cuts >= max(1, begin + margin)) & (cuts <= min(size, begin + width - margin))]
        return pd.DataFrame({"ctg": frame["ctg"].iloc[0], "window": frame["window"].iloc[0], "last": frame["last"].iloc[0], "cuts": [cuts.tolist()], "noise": scales[1] if fine else None})

    found = wide.select("ctg", "window", "last", "begin", "size", "index", "logr", "baf").groupBy("ctg", "window")
    found = reliable(found.applyInPandas(run, "ctg string, window long, last long, cuts array<long>, noise double"))
    noise = found.groupBy("ctg").agg(F.coalesce(F.sqrt(F.avg(F.col("noise") * F.col("noise"))), F.lit(0.0)).alias("noise"))
    cuts = found.select("ctg", "window", "last", F.explode("cuts").alias("cut"))
    before = cuts.filter("window < last").groupBy("ctg").agg(F.max("cut").alias("before"))
    cuts = cuts.join(before, "ctg", "left").filter("window < last or before is null or cut > before").select("ctg", F.col("cut").alias("rstart"))
    edges = cuts.unionByName(sizes.select("ctg", F.lit(0).cast("long").alias("rstart"))).distinct()
    ends = F.lead("rstart").over(Window.partitionBy("ctg").orderBy("rstart"))  # a row for each segment
    bounds = edges.withColumn("rend", ends).join(sizes, "ctg").select("ctg", "rstart", F.coalesce("rend", "size").alias("rend"))
    joined = intervals.point_join(d.select("ctg", (F.col("index") + 1).alias("pos"), F.col("pos").alias("place"), "logr", "baf"), bounds, 4 * width)
    off = F.avg(F.abs(F.col("baf") - 0.5))
    by = joined.groupBy("ctg", "rstart").agg(F.min("place").alias("start"), F.max("place").alias("end"), F.count("*").alias("n"), F.avg("logr").alias("logr"), off.alias("off"))
    within = F.sqrt(F.col("noise") * F.col("noise") + F.col("off") * F.col("off")) < 2 * F.col("noise")
    return by.join(noise, "ctg").select("ctg", "start", "end", "n", "logr", F.when(within, 0.5).otherwise(0.5 - F.col("off")).alias("baf"))


def copies(logr: Column, baf: Column, rho: Column, psi: Column, gamma: float = 1.0) -> tuple[Column, Column]:
    """Raw copies of both alleles at a purity and ploidy."""
    total = F.pow(F.lit(2.0), logr / gamma) * (2 * (1 - rho) + rho * psi)
    return (rho - 1 - (baf - 1) * total) / rho, (rho - 1 + baf * total) / rho


def purity_grid(segs: DataFrame, rhos: list[float], psis: list[float], shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """For each purity and ploidy on a grid: the distance of the segments' minor copies from whole numbers, weighted by
    length and, balanced ones, by 0.05; goodness of fit in percent; ploidy; and shares of the length: zero, without
    copies of an allele (both counted); zero_aberrant, the same of unbalanced segments alone; uneven, with one odd and
    one even number. The minor allele is the one with fewer copies in all. aberrant: unbalanced segments are over 0.03
    of the length or one of them over 0.005.

    rho and psi are named, and ploidy and shares taken, a shift beyond the cell at which the distance is measured.
    Segments meet the grid, whose size is fixed, by a broadcast; each cell is then a sum.
    """
    cells = [(i, j, float(r), float(p)) for i, r in enumerate(rhos) for j, p in enumerate(psis)]
    grid = segs.sparkSession.createDataFrame(cells, "rho_at int, psi_at int, r double, p double")
    grid = grid.withColumns({"rho": F.round(F.col("r") + shift[0], 6), "psi": F.round(F.col("p") + shift[1], 6)})
    even = F.col("baf") == 0.5
    d = segs.select("n", "logr", "baf").crossJoin(F.broadcast(grid))
    a, b = copies(F.col("logr"), F.col("baf"), F.col("r"), F.col("p"))
    x, y = copies(F.col("logr"), F.col("baf"), F.col("rho"), F.col("psi"))
    d = d.withColumns({"na": a, "nb": b, "x": x, "y": y, "w": F.col("n") * F.when(even, 0.05).otherwise(1.0)})
    off = lambda c: F.pow(F.col(c) - F.greatest(F.bround(c), F.lit(0.0)), F.lit(2.0)) * F.col("w")
    none = (F.bround("x") == 0).cast("int") + (F.bround("y") == 0).cast("int")
    odd = F.pmod(F.bround("x"), F.lit(2)) != F.pmod(F.bround("y"), F.lit(2))
    share = lambda c, of: F.coalesce(F.try_divide(F.sum(c), F.sum(of)), F.lit(0.0))
    loose = F.when(even, 0).otherwise(F.col("n"))
    by = d.groupBy("rho_at", "psi_at", "rho", "psi").agg(
        F.sum("na").alias("sa"), F.sum("nb").alias("sb"), F.sum(off("na")).alias("da"), F.sum(off("nb")).alias("db"), F.sum(0.25 * F.col("w")).alias("worst"),
        share((F.col("x") + F.col("y")) * F.col("n"), F.col("n")).alias("ploidy"), share(none * F.col("n"), F.col("n")).alias("zero"), share(none * loose, loose).alias("zero_aberrant"),
        share(odd.cast("int") * F.col("n"), F.col("n")).alias("uneven"),
        ((F.sum(loose) > 0.03 * F.sum("n")) | (F.max(loose) > 0.005 * F.sum("n"))).alias("aberrant"),
    )
    distance = F.when(F.col("sa") < F.col("sb"), F.col("da")).otherwise(F.col("db"))
    by = by.withColumn("distance", distance)
    return by.select("rho_at", "psi_at", "rho", "psi", "distance", ((1 - F.try_divide("distance", "worst")) * 100).alias("goodness"), "ploidy", "zero", "zero_aberrant", "uneven", "aberrant")


#: Least purity, least goodness of fit, shares of the stages, and the narrow range of ploidies.
MIN_RHO, MIN_GOODNESS, MIN_ZERO, MIN_ZERO_ABERRANT, MIN_UNEVEN, NARROW = 0.2, 60.0, 0.02, 0.1, 0.05, (1.7, 2.3)


def best_purity(grid: DataFrame, ploidies: tuple[float, float] = (1.5, 5.5)) -> DataFrame:
    """The purity and ploidy of purity_grid, by four stages; the first one that has a local minimum decides, by the
    least distance. One row at most: rho (1 at most), psi, stage, distance, goodness, ploidy.

    1: aberrant, any ploidy, enough without an allele. 2: a narrow ploidy, enough of the unbalanced length without an
    allele. For 3 and 4 minima are searched again with purities above 1 out. 3: aberrant, any ploidy, enough of one of
    the three shares. 4: a narrow ploidy. The grid has a fixed size, so that it is cut from the segments first.
    """
    grid = reliable(grid)
    narrow_fits = ploidies[0] < NARROW[1] and ploidies[1] > NARROW[0]
    masked = grid.withColumn("distance", F.when(F.col("rho") > 1, 1e20).otherwise(F.col("distance")))
    fit = (F.col("rho") >= MIN_RHO) & (F.col("goodness") > MIN_GOODNESS)
    inside = lambda lo, hi: (F.col("ploidy") > lo) & (F.col("ploidy") < hi)
    wide, narrow = F.col("aberrant") & inside(*ploidies), inside(*NARROW) & F.lit(narrow_fits)
    zero, loose = F.col("zero") > MIN_ZERO, F.col("zero_aberrant") > MIN_ZERO_ABERRANT
    stage = lambda d, first, second, k: local_minima(d, "rho_at", "psi_at", "distance").withColumn("stage", F.when(fit & first, k).when(fit & second, k + 1))
    found = stage(grid, wide & zero, narrow & loose, 1).unionByName(stage(masked, wide & (loose | zero | (F.col("uneven") > MIN_UNEVEN)), narrow, 3))
    best = found.filter("stage is not null").orderBy("stage", "distance", "psi_at", "rho_at").limit(1)
    return best.select(F.least("rho", F.lit(1.0)).alias("rho"), "psi", "stage", "distance", "goodness", "ploidy")


def whole_copies(segs: DataFrame, rho: float, psi: float) -> DataFrame:
    """Segments with whole copies: major and minor. What one allele has below 0 comes off the other; of a balanced
    segment whose sum is off by more than half a copy, one allele takes or gives it."""
    a, b = copies(F.col("logr"), F.col("baf"), F.lit(rho), F.lit(psi))
    d = segs.withColumns({"a": a, "b": b})
    lost = F.col("a") + F.col("b") < 0
    x = F.when(lost | (F.col("a") < 0), 0.0).when(F.col("b") < 0, F.col("a") + F.col("b")).otherwise(F.col("a"))
    y = F.when(lost | ((F.col("b") < 0) & (F.col("a") >= 0)), 0.0).when(F.col("a") < 0, F.col("a") + F.col("b")).otherwise(F.col("b"))
    d = d.withColumns({"x": x, "y": y})
    rx, ry, even = F.bround("x"), F.bround("y"), F.col("baf") == 0.5
    over = F.col("x") + F.col("y") - rx - ry
    na, nb = rx + F.when(even & (over > 0.5), 1).otherwise(0), ry - F.when(even & (over < -0.5), 1).otherwise(0)
    return d.select(*segs.columns, F.greatest(na, nb).cast("int").alias("major"), F.least(na, nb).cast("int").alias("minor"))


def log_choose(n: Column, k: Column) -> Column:
    """The logarithm of n over k, by a native sum: n is a read depth."""
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((n - k + i) / i))


def binomial_p(k: Column, n: Column, p: Column) -> Column:
    """The two-sided exact p-value: the sum of all outcomes that are no more likely than k. A native fold over the
    n + 1 outcomes, each from the one before."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    odds = F.log(p) - F.log(1 - p)
    own = log_choose(n, k) + k * F.log(p) + (n - k) * F.log(1 - p)
    start = F.struct(F.lit(0.0).alias("sum"), (n * F.log(1 - p)).alias("l"))

    def step(s: Column, i: Column) -> Column:
        hit = s["l"] <= own + 1e-7
        after = s["l"] + F.when(i < n, F.log((n - i) / (i + 1.0)) + odds).otherwise(0.0)
        return F.struct((s["sum"] + F.when(hit, F.exp(s["l"])).otherwise(0.0)).alias("sum"), after.alias("l"))

    return F.least(F.aggregate(F.sequence(F.lit(0), n), start, step, lambda s: s["sum"]), F.lit(1.0))


def verdicts(calls: DataFrame, alpha: float = 0.01) -> DataFrame:
    """verdict of calls (alt, depth, purity, major, minor): what their fraction fits, at the expected ones of a germline
    and a somatic variant with either number of copies."""
    e1 = expected_fractions(F.col("purity"), F.col("major"), F.col("minor"))
    e2 = expected_fractions(F.col("purity"), F.when(F.col("minor") == 0, F.col("major")).otherwise(F.col("minor")), F.when(F.col("minor") == 0, F.col("minor")).otherwise(F.col("major")))
    d = calls.withColumns({"f": F.col("alt") / F.col("depth"), "e1": e1, "e2": e2})
    pv = lambda e: binomial_p(F.col("alt"), F.col("depth"), e)
    d = d.withColumns({"pg": F.greatest(pv(F.col("e1.germline")), pv(F.col("e2.germline"))), "ps": F.greatest(pv(F.col("e1.somatic")), pv(F.col("e2.somatic")))})
    d = d.withColumn("odds", F.log10((F.col("pg") + 1e-300) / (F.col("ps") + 1e-300)))
    f, pg, ps, odds, pur = (F.col(c) for c in ("f", "pg", "ps", "odds", "purity"))
    eg, es = F.col("e1.germline"), F.col("e1.somatic")
    low = F.when(es <= eg, f < es / 1.5).otherwise(f < eg / 2)
    kind = (
        F.when((f < 0.05) & (pur > 0.2) & (pur < 0.9), "subclonal").when(f > 0.95, "germline")
        .when((pg > alpha) & (ps < alpha), F.when((odds >= 2) & (f > 0.25), "germline").otherwise("probable_germline"))
        .when((pg < alpha) & (ps > alpha), F.when(odds <= -2, "somatic").otherwise("probable_somatic"))
        .when((pg > alpha) & (ps > alpha), "ambiguous")
        .when((pur >= 0.3) & (f < 0.25) & low, "subclonal").when((odds < -5) & (ps > 1e-10), "somatic")
        .when((odds > 5) & (pg > 1e-4), "germline").otherwise("ambiguous")
    )
    return d.withColumn("verdict", kind).drop("e1", "e2")
