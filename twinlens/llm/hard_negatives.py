"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A component more gives all rows the same norm, so that the distance from an anchor, whose further component is 0,
falls as the inner product grows: a window of scores is an annulus of distances. The top of the tree is fitted on a
bounded sample and deals all rows to cells; each cell's rows, in blocks of bounded size, hold a vantage-point tree of
their own. An anchor first searches the cell that may be nearest, then, with the bound found there, every cell that its
annulus still meets. Within a block it takes the leaves nearest first and stops once no leaf can be nearer than what it has.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinlens.llm.common import reliable, stored, table

#: Rows and bytes of the sample that the top of the tree is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 32 << 20
#: Cells that the top of the tree may have; rows and bytes of a block, about; rows of a leaf; anchors that a task holds.
CELLS, BLOCK, BLOCK_BYTES, LEAF, ANCHORS = 1024, 32_768, 32 << 20, 256, 4096
#: Scores beyond all others.
FAR = 1 << 62


@dataclass
class Tree:
    """Vantage points (vectors), the radius of each one's inside, and its children: a node, or -1 - leaf."""

    points: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray
    leaves: list[np.ndarray] = field(default_factory=list)

    def bounds(self, q: np.ndarray, square: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of the anchors q, the least and greatest distance that a row of each leaf may have."""
        n = max(1, len(self.leaves) or (len(self.radius) + 1))
        low, high = np.zeros((len(q), n)), np.full((len(q), n), np.inf)
        if not len(self.radius):
            return low, high
        away = np.sqrt(np.maximum(0.0, (q * q).sum(1)[:, None] + square - 2 * (q @ self.points.T)))
        at = {0: (np.zeros(len(q)), np.full(len(q), np.inf))}
        for k in range(len(self.radius)):  # parents come before their children
            lo, hi = at.pop(k)
            d, r = away[:, k], self.radius[k]
            for child, bound in ((self.inside[k], (np.maximum(lo, d - r), np.minimum(hi, d + r))), (self.outside[k], (np.maximum(lo, r - d), hi))):
                if child < 0:
                    low[:, -1 - child], high[:, -1 - child] = bound
                else:
                    at[int(child)] = bound
        return low, high


def _apart(x: np.ndarray, more: np.ndarray, v: np.ndarray, v_more: np.ndarray | float, square: int) -> np.ndarray:
    """Distances of augmented rows from one augmented row, or from one for each."""
    dot = (x * v).sum(1) if v.ndim == 2 else x @ v
    return np.sqrt(np.maximum(0.0, 2.0 * (square - dot - more * v_more)))


def augmented(x: np.ndarray, square: int) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, square - (x * x).sum(1)))


def build(x: np.ndarray, square: int, leaf: int) -> Tree:
    """A tree over rows x; rows at one place may fill a leaf beyond its size."""
    more = augmented(x, square)
    tree = Tree(np.zeros((0, x.shape[1])), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    points, radius, children, queue = [], [], [], [(np.arange(len(x)), None)]
    for own, parent in queue:
        split = None
        if len(own) > leaf:
            v = own[int(np.argmax(_apart(x[own], more[own], x[own[0]], more[own[0]], square)))]
            d = _apart(x[own], more[own], x[v], more[v], square)
            r = float(np.median(d))
            near = d <= r
            if near.all():  # ties at the median
                r = float(d[d < r].max()) if (d < r).any() else r
                near = d <= r
            split = None if near.all() else (near, r, v)
        name = len(radius) if split else -1 - len(tree.leaves)
        if parent is not None:
            children[parent[0]][parent[1]] = name
        if split:
            near, r, v = split
            points.append(x[v])
            radius.append(r)
            children.append([0, 0])
            queue += [(own[near], (name, 0)), (own[~near], (name, 1))]
        else:
            tree.leaves.append(own)
    if radius:
        both = np.array(children, np.int64)
        tree.points, tree.radius, tree.inside, tree.outside = np.stack(points), np.array(radius), both[:, 0], both[:, 1]
    return tree


def _cells(tree: Tree, x: np.ndarray, square: int) -> np.ndarray:
    """The leaf of each row."""
    at, more = np.zeros(len(x), np.int64), augmented(x, square)
    if not len(tree.radius):
        return at
    more_points, open_ = augmented(tree.points, square), np.ones(len(x), bool)
    while open_.any():
        k = at[open_]
        d = _apart(x[open_], more[open_], tree.points[k], more_points[k], square)
        at[open_] = np.where(d <= tree.radius[k], tree.inside[k], tree.outside[k])
        open_ = at >= 0
    return -1 - at


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of doubles from lists of numbers; short ones end in zeros."""
    n = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    if len(flat):
        out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _exact(x: np.ndarray, q: np.ndarray, whole: bool) -> np.ndarray:
    return (x @ q).astype(np.int64) if whole else x.astype(np.int64) @ q.astype(np.int64)


def _nearest(tree: Tree, x, row, ident, label, q, name, own_label, windows, same, k, square, low, high, whole) -> list[tuple[int, int, int, int]]:
    """(p, row, id, score) of the first k rows in each window (p, lo, hi, floor) of one anchor; leaves nearest first."""
    norm, slack = float(q @ q) + square, 1e-6 * (square**0.5 + 1)
    reach = lambda score: (max(0.0, norm - 2.0 * score)) ** 0.5 + slack
    open_ = [[p, max(lo, floor), hi, [], reach(max(lo, floor)), (max(0.0, norm - 2.0 * hi)) ** 0.5 - slack] for p, lo, hi, floor in windows]
    for leaf in np.argsort(low, kind="stable").tolist():
        if low[leaf] > max(w[4] for w in open_):
            break
        wanted = [w for w in open_ if low[leaf] <= w[4] and high[leaf] >= w[5]]
        if not wanted:
            continue
        own = tree.leaves[leaf]
        score = _exact(x[own], q, whole)
        fits = label[own] == own_label if same else label[own] != own_label
        if same:
            fits &= row[own] != name
        for w in wanted:
            found = np.flatnonzero(fits & (score >= w[1]) & (score <= w[2]))
            if len(found):
                at = own[found]
                w[3] += zip((-score[found]).tolist(), ident[at].tolist(), row[at].tolist(), strict=True)
                w[3] = sorted(w[3])[:k]
                if len(w[3]) == k:
                    w[1] = max(w[1], -w[3][-1][0])
                    w[4] = reach(w[1])
    return [(w[0], r, i, -s) for w in open_ for s, i, r in w[3]]


def _searched(dims: int, square: int, same: bool, k: int):
    whole = square < 1 << 52

    def run(index: pa.Table, anchors: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and anchors.num_rows:
            x = np.frombuffer(index.column("vecs")[0].as_py(), np.float64).reshape(-1, dims)
            row, ident, label = (np.array(index.column(c)[0].as_py(), np.int64) for c in ("rows", "ids", "labels"))
            tree = build(x, square, LEAF)
            q = _vectors(_flat(anchors.column("vec")), dims)
            low, high = tree.bounds(q, square)
            names, labels, windows = (anchors.column(c).to_pylist() for c in ("a", "label", "windows"))
            for j in range(len(q)):
                w = [(x["p"], x["lo"], x["hi"], x["floor"]) for x in windows[j]]
                out += [(names[j], *t) for t in _nearest(tree, x, row, ident, label, q[j], names[j], labels[j], w, same, k, square, low[j], high[j], whole)]
        columns = zip(*out, strict=True) if out else [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "p", "row", "id", "score"), columns, strict=True)})

    return run


def _packed(dims: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        x = _vectors(_flat(rows.column("vec")), dims)
        one = {"block": [rows.column("block")[0].as_py()], "vecs": pa.array([x.tobytes()], pa.binary())}
        return pa.table(one | {n: [rows.column(c).to_pylist()] for n, c in (("rows", "row"), ("ids", "id"), ("labels", "label"))})

    return run


class Forest:
    """The rows of a table of vectors, dealt to blocks of one index, and searches over all of them."""

    def __init__(self, rows: DataFrame):
        """rows: (row, id, label, vec) without nulls."""
        self.rows = rows
        n, self.dims, square = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.max(F.expr("aggregate(vec, 0D, (s, v) -> s + v * v)"))).first()
        self.dims, self.square = max(1, self.dims), int(square or 0)
        size = min(BLOCK, max(1, BLOCK_BYTES // (8 * self.dims)), max(LEAF, n // 64))
        cells = max(1, min(CELLS, n // size))
        most = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * self.dims)))
        sample = rows.orderBy(F.xxhash64("row"), "row").limit(most).select("vec").toArrow().column(0)
        x = _vectors(_flat(sample), self.dims)
        self.top = build(x, self.square, max(1, -(-len(x) // cells)))
        dims, square, top = self.dims, self.square, self.top

        def route(batches):
            for b in batches:
                cell = _cells(top, _vectors(b.column(3), dims), square)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["row", "id", "label", "vec", "cell"])

        dealt = stored(rows.select("row", "id", "label", "vec").mapInArrow(route, "row long, id long, label long, vec array<long>, cell long"))
        counts = {r[0]: r[1] for r in dealt.groupBy("cell").count().collect()}  # one number a cell, CELLS at most or so
        blocks, self.blocks = 0, {}
        for cell in sorted(counts):
            m = -(-counts[cell] // (2 * size))
            self.blocks[cell] = range(blocks, blocks + m)
            blocks += m
        first = F.create_map(*(F.lit(x) for c, b in self.blocks.items() for x in (c, b.start))) if counts else F.create_map(F.lit(0), F.lit(0))
        many = F.create_map(*(F.lit(x) for c, b in self.blocks.items() for x in (c, len(b)))) if counts else F.create_map(F.lit(0), F.lit(1))
        block = (first[F.col("cell").cast("int")] + F.pmod(F.xxhash64("row"), many[F.col("cell").cast("int")])).cast("long")
        kept = dealt.withColumn("block", block).select("block", "row", "id", "label", "vec")
        schema = "block long, vecs binary, rows array<long>, ids array<long>, labels array<long>"
        self.index = stored(kept.groupBy("block").applyInArrow(_packed(self.dims), schema))

    def _dealt(self, anchors: DataFrame, first: bool) -> DataFrame:
        """Anchors for each block of the cell that may be nearest, or of all others that their annuli meet."""
        dims, square, top, blocks = self.dims, self.square, self.top, self.blocks
        slack = 1e-6 * (square**0.5 + 1)

        def run(batches):
            for b in batches:
                q = _vectors(b.column(2), dims)
                low, high = top.bounds(q, square)
                norm = (q * q).sum(1) + square
                of, to = [], []
                for j, windows in enumerate(b.column(3).to_pylist()):
                    meets, nearest = np.zeros(low.shape[1], bool), np.zeros(low.shape[1], bool)
                    for w in windows:
                        begin = max(0.0, norm[j] - 2.0 * w["hi"]) ** 0.5 - slack
                        inner = high[j] >= begin
                        nearest |= inner & (low[j] <= max(0.0, norm[j] - 2.0 * w["lo"]) ** 0.5 + slack)
                        meets |= inner & (low[j] <= max(0.0, norm[j] - 2.0 * max(w["lo"], w["floor"])) ** 0.5 + slack)
                    one = int(np.argmin(np.where(nearest, low[j], np.inf)))
                    cells = [one] if first else [c for c in np.flatnonzero(meets).tolist() if c != one]
                    for c in cells:
                        for x in blocks.get(c, ()):
                            of.append(j)
                            to.append(x)
                    if len(of) > 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *b.take(pa.array(of, pa.int64())).columns], ["block", "a", "label", "vec", "windows"])
                        of, to = [], []
                if of:
                    yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *b.take(pa.array(of, pa.int64())).columns], ["block", "a", "label", "vec", "windows"])

        windows = "array<struct<p: bigint, lo: bigint, hi: bigint, floor: bigint>>"
        return anchors.select("a", "label", "vec", F.col("windows").cast(windows)).mapInArrow(run, f"block long, a long, label long, vec array<long>, windows {windows}")

    def _search(self, dealt: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
        """Anchors in groups of bounded size against each block."""
        group = F.pmod(F.xxhash64("a"), F.lit(groups))
        index = self.index.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        left, right = index.groupBy("block", "group"), dealt.withColumn("group", group.cast("long")).groupBy("block", "group")
        return left.cogroup(right).applyInArrow(_searched(self.dims, self.square, same, k), "a long, p long, row long, id long, score long")

    def first_in(self, anchors: DataFrame, n: int, same: bool, k: int) -> DataFrame:
        """(a, p, row, id, score, rank): the first k rows of the same label or of others in each window (p, lo, hi,
        floor) of the n anchors (a, label, vec, windows)."""
        groups = max(1, -(-n // ANCHORS))
        best = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id", "row")
        top = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        near = reliable(top(self._search(self._dealt(anchors, True), groups, same, k)))
        full = near.groupBy("a", "p").agg(F.count("*").alias("m"), F.min("score").alias("least")).filter(F.col("m") == k)
        floors = full.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("p", "least"))).alias("floors"))
        raised = F.transform("windows", lambda w: w.withField("floor", F.coalesce(F.try_element_at("floors", w["p"]), w["floor"])))
        later = anchors.join(floors, "a", "left").withColumn("floors", F.coalesce("floors", F.create_map().cast("map<bigint,bigint>"))).withColumn("windows", raised).drop("floors")
        rest = self._search(self._dealt(later, False), groups, same, k)
        return reliable(top(near.drop("rank").unionByName(rest)))


def hard_negatives(
    vectors: DataFrame, anchor, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    anchor is a condition on the columns of vectors. Components are floor(scale * x); the score of two rows is their
    inner product, equal scores go by the smaller id. Rows with a null label, a null vector, or a null or non-finite
    component take no part; short vectors count as ending in zeros; an empty one scores 0. Ids and labels are whole
    numbers; a null id comes last among equal scores (as the largest long, and is given back as null). Repeated rows are
    rows of their own, told apart by their place, so that a repeat of an anchor is a positive of it. An anchor without
    others of its label, or a window without rows, gives nothing. An empty table gives an empty result; other columns
    are ignored. The squares of a row's components must add up to less than 2**62.
    """
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).filter(F.coalesce(fine, F.lit(False)))
    vec = F.transform(vec_col, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    last = F.lit((1 << 63) - 1)
    rows = own.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), last).alias("id"), F.col(label_col).cast("long").alias("label"),
        vec.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    rows = stored(rows)
    forest = Forest(rows)
    anchors = rows.filter("anchor").select(F.col("row").alias("a"), "id", "label", "vec")
    n = anchors.count()
    whole = F.array(F.struct(*(F.lit(x).cast("long").alias(c) for c, x in (("p", -1), ("lo", -FAR), ("hi", FAR), ("floor", -FAR)))))
    found = forest.first_in(anchors.withColumn("windows", whole), n, True, positives)
    # percent * p <= 100 * s <= 100 * p
    low = F.ceil(F.col("score") * percent / F.lit(100).cast("decimal(20,0)")).cast("long")
    window = F.struct(F.col("row").alias("p"), low.alias("lo"), F.col("score").alias("hi"), F.lit(-FAR).cast("long").alias("floor"))
    of = found.filter("score >= 0").groupBy("a").agg(F.collect_list(window).alias("windows"))  # positives in number at most
    wanted = forest.first_in(anchors.join(of, "a"), n, False, negatives)
    pairs = wanted.select("a", F.col("p").alias("positive"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    firsts = found.select("a", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(firsts, ["a", "positive"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    named = lambda c: F.when(F.col(c) != last, F.col(c)).alias(c)
    return out.select(named("anchor_id"), named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    """A label is moved on where vec_id is divisible by 7; anchors are rows whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = r"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 5
"""
