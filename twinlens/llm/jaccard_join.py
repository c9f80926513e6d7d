"""N-gram Jaccard join by PartEnum signatures.

Sets whose sizes allow the similarity are in one band of sizes or in neighbouring ones, and differ in at most k
elements, which follows from the band. The domain is hashed into n1 parts of n2 smaller ones; by the pigeonhole
principle two such sets differ by at most k2 in one of the n1 parts, so that they agree on n2 - k2 of its smaller
parts. A signature is a band, a part, a subset of its smaller parts, and the elements there.

Pairs are never expanded. Under each signature, a breadth-first search over the parity sketches of its sets, whose
distance is a lower bound of the sets' difference, leaves a spanning forest of what may be similar. The components of
all forests are clusters; each ships its sets once, and a search by exact comparison leaves a spanning forest of the
links. Groups above the bounds of one search are enumerated again by finer signatures, and what is still too large goes
block by block with a bounded number of hubs in each round, until all sets outside of the largest component have been
hubs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import let_go, reliable, shared_folder, sheltered, small, small_batches, table, tidy, tidy_groups
from twinlens.llm.components import components
from twinlens.llm.words import GOLD, mixed, text_hashes

#: Smaller parts in each part, and how many of them may differ; the next shape is for groups that are too large.
SHAPES = ((3, 1), (6, 3))
#: Sets, and elements by the largest one's size, of one search in a task.
MOST_SETS, MOST_ELEMENTS = 2048, 4 << 20
#: Hubs of a group in the first round and in the later ones.
FIRST_HUBS, HUBS = 64, 1024
#: Bytes of signatures or of sets in a bucket, about; signatures that a task gathers before it hands them on; of them,
#: groups of more sets than FEW go round the bucket.
BUCKET_BYTES, FLUSH, FEW = 8 << 20, 1 << 20, 8
#: Classes that a task remembers.
KEPT_CLASSES = 300_000


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct 64-bit hashes of its shingles; of the whole sequence if it has fewer words."""
    out = []
    for h, sizes in text_hashes(texts):
        begin = np.cumsum(sizes) - sizes
        s = h[: max(0, len(h) - words + 1)].copy()
        for k in range(1, words):
            s = mixed(s + np.uint64(k)) * GOLD + h[k : k + len(s)]
        s = mixed(s + np.uint64(words))
        for a, n in zip(begin.tolist(), sizes.tolist(), strict=True):
            if n >= words:
                out.append(np.unique(s[a : a + n - words + 1]))
            elif n:
                x = h[a : a + 1].copy()
                for k in range(1, n):
                    x = mixed(x + np.uint64(k)) * GOLD + h[a + k : a + k + 1]
                out.append(mixed(x + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> bytes:
    """The set's 128-bit name: equal sets have one."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def sketch(s: np.ndarray) -> bytes:
    """The parities of the numbers of elements in hash slots, at least two slots for an element: sketches of two sets
    differ in no more bits than the sets in elements, and fold to half by exclusive or."""
    slots = 1 << max(6, (2 * len(s) - 1).bit_length())
    at = (mixed(s + np.uint64(0x632BE59BD9B4E019)) & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=slots) & 1, bitorder="little").tobytes()


class Bands:
    """Bands of sizes, and for tag t, which covers bands t - 1 and t, the number of parts."""

    def __init__(self, percent: int, shape: tuple[int, int]):
        self.percent, self.shape, self.starts = percent, shape, [1]

    def _grow(self) -> None:
        self.starts.append(self.starts[-1] * 100 // self.percent + 1)

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self._grow()
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def parts(self, tag: int) -> int:
        """n1 of a tag; 0 if its sets must be equal to be similar."""
        while len(self.starts) <= tag + 1:
            self._grow()
        k = 2 * (self.starts[tag + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        return -(-(k + 1) // (self.shape[1] + 1)) if k else 0


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of all sets, none of them empty, and the index of each one's set."""
    n2, k2 = bands.shape
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    own_bands = np.array([bands.band(int(n)) for n in sizes])
    content = mixed(flat + np.uint64(0x2545F4914F6CDD1D))
    found, of = [], []
    for up in (0, 1):
        tags = own_bands + up
        n1 = np.array([bands.parts(int(t)) for t in tags])
        if not n1.any():
            continue
        base = np.cumsum(n1 * n2) - n1 * n2
        salt = mixed(tags.astype(np.uint64) * np.uint64(n2) + np.uint64(1))
        some = n1[owner] > 0
        own, elements = owner[some], flat[some]
        part = base[own] + (mixed(elements ^ salt[own]) % (n1 * n2).astype(np.uint64)[own]).astype(np.int64)
        order = np.argsort(part, kind="stable")
        head = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1]))
        sums = np.zeros(int((n1 * n2).sum()), np.uint64)
        sums[part[order][head]] = np.add.reduceat(content[some][order], head)
        which = np.repeat(np.arange(len(sets)), n1)
        f = np.arange(len(which)) - np.repeat(np.cumsum(n1) - n1, n1)
        smaller = sums[(base[which] + f * n2)[:, None] + np.arange(n2)]
        where = mixed((tags[which].astype(np.uint64) << np.uint64(40)) + f.astype(np.uint64)) + np.uint64(n2)
        for j, kept in enumerate(combinations(range(n2), n2 - k2)):
            found.append(mixed(smaller[:, kept].sum(1, dtype=np.uint64) + where + np.uint64(64 * j)))
            of.append(which)
    return (np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _slices(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


def classes(docs: DataFrame, words: int) -> DataFrame:
    """(id, t, n_shingles, class, sketch) of (id, t, text)."""

    def run(batches):
        for b in _slices(batches):
            sets = shingle_sets(b.column(2), words)
            n = pa.array([len(s) for s in sets], pa.int64())
            columns = [b.column(0), b.column(1), n, pa.array(map(class_of, sets), pa.binary()), pa.array(map(sketch, sets), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "t", "n_shingles", "class", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "t", "text").mapInArrow(tidy(run), f"id {kind}, t long, n_shingles long, class binary, sketch binary")


def _enumerate(words: int, bands: Bands, buckets: int):
    """Texts to rows for a bucket: kind 0, signatures set by set with the sets' names and their numbers of signatures;
    kind 1, the same of one set for each signature that more than FEW of those gathered have; kind 2, all sets of
    these, by group."""

    def rows(sig, of, names, kind):
        bucket = (sig % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((of, bucket))
        bucket, of, high = bucket[order], of[order], (sig[order] >> np.uint64(32)).astype(np.uint32)
        for own in np.split(np.arange(len(bucket)), np.flatnonzero(bucket[1:] != bucket[:-1]) + 1):
            sets, n = np.unique(of[own], return_counts=True)
            yield int(bucket[own[0]]), kind, high[own].tobytes(), names[sets].tobytes(), n.astype(np.uint32).tobytes()

    def handed_on(gathered):
        sig, of = np.concatenate([g[0] for g in gathered]), np.concatenate([g[1] for g in gathered])
        names = np.concatenate([g[2] for g in gathered])
        order = np.argsort(sig, kind="stable")
        starts = np.flatnonzero(np.append(True, sig[order][1:] != sig[order][:-1]))
        n = np.diff(np.append(starts, len(sig)))
        many = np.repeat(n > FEW, n)
        out = []
        if many.any():
            rest, heads = order[many], order[starts[n > FEW]]
            gid = ((sig[rest] % np.uint64(buckets)) << np.uint64(32)) + (sig[rest] >> np.uint64(32))
            for k in range(0, len(rest), FLUSH // 16):
                to = int(sig[rest[k]] >> np.uint64(7)) % buckets
                out.append((-1 - to, 2, gid[k : k + FLUSH // 16].tobytes(), names[of[rest[k : k + FLUSH // 16]]].tobytes(), b""))
            out += rows(sig[heads], of[heads], names, 1)
        if not many.all():
            few = order[~many]
            out += rows(sig[few], of[few], names, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
            ["bucket", "kind", "signatures", "classes", "counts"],
        )

    def run(batches):
        seen, gathered, n, n_sets = set(), [], 0, 0
        for b in _slices(batches):
            sets = {}
            for s in shingle_sets(b.column(0), words):
                c = class_of(s)
                if len(s) and c not in seen:  # copies within a task have the same signatures
                    sets[c] = s
            if len(seen) > KEPT_CLASSES:
                seen.clear()
            seen.update(sets)
            if sets:
                sig, of = signatures(list(sets.values()), bands)
                gathered.append((sig, of + n_sets, np.array(list(sets), "V16")))
                n, n_sets = n + len(sig), n_sets + len(sets)
            if n > FLUSH:
                yield handed_on(gathered)
                gathered, n, n_sets = [], 0, 0
        if n:
            yield handed_on(gathered)

    return run


def _groups(key: tuple, rows: pa.Table) -> pa.Table:
    """Signatures that two classes share, and these classes; of those with the same classes, one stays."""
    gids, names = [], []
    sig, cls, hot = [], [], []
    for kind, s, c, n in zip(*(rows.column(k).to_pylist() for k in ("kind", "signatures", "classes", "counts")), strict=True):
        c = np.frombuffer(c, "V16")
        if kind == 2:
            gids.append(np.frombuffer(s, np.int64))
            names.append(c)
        else:
            sig.append(np.frombuffer(s, np.uint32))
            cls.append(np.repeat(c, np.frombuffer(n, np.uint32)))
            hot.append(np.full(len(sig[-1]), kind == 1))
    if sig:
        sig, cls, hot = np.concatenate(sig), np.concatenate(cls), np.concatenate(hot)
        order = np.argsort(sig, kind="stable")
        same = sig[order][1:] == sig[order][:-1]
        order = order[np.append(same, False) | np.append(False, same)]
        low = cls[order].view(np.uint64).reshape(-1, 2)
        order = order[np.lexsort((low[:, 1], low[:, 0], sig[order]))]
        low = cls[order].view(np.uint64).reshape(-1, 2)
        new = np.ones(len(order), bool)
        new[1:] = (sig[order][1:] != sig[order][:-1]) | (low[1:] != low[:-1]).any(1)
        flag = np.zeros(len(order), bool)
        flag[:] = hot[order]
        starts = np.flatnonzero(np.append(True, sig[order][1:] != sig[order][:-1])) if len(order) else np.zeros(0, np.int64)
        if len(starts):
            n = np.add.reduceat(new.astype(np.int64), starts)
            open_ = np.logical_or.reduceat(flag, starts)  # it has more sets elsewhere
            print_ = np.add.reduceat(np.where(new, mixed(low[:, 0] ^ (low[:, 1] * GOLD)), np.uint64(0)), starts)
            first = np.zeros(len(starts), bool)
            first[np.unique(np.stack([print_, n.astype(np.uint64)]), axis=1, return_index=True)[1]] = True
            wanted = (n > 1) & (open_ | first)
            keep = new & np.repeat(wanted, np.diff(np.append(starts, len(order))))
            gids.append((int(key[0].as_py()) << 32) + sig[order][keep].astype(np.int64))
            names.append(cls[order][keep])
    g, c = (np.concatenate(gids), np.concatenate(names)) if gids else (np.zeros(0, np.int64), np.zeros(0, "V16"))
    return pa.table({"gid": g, "class": pa.Array.from_buffers(pa.binary(16), len(c), [None, pa.py_buffer(np.ascontiguousarray(c))]).cast(pa.binary())})


def _common(s: np.ndarray, t: np.ndarray) -> int:
    if len(s) > len(t):
        s, t = t, s
    at = np.searchsorted(t, s)
    return int((t[np.minimum(at, len(t) - 1)] == s).sum())


def _tree(c: np.ndarray, n: np.ndarray, sketches: list[bytes], sets: list[bytes] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of sets c of sizes n; without sets, of what their sketches leave possible."""
    words = [np.frombuffer(x, np.uint64) for x in sketches]
    width = min(map(len, words))
    m = np.stack([np.bitwise_xor.reduce(w.reshape(-1, width), axis=0) for w in words])
    exact = sets and [np.frombuffer(x, np.uint64) for x in sets]
    edges, left = [], np.arange(len(c))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        rest = m[left]
        while queue and len(left):
            x = queue.pop()
            apart = np.bitwise_count(rest ^ m[x]).sum(1, dtype=np.int64)
            near = ((100 + percent) * apart <= (100 - percent) * (n[left] + n[x])) & (100 * np.minimum(n[left], n[x]) >= percent * np.maximum(n[left], n[x]))
            if exact:
                for k in np.flatnonzero(near):
                    both = _common(exact[x], exact[left[k]])
                    near[k] = 100 * both >= percent * (n[x] + n[left[k]] - both)
            if near.any():
                edges += [(int(c[x]), int(c[k])) for k in left[near]]
                queue += left[near].tolist()
                left, rest = left[~near], rest[~near]
    return edges


def _trees(percent: int, exact: bool):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        gid, c, n = (rows.column(k).to_numpy() for k in ("gid", "c", "n"))
        order = np.lexsort((c, gid))
        data = rows.column("data").to_pylist()
        edges = []
        for own in np.split(order, np.flatnonzero(gid[order][1:] != gid[order][:-1]) + 1):
            if len(own) > 1:
                d = [data[k] for k in own]
                if exact:
                    edges += _tree(c[own], n[own], [sketch(np.frombuffer(x, np.uint64)) for x in d], d, percent)
                else:
                    edges += _tree(c[own], n[own], d, None, percent)
        a, b = zip(*set(edges), strict=True) if edges else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _forest(members: DataFrame, data: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links (a, b) that span the links within the groups of members (gid, c), by data (c, n, data): sets or sketches."""
    rows = members.join(data, "c")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("data") + 64), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(tidy_groups(_trees(percent, exact)), "a long, b long")


def _by_hubs(members: DataFrame, data: DataFrame, percent: int, exact: bool) -> DataFrame:
    """_forest of groups of any size: a round compares all members with some hubs, block by block."""
    sizes = members.groupBy("gid").agg(F.count("*").alias("m"), F.max("n").alias("top"))
    most = F.least(F.lit(MOST_SETS // 2), F.greatest(F.lit(1), F.floor(F.lit(MOST_ELEMENTS) / 2 / F.col("top")))).cast("long")
    sizes = reliable(sizes.select("gid", "m", most.alias("most")))
    blocks = members.select("gid", "c").join(sizes, "gid").withColumn("blocks", F.ceil(F.col("m") / F.col("most")).cast("long"))
    blocks = reliable(blocks.withColumn("block", F.pmod(F.xxhash64("c", F.lit(1)), F.col("blocks"))))
    open_rows, links, hubs_of = blocks.select("gid", "c", "blocks", "most"), None, FIRST_HUBS
    while True:
        place = F.pmod(F.xxhash64("c", F.lit(2)), F.least(F.lit(hubs_of), F.col("most")))
        hubs = reliable(open_rows.groupBy("gid", "blocks", place.alias("place")).agg(F.min("c").alias("c")))
        everywhere = hubs.select("gid", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        now = blocks.select("gid", "c", "block").unionByName(everywhere.select("gid", "c", "block")).distinct()
        found = _forest(now.select(F.xxhash64("gid", "block").alias("gid"), "c"), data, percent, exact)
        links = reliable(found if links is None else links.unionByName(found))
        named = components(links)
        rows = open_rows.join(hubs.select("gid", "c"), ["gid", "c"], "left_anti")
        at = F.coalesce("component", "c").alias("at")
        mains = blocks.join(named, F.col("c") == F.col("node"), "left").groupBy("gid", at).agg(F.count("*").alias("k"))
        mains = mains.groupBy("gid").agg(F.max_by("at", F.struct("k", "at")).alias("main"))
        rows = rows.join(named, F.col("c") == F.col("node"), "left").join(mains, "gid").filter(at != F.col("main"))
        open_rows = reliable(rows.select("gid", "c", "blocks", "most"))
        let_go(links.sparkSession)
        if not open_rows.limit(1).count():
            return links
        hubs_of = HUBS


def _spanned(members: DataFrame, data: DataFrame, percent: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """The links of groups (gid, c, n) that one search takes, and the rows of the larger groups."""
    sizes = members.groupBy("gid").agg(F.count("*").alias("m"), F.max("n").alias("top"))
    large = sizes.filter((F.col("m") > MOST_SETS) | (F.col("m") * F.col("top") > MOST_ELEMENTS) & (F.col("m") > 2)).select("gid")
    large = reliable(large)
    k = large.count()
    if not k:
        return reliable(_forest(members.select("gid", "c"), data, percent, exact)), members.limit(0)
    links = _forest(members.join(small(large, k), "gid", "left_anti").select("gid", "c"), data, percent, exact)
    return reliable(links), reliable(members.join(small(large, k), "gid", "left_semi"))


def _clusters(own: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that span what may be similar of sets (c, first, t, n, class, data)."""
    names, data = sets.select("class", "c", "n"), sets.select("c", "n", "data")
    found, wanted = [], None
    for shape in SHAPES:
        some = sets if wanted is None else sets.join(wanted, "c", "left_semi")
        total = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        bands = Bands(percent, shape)
        each = (100 - percent) / (100 + percent) * 2.5 * len(list(combinations(range(shape[0]), shape[1]))) / (shape[1] + 1)
        buckets = max(1, -(-int(total * 8 * each) // BUCKET_BYTES))
        texts = own.select("text") if wanted is None else _texts(own, some).select("text")
        packed = texts.mapInArrow(tidy(_enumerate(words, bands, buckets)), "bucket long, kind int, signatures binary, classes binary, counts binary")
        groups = packed.groupBy("bucket").applyInArrow(tidy_groups(_groups), "gid long, class binary")
        members = reliable(groups.join(names, "class").select("gid", "c", "n").distinct())
        links, large = _spanned(members, data, percent, False)
        found.append(links)
        if not large.limit(1).count():
            break
        wanted = reliable(large.select("c").distinct())
    else:
        found.append(_by_hubs(large, data, percent, False))
    links = found[0]
    for x in found[1:]:
        links = links.unionByName(x)
    return links


def _texts(own: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, class, text): a text of each of the sets."""
    of = sets.select("c", "class", F.col("first").alias("_first"), F.col("t").alias("_t"))
    same = F.col("id").eqNullSafe(F.col("_first")) & (F.col("t") == F.col("_t"))
    return own.join(small(of, of.count()), same).select("c", "class", "text")


def _exact_sets(words: int):
    def run(batches):
        for b in _slices(batches):
            sets = shingle_sets(b.column(2), words)
            right = [class_of(s) == c for s, c in zip(sets, b.column(1).to_pylist(), strict=True)]
            n = pa.array([len(s) for s in sets], pa.int64())
            out = pa.RecordBatch.from_arrays([b.column(0), n, pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "n", "data"])
            yield out.filter(pa.array(right, pa.bool_()))

    return run


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    Two documents link if their sets of shingles of so many words have a Jaccard similarity of percent or more;
    component_id is the smallest id that links reach. A null or empty text, and one without words, has no shingles and
    links with nothing. Rows with one id are nodes of their own. Rows with a null id link like all others; a component
    is null only if it has no other id. Other columns are ignored. Empty tables give empty results. Sets are told apart
    by 128-bit hashes, words and shingles by 64-bit hashes.
    """
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.col(text_col).alias("text"))
    nodes = reliable(classes(own, words))
    full = nodes.filter("n_shingles > 0")
    one = F.struct(F.col("id").isNull().alias("none"), "id", "t", "n_shingles", "sketch")
    firsts = full.groupBy("class").agg(F.min(one).alias("x")).select("class", "x.id", "x.t", "x.n_shingles", "x.sketch")
    firsts = reliable(firsts.toDF("class", "first", "t", "n", "data"))
    sets = reliable(firsts.withColumn("c", F.monotonically_increasing_id()))
    near = components(reliable(_clusters(own, sets, words, percent).distinct()))
    near = near.select(F.col("component").alias("gid"), F.col("node").alias("c")).join(sets.select("c", "n"), "c").select("gid", "c", "n")
    near = reliable(near)
    data = reliable(_texts(own, sets.join(near, "c", "left_semi")).mapInArrow(tidy(_exact_sets(words)), "c long, n long, data binary").dropDuplicates(["c"]))
    links, large = _spanned(near, data, percent, True)
    if large.limit(1).count():
        links = links.unionByName(_by_hubs(large, data, percent, True))
    merged = components(links).select(F.col("node").alias("c"), "component")
    # a class that has links is in its component, another one alone
    tops = reliable(sets.select("class", "c", "first").join(merged, "c", "left").withColumn("component", F.coalesce("component", "c")))
    least = tops.groupBy("component").agg(F.min("first").alias("component_id"))
    named = reliable(tops.join(least, "component").select("class", "component_id"))  # used more than once below
    empty = nodes.filter("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    large_classes = full.join(_hot(full, named), "class", "left")
    done = large_classes.filter("many").select("id", "n_shingles", F.col("hot").alias("component_id"))
    rest = large_classes.filter("many is null").select("class", "id", "n_shingles").join(named, "class").select("id", "n_shingles", "component_id")
    return empty.unionByName(done).unionByName(rest).withColumnRenamed("id", id_col)


#: Classes of more copies than this, and than a thousandth of the rows, are joined by broadcast; a thousand at most.
HOT_ROWS = 1000


def _hot(full: DataFrame, named: DataFrame) -> DataFrame:
    limit = max(HOT_ROWS, full.count() // 1000)
    many = full.groupBy("class").agg(F.count("*").alias("m")).filter(F.col("m") > limit)
    return F.broadcast(named.join(F.broadcast(many), "class", "left_semi").select("class", F.col("component_id").alias("hot"), F.lit(True).alias("many")))


def op4_jaccard_join(spark, sf_dir):
    return link(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90)


@sheltered
def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates, one row stays, the smallest by doc_id (null last), then text,
    then the place among the written rows.

    Repeated rows, texts under one doc_id and rows with a null doc_id are rows of their own: each links by its text.
    Texts without words link with nothing, so all of them stay.
    """
    small_batches(spark)
    path = f"{shared_folder(spark)}/near-{uuid4().hex}"
    docs.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    kind = docs.schema["doc_id"].dataType
    # without nulls, and in the order of doc_id
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit("0").cast(kind)).alias("doc_id"), F.col("_row").alias("row"))
    found = link(rows.select(name.alias("_key"), "text"), "_key", words=5, percent=80)
    least = F.struct("_key.none", "_key.doc_id") == F.struct("component_id.none", "component_id.doc_id")
    members = reliable(found.select(F.col("_key.row").alias("_row"), F.col("component_id.row").alias("c"), least.alias("least")))
    groups = members.groupBy("c").agg(F.count("*").alias("m"), F.count_if("least").alias("k")).filter("m > 1")
    grouped = reliable(members.join(groups, "c"))
    n, n_tied = grouped.agg(F.count("*"), F.count_if(F.col("least") & (F.col("k") > 1))).first()
    # of rows with the smallest doc_id of a component, of which more than one is rare, the smallest text stays
    tied = grouped.filter("least and k > 1").select("_row", "c")
    first = rows.select("_row", "text").join(small(tied, n_tied), "_row").groupBy("c").agg(F.min(F.struct("text", "_row")).alias("m"))
    kept = grouped.filter("least and k = 1").select("_row").unionByName(first.select(F.col("m._row").alias("_row")))
    gone = reliable(grouped.select("_row").join(kept, "_row", "left_anti"))
    return rows.join(small(gone, n), "_row", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 90 * (x.n + y.n - m)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT t.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(t.doc_id, coalesce(min(r.other), t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY t.doc_id
"""
