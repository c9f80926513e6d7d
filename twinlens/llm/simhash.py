"""SimHash near-duplicates by tiled exact comparison.

Each document has a fingerprint of 64 bits; equal ones are one entry. Entries are laid in tiles by their population
counts, taken over the parts of a fingerprint. Two fingerprints differ in at least as many bits as their counts do, so
that only tiles whose counts are within the radius are paired. A pair of tiles is compared whole, by exclusive or and
bit counts over numpy arrays, and hands on a spanning forest of its links, never all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import reliable, small, stored, table
from twinlens.llm.components import components

#: A-Z as a-z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Bytes of a text that are taken at once, if words allow it.
PIECE = 1 << 20
#: Fingerprints of a tile, and how many times that tiles by counts alone may have before more parts are counted.
TILE, TILES_OF_A_COUNT = 2048, 2
#: Rows of a tile that are compared at once.
SLAB = 256


def _word_runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists; cut between words. bytes.split() cuts at the six white-space bytes."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and text[stop] not in b" \t\n\v\f\r":
            stop += 1
        yield text[at:stop].split()
        at = stop


def fingerprint(text: str | None, words: int) -> int:
    """A bit is set if it is in over half of the XXH64 of the shingles, repeats included; 0 for a text without words."""
    raw = (text or "").encode().translate(LOWER)
    ones, n, carried = np.zeros(64, np.int64), 0, []
    for run in _word_runs(raw):
        run = carried + run
        if len(run) >= words:
            joined = b" ".join(run)
            ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            spans = zip(starts[: len(run) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
            h = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
            carried = run[len(run) - words + 1 :]
        else:
            carried = run
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(id, f): each row's fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f)], ["id", "f"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, f long")


def parts_for(n: int) -> int:
    """Parts of a fingerprint that are counted: as few as leave tiles by counts of random bits near the size of a tile."""
    for parts in (1, 2, 4, 8, 16):
        bits = 64 // parts
        share = sum((comb(bits, k) / 2**bits) ** 2 for k in range(bits + 1)) ** parts
        if n * share <= TILE * TILES_OF_A_COUNT:
            break
    return parts


def counts_of(f: Column, parts: int) -> Column:
    """The population counts of a fingerprint's parts as one number, 7 bits for each part up to 8, else 3 for nibbles."""
    bits = 64 // parts
    step, mask = (3, 15) if parts == 16 else (7, (1 << bits) - 1 if bits < 64 else -1)
    out = F.lit(0).cast("long")
    for k in range(parts):
        one = F.bit_count(F.shiftrightunsigned(f, k * bits).bitwiseAND(F.lit(mask).cast("long"))).cast("long")
        out = out + F.shiftleft(one, step * k)
    return out


def steps_within(radius: int, parts: int) -> list[tuple[int, ...]]:
    """Differences of counts whose sizes add up to radius at most, one of each and its opposite, and zero."""

    def grow(left: int, k: int):
        if k == 0:
            yield ()
            return
        for d in range(-left, left + 1):
            for rest in grow(left - abs(d), k - 1):
                yield (d, *rest)

    return [d for d in grow(radius, parts) if d >= tuple(-x for x in d)]


def _neighbours(radius: int, parts: int):
    """Tiles (counts, sub, subs) to pairs (counts, sub, other): their own counts, and those within the radius."""
    bits, step = 64 // parts, 3 if parts == 16 else 7
    offsets = np.array(steps_within(radius, parts), np.int64)

    def run(batches):
        for b in batches:
            c, sub = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fields = (c[:, None] >> (step * np.arange(parts))) & ((1 << step) - 1)
            for k in range(0, len(c), 4096):
                to = fields[k : k + 4096, None, :] + offsets[None]
                fine = ((to >= 0) & (to <= min(bits, (1 << step) - 1))).all(2)
                row, which = np.nonzero(fine)
                other = (to[row, which] << (step * np.arange(parts))).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(c[k + row]), pa.array(sub[k + row]), pa.array(other)], ["counts", "sub", "other"])

    return run


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Of links between rows and columns, as many as keep together what they reach."""
    edges, row_open, column_open = [], near.any(1), near.any(0)
    for first in np.flatnonzero(row_open).tolist():
        if not row_open[first]:
            continue
        row_open[first], queue = False, [first]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(near[x] & column_open)
            column_open[new] = False
            for c in new.tolist():
                edges.append((x, c))
                more = np.flatnonzero(near[:, c] & row_open)
                row_open[more] = False
                edges += [(r, c) for r in more.tolist()]
                queue += more.tolist()
    return edges


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of two tiles, or within one, that span all links between them."""
    left, right = [], []
    for k in range(0, len(a), SLAB):
        near = np.bitwise_count(a[k : k + SLAB, None] ^ b[None]) <= radius
        if same:
            near &= np.arange(len(b))[None] > np.arange(k, min(k + SLAB, len(a)))[:, None]
        rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if len(rows):
            e = np.array(forest(near[np.ix_(rows, columns)]))
            left.append(a[k + rows[e[:, 0]]])
            right.append(b[columns[e[:, 1]]])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _compared(radius: int):
    def run(batches):
        for batch in batches:
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                x, y = tile_links(a.values.to_numpy().view(np.uint64), b.values.to_numpy().view(np.uint64), same, radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints (f), n in number, that span all pairs within the radius."""
    parts = parts_for(n)
    own = distinct.select("f", counts_of(F.col("f"), parts).alias("counts"))
    sizes = reliable(own.groupBy("counts").agg(F.ceil(F.count("*") / TILE).alias("subs")))
    # a frequent count is dealt to tiles before it is shuffled, not with all its fingerprints to one task
    dealt = own.join(small(sizes, sizes.count()), "counts").withColumn("sub", F.pmod(F.xxhash64("f"), F.col("subs")))
    tiles = stored(dealt.groupBy("counts", "sub").agg(F.collect_list("f").alias("fs"), F.first("subs").alias("subs")))
    directory = tiles.select("counts", "sub")
    pairs = directory.mapInArrow(_neighbours(radius, parts), "counts long, sub long, other long")
    pairs = pairs.join(directory.toDF("other", "other_sub"), "other").filter("counts <> other or sub <= other_sub")
    both = pairs.join(tiles.select("counts", "sub", F.col("fs").alias("x")), ["counts", "sub"])
    both = both.join(tiles.select(F.col("counts").alias("other"), F.col("sub").alias("other_sub"), F.col("fs").alias("y")), ["other", "other_sub"])
    rows = both.select("x", "y", ((F.col("counts") == F.col("other")) & (F.col("sub") == F.col("other_sub"))).alias("same"))
    return rows.mapInArrow(_compared(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id.

    Documents link if their fingerprints differ in radius bits or fewer; component_id is the smallest id that links
    reach, null only if a component has no other. A null text, and one without words, has the fingerprint zero and links
    like any other. A text with fewer words than a shingle is one shingle. Repeated rows and rows with one id are judged
    each by its text; other columns are ignored; an empty table gives an empty result. Texts are taken whole, in pieces.
    """
    own = stored(fingerprints(docs, id_col, text_col, words))
    distinct = reliable(own.groupBy("f").agg(F.min("id").alias("first")))
    n = distinct.count()
    found = components(reliable(links(distinct, n, radius).distinct()))
    named = distinct.join(found, F.col("f") == F.col("node"), "left").select("f", "first", F.coalesce("component", "f").alias("c"))
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    labels = reliable(named.join(least, "c").select("f", "component_id"))
    # fingerprints of over a thousandth of the rows, a thousand at most, go by broadcast, so that none meets in one task
    rows = own.groupBy("f").agg(F.count("*").alias("m"))
    limit = max(HOT_ROWS, own.count() // 1000)
    hot = labels.join(F.broadcast(rows.filter(F.col("m") > limit).select("f")), "f", "left_semi").select("f", F.col("component_id").alias("hot"), F.lit(True).alias("many"))
    dealt = own.join(F.broadcast(hot), "f", "left")
    done = dealt.filter("many").select("id", "f", F.col("hot").alias("component_id"))
    rest = dealt.filter("many is null").select("id", "f").join(small(labels, n), "f")
    out = done.unionByName(rest.select("id", "f", "component_id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints of more rows than this, and than a thousandth of all, are joined by broadcast.
HOT_ROWS = 1000


def op12_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=3)
