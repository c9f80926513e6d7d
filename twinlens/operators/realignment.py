"""Local realignment: the haplotypes of a window, its reads' places on them, and what that says on the reference.

A window and its reads are of bounded size, and a task takes some windows at once. Reads are placed without gaps by the
k-mers they share with a haplotype, all reads of a window at once; the rest is aligned along anti-diagonals, those of many
windows at once. A place on a haplotype and the haplotype's alignment are composed base by base into a place and a CIGAR on
the reference.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores of a match, a mismatch, the first base of a gap and each further one; mismatches of a place without gaps; k.
MATCH, MISMATCH, OPEN, EXTEND = 4, 6, 8, 2
MOST_MISMATCHES, K = 2, 32
#: Pairs that are aligned at once, and bytes of their trace, about; windows and reads that a task gathers.
PAIRS_AT_ONCE, TRACE_BYTES, WINDOWS_AT_ONCE, READS_AT_ONCE = 512, 16 << 20, 128, 8192


def haplotypes(ref: str, reads: list[tuple[str, np.ndarray | list[int]]], min_k: int = 10, max_k: int = 101, min_bq: int = 15, min_weight: int = 2, most: int = 256) -> list[str]:
    """The paths of a de Bruijn graph of the reference and reads from its first to its last k-mer, sorted; none if the
    graph has cycles at every k or more paths than most. Reads break at odd or low-quality bases."""
    parts = []
    for seq, bq in reads:
        if not seq.strip("ACGT") and len(seq) == len(bq) and min(bq, default=min_bq) >= min_bq:
            parts.append(seq)
        else:
            parts += "".join(c if c in "ACGT" and q >= min_bq else " " for c, q in zip(seq, bq, strict=True)).split()
    for k in range(min_k, min(max_k, len(ref) - 1) + 1):
        mers = [ref[i : i + k] for i in range(len(ref) - k + 1)]
        if len(set(mers)) < len(mers):
            continue
        fixed = set(zip(mers, mers[1:], strict=False))
        weight = Counter(part[i : i + k + 1] for part in parts for i in range(len(part) - k))  # an edge is k + 1 bases
        out: dict[str, set[str]] = defaultdict(set)
        for edge, n in weight.items():
            if n >= min_weight:
                out[edge[:-1]].add(edge[1:])
        for a, b in fixed:
            out[a].add(b)
        state: dict[str, int] = {}
        cyclic = False
        stack = [(mers[0], iter(sorted(out[mers[0]])))]
        state[mers[0]] = 1
        while stack and not cyclic:
            node, rest = stack[-1]
            nxt = next(rest, None)
            if nxt is None:
                state[node] = 2
                stack.pop()
            elif state.get(nxt) == 1:
                cyclic = True
            elif nxt not in state:
                state[nxt] = 1
                stack.append((nxt, iter(sorted(out[nxt]))))
        if cyclic:
            continue
        paths, todo = [], [(mers[0], mers[0])]
        while todo:
            node, text = todo.pop()
            if node == mers[-1]:
                paths.append(text)
                if len(paths) > most:
                    return []
                continue
            todo += [(b, text + b[-1]) for b in out[node]]
            if len(todo) > 64 * most:
                return []
        return sorted(set(paths))
    return []


def _padded(texts: list[str], width: int, pad: int = 0) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.uint8)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode(), np.uint8)
    return out


def _mers(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of all k-mers of texts."""
    lengths = np.array([len(t) for t in texts], int)
    n = np.maximum(lengths - k + 1, 0)
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    if not len(of):
        return np.zeros(0, np.uint64), of, at
    power = np.cumprod(np.full(k, 0x9E3779B97F4A7C15, np.uint64))
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer("".join(texts).encode(), np.uint8).astype(np.uint64), k)
    return view[np.cumsum(lengths)[of] - lengths[of] + at] @ power, of, at


def places(hap: str, reads: list[str], index: tuple[np.ndarray, np.ndarray, np.ndarray], bare: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """The best score of each read on the haplotype without gaps, and its place; 0 and -1 if it has none.

    A place is tried if a k-mer there is shared; N fits any base. bare: with it, the haplotype counts for nothing if a
    base between so many first and last ones is in no place that was found up to it.
    """
    score, place = np.zeros(len(reads), int), np.full(len(reads), -1)
    h, _, i = _mers([hap], K)
    mers, of, at = index
    order = np.argsort(h, kind="stable")
    low, high = np.searchsorted(h[order], mers, "left"), np.searchsorted(h[order], mers, "right")
    n = high - low
    hit = np.repeat(np.arange(len(mers)), n)
    seen = i[order][np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    read, start = of[hit], np.maximum(0, seen - at[hit])
    lengths = np.array([len(r) for r in reads], int)
    fits = start + lengths[read] <= len(hap)
    read, start, seen = read[fits], start[fits], seen[fits]
    if len(read):
        order = np.lexsort((seen, start, read))  # one row for each place, with the first k-mer that shows it
        first = np.append(True, (np.diff(read[order]) != 0) | (np.diff(start[order]) != 0))
        read, start, seen = read[order][first], start[order][first], seen[order][first]
        width = int(lengths.max())
        own = _padded(reads, width)[read]
        target = np.frombuffer(hap.encode().ljust(len(hap) + width, b"N"), np.uint8)[start[:, None] + np.arange(width)]
        inside = np.arange(width) < lengths[read][:, None]
        off = (inside & (own != target) & (own != ord("N")) & (target != ord("N"))).sum(1)
        good = off <= MOST_MISMATCHES
        read, start, seen, off = read[good], start[good], seen[good], off[good]
        found = MATCH * (lengths[read] - off) - MISMATCH * off
        for r, s, f in sorted(zip(read.tolist(), start.tolist(), found.tolist(), strict=True), key=lambda x: (x[0], -x[2], x[1])):
            if place[r] < 0 and f > 0:
                score[r], place[r] = f, s
    if bare is not None:
        change = np.zeros(len(hap) + 1, int)
        if len(read):
            np.add.at(change, np.maximum(start, seen), 1)
            np.add.at(change, start + lengths[read], -1)
        depth = np.cumsum(change[:-1])
        if (depth[bare[0] : min(len(hap) - bare[1], len(hap) - K + 1)] == 0).any():
            return np.zeros(len(reads), int), np.full(len(reads), -1)
    return score, place


def align(queries: list[str], target: str) -> list[tuple[int, int, str]]:
    """align_pairs of queries to one target."""
    return align_pairs([(q, target) for q in queries])


def align_pairs(pairs: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Local alignments with affine gaps of a query to a target each: score, first place in the target, and a CIGAR with
    soft clips. Cells of an anti-diagonal do not depend on each other: each is one step, for all pairs at once."""
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    out, own, n, m = [(0, 0, "")] * len(pairs), [], 0, 0
    for k in order:
        q, t = map(len, pairs[k])
        wide, long = max(n, q), max(m, t)
        if own and (len(own) == PAIRS_AT_ONCE or (wide + long + 1) * (wide + 1) * (len(own) + 1) > TRACE_BYTES):
            for x, found in zip(own, _aligned([pairs[x] for x in own]), strict=True):
                out[x] = found
            own, wide, long = [], q, t
        own.append(k)
        n, m = wide, long
    for x, found in zip(own, _aligned([pairs[x] for x in own]) if own else [], strict=True):
        out[x] = found
    return out


def _aligned(pairs: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    queries, targets = [x for x, _ in pairs], [x for _, x in pairs]
    n, m, b = max(map(len, queries)), max(map(len, targets)), len(pairs)
    # no base is like another's padding, so that a cell there is below one before it and no best one
    q, t = _padded(queries, n).T.copy(), _padded(targets, m, 1).T[::-1].copy()
    kind = np.int16 if MATCH * min(n, m) < 1 << 14 else np.int32
    fit, miss, open_, extend, zero = (kind(x) for x in (MATCH, -MISMATCH, OPEN, EXTEND, 0))
    # rows are places in the query; what was never written is the border: 0 for h, far below for gaps
    h2, h1, h = (np.zeros((n + 1, b), kind) for _ in range(3))
    e1, e, f1, f = (np.full((n + 1, b), np.iinfo(kind).min // 2, kind) for _ in range(4))
    # of each cell, bits: 1 if h comes from the diagonal, 2 if from e, 4 if e opens here, 8 if f does, 16 if h is 0
    trace = np.full((n + m + 1, n + 1, b), 16, np.uint8)
    best, best_i, best_j = np.zeros(b, kind), np.zeros(b, int), np.zeros(b, int)
    bit = lambda x, k: x.view(np.uint8) << np.uint8(k)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1) + 1
        own, above = slice(lo, hi), slice(lo - 1, hi - 1)
        open_e, open_f = h1[above] - open_, h1[own] - open_
        np.maximum(open_e, e1[above] - extend, out=e[own])
        np.maximum(open_f, f1[own] - extend, out=f[own])
        bases = t[m - d + lo : m - d + hi]  # target places d - i, from the last to the first
        diagonal = h2[above] + np.where(q[above] == bases, fit, miss)
        v = np.maximum(np.maximum(diagonal, np.maximum(e[own], f[own])), zero, out=h[own])
        trace[d, own] = (v == diagonal).view(np.uint8) | bit(v == e[own], 1) | bit(e[own] == open_e, 2) | bit(f[own] == open_f, 3) | bit(v == zero, 4)
        value = v.max(0)
        some = np.flatnonzero((value >= best) & (value > 0))
        if len(some):
            row = lo + v[:, some].argmax(0)  # of equal cells of a diagonal the first in the query
            better = (value[some] > best[some]) | (row < best_i[some]) | ((row == best_i[some]) & (d - row < best_j[some]))
            some, row = some[better], row[better]
            best[some], best_i[some], best_j[some] = value[some], row, d - row
        h2, h1, h, e1, e, f1, f = h1, h, h2, e, e1, f, f1
    out = []
    for k in range(b):
        i, j, ops, state = int(best_i[k]), int(best_j[k]), [], 0
        tail = len(queries[k]) - i
        own = trace[:, :, k]
        while True:
            bits = own.item(i + j, i)
            if state == 0:
                if bits & 16:
                    break
                state = 1 if bits & 1 else 2 if bits & 2 else 3
                if state == 1:
                    ops.append("M")
                    i, j, state = i - 1, j - 1, 0
            elif state == 2:
                ops.append("I")
                i, state = i - 1, 0 if bits & 4 else 2
            else:
                ops.append("D")
                j, state = j - 1, 0 if bits & 8 else 3
        out.append((int(best[k]), j, _cigar("S" * i + "".join(ops[::-1]) + "S" * tail)))
    return out


def _cigar(ops: str) -> str:
    return "".join(f"{len(x[0])}{x[1]}" for x in re.findall(r"((.)\2*)", ops))


def _columns(cigar: str, start: int) -> np.ndarray:
    """The target place of each query base: -1 where it is inserted, -2 where it is clipped."""
    out, at = [], start
    for n, op in re.findall(r"(\d+)([MIDS=X])", cigar):
        n = int(n)
        if op in "M=X":
            out.append(np.arange(at, at + n))
            at += n
        elif op == "D":
            at += n
        else:
            out.append(np.full(n, -1 if op == "I" else -2))
    return np.concatenate(out) if out else np.zeros(0, int)


def project(read_cigar: str, read_place: int, hap_cigar: str, hap_place: int) -> tuple[int, str] | None:
    """Where a read is on the reference, and its CIGAR there, from its alignment to a haplotype and the haplotype's to
    the reference; none if no base of it has a place there. A deletion of what the haplotype inserts is nothing."""
    return _projected(read_cigar, read_place, _columns(hap_cigar, hap_place))


def _projected(read_cigar: str, read_place: int, hap: np.ndarray) -> tuple[int, str] | None:
    if read_cigar[:-1].isdigit() and read_cigar[-1] == "M":
        there = hap[read_place : read_place + int(read_cigar[:-1])]
        if len(there) == int(read_cigar[:-1]) > 0 and there[-1] - there[0] == len(there) - 1 and there.min() >= 0:
            return int(there[0]), read_cigar  # no gap of the haplotype is in between
    own = _columns(read_cigar, read_place)
    known = (own >= 0) & (own < len(hap))
    at = np.where(own >= 0, -2, own)
    at[known] = hap[own[known]]
    aligned = np.flatnonzero(at >= 0)
    if not len(aligned):
        return None
    ops, last = [], None
    for x in at.tolist():
        if x >= 0:
            if last is not None and x > last + 1:
                ops.append("D" * (x - last - 1))
            last = x
            ops.append("M")
        else:
            ops.append("I" if x == -1 else "S")
    text = "".join(ops)
    # what is inserted before the first or after the last aligned base is clipped, as are clips between
    first, end = text.index("M"), text.rindex("M")
    middle = text[first : end + 1].replace("S", "I")
    return int(at[aligned[0]]), _cigar("S" * first + middle + "S" * (len(text) - end - 1))


def realign_window(ref: str, start: int, prefix: int, suffix: int, seqs: list[str], quals: list[list[int]]) -> list[tuple | None]:
    """realign_windows of one."""
    return realign_windows([(ref, start, prefix, suffix, seqs, quals)])[0]


def realign_windows(windows: list[tuple]) -> list[list[tuple | None]]:
    """(haplotype, score, pos, cigar) of each read of windows (ref, start, prefix, suffix, seqs, quals), none for reads that
    stay as they are.

    ref begins at the place start; its first prefix and last suffix bases only lend context. Of equal scores a haplotype
    other than the reference wins, then the one that all reads together fit better.
    """
    placed, pairs = [], {}
    for ref, _, prefix, suffix, seqs, quals in windows:
        centre = ref[prefix : len(ref) - suffix]
        found = haplotypes(centre, list(zip(seqs, quals, strict=True)))
        haps = [ref[:prefix] + h + ref[len(ref) - suffix :] for h in found] or [ref]
        index = _mers([s if len(s) > K else "" for s in seqs], K)
        scores, spots = zip(*(places(hap, seqs, index, None if hap == ref else (prefix, suffix)) for hap in haps), strict=True)
        fits = [int(s.sum()) for s in scores]
        open_ = [k for k in range(len(seqs)) if seqs[k] and not any(s[k] > 0 for s in scores)]
        pairs |= {(seqs[k], hap): None for hap, fit in zip(haps, fits, strict=True) if fit for k in open_}  # a haplotype without any read is none
        pairs |= {(hap, ref): None for hap in haps if hap != ref}
        placed.append((haps, scores, spots, fits, open_))
    aligned = dict(zip(pairs, align_pairs(list(pairs)), strict=True))
    out = []
    for (ref, start, _, _, seqs, _), (haps, scores, spots, fits, open_) in zip(windows, placed, strict=True):
        cigars = [[f"{len(x)}M" for x in seqs] for _ in haps]
        for hap, s, p, c, fit in zip(haps, scores, spots, cigars, fits, strict=True):
            for k in open_ if fit else ():
                value, at, cigar = aligned[seqs[k], hap]
                if value > 0:
                    s[k], p[k], c[k] = value, at, cigar
        on_ref = [_columns(f"{len(ref)}M", 0) if h == ref else _columns(aligned[h, ref][2], aligned[h, ref][1]) for h in haps]
        found = []
        for k in range(len(seqs)):
            best = max(range(len(haps)), key=lambda h: (scores[h][k], haps[h] != ref, fits[h], haps[h]))
            there = _projected(cigars[best][k], int(spots[best][k]), on_ref[best]) if scores[best][k] > 0 else None
            found.append((haps[best], int(scores[best][k]), start + there[0], there[1]) if there else None)
        out.append(found)
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in the order of windows as tables of whole windows, some at once."""
    held, n = [], 0
    for b in batches:
        while b.num_rows:
            w = b.column("window")
            last = held[-1].column("window")[-1] if held else w[0]
            starts = np.flatnonzero([True, *(x != y for x, y in zip(w[1:].to_pylist(), w[:-1].to_pylist(), strict=True))])
            if last == w[0]:
                starts = starts[1:]  # the first goes on
            full = [x for k, x in enumerate(starts.tolist()) if n + x >= READS_AT_ONCE or k >= WINDOWS_AT_ONCE]
            cut = full[0] if full else b.num_rows
            if cut:
                held.append(b.slice(0, cut))
                n += cut
            if full:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            b = b.slice(cut)
    if held:
        yield pa.Table.from_batches(held)


def realign(reads: DataFrame, windows: DataFrame, most_reads: int = 1000, most_bases: int = 1000) -> DataFrame:
    """Every read of reads (window, qname, seq, quals, rank, pos, cigar) with its haplotype and score, and its place and
    CIGAR on the reference; both are null, and pos and cigar as they were, for a read that stays as it is.

    windows has (window, start, ref), and prefix and suffix where the ends of ref only lend context. Windows of more than
    most_bases, reads of a rank above most_reads and reads without a window stay as they are, which bounds a window's
    reads; a task gathers windows up to a number of reads.
    """
    zero = F.lit(0)
    few = windows.filter(F.length("ref") <= most_bases).select(
        "window", "start", "ref", *((F.coalesce(c, zero) if c in windows.columns else zero).alias(c) for c in ("prefix", "suffix"))
    )
    joined = reads.join(few, "window", "left").withColumn("open", F.col("ref").isNotNull() & (F.col("rank") <= most_reads))
    kind = {c: reads.schema[c].dataType.simpleString() for c in ("window", "qname", "pos")}
    schema = f"window {kind['window']}, qname {kind['qname']}, haplotype string, score long, pos {kind['pos']}, cigar string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            w = rows.column("window").to_pylist()
            starts = [k for k in range(len(w)) if not k or w[k] != w[k - 1]]
            seqs, quals = rows.column("seq").to_pylist(), rows.column("quals").combine_chunks()
            ends, flat = np.cumsum(quals.value_lengths().to_numpy(zero_copy_only=False)), quals.flatten().fill_null(0).to_numpy(zero_copy_only=False).tolist()
            some = []
            for a, z in zip(starts, [*starts[1:], len(w)], strict=True):
                ref, start, prefix, suffix = (rows.column(c)[a].as_py() for c in ("ref", "start", "prefix", "suffix"))
                some.append((ref, int(start), int(prefix), int(suffix), seqs[a:z], [flat[(ends[k - 1] if k else 0) : ends[k]] for k in range(a, z)]))
            new = [x for one in realign_windows(some) for x in one]
            pos, cigar = rows.column("pos").to_pylist(), rows.column("cigar").to_pylist()
            columns = zip(*(x if x else (None, None, p, c) for x, p, c in zip(new, pos, cigar, strict=True)), strict=True)
            moved = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), rows.schema.field("pos").type, pa.string()), strict=True)]
            out = [rows.column("window").combine_chunks(), rows.column("qname").combine_chunks(), *moved]
            yield pa.RecordBatch.from_arrays(out, ["window", "qname", "haplotype", "score", "pos", "cigar"])

    columns = ("window", "qname", "seq", "quals", "rank", "pos", "cigar", "start", "ref", "prefix", "suffix")
    dealt = joined.filter("open").select(*columns).repartition("window").sortWithinPartitions("window", "rank", "qname")
    none = F.lit(None)
    return dealt.mapInArrow(run, schema).unionByName(joined.filter("not open").select("window", "qname", none.cast("string").alias("haplotype"), none.cast("long").alias("score"), "pos", "cigar"))
