"""Removal of repeated byte strings by suffix sorting, deep-shallow.

Every 50-byte string has an anchor: the substring of ANCHOR bytes with the smallest hash, the leftmost of equal ones.
Equal strings have equal anchors at the same place, so strings meet by their anchors' keys, and strings whose anchor
occurs in one document only are settled without being sent anywhere.

1. Documents are dealt into blocks; a block hands on the keys of its anchors, each once.
2. Keys that occur in two documents go back to their blocks.
3. A block hands on the stretches of text around these anchors, each distinct one once, with its smallest document.
4. Stretches with one key meet, and the suffixes that start their 50-byte strings are sorted: multikey quicksort over
   8-byte characters to a shallow depth, then blind tries for the groups that are still tied. A class of equal strings
   gets its smallest document.
5. These go back to the blocks, which remove the bytes that they cover.

All steps are one query, so that the documents are shuffled once and the exchange is used again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import table

#: Bytes of a string that counts as repeated, and of its anchor.
LENGTH, ANCHOR = 50, 20
#: Depth of the multikey quicksort; two of its 8-byte characters.
SHALLOW = 16
#: Bytes of text in a block, and of anchors or stretches in a bucket, about.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20


def words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number; raw is followed by zeros."""
    padded = np.concatenate([raw, np.zeros(LENGTH + 8, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(raw: np.ndarray, bounds: np.ndarray, length: int = LENGTH, k: int = ANCHOR):
    """Runs of strings with one anchor: key, first and last start of a string, index of the document.

    bounds has the places at which documents begin, and the end; no string crosses them.
    """
    n = len(raw) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    w = words_at(raw)
    m = len(raw) - k + 1
    h = _mixed(w[:m] * np.uint64(0x9E3779B97F4A7C15) ^ _mixed(w[8 : 8 + m] + _mixed(w[k - 8 : k - 8 + m])))
    bits = np.uint64(max(1, int(len(raw)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = (h & ~low) | np.arange(m, dtype=np.uint64)
    span, have = length - k + 1, 1  # sliding minimum over span values, by doubling
    while 2 * have <= span:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < span:
        v = np.minimum(v[: len(v) - (span - have)], v[span - have :])
    place = (v[:n] & low).astype(np.int64)
    doc = np.searchsorted(bounds, np.arange(n), side="right") - 1
    inside = np.arange(n) + length <= bounds[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], n) - 1
    last = np.minimum(last, bounds[doc[starts] + 1] - length)  # strings at a document's end don't fit
    ok = inside[starts]
    starts, last = starts[ok], last[ok]
    return h[place[starts]], starts, last, doc[starts]


def sort_suffixes(w: np.ndarray, starts: np.ndarray, limit: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """starts in the order of the first limit bytes from them on, and which of them begin a class of equal strings.

    w has the 8 bytes from each position on.
    """
    first = w[starts]
    order = np.argsort(first, kind="stable")
    starts, first = starts[order], first[order]
    head = np.ones(len(starts), bool)
    head[1:] = first[1:] != first[:-1]
    for depth in range(8, shallow, 8):  # multikey quicksort: tied groups by their next character
        slots, group = _tied(head, np.zeros(len(head), bool))
        if not len(slots):
            return starts, head
        key = w[starts[slots] + depth]
        perm = np.lexsort((key, group))
        starts[slots], key = starts[slots][perm], key[perm]
        head[slots[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
    done = np.zeros(len(starts), bool)
    while True:  # blind tries: members of a group branch off its first member's path
        slots, group = _tied(head, done)
        if not len(slots):
            return starts, head
        own = starts[slots]
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        path = own[lead][group - group[0] if len(lead) == 1 else np.cumsum(np.append(False, group[1:] != group[:-1]))]
        common, below = _common(w, own, path, shallow, limit)
        byte = (w[np.minimum(own + common, len(w) - 1)] >> np.uint64(56)).astype(np.int64)
        equal = common >= limit
        branch = np.where(equal, limit * 256, np.where(below, common * 256 + byte, (2 * limit - common) * 256 + byte))
        key = group * (1 << 17) + branch
        perm = np.argsort(key, kind="stable")
        starts[slots], key, equal = own[perm], key[perm], equal[perm]
        head[slots[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])
        done[slots[equal]] = True


def _tied(head: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in groups of two or more that are not done, and their groups' numbers."""
    group = np.cumsum(head)
    alone = head & np.append(head[1:], True)
    slots = np.flatnonzero(~alone & ~done)
    return slots, group[slots]


def _common(w: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Common bytes of the strings at a and b, which share the first depth bytes, and if a's is the smaller one."""
    common = np.full(len(a), limit, np.int64)
    below = np.zeros(len(a), bool)
    left = np.arange(len(a))
    for at in [*range(depth, limit - 8, 8), limit - 8]:
        x, y = w[a[left] + at], w[b[left] + at]
        differ = x ^ y
        odd = np.flatnonzero(differ)
        if len(odd):
            d = differ[odd]
            zero = np.zeros(len(d), np.int64)
            for byte in range(1, 8):
                zero += d < (np.uint64(1) << np.uint64(64 - 8 * byte))
            common[left[odd]] = at + zero
            below[left[odd]] = x[odd] < y[odd]
            left = np.delete(left, odd)
        if not len(left):
            break
    return common, below


def _content(raw: bytes, first: int, last: int) -> bytes:
    return raw[first : last + LENGTH]


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=8).digest()


class Block:
    """A block's documents as one array of bytes, in chunks, with the runs of strings by anchor."""

    def __init__(self, frame: pd.DataFrame):
        self.ids = frame["id"].to_numpy()
        self.texts = [t.encode() for t in frame["text"]]
        self.raw = b"".join(self.texts)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in self.texts])]).astype(np.int64)
        parts, lo = [], 0
        while lo < len(self.texts):
            hi = max(lo + 1, int(np.searchsorted(self.bounds, self.bounds[lo] + (1 << 20), side="right")) - 1)
            at = self.bounds[lo]
            k, first, last, doc = anchors(np.frombuffer(self.raw[at : self.bounds[hi]], np.uint8), self.bounds[lo : hi + 1] - at)
            parts.append((k, first + at, last + at, doc + lo))
            lo = hi
        self.keys, self.first, self.last, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True))


def _split(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The places of each bucket's keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))


def _hand_on_keys(buckets: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        b = Block(frame)
        keys, ids = b.keys, b.ids[b.doc]
        order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        keys, twice = keys[at], np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at) if len(at) else new
        parts = [(i, p) for i, p in enumerate(_split(keys, buckets)) if len(p)]
        return pd.DataFrame({
            "bucket": [i for i, _ in parts], "block": [key[0]] * len(parts),
            "keys": [keys[p].tobytes() for _, p in parts], "twice": [np.packbits(twice[p]).tobytes() for _, p in parts],
        })

    return run


def _repeated_keys(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    keys = [np.frombuffer(k, np.uint64) for k in frame["keys"]]
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(k)) for t, k in zip(frame["twice"], keys, strict=True)]).astype(bool)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # one bit for a key that other blocks have is enough for those that have it in one document only
    live = [k[m] for k, m in zip(keys, np.split(twice, np.cumsum([len(k) for k in keys])[:-1]), strict=True)]
    some = [i for i, k in enumerate(live) if len(k)]
    return pd.DataFrame({"block": frame["block"].to_numpy()[some], "keys": [live[i].tobytes() for i in some]})


def _hand_on_stretches(buckets: int):
    def run(key: tuple, frame: pd.DataFrame, live: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", "block", "texts", "sizes", "keys", "low", "high"]
        if not len(frame) or not len(live):
            return pd.DataFrame({n: [] for n in names})
        b = Block(frame)
        found = np.flatnonzero(np.isin(b.keys, np.concatenate([np.frombuffer(k, np.uint64) for k in live["keys"]])))
        own: dict[bytes, list] = {}
        rows = zip(b.first[found].tolist(), b.last[found].tolist(), b.keys[found].tolist(), b.ids[b.doc[found]].tolist(), strict=True)
        for first, last, k, i in rows:
            x = own.setdefault(_content(b.raw, first, last), [k, i, i])
            if i < x[1]:
                x[1] = i
            elif i > x[2]:
                x[2] = i
        texts = list(own)
        keys, low, high = np.array([x[0] for x in own.values()], np.uint64), np.array([x[1] for x in own.values()], np.int64), np.array([x[2] for x in own.values()], np.int64)
        out = []
        for i, p in enumerate(_split(keys, buckets)):
            if len(p):
                part = [texts[j] for j in p]
                out.append((i, key[0], zstandard.compress(b"".join(part), 3), np.array([len(x) for x in part], np.int32).tobytes(), keys[p].tobytes(), low[p].tobytes(), high[p].tobytes()))
        return pd.DataFrame(dict(zip(names, zip(*out, strict=True), strict=True))) if out else pd.DataFrame({n: [] for n in names})

    return run


def _smallest_documents(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Runs of strings of each block's stretches that occur in a document before the block's last one with them."""
    place: dict[bytes, int] = {}
    owner, low, high, block, keys = [], [], [], [], []
    for r in frame.itertuples():
        ends = np.cumsum(np.frombuffer(r.sizes, np.int32)).tolist()
        at, stretches = 0, zstandard.decompress(r.texts)
        for end in ends:
            owner.append(place.setdefault(stretches[at:end], len(place)))
            at = end
        low.append(np.frombuffer(r.low, np.int64))
        high.append(np.frombuffer(r.high, np.int64))
        keys.append(np.frombuffer(r.keys, np.uint64))
        block.append(np.full(len(ends), r.block))
    owner, low, high, keys, block = np.array(owner), *map(np.concatenate, (low, high, keys, block))
    texts = list(place)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, owner, low)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    n = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    starts = begin[of] + offset
    w = words_at(np.frombuffer(b"".join(texts), np.uint8))
    order, head = sort_suffixes(w, starts.copy())
    text_of = np.searchsorted(begin, order, side="right") - 1
    classes = np.flatnonzero(head)
    low_of = np.repeat(np.minimum.reduceat(least[text_of], classes), np.diff(np.append(classes, len(order))))
    # back in the order of the texts, as runs of one smallest document
    answer = np.empty(int(begin[-1] + sizes[-1]), np.int64)
    answer[order] = low_of
    answer = answer[starts]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (answer[1:] != answer[:-1])
    run = np.flatnonzero(new)
    run_text, run_at, run_low = of[run], offset[run], answer[run]
    run_n = np.diff(np.append(run, len(of)))
    digest = [_digest(t) for t in texts]
    runs = np.searchsorted(run_text, np.arange(len(texts) + 1))
    out = []
    for b in np.unique(block):
        mine = np.flatnonzero(block == b)
        many = runs[owner[mine] + 1] - runs[owner[mine]]
        row = np.repeat(mine, many)
        r = runs[owner[row]] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        good = run_low[r] < high[row]
        row, r = row[good], r[good]
        if len(row):
            out.append((int(b), keys[row].tobytes(), b"".join(digest[owner[i]] for i in row), run_at[r].astype(np.int32).tobytes(), run_n[r].astype(np.int32).tobytes(), run_low[r].tobytes()))
    names = ["block", "keys", "digests", "at", "n", "low"]
    return pd.DataFrame(dict(zip(names, zip(*out, strict=True), strict=True))) if out else pd.DataFrame({k: [] for k in names})


def _remove(key: tuple, frame: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    if not len(frame):
        return pd.DataFrame({k: [] for k in ("id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")})
    b = Block(frame)
    change = np.zeros(len(b.raw) + 1, np.int32)
    if len(found):
        runs: dict[tuple, list] = {}
        for r in found.itertuples():
            columns = np.frombuffer(r.keys, np.uint64).tolist(), np.frombuffer(r.at, np.int32).tolist(), np.frombuffer(r.n, np.int32).tolist(), np.frombuffer(r.low, np.int64).tolist()
            for i, (k, at, n, low) in enumerate(zip(*columns, strict=True)):
                runs.setdefault((k, r.digests[8 * i : 8 * i + 8]), []).append((at, n, low))
        keys = np.unique(np.array([k for k, _ in runs], np.uint64))
        some = np.flatnonzero(np.isin(b.keys, keys))
        rows = zip(b.first[some].tolist(), b.last[some].tolist(), b.keys[some].tolist(), b.ids[b.doc[some]].tolist(), strict=True)
        ups, downs = [], []
        for first, last, k, i in rows:
            for at, n, low in runs.get((k, _digest(_content(b.raw, first, last))), ()):
                if low < i:
                    ups.append(first + at)
                    downs.append(first + at + n - 1 + LENGTH)
        np.add.at(change, np.array(ups, np.int64), 1)
        np.add.at(change, np.array(downs, np.int64), -1)
    gone = np.cumsum(change[:-1]) > 0
    raw, out = np.frombuffer(b.raw, np.uint8), []
    for i, lo, hi in zip(b.ids.tolist(), b.bounds[:-1].tolist(), b.bounds[1:].tolist(), strict=True):
        g = gone[lo:hi]
        spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
        kept = raw[lo:hi][~g].tobytes()
        out.append((i, hi - lo, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes, what is left.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id. A null text is
    empty; texts shorter than LENGTH stay. Rows with one id are one document to each other: none removes from another.
    A null id counts as the largest. An empty table gives an empty result; other columns are ignored. Ids are integers.
    """
    none = F.lit((1 << 63) - 1)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    key_buckets = max(1, -(-total // 2 // bucket_bytes))  # 8 bytes for every 16 of text
    stretch_buckets = max(1, -(-total // bucket_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(blocks)))
    keys = dealt.groupBy("block").applyInPandas(_hand_on_keys(key_buckets), "bucket long, block long, keys binary, twice binary")
    live = keys.groupBy("bucket").applyInPandas(_repeated_keys, "block long, keys binary")
    stretches = dealt.groupBy("block").cogroup(live.groupBy("block")).applyInPandas(
        _hand_on_stretches(stretch_buckets), "bucket long, block long, texts binary, sizes binary, keys binary, low binary, high binary"
    )
    found = stretches.groupBy("bucket").applyInPandas(_smallest_documents, "block long, keys binary, digests binary, at binary, n binary, low binary")
    left = dealt.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(
        _remove, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"
    )
    return left.select(F.when(F.col("id") != none, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_bytes")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 999) // 1000)) AS k FROM d),
w AS (SELECT doc_id, 1000 * k AS o, substr(h, 2000 * k + 1, 2098) AS h, least(1000, length(h) // 2 - 1000 * k) AS n FROM q),
p AS (SELECT doc_id, o, h, unnest(range(0, n)) AS j FROM w),
g AS (SELECT doc_id, o + j AS i, substr(h, 2 * j + 1, 2) AS b, CASE WHEN 2 * j + 100 <= length(h) THEN md5(substr(h, 2 * j + 1, 100)) END AS s FROM p),
f AS (SELECT s, min(doc_id) AS m FROM g WHERE s IS NOT NULL GROUP BY s),
c AS (SELECT g.doc_id, g.i, g.b, coalesce(max(CASE WHEN f.m < g.doc_id THEN g.i END) OVER (PARTITION BY g.doc_id ORDER BY g.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS gone FROM g LEFT JOIN f USING (s)),
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
