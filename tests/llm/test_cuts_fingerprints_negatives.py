"""Fill-in-the-middle, SimHash and hard negatives against brute force, with nulls, repeats, ties and odd texts."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinlens.llm import fill_in_middle, hard_negatives, simhash

SCHEMA = "doc_id long, text string, lang string, id long, h long, n int, f string, part int, form string, component_id int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "\n", "\n\n", "a", "a\n", "é\nß\r\n日本\n", "<P>x\ny", "x<S\n>y", "<M>", "<\nS>", "A b C", " \t", "x" * 9000, "one two three\n" * 3000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 2, 3, "x", 4, "plain", 5) for i, t in rows], SCHEMA).repartition(3)


def some_texts(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdéF") for _ in range(r.randint(1, 7))) for _ in range(40)]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 150))) for _ in range(8)]
    out = list(enumerate(ODD)) + [(3, "a"), (None, "a\nb\nc\n"), (None, "a\nb\nc\n"), (2, "é\nß\n"), (2, "é\nß\n")]
    for i in range(100, 100 + n):
        w = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 0, 1, 2, 9])):
            w[r.randrange(len(w))] = r.choice(words)
        out.append((i, "".join(x + r.choice("\n   ") for x in w)))
    return out


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute_cut(i, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), sha(f"7:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, n, "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return i, n, "spm" if h4 % 100 < spm else "psm", len(p), len(m), out


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (60, 100)])
def test_cuts(spark, rate, spm):
    rows = some_texts(1, 80)
    out = fill_in_middle.fill_in_middle(frame(spark, rows), rate=rate, spm=spm)
    found = out.select("*", fill_in_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r[:6]) for r in found), key=key) == sorted((brute_cut(i, t, rate, spm) for i, t in rows), key=key)
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)


def test_cuts_of_a_text_that_many_documents_have(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "HOT_ROWS", 20)
    rows = [(i, "one\ntwo\nthree\n" if i % 3 else f"{i}\nx\n") for i in range(300)]
    df = frame(spark, rows).repartition(12)
    assert fill_in_middle.distinct_texts(df).filter("text like 'one%'").count() > 1
    assert sorted(tuple(r) for r in fill_in_middle.fill_in_middle(df).collect()) == sorted(brute_cut(i, t) for i, t in rows)


def test_elias_fano():
    r = np.random.default_rng(3)
    for values in ([0], [5], [0, 0, 0], range(3000), np.cumsum(r.integers(0, 9, 5000)), np.cumsum(r.integers(0, 1 << 40, 2000)), [0, (1 << 52)]):
        v = np.array(list(values), np.int64)
        e = fill_in_middle.EliasFano(v)
        assert (e.select(np.arange(len(v))) == v).all()
    v = np.cumsum(r.integers(30, 90, 100_000))
    assert fill_in_middle.EliasFano(v).nbytes * 8 < 10.5 * len(v)


def brute_print(text, words):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("words", [1, 3, 5])
def test_fingerprints(words, monkeypatch):
    texts = [t for _, t in some_texts(4, 40)]
    want = [brute_print(t, words) for t in texts]
    assert [simhash.fingerprint(t, words) for t in texts] == want
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert [simhash.fingerprint(t, words) for t in texts] == want


def brute_components(ids, prints, radius):
    label = list(range(len(ids)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                label[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least.setdefault(find(k), []).append(i)
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_near_duplicates(spark):
    rows = some_texts(5, 150)
    prints = [brute_print(t, 3) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], [f"{p:016x}" for p in prints], brute_components([i for i, _ in rows], prints, 2), strict=True), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, rows), words=3).collect()), key=str) == want
    assert len({c for *_, c in want}) < len({p for _, p, _ in want})


@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16])
def test_tiles_keep_every_link(spark, monkeypatch, parts):
    r = random.Random(parts)
    values = {r.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1, 3}
    for v in list(values)[:40]:
        for _ in range(6):
            v ^= sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 2, 3])))
            values.add(v)
    values = sorted(values)
    monkeypatch.setattr(simhash, "parts_for", lambda n: parts)
    monkeypatch.setattr(simhash, "TILE", 3)
    monkeypatch.setattr(simhash, "SLAB", 2)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "f long"), len(values), 2).collect()
    at = {x: k for k, x in enumerate(signed)}
    assert all((values[at[a]] ^ values[at[b]]).bit_count() <= 2 for a, b in found)
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        label[find(at[a])] = find(at[b])
    want = brute_components(range(len(values)), values, 2)
    got = [find(k) for k in range(len(values))]
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got)) < len(values)


def test_forest_hands_on_few_links():
    a = np.arange(256, dtype=np.uint64)
    x, y = simhash.tile_links(a, a, True, 64)
    assert len(x) < 2 * len(a)


def test_parts_grow_with_the_table():
    assert [simhash.parts_for(n) for n in (1, 10**5, 10**7, 10**9, 10**12)] == [1, 2, 4, 8, 16]


def brute_negatives(rows, k=5, m=5):
    fine = [(n, i, lab, [math.floor(256 * float(x)) for x in v]) for n, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, lab, v in fine:
        if i is None or i % 100:
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), math.inf if j is None else j, o, other) for o, j, other, w in fine if o != n)
        for p, pid, *_ in [s for s in scored if s[3] == lab][:k]:
            inside = [s for s in scored if s[3] != lab and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(i, None if pid == math.inf else pid, rank + 1, None if j == math.inf else j, -p, -s) for rank, (s, j, *_) in enumerate(inside[:m])]
    return sorted(out, key=str)


def vectors(seed, n, dims=6, labels=3):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(4, dims))
    rows = []
    for i in range(n):
        v = centre[i % 4] + r.normal(size=dims) * r.choice([0.0, 0.1, 1.0])
        rows.append((i, [float(x) for x in np.float32(v / np.linalg.norm(v))], int(r.integers(labels))))
    rows += [(200, rows[100][1], 1), (300, rows[100][1], 1), (None, rows[0][1], 0), (None, rows[0][1], 1), (401, None, 1), (402, rows[3][1], None), (403, [], 1)]
    return rows + [(404, [1.0, None], 1), (405, [math.nan] * dims, 1), (406, [math.inf] * dims, 0), (500, [0.5], 2), (600, [-1.0] * dims, 0), (7, rows[7][1], 1)]


SHAPES = [(300, 16, 20), (300, 4, 3), (160, 256, 5)]


@pytest.mark.parametrize(("n", "leaf", "anchors"), SHAPES)
def test_hard_negatives(spark, monkeypatch, n, leaf, anchors):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rows = vectors(n + leaf, n)
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, row int, id string, a int, p int")
    found = hard_negatives.hard_negatives(df.coalesce(1), F.col("vec_id") % 100 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_negatives(rows)


def test_tree_bounds_hold():
    r = np.random.default_rng(9)
    x = np.floor(256 * r.normal(size=(500, 5)))
    square = int((x * x).sum(1).max())
    tree = hard_negatives.build(x, square, 16)
    assert sorted(np.concatenate(tree.leaves)) == list(range(500)) and len(tree.leaves) > 20
    q = x[:40]
    low, high = tree.bounds(q, square)
    away = np.sqrt((q * q).sum(1)[:, None] + square - 2 * q @ x.T)
    for k, own in enumerate(tree.leaves):
        assert (low[:, k] <= away[:, own].min(1) + 1e-6).all() and (high[:, k] >= away[:, own].max(1) - 1e-6).all()
    assert (hard_negatives._cells(tree, x, square) == np.repeat(np.arange(len(tree.leaves)), [len(o) for o in tree.leaves])[np.argsort(np.concatenate(tree.leaves))]).all()


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert fill_in_middle.fill_in_middle(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).count() == 0
