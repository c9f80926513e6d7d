"""The stages and verdicts that other tests leave: nulls, repeated rows, clashing names, empty tables, long texts."""

import functools
import hashlib
import math
import os
import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_corpus_operators import ODD, corpus

from twinlens.llm import common, quality_rules
from twinlens.llm.language_id import language_stage
from twinlens.llm.mixing import mixing_stage
from twinlens.llm.packing import packing_stage

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
MORE = ", s string, size string, h int, target double, at int, lang_pred string, _score int, piece int, length string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    """Rows (doc_id, text, lang, source), with columns whose names stages use themselves."""
    return spark.createDataFrame([(*x, len(x[1] or ""), "a", "b", 3, 4.0, 5, "c", 6, 7, "d") for x in rows], COLUMNS + MORE).repartition(3)


def some_rows(seed=3):
    rows = corpus(seed, 60)
    rows += [(None, "null id one two", "en", "s0"), (None, "null id one two", "en", "s0"), (None, None, None, None), (20, rows[20][1], rows[20][2], rows[20][3]), (20, "another text of it", "en", "s1")]
    return rows + [(900, "long words here " * 40_000, "en", "s2"), (901, "x" * 200_000, "fr", "s2")]


def plain(df):
    return Counter(tuple(r) for r in df.collect())


def test_mixing_stage(spark):
    rows = some_rows()
    d = frame(spark, rows)
    out = mixing_stage(spark, d, "")
    assert out.columns == d.columns
    got, had = plain(out), plain(d)
    size = lambda t: len(WORD.findall(t or ""))
    taken, whole, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row, n in had.items():
        assert got[row] % n == 0 and got[row] // n <= 3
        if not size(row[1]):
            assert got[row] == n
        taken[row[3]] += got[row] * size(row[1])
        whole[row[3]] += n * size(row[1])
        largest[row[3]] = max(largest[row[3]], n * size(row[1]))
    assert set(got) <= set(had)
    sources = sorted((s for s in whole if s is not None)) + ([None] if None in whole else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    held, left = {}, sum(whole.values())
    while True:
        rest = [s for s in sources if s not in held]
        over = [s for s in rest if 3 * whole[s] * sum(weight[x] for x in rest) < left * weight[s]]
        if not over:
            break
        for s in over:
            held[s] = 3 * whole[s]
        left = sum(whole.values()) - sum(held.values())
    for s in sources:
        want = held.get(s, left * weight[s] / max(1, sum(weight[x] for x in sources if x not in held)))
        assert abs(taken[s] - want) <= largest[s] / 2 + 1, (s, taken[s], want)
    assert plain(mixing_stage(spark, frame(spark, rows), "")) == got
    assert mixing_stage(spark, d.limit(0), "").count() == 0


def test_packing_stage(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = some_rows(4)
    want = Counter()
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    out = packing_stage(spark, frame(spark, rows), "").collect()
    assert Counter(tuple(r)[:5] for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in out)
    assert len(by) <= 1.05 * -(-total // 2048) + 2
    assert packing_stage(spark, frame(spark, rows).limit(0), "").count() == 0


def test_language_stage(spark):
    r = random.Random(2)
    words = {"aa": ["lo", "mi", "na", "ra"], "bb": ["sch", "ker", "tz", "uff"]}
    made = lambda k, n: " ".join(r.choice(words[k]) + r.choice(words[k]) for _ in range(n))
    rows = [(i, made(k, 40), k, "s") for i in range(60) for k in [r.choice(["aa", "bb"])]]
    clean = [*rows, (5, rows[5][1], rows[5][2], "s"), (None, made("aa", 30), "aa", "s"), (None, made("aa", 30), None, "s"), (80, made("bb", 9000), "bb", "s")]
    gone = [(90, None, "aa", "s"), (91, "", "aa", "s"), (92, "12 !? 34", "bb", "s"), (None, " \t", None, None)]
    d = frame(spark, clean + gone)
    out = language_stage(spark, d, "")
    assert out.columns == d.columns and plain(out) == plain(frame(spark, clean))
    assert language_stage(spark, d.limit(0), "").count() == 0


def js(p, q):
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return float(a != b)
    total = 0.0
    for k in set(p) | set(q):
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, total / 2))


def char_class(c):
    for name, members in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t"), ("newline", "\n\r\x0b\x0c"), ("stop", ".,;:!?'\"()-"), ("symbol", "#*$%&|<>")):
        if c in members:
            return name
    return "other" if ord(c) < 128 else "accented" if ord(c) < 0x800 else "wide"


@pytest.mark.parametrize("at_once", [1, 2, 200])
def test_quality_verdicts_by_brute_force(spark, monkeypatch, at_once):
    """Distances and verdicts of three languages and the null one, whose references are held some at once."""
    monkeypatch.setattr(quality_rules, "references", functools.partial(quality_rules.references, langs=at_once))
    r = random.Random(at_once)
    vocabulary = {k: ["".join(r.choice(x) for _ in range(r.randint(2, 7))) for _ in range(400)] for k, x in (("en", "abcdef"), ("fr", "éaiouß"), ("ja", "日本語あい"), (None, "xyzXYZ"))}
    rows = []
    for i in range(200):
        k = r.choice(list(vocabulary))
        from_ = r.choice([k, k, k, r.choice(list(vocabulary))])
        w = [r.choice(vocabulary[from_][: r.choice([20, 400])]) for _ in range(r.choice([5, 60, 120, 300]))]
        rows.append((i, "".join(x + r.choice([" ", " ", "\n", ". ", " # "]) for x in w), k, "s"))
    rows += [(500 + i, t, "en", "s") for i, t in enumerate(ODD)] + [(None, None, None, None), (7, rows[7][1], rows[7][2], "s")]
    classes, counts = defaultdict(Counter), defaultdict(Counter)
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for _, t, k, _ in rows:
        classes[k].update(map(char_class, t or ""))
        counts[k].update(WORD.findall(lower(t)))
    want = []
    for i, t, k, _ in rows:
        t = t or ""
        w = WORD.findall(lower(t))
        far = [js(Counter(map(char_class, t)), classes[k]) if len(t) >= 200 else 0.0, 0.0]
        if len(w) >= 100:
            top = {x for x, _ in sorted(counts[k].items(), key=lambda x: (-x[1], x[0].encode()))[:200]}
            fold = lambda c: Counter({**{x: n for x, n in c.items() if x in top}, "": sum(n for x, n in c.items() if x not in top)})  # noqa: B023, E731
            far[1] = js(fold(Counter(w)), fold(counts[k]))
        want.append((str(i), round(far[0], 9), round(far[1], 9), far[0] <= 0.3 and far[1] <= 0.52))
    got = quality_rules.quality(frame(spark, rows)).collect()
    found = sorted((str(x.doc_id), round(x.class_distance, 9), round(x.word_distance, 9)) for x in got)
    assert found == sorted(w[:3] for w in want)
    verdict = defaultdict(set)
    for w in want:
        verdict[w[0]].add(w[3])
    assert all(x.kept == (not x.base_failed and verdict[str(x.doc_id)] == {True}) for x in got if len(verdict[str(x.doc_id)]) == 1)
    assert 0 < sum(x.kept for x in got) and any(not w[3] for w in want)


def test_the_pipeline_leaves_its_last_table_only(spark, tmp_path, monkeypatch):
    rows = [(i, f"{hashlib.md5(str(i).encode()).hexdigest()} word {i} and more of them", "en", "s") for i in range(30)]
    spark.createDataFrame([(*x, len(x[1])) for x in rows], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    kept = lambda spark, docs, d: docs.filter("doc_id % 2 = 0")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", lambda s, docs, d: docs.checkpoint().filter("doc_id < 20")), ("b", kept), ("c", packing_stage)])
    before = corpus_pipeline.shared_folder(spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 20, 2))
    folder = out.inputFiles()[0].split("://")[-1].split(":", 1)[-1].rsplit("/", 2)[0]
    assert sorted(os.listdir(folder)) == ["2"] and corpus_pipeline.shared_folder(spark).startswith(before)


def test_a_worker_gives_back_what_its_task_has_held(monkeypatch):
    held, alive = [], []

    class Words:
        pass

    def kernel(batches):
        own = Words()
        held.append(weakref.ref(own))
        yield from batches

    monkeypatch.setattr(common, "give_back", lambda: alive.append(held[0]() is not None))
    assert list(common.tidy(kernel)([1, 2])) == [1, 2] and alive == [True, True, False]


@pytest.mark.parametrize("stage", [s for k, s in corpus_pipeline.STAGES if k in ("language ID", "near duplicates", "packing")])
def test_stages_hand_texts_over_in_small_batches(spark, stage):
    text = F.repeat(F.concat(F.md5(F.col("id").cast("string")), F.lit(" ")), 250)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(8250).alias("n_chars"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        stage(spark, docs, "")
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(x.n for x in got) == 2000 and max(x.size for x in got) < 6e6
        spark.conf.set(key, "1m")
        stage(spark, docs.limit(3), "")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)
