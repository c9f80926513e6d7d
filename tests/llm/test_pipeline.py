"""The pipeline on a small corpus with planted rejects, copies, near copies and repeated lines."""

import random
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from test_corpus_operators import corpus, lines_left, links, mutate, words

from twinlens.llm.common import reliable, stored
from twinlens.llm.jaccard_join import near_duplicate_stage
from twinlens.llm.line_dedup import line_stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    r = random.Random(1)
    vocabulary = {"aa": ["the", "thing", "when", "wher", "ing"], "bb": ["sch", "eine", "ung", "der", "zz"]}
    def make(k, n):
        return " ".join(r.choice(vocabulary[k]) + r.choice(vocabulary[k]) for _ in range(n))
    rows = [(i, make(k, r.randint(30, 60)), k, f"s{i % 2}") for i in range(40) for k in [r.choice(["aa", "bb"])]]
    line = make("aa", 8)
    rows += [(100, None, "aa", "s0"), (101, "123 !!", "bb", "s0"), (102, rows[0][1], rows[0][2], "s1"), (103, rows[1][1] + " x", rows[1][2], "s1"), (104, rows[2][1].replace(" ", " q ", 1), rows[2][2], "s0")]
    rows += [(110 + i, f"{line}\n{make('aa', 25)}", "aa", "s0") for i in range(4)]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA).select(*COLUMNS)
    folder = str(tmp_path / "tables")
    docs.write.parquet(f"{folder}/documents.parquet")

    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"stage{k}")
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        kept[name] = docs
        assert docs.columns == COLUMNS or k == len(corpus_pipeline.STAGES) - 1
    ids = {n: sorted(x.doc_id for x in d.select("doc_id").collect()) for n, d in kept.items()}
    assert ids["language ID"] == sorted(x[0] for x in rows if x[0] not in (100, 101))
    lines = {x.doc_id: x.text for x in kept["line dedup"].collect()}
    assert 102 not in lines and 103 not in lines and lines[110].startswith(line) and not any(lines[110 + i].startswith(line) for i in (1, 2, 3))
    assert kept["line dedup"].filter(F.char_length("text") != F.col("n_chars")).count() == 0
    assert ids["near duplicates"] == [i for i in ids["line dedup"] if i != 104]
    assert set(ids["mixing"]) <= set(ids["near duplicates"]) and max(ids["mixing"].count(i) for i in ids["mixing"]) <= 3
    fill = defaultdict(int)
    for p in kept["packing"].collect():
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 2048
    assert kept["packing"].filter("piece = 0").count() == len(ids["mixing"])


def test_one_row_of_each_near_duplicate_group_stays(spark, tmp_path):
    r = random.Random(5)
    make = lambda: [f"w{r.randrange(10**6)}" for _ in range(40)]
    a, b, c, d, e = (" ".join(make()) for _ in range(5))
    rows = [(1, a)] * 3 + [(2, b), (3, b + " x"), (3, c)]  # repeated rows; two texts under one doc_id, one in a group of a smaller one
    rows += [(None, d)] * 4 + [(None, d + " x"), (None, d + " y"), (9, e), (None, e + " x")]  # null ids alone, and with a doc_id
    rows += [(5, a + " x"), (7, c + " b"), (7, c + " a"), (20, None), (None, ""), (None, "")]
    f = " ".join(make())
    rows += [(8, f + " b"), (8, f + " a")]
    docs = spark.createDataFrame([(i, t, "aa", "s", len(t or "")) for i, t in rows], SCHEMA).select(*COLUMNS).repartition(3)
    kept = near_duplicate_stage(spark, docs, str(tmp_path))
    assert kept.columns == COLUMNS
    want = [(1, a), (2, b), (3, c), (None, d), (8, f + " a"), (9, e), (20, None), (None, ""), (None, "")]
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=repr) == sorted(want, key=repr)
    assert near_duplicate_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_dedup_stages_against_brute_force(spark, tmp_path):
    """Line dedup and near duplicates on a corpus with odd texts, repeated and mutated lines; further columns pass."""
    r = random.Random(11)
    rows = [(i, t, k, s) for i, t, k, s in corpus(3, 50)]
    lines = ["".join(r.choice("abcdefgh ") for _ in range(40)) for _ in range(6)]
    rows += [(200 + i, "\n".join(mutate(r, r.choice(lines), r.choice([0, 1, 3])) for _ in range(r.randint(1, 4))), "en", "s") for i in range(30)]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), 7, 5, "r") for x in rows], SCHEMA + ", n_near int, c int, _rest string").repartition(3)
    kept = line_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = {x.doc_id: x for x in kept.collect()}
    want = {i: t for i, (t, _, exact, close) in lines_left(rows).items() if exact + close == 0 or words(t)}
    assert {i: x.text for i, x in found.items()} == want and {(x.n_near, x.c, x._rest) for x in found.values()} == {(7, 5, "r")}
    near = near_duplicate_stage(spark, docs, str(tmp_path))
    top = links(rows, 5, 80)
    assert sorted(x.doc_id for x in near.collect()) == sorted(i for i, (_, c) in top.items() if i == c)
    for stage in (line_stage, near_duplicate_stage):
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_tables_leave_the_drivers_heap_as_small_as_it_was(spark):
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    for keep in (reliable, stored):
        size = min(heap.maxMemory() // 2, (1 << 31) - 64)
        held = spark._jvm.java.nio.ByteBuffer.allocate(size)
        grown = heap.totalMemory()
        assert grown > size
        del held
        assert keep(spark.range(3)).count() == 3
        assert heap.totalMemory() < grown and heap.totalMemory() - heap.freeMemory() < size
