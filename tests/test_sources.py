"""Readers and writers over files, and small operators that no query has."""

import random

import pytest
from pyspark.sql import functions as F

from twinlens.functions import alleles
from twinlens.operators import calls, counts, evaluate, intervals, sampling, sequences, sites
from twinlens.sources import readers, writers


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "300")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block", [7, 64, 1000])
def test_references_in_splits(spark, small_splits, tmp_path, block):
    """Records over many splits, short ones, empty ones, odd lines, and headers at the ends of splits."""
    r = random.Random(block)
    want = {}
    for f in range(3):
        lines = ["left out"]
        for k in range(12):
            name, seq = f"c{f}_{k}", "".join(r.choice("acgtN") for _ in range(r.choice([0, 1, 59, 60, 61, 700, 2500])))
            lines.append(f">{name} of {r.choice(['x', 'y' * 200])}")
            at = 0
            while at < len(seq):
                n = r.choice([60, 60, 60, 1, 7])
                lines.append(seq[at : at + n] + r.choice(["", "", " ", "\r"]))
                at += n
            lines += [""] * r.choice([0, 0, 2])
            if seq:
                want[name] = seq.upper()
        (tmp_path / f"{f}.fa").write_text("\n".join(lines) + "\n")
    d = readers.fasta(spark, str(tmp_path), block)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = {}
    for x in d.orderBy("ctg", "start").collect():
        assert (x.start - 1) % block == 0 and len(got.get(x.ctg, "")) == x.start - 1
        got[x.ctg] = got.get(x.ctg, "") + x.seq
    assert got == want


def test_broken_pileup_lines(spark, tmp_path):
    (tmp_path / "p").write_text("chr1\t7\tN\t1\tA\tI\nchr1\t8\tN\t2\tAC\tI\n")
    assert readers.pileup(spark, str(tmp_path / "p"), "t").count() == 1
    with pytest.raises(Exception, match="differ in number at chr1:8"):
        readers.pileup(spark, str(tmp_path / "p"), "t", strict=True).collect()


def test_reads_that_align_little_are_left_out(spark, tmp_path):
    lines = [f"q{k}\t0\tchr1\t5\t60\t{c}\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII" for k, c in enumerate(["10M", "5M5I", "2S8M", "1M9I"])]
    (tmp_path / "r").write_text("\n".join(lines) + "\n")
    assert {x.qname for x in readers.sam(spark, str(tmp_path / "r"), min_aligned=0.5).collect()} == {"q0", "q1", "q2"}


def test_tables_of_sites(spark, tmp_path):
    (tmp_path / "1.hybrid_info").write_text("chr1\t5\tA\t3/4-XC 1/0\t9/9-\nchr2\t6\tC\n")
    (tmp_path / "other").write_text("chr9\t5\tA\tx\ty\n")
    assert sorted(map(tuple, readers.hybrid_info(spark, str(tmp_path)).collect())) == [("chr1", 5, "A", "3/4-XC 1/0", "9/9-"), ("chr2", 6, "C", None, None)]
    (tmp_path / "purity").write_text("Sample\tPurity\tPloidy\tGoodnessOfFit\nS1\t0.7\t2.1\t96.5\n")
    assert readers.purity(spark, str(tmp_path / "purity")).collect() == [("S1", 0.7, 2.1, 96.5)]
    (tmp_path / "tensors").write_text("chr1\t5\tACG\t1 2  3\tn\t4 -5 6\tt\tsomatic\nchr1\t6\tACG\t1\tn\t2\tt\n")
    got = readers.tensor_rows(spark, str(tmp_path / "tensors")).orderBy("pos").collect()
    assert got[0][:4] == ("chr1", 5, "ACG", [1.0, 2.0, 3.0]) and got[0].tumor == [4.0, -5.0, 6.0] and got[0].kind == "somatic" and got[1].kind is None
    (tmp_path / "fractions").write_text("chr1\t5\tA\t40\t0.5,0.25\tA:0.5 A+C:0.25\tC:0.1\thet,x\n")
    x = readers.fraction_table(spark, str(tmp_path / "fractions")).first()
    assert (x.depth, x.fractions, x.alleles, x.tumor_alleles, x.tags) == (40, [0.5, 0.25], {"A": 0.5, "A+C": 0.25}, {"C": 0.1}, ["het", "x"])
    depth = spark.createDataFrame([("a", 10), ("a", 20), ("b", 60)], "ctg string, depth long")
    assert {r.ctg: r.depth for r in readers.mean_depth(depth).collect()} == {"a": 15.0, "b": 60.0, "total": 30.0}


def test_headers_keep_their_last_line():
    head = writers.vcf_header([("chr1", 9)], "run")
    got = writers.add_to_header(head, ["##new=1", head[1], "##new=1", "##more=2"])
    assert got[-1] == head[-1] and got[-3:-1] == ["##new=1", "##more=2"] and len(got) == len(head) + 2


def test_written_folders(spark, tmp_path):
    d = spark.createDataFrame([(c, 100 * k) for c in ("a", "b") for k in range(1, 26)], "ctg string, pos long")
    writers.write_windows(d.coalesce(1), str(tmp_path / "w"), flank=16, rows=10)
    back = spark.read.parquet(str(tmp_path / "w"))
    assert back.count() == 50 and back.filter("end - start <> 34 or (start + 17) % 100 <> 0").count() == 0
    assert len(list((tmp_path / "w" / "ctg=a").glob("*.parquet"))) == 3 and back.filter("ctg = 'b'").count() == 25
    o = spark.createDataFrame([("tp", 1), ("fp", 2), ("tp", 3)], "outcome string, pos long")
    writers.write_outcomes(o, str(tmp_path / "o"))
    assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "o" / "outcome=tp")).collect()) == [1, 3]
    writers.write_table(o.coalesce(1), str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect())) == [("fp", "2"), ("tp", "1"), ("tp", "3")]


def test_supported_variants(spark):
    v = spark.createDataFrame([("a", 1, "A", "T", "0/1"), ("a", 2, "A", "T", "0/1"), ("a", 3, "A", "G", "1/1")], "ctg string, pos long, ref string, alt string, gt string")
    obs = spark.createDataFrame([("a", 1, "T", 10, 40, 0), ("a", 1, "T", 60, 40, 0), ("a", 2, "A", 60, 40, 4), ("a", 3, "G", 60, 9, 1)], "ctg string, pos long, allele string, mq int, bq int, flag int")
    assert {r.pos: r.gt for r in calls.supported(v, obs).collect()} == {1: "0/1", 2: None, 3: "1/1"}
    assert {r.pos: r.gt for r in calls.supported(v, counts.usable(obs, min_bq=10)).collect()} == {1: "0/1", 2: None, 3: None}
    assert [(r.pos, r.mq) for r in counts.usable(obs).orderBy("pos").collect()] == [(1, 60), (3, 60)]
    assert [r.pos for r in sites.distinct_positions(obs).collect()] == [1, 2, 3]


def test_probes_get_the_mean_of_what_is_nearest(spark):
    p = spark.createDataFrame([("c", 10), ("c", 20), ("c", 40)], "ctg string, pos long")
    v = spark.createDataFrame([("c", x, float(x)) for x in (1, 15, 16, 30, 31, 99)], "ctg string, at long, value double")
    got = {r.pos: (r.mean, r.n) for r in sequences.nearest_probe_mean(p, v).collect()}
    assert got == {10: (8.0, 2), 20: (23.0, 2), 40: (65.0, 2)}


def test_small_operators(spark):
    d = spark.createDataFrame([("chr1", 4, 9), ("chr1", None, 9), ("chr1", None, None)], "ctg string, start long, end long")
    assert [r[0] for r in d.select(alleles.region_string(F.col("ctg"), F.col("start"), F.col("end"))).collect()] == ["chr1:4-9", "chr1", "chr1"]
    k = spark.createDataFrame([(s, h) for s in ("normal", "tumor", "x") for h in (0, 1, 2)], "s string, h int")
    assert [r[0] for r in k.select(alleles.haplotype_code(F.col("s"), F.col("h"))).collect()] == [-60, -90, -30, 60, 30, 90, 0, 0, 0]
    i = spark.createDataFrame([("c", 0, 10), ("c", 0, 4)], "ctg string, start long, end long")
    assert [(r.start, r.end) for r in intervals.pad_inward(i, 2).collect()] == [(2, 8)]
    v = spark.createDataFrame([("A", "C"), ("A", "CT"), ("AG", "C"), ("G", "T")], "ref string, alt string")
    assert {r.kind: r.n for r in evaluate.type_counts(v).collect()} == {"SNV": 2, "INS": 1, "DEL": 1}
    t = spark.range(4000).withColumn("s", F.lit("t"))
    m = sampling.mix_reads(t, t.withColumn("s", F.lit("n")), "id", 0.25, 0.5, 3)
    n = {r.s: r["count"] for r in m.groupBy("s").count().collect()}
    assert abs(n["t"] - 1000) < 120 and abs(n["n"] - 2000) < 120 and m.count() == sampling.mix_reads(t, t.withColumn("s", F.lit("n")), "id", 0.25, 0.5, 3).count()


def test_a_region_opens_its_parts_only(spark, tmp_path):
    rows = [(c, p, "A", "T", 9.0, "PASS", "0/0" if p % 5 == 0 else "0/1") for c in ("chr1", "chr10", "chr2", "other") for p in (*range(1, 40_000, 97), 3_000_000, 900_000_000)]
    d = spark.createDataFrame(rows, "ctg string, pos long, ref string, alt string, qual double, filter string, gt string")
    path = str(tmp_path / "v")
    writers.write_indexed_vcf(d.repartition(3), path, {"GT": "gt"}, [("chr1", 10**9)], parts=12, show_reference=True, gzip=True)
    files = len(list((tmp_path / "v").glob("part-*.gz")))
    assert files > 8 and spark.read.text(path).filter("value not like '#%'").count() == len(rows)
    for c, a, b in (("chr1", 1, 500), ("chr2", 16_300, 16_500), ("chr10", 39_000, 899_999_999), ("other", 900_000_000, 900_000_000), ("chr2", 1, 1 << 31), ("chr1", 2, 97), ("chr7", 1, 9)):
        opened = readers.indexed_parts(spark, path, c, a, b)
        want = sorted(p for k, p, *_ in rows if k == c and a <= p <= b)
        assert sorted(r.pos for r in readers.vcf_region(spark, path, c, a, b).collect()) == want
        text = spark.read.text(opened) if opened else None
        assert bool(opened) == bool(want) or c == "chr1" and a == 2
        assert len(opened) <= max(1, files // 2) and (text is None or text.filter(f"value like '{c}\t%'").count() > 0)
    assert readers.vcf_region(spark, path, "chr1", 1, 500, drop_reference=True).count() == sum(1 for k, p, *_ in rows if k == "chr1" and p <= 500 and p % 5)
