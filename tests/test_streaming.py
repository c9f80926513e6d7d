"""A scan of observations as a stream against the batch plan, with late reads and places that stay in the state."""

import random

from pyspark.sql import functions as F

from twinlens.operators import counts, paired
from twinlens.streaming import live

OBS = "ctg string, pos long, ref string, sample string, base string, indel string"


def written(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, OBS).coalesce(1).write.parquet(f"{folder}/{k}")


def test_scan_equals_the_batch_plan(spark, tmp_path):
    r = random.Random(4)
    rows = []
    for ctg in ("a", "b"):
        for pos in range(0, 900, 7):
            alt = r.choice("CGT")
            for sample, share in (("tumor", r.choice([0, 0.3, 0.6])), ("normal", r.choice([0, 0, 0.3]))):
                for _ in range(r.randint(3, 14)):
                    rows.append((ctg, pos, "A", sample, r.choice([str.upper, str.lower])(alt if r.random() < share else "A"), r.choice(["", "", "", "+TT"]) if pos % 5 == 0 else ""))
    # a read comes up to 40 places after its own
    rows.sort(key=lambda x: (x[1] + r.randint(0, 40)))
    batches = [rows[k : k + len(rows) // 5] for k in range(0, len(rows), len(rows) // 5)]
    written(spark, str(tmp_path / "in"), [*batches, [("a", live.END, None, None, None, None), ("b", live.END, None, None, None, None)]])
    d = spark.createDataFrame(rows, OBS)
    sites, late = live.scan_candidates(spark, str(tmp_path / "in"), d.schema, str(tmp_path / "out"), reach=100)
    c = counts.allele_counts(d)
    want = paired.paired_filter(counts.candidates(c.filter("sample = 'tumor'")), c)
    assert want.count() > 20 and sorted(map(str, sites.select(*want.columns).collect())) == sorted(map(str, want.collect())) and late.count() == 0


def test_late_reads_and_places_not_left(spark, tmp_path):
    at = lambda pos, n, base="T", ctg="a": [(ctg, pos, "A", "tumor", base, "")] * n
    written(spark, str(tmp_path / "in"), [at(10, 9), at(150, 9), at(10, 3) + at(400, 9) + at(5, 2, "C"), at(20, 5, ctg="b")])
    schema = spark.createDataFrame([], OBS).schema
    sites, late = live.scan_candidates(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), reach=100)
    assert sorted(r.pos for r in sites.collect()) == [10, 150] and {r.depth for r in sites.collect()} == {9}
    assert sorted((r.pos, r.allele, r.n, r.depth) for r in late.collect()) == [(5, "C", 2, 2), (10, "T", 3, 3)]
    # the stream goes on where it was: what is left comes out with the ends
    spark.createDataFrame([("a", live.END, None, None, None, None), ("b", live.END, None, None, None, None)], OBS).coalesce(1).write.parquet(str(tmp_path / "in" / "9"))
    sites, late = live.scan_candidates(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), reach=100)
    assert sorted((r.ctg, r.pos) for r in sites.collect()) == [("a", 10), ("a", 150), ("a", 400), ("b", 20)] and late.count() == 2
    assert sites.filter(F.col("top_allele") == "T").count() == 4
