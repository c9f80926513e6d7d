"""The registry of the engine's queries over the bundled tables, with the DuckDB SQL of those that SQL can express.

Sites, samples and alleles are made from line items: the part is the position, return flags A and R are the normal and
the tumor, line numbers give bases. All queries run over whole tables.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlens.functions import alleles as A
from twinlens.functions import quality as Q
from twinlens.functions import text as T
from twinlens.operators import calls as CALLS
from twinlens.operators import copynumber as CN
from twinlens.operators import counts as C
from twinlens.operators import evaluate as EV
from twinlens.operators import examples as EX
from twinlens.operators import haplotype as H
from twinlens.operators import intervals as IV
from twinlens.operators import kernels as K
from twinlens.operators import matrices as MX
from twinlens.operators import paired as P
from twinlens.operators import realignment as RE
from twinlens.operators import sampling as S
from twinlens.operators import sequences as SEQ
from twinlens.operators import sites as SI
from twinlens.operators.lineage import shared_folder
from twinlens.plans import pipelines as PL
from twinlens.sources import readers, writers
from twinlens.streaming import live

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").filter("l_returnflag in ('A', 'R')")
    return li.select(
        F.expr("concat('chr', l_partkey % 22 + 1)").alias("ctg"), F.col("l_partkey").alias("pos"),
        F.expr("substring('ACGT', cast(l_partkey % 4 as int) + 1, 1)").alias("ref"),
        F.expr("case l_returnflag when 'A' then 'normal' else 'tumor' end").alias("sample"),
        F.expr("case l_linestatus when 'O' then lower(substring('ACGT', l_linenumber % 4 + 1, 1)) else substring('ACGT', l_linenumber % 4 + 1, 1) end").alias("base"),
        F.expr("case when l_quantity % 10 = 0 then '+AC' when l_quantity % 15 = 0 then '-NN' else '' end").alias("indel"),
        F.expr("cast(l_quantity as int)").alias("bq"), F.expr("cast(l_suppkey % 60 as int)").alias("mq"), F.expr("cast(l_suppkey % 3 as int)").alias("hp"),
        F.expr("cast(l_orderkey as string)").alias("qname"), F.lit(0).alias("flag"),
    )


OBS = """o AS (
  SELECT concat('chr', l_partkey % 22 + 1) AS ctg, l_partkey AS pos, substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS ref,
    CASE l_returnflag WHEN 'A' THEN 'normal' ELSE 'tumor' END AS sample,
    CASE l_linestatus WHEN 'O' THEN lower(substr('ACGT', l_linenumber % 4 + 1, 1)) ELSE substr('ACGT', l_linenumber % 4 + 1, 1) END AS base,
    CASE WHEN l_quantity % 10 = 0 THEN '+AC' WHEN l_quantity % 15 = 0 THEN '-NN' ELSE '' END AS indel,
    CAST(l_quantity AS INT) AS bq, CAST(l_suppkey % 60 AS INT) AS mq, CAST(l_suppkey % 3 AS INT) AS hp, CAST(l_orderkey AS VARCHAR) AS qname
  FROM lineitem WHERE l_returnflag IN ('A', 'R'))"""
ALLELES = f"""{OBS}, e AS (
  SELECT ctg, pos, ref, sample, upper(base) AS allele FROM o
  UNION ALL SELECT ctg, pos, ref, sample, CASE substr(indel, 1, 1) WHEN '+' THEN 'I' || upper(base) || substr(indel, 2) ELSE 'D' || repeat('N', length(indel) - 1) END FROM o WHERE indel <> ''),
g AS (SELECT ctg, pos, ref, sample, allele, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT *, CAST(sum(CASE WHEN length(allele) = 1 THEN n ELSE 0 END) OVER (PARTITION BY ctg, pos, ref, sample) AS BIGINT) AS depth FROM g)"""
GATE = f"""{ALLELES}, k AS (
  SELECT ctg, pos, ref, sample, depth,
    coalesce(bool_or(length(allele) = 1 AND allele <> ref AND n >= 3 AND n / depth >= 0.05), false) AS snv,
    coalesce(bool_or(length(allele) > 1 AND n >= 3 AND n / depth >= 0.1), false) AS indel,
    list_sort(list({{'m': -n, 'a': allele}}) FILTER (length(allele) = 1 AND allele <> ref)) AS r,
    list_sort(list({{'m': -n, 'a': allele}}) FILTER (length(allele) > 1)) AS i
  FROM c WHERE depth > 4 GROUP BY ALL),
s AS (SELECT ctg, pos, ref, sample, depth, snv, indel, r[1].a AS top_allele, round(-r[1].m / depth, 3) AS top_af, round(-r[2].m / depth, 3) AS second_af,
  i[1].a AS top_indel, round(-i[1].m / depth, 3) AS indel_af FROM k WHERE snv OR indel)"""
FRACTIONS = f"""{ALLELES}, f AS (
  SELECT ctg, pos, ref, allele, coalesce(max(CASE sample WHEN 'tumor' THEN n / depth END), 0.0) AS taf, coalesce(max(CASE sample WHEN 'normal' THEN n / depth END), 0.0) AS naf
  FROM c WHERE length(allele) = 1 AND allele <> ref GROUP BY ALL)"""


@query(f"WITH {ALLELES} SELECT * FROM c")
def allele_counts(spark, d):
    return C.allele_counts(observations(spark, d))


@query(f"WITH {GATE} SELECT * FROM s")
def candidate_sites(spark, d):
    return C.candidates(C.allele_counts(observations(spark, d)))


def _paired_sql(liquid: str = "") -> str:
    stays = lambda af, naf, n, allele: f"{allele} IS NOT NULL AND CASE WHEN coalesce(nd, 0) <= 4 THEN true WHEN {naf} <= 0 OR {af} <= 0 THEN true WHEN {naf} >= 0.05 THEN {af} >= round(6 * {naf}, 6)" + liquid.format(af=af, naf=naf, n=n) + f" ELSE {af} > round(4 * {naf}, 6) END"
    return f"""WITH {GATE}, d AS (SELECT ctg, pos, max(depth) AS nd FROM c WHERE sample = 'normal' GROUP BY ALL), j AS (
  SELECT s.*, d.nd, coalesce(x.n, 0) AS xn, coalesce(y.n, 0) AS yn, coalesce(round(x.n / d.nd, 3), 0.0) AS naf, coalesce(round(y.n / d.nd, 3), 0.0) AS indel_naf
  FROM s LEFT JOIN d USING (ctg, pos) LEFT JOIN c x ON x.sample = 'normal' AND x.ctg = s.ctg AND x.pos = s.pos AND x.allele = s.top_allele
  LEFT JOIN c y ON y.sample = 'normal' AND y.ctg = s.ctg AND y.pos = s.pos AND y.allele = s.top_indel WHERE s.sample = 'tumor'),
q AS (SELECT * REPLACE (snv AND {stays('top_af', 'naf', 'xn', 'top_allele')} AS snv, indel AND {stays('indel_af', 'indel_naf', 'yn', 'top_indel')} AS indel) FROM j)
SELECT ctg, pos, ref, sample, depth, snv, indel, top_allele, top_af, second_af, top_indel, indel_af, naf, indel_naf FROM q WHERE snv OR indel"""


@query(_paired_sql())
def paired_normal_filter(spark, d):
    c = C.allele_counts(observations(spark, d))
    return P.paired_filter(C.candidates(c.filter("sample = 'tumor'")), c)


@query(_paired_sql(" OR ({af} >= round(5 * {naf}, 6) AND {n} < 2)"))
def paired_liquid_filter(spark, d):
    c = C.allele_counts(observations(spark, d))
    return P.paired_filter(C.candidates(c.filter("sample = 'tumor'")), c, liquid=True)


@query(f"""WITH {FRACTIONS} SELECT ctg, pos, ref,
  min({{'g': -round(taf - naf, 9), 'a': allele}}) FILTER (round(taf - naf, 9) > 0).a AS somatic, min({{'g': -round(taf + naf, 9), 'a': allele}}).a AS germline
FROM f GROUP BY ALL""".replace("min({'g': -round(taf - naf, 9), 'a': allele}) FILTER (round(taf - naf, 9) > 0).a", "(min({'g': -round(taf - naf, 9), 'a': allele}) FILTER (round(taf - naf, 9) > 0)).a").replace("min({'g': -round(taf + naf, 9), 'a': allele}).a", "(min({'g': -round(taf + naf, 9), 'a': allele})).a"))
def best_alleles(spark, d):
    return P.best_alleles(P.allele_fractions(C.allele_counts(observations(spark, d))))


@query(f"""WITH {OBS} SELECT ctg, pos, ref, sample, count(*) AS depth,
  count(*) FILTER (upper(base) = 'A') AS n_a, count(*) FILTER (upper(base) = 'C') AS n_c, count(*) FILTER (upper(base) = 'G') AS n_g, count(*) FILTER (upper(base) = 'T') AS n_t,
  count(*) FILTER (base = upper(base)) AS forward, count(*) FILTER (base <> upper(base)) AS reverse,
  count(*) FILTER (hp = 0) AS hp0, count(*) FILTER (hp = 1) AS hp1, count(*) FILTER (hp = 2) AS hp2,
  count(*) FILTER (hp = 0 AND upper(base) <> ref) AS alt_hp0, count(*) FILTER (hp = 1 AND upper(base) <> ref) AS alt_hp1, count(*) FILTER (hp = 2 AND upper(base) <> ref) AS alt_hp2,
  round(avg(bq) FILTER (upper(base) <> ref), 6) AS alt_bq FROM o GROUP BY ALL""")
def stranded_and_haplotype_counts(spark, d):
    return C.reference_by_difference(C.site_counts(observations(spark, d))).withColumn("alt_bq", F.round("alt_bq", 6))


def _channel_sql() -> str:
    n = "count(*) FILTER (mq >= 20 AND {})"
    cells = {b: n.format(f"base = '{b}'") for b in "ACGT*acgt#"}
    for m, sign in (("I", "+"), ("D", "-")):
        cells[m] = n.format(f"indel LIKE '{sign}%' AND base = upper(base)")
        cells[m.lower()] = n.format(f"indel LIKE '{sign}%' AND base <> upper(base)")
        cells[m + "1"], cells[m.lower() + "1"] = cells[m], cells[m.lower()]  # one insertion and one deletion in these data
    for b in "ACGTacgt":
        cells[b + "LMQ"] = f"count(*) FILTER (mq < 20 AND base = '{b}')"
        cells[b + "LBQ"] = n.format(f"bq < 30 AND base = '{b}'")
    parts = ", ".join(f'{cells[c]} AS "k{i}"' for i, c in enumerate(C.CHANNELS))
    out = []
    for i, c in enumerate(C.CHANNELS):
        if c[0] in "ACGTacgt" and c[1:] in ("", "LMQ", "LBQ"):
            strand = "ACGT" if c[0].isupper() else "acgt"
            total = " + ".join(f'"k{C.CHANNELS.index(b + c[1:])}"' for b in strand)
            out.append(f"CASE WHEN ref = '{c[0].upper()}' THEN {total} ELSE \"k{i}\" END")
        else:
            out.append(f'"k{i}"')
    return f"WITH {OBS}, w AS (SELECT ctg, pos, ref, sample, {parts} FROM o GROUP BY ALL) SELECT ctg, pos, ref, sample, array_to_string([{', '.join(out)}], ',') AS channels FROM w"


@query(_channel_sql())
def pivot_channels(spark, d):
    return C.channels(observations(spark, d)).withColumn("channels", F.array_join(F.transform("channels", lambda x: x.cast("string")), ","))


@query(f"""WITH {OBS}, v AS (SELECT ctg, pos, count(*) AS a, count(DISTINCT hp) AS b FROM o GROUP BY ALL),
w AS (SELECT s.ctg, s.pos, unnest(range(s.pos - 16, s.pos + 17)) AS at FROM (SELECT DISTINCT ctg, pos FROM v) s)
SELECT w.ctg, w.pos, string_agg(coalesce(v.a, 0) || ',' || coalesce(v.b, 0), ',' ORDER BY w.at) AS features FROM w LEFT JOIN v ON v.ctg = w.ctg AND v.pos = w.at GROUP BY w.ctg, w.pos""")
def feature_window(spark, d):
    v = observations(spark, d).groupBy("ctg", "pos").agg(F.array(F.count("*"), F.count_distinct("hp")).alias("channels"))
    w = SEQ.feature_window(v.select("ctg", "pos"), v, 2)
    return w.withColumn("features", F.array_join(F.transform("features", lambda x: x.cast("string")), ","))


@query(f"WITH {OBS}, u AS (SELECT DISTINCT ctg, pos, qname, upper(base) AS b FROM o) SELECT ctg, pos, count(*) FILTER (b = 'A') AS count_a, count(*) FILTER (b = 'C') AS count_c, count(*) FILTER (b = 'G') AS count_g, count(*) FILTER (b = 'T') AS count_t, count(*) AS good_depth FROM u GROUP BY ALL")
def unique_fragment_counts(spark, d):
    return C.unique_fragment_counts(observations(spark, d))


def _calls(spark, d, flag: str) -> DataFrame:
    """A call set from line items: of each part, the first allele by order key; the tax gives a probability."""
    li = load(spark, d, "lineitem").filter(F.col("l_returnflag") == flag)
    first = li.groupBy(F.col("l_partkey").alias("pos")).agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")).alias("r"))
    return first.select(
        F.expr("concat('chr', pos % 22 + 1)").alias("ctg"), "pos", F.expr("substring('ACGT', cast(pos % 4 as int) + 1, 1)").alias("ref"),
        F.expr("substring('ACGT', cast((pos + 1 + r.l_linenumber % 3) % 4 as int) + 1, 1)").alias("alt"), F.expr("round(r.l_quantity / 51, 4)").alias("qual"),
        F.expr("case when r.l_discount < 0.07 then 'PASS' when r.l_discount < 0.09 then 'Germline' else 'LowQual' end").alias("filter"), F.expr("r.l_tax * 2").alias("naf"),
        F.expr("cast(r.l_quantity as int)").alias("dp"),
    )


def _calls_sql(name: str, flag: str) -> str:
    return f"""{name} AS (
  SELECT concat('chr', pos % 22 + 1) AS ctg, pos, substr('ACGT', CAST(pos % 4 AS INT) + 1, 1) AS ref,
    substr('ACGT', CAST((pos + 1 + r.l_linenumber % 3) % 4 AS INT) + 1, 1) AS alt, round(r.l_quantity / 51, 4) AS qual,
    CASE WHEN r.l_discount < 0.07 THEN 'PASS' WHEN r.l_discount < 0.09 THEN 'Germline' ELSE 'LowQual' END AS filter, r.l_tax * 2 AS naf, CAST(r.l_quantity AS INT) AS dp
  FROM (SELECT l_partkey AS pos, min({{'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_discount': l_discount, 'l_tax': l_tax, 'l_quantity': l_quantity}}) AS r
        FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY l_partkey))"""


def _ratios_sql(places: int) -> str:
    p, r = "coalesce(tp / nullif(tp + fp, 0), 0.0)", "coalesce(tp / nullif(tp + fn, 0), 0.0)"
    return f"round({p}, {places}) AS precision, round({r}, {places}) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0.0), {places}) AS f1"


SCORED = "x AS (SELECT d.doc_id, d.n_chars // 100 AS score, CAST(coalesce(l.quality, 0) AS BIGINT) AS truth, (d.n_chars % 101) / 100 AS af FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark, d) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(load(spark, d, "labels"), "doc_id").select(
        "doc_id", F.expr("n_chars div 100").alias("score"), F.coalesce("quality", F.lit(0)).cast("long").alias("truth"), (F.col("n_chars") % 101 / 100).alias("af")
    )


@query(f"""WITH {_calls_sql('t', 'A')}, {_calls_sql('c', 'R')}, j AS (
  SELECT t.alt IS NOT NULL AS it, c.alt IS NOT NULL AS ic, coalesce(t.ref = c.ref AND t.alt = c.alt, false) AS same FROM t FULL JOIN c ON t.ctg = c.ctg AND t.pos = c.pos),
n AS (SELECT count(*) FILTER (same) AS tp, count(*) FILTER (ic AND NOT same) AS fp, count(*) FILTER (it AND NOT same) AS fn FROM j),
k AS (SELECT unnest(['SNV']) AS kind) SELECT kind, tp, fp, fn, {_ratios_sql(4)} FROM n, k""")
def confusion_metrics(spark, d):
    return EV.metrics(EV.classify(_calls(spark, d, "A"), _calls(spark, d, "R"), ["ctg", "pos"]))


INDELS = """v AS (SELECT l_orderkey AS pos, l_linenumber AS ln, CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AT' ELSE 'G' END AS ref,
  CASE l_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'CT' ELSE 'G' END AS alt, l_returnflag AS f FROM lineitem)"""


@query(f"""WITH {INDELS}, t AS (SELECT * FROM v WHERE f <> 'N'), c AS (SELECT pos, ln, ref, CASE WHEN pos % 5 = 0 THEN 'T' ELSE alt END AS alt FROM v WHERE f <> 'A'),
j AS (SELECT t.ref AS tr, t.alt AS ta, c.ref AS cr, c.alt AS ca FROM t FULL JOIN c ON t.pos = c.pos AND t.ln = c.ln),
e AS (SELECT CASE WHEN ca IS NULL THEN ['fn'] WHEN ta IS NULL THEN ['fp'] WHEN ca = ta AND cr = tr THEN ['tp'] ELSE ['fp', 'fn'] END AS os, * FROM j),
u AS (SELECT unnest(os) AS o, * FROM e), q AS (SELECT o, CASE WHEN o = 'fn' THEN tr ELSE cr END AS r, CASE WHEN o = 'fn' THEN ta ELSE ca END AS a FROM u),
y AS (SELECT o, CASE WHEN length(r) = 1 AND length(a) = 1 THEN 'SNV' WHEN length(r) < length(a) THEN 'INS' WHEN length(r) > length(a) THEN 'DEL' END AS kind FROM q),
z AS (SELECT kind, o FROM y WHERE kind IS NOT NULL UNION ALL SELECT 'INDEL', o FROM y WHERE kind IN ('INS', 'DEL')),
n AS (SELECT kind, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn FROM z GROUP BY kind) SELECT kind, tp, fp, fn, {_ratios_sql(4)} FROM n""")
def metrics_by_class(spark, d):
    v = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("ln"), F.expr("case l_linenumber % 3 when 0 then 'A' when 1 then 'AT' else 'G' end").alias("ref"),
        F.expr("case l_partkey % 3 when 0 then 'C' when 1 then 'CT' else 'G' end").alias("alt"), F.col("l_returnflag").alias("f"),
    )
    called = v.filter("f <> 'A'").withColumn("alt", F.expr("case when pos % 5 = 0 then 'T' else alt end")).drop("f")
    return EV.metrics(EV.classify(v.filter("f <> 'N'").drop("f"), called, ["pos", "ln"]))


SWEEP = f"""WITH {SCORED}, g AS (SELECT score, sum(truth) AS t, count(*) AS n FROM x GROUP BY score),
r AS (SELECT score, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS a, CAST(sum(t) OVER () AS BIGINT) AS truths FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
n AS (SELECT score, tp, a - tp AS fp, truths - tp AS fn FROM r), f AS (SELECT score, tp, fp, fn, {_ratios_sql(6)} FROM n)"""


@query(SWEEP + " SELECT * FROM f")
def roc_sweep(spark, d):
    return EV.sweep(_scored(spark, d))


@query(SWEEP + " SELECT * FROM f ORDER BY f1 DESC, score DESC LIMIT 1")
def best_f1_cutoff(spark, d):
    return EV.best_cut(EV.sweep(_scored(spark, d)))


@query(f"""WITH {SCORED}, b AS (SELECT *, CASE WHEN af < 0.2 THEN 0.0 WHEN af < 0.5 THEN 0.2 WHEN af < 1.01 THEN 0.5 END AS bin FROM x),
n AS (SELECT CAST(bin AS DOUBLE) AS bin, count(*) FILTER (score >= 10 AND truth = 1) AS tp, count(*) FILTER (score >= 10 AND truth <> 1) AS fp, count(*) FILTER (score < 10 AND truth = 1) AS fn FROM b GROUP BY bin)
SELECT bin, tp, fp, fn, {_ratios_sql(6)} FROM n""")
def metrics_by_bin(spark, d):
    return EV.metrics_by_bin(_scored(spark, d), [0.0, 0.2, 0.5, 1.0], 10)


@query("WITH g AS (SELECT l_linenumber AS label, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT *, (1 - 0.999) / (1 - pow(0.999, n)) AS w FROM g) SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM w")
def class_weights(spark, d):
    g = load(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("label")).agg(F.count("*").alias("n"))
    return EV.class_weights(g).withColumn("weight", F.round("weight", 6))


@query("SELECT CASE WHEN l_tax < 0 THEN 0 WHEN l_tax >= 0.08 THEN 9 ELSE CAST(floor(l_tax / 0.01 + 1e-9) AS BIGINT) + 1 END AS bin, count(*) AS n FROM (SELECT round(l_tax + 0.002, 3) AS l_tax FROM lineitem) GROUP BY 1")
def fraction_histogram(spark, d):
    x = load(spark, d, "lineitem").select(F.round(F.col("l_tax") + 0.002, 3).alias("v"))
    return EV.histogram(x, "v", 0.0, 0.08, 8)


# intervals: of parts and suppliers on the axis of order keys
PARTS = "p AS (SELECT concat('chr', p_partkey % 3 + 1) AS ctg, p_partkey * 7 AS start, p_partkey * 7 + p_size AS end FROM part)"
ORDERS = "q AS (SELECT concat('chr', o_orderkey % 3 + 1) AS ctg, o_orderkey AS pos FROM orders)"


def _parts(spark, d) -> DataFrame:
    return load(spark, d, "part").select(F.expr("concat('chr', p_partkey % 3 + 1)").alias("ctg"), F.expr("p_partkey * 7").alias("start"), F.expr("p_partkey * 7 + p_size").alias("end"))


def _orders(spark, d) -> DataFrame:
    return load(spark, d, "orders").select(F.expr("concat('chr', o_orderkey % 3 + 1)").alias("ctg"), F.col("o_orderkey").alias("pos"))


def _right(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "rstart", "end": "rend"})


INSIDE = f'WITH {PARTS}, {ORDERS} SELECT ctg, pos FROM q WHERE {{}} EXISTS (SELECT 1 FROM p WHERE p.ctg = q.ctg AND q.pos > p.start AND q.pos <= p."end")'


@query(INSIDE.format(""))
def interval_semi_join(spark, d):
    return IV.points_inside(_orders(spark, d), _right(_parts(spark, d)), ["ctg", "pos"], width=64)


@query(INSIDE.format("NOT"))
def interval_anti_join(spark, d):
    return IV.points_inside(_orders(spark, d), _right(_parts(spark, d)), ["ctg", "pos"], inside=False, width=64)


@query(f"""WITH {PARTS}, {ORDERS} SELECT q.ctg, q.pos, min(p.start) AS rstart FROM q JOIN p ON p.ctg = q.ctg AND q.pos > p.start AND q.pos <= p."end" GROUP BY ALL""")
def interval_first_match(spark, d):
    return IV.first_match(_orders(spark, d), _right(_parts(spark, d)), "rstart", 64).select("ctg", "pos", "rstart")


@query(f"""WITH {PARTS}, l AS (SELECT concat('chr', s_suppkey % 3 + 1) AS ctg, s_suppkey * 101 AS start, s_suppkey * 101 + 150 AS "end", s_suppkey AS id FROM supplier),
j AS (SELECT id, p.start AS rstart, p."end" AS rend, least(l."end", p."end") - greatest(l.start, p.start) AS overlap FROM l JOIN p ON l.ctg = p.ctg AND l.start < p."end" AND p.start < l."end")
SELECT id, rstart, rend, overlap FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY overlap DESC, rstart, rend) AS k FROM j) WHERE k = 1""")
def max_overlap_window(spark, d):
    left = load(spark, d, "supplier").select(F.expr("concat('chr', s_suppkey % 3 + 1)").alias("ctg"), F.expr("s_suppkey * 101").alias("start"), F.expr("s_suppkey * 101 + 150").alias("end"), F.col("s_suppkey").alias("id"))
    return IV.largest_overlap(left, _right(_parts(spark, d)), "id", 128)


ISLANDS = f"""WITH {PARTS}, m AS (SELECT *, max("end") OVER (PARTITION BY ctg ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR start {{}} top THEN 1 ELSE 0 END) OVER (PARTITION BY ctg ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT ctg, min(start) AS start, max("end") AS "end", count(*) AS merged FROM i GROUP BY ctg, g"""


@query(ISLANDS.format(">="))
def merge_overlaps(spark, d):
    return IV.merge_overlaps(_parts(spark, d))


@query(ISLANDS.format(">"))
def merge_touching(spark, d):
    return IV.merge_overlaps(_parts(spark, d), strict=False)


@query("SELECT concat('chr', p_partkey % 3 + 1) AS ctg, CAST(p_size AS BIGINT) AS start, CAST(p_size + 5 AS BIGINT) AS \"end\", count(*) AS merged, max(p_retailprice) AS top FROM part GROUP BY ALL")
def merge_equal_intervals(spark, d):
    p = load(spark, d, "part").select(F.expr("concat('chr', p_partkey % 3 + 1)").alias("ctg"), F.col("p_size").cast("long").alias("start"), (F.col("p_size") + 5).cast("long").alias("end"), "p_retailprice")
    return IV.merge_equals(p, {"top": F.max("p_retailprice")})


@query(f"""WITH {PARTS}, b AS (SELECT ctg, start AS c FROM p UNION SELECT ctg, "end" FROM p),
k AS (SELECT DISTINCT p.ctg, p.start, p."end", b.c FROM p JOIN b ON b.ctg = p.ctg AND b.c >= p.start AND b.c <= p."end"),
n AS (SELECT ctg, c AS start, lead(c) OVER (PARTITION BY ctg, start, "end" ORDER BY c) AS "end" FROM k) SELECT DISTINCT * FROM n WHERE "end" IS NOT NULL""")
def split_overlaps(spark, d):
    return IV.split_overlaps(_parts(spark, d), 64)


@query(f"""WITH {PARTS} SELECT ctg, start, least("end", 7000) AS "end" FROM p WHERE start < 7000 UNION ALL SELECT ctg, greatest(start, 7040), "end" FROM p WHERE "end" > 7040""")
def chop_intervals(spark, d):
    return IV.chop(_parts(spark, d), 7000, 7040)


@query(f"""WITH {PARTS} SELECT ctg, start, "end" FROM p WHERE NOT (start < 7000 AND 7000 < "end") UNION ALL SELECT ctg, start, 7000 FROM p WHERE start < 7000 AND 7000 < "end" UNION ALL SELECT ctg, 7000, "end" FROM p WHERE start < 7000 AND 7000 < "end" """)
def slice_intervals(spark, d):
    return IV.slice_at(_parts(spark, d), 7000)


@query(f"""WITH {PARTS}, u AS (SELECT DISTINCT * FROM p) SELECT a.ctg, a.start, a."end", b.start AS rstart, b."end" AS rend FROM u a JOIN u b ON a.ctg = b.ctg AND a.start <= b.start AND b."end" <= a."end" AND (a.start < b.start OR b."end" < a."end")""")
def nested_intervals(spark, d):
    return IV.nested(_parts(spark, d), 64)


@query(f"""WITH {PARTS}, w AS (SELECT concat('chr', s_suppkey % 3 + 1) AS ctg, s_suppkey * 35 AS start, s_suppkey * 35 + (SELECT p_size FROM part WHERE p_partkey = s_suppkey * 5) AS "end" FROM supplier WHERE s_suppkey * 5 IN (SELECT p_partkey FROM part))
(SELECT * FROM p EXCEPT SELECT * FROM w) UNION (SELECT * FROM w EXCEPT SELECT * FROM p)""")
def interval_symmetric_difference(spark, d):
    """Intervals of all parts and of all suppliers, whose intervals are those of every fifth part on a contig of their own."""
    sizes = load(spark, d, "part").select("p_partkey", "p_size")
    own = load(spark, d, "supplier").join(sizes, F.col("p_partkey") == F.col("s_suppkey") * 5)
    w = own.select(F.expr("concat('chr', s_suppkey % 3 + 1)").alias("ctg"), F.expr("s_suppkey * 35").alias("start"), F.expr("s_suppkey * 35 + p_size").alias("end"))
    return IV.set_operation(_parts(spark, d), w, "symmetric_difference")


@query(f"""WITH {PARTS} SELECT ctg, min(start) AS start, max("end") AS "end" FROM p GROUP BY ctg""")
def interval_span(spark, d):
    return IV.span(_parts(spark, d))


THIN = "t AS (SELECT concat('chr', o_custkey % 22 + 1) AS ctg, o_orderkey AS pos FROM orders)"


def _thin(spark, d) -> DataFrame:
    """All orders over as many contigs as a karyotype has."""
    return load(spark, d, "orders").select(F.expr("concat('chr', o_custkey % 22 + 1)").alias("ctg"), F.col("o_orderkey").alias("pos"))


@query(f"WITH {THIN} SELECT ctg, pos FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.ctg = t.ctg AND u.pos <> t.pos AND abs(u.pos - t.pos) <= 16)")
def near_neighbour_exclusion(spark, d):
    return IV.isolated(_thin(spark, d), 16)


@query(f"WITH {THIN} SELECT t.ctg, t.pos, string_agg(CAST(u.pos AS VARCHAR), ',' ORDER BY u.pos) AS near FROM t JOIN t u ON u.ctg = t.ctg AND u.pos > t.pos - 100 AND u.pos <= t.pos + 100 AND u.pos <> t.pos GROUP BY ALL")
def flank_germline_list(spark, d):
    t = _thin(spark, d)
    near = IV.neighbours(t, t.select("ctg", F.col("pos").alias("opos")), 100)
    return near.groupBy("ctg", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list("opos")), lambda x: x.cast("string")), ",").alias("near"))


@query(f"""WITH {THIN}, l AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY ctg ORDER BY pos) <= 16 THEN 0 ELSE 1 END AS n FROM t), g AS (SELECT *, sum(n) OVER (PARTITION BY ctg ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT ctg, min(pos) - 8 AS start, max(pos) + 8 AS "end", count(*) AS n FROM g GROUP BY ctg, g""")
def window_clusters(spark, d):
    return SEQ.clusters(_thin(spark, d), 16, 8)


# calls
def _score_sql(p: str) -> str:
    return f"greatest(round(-10.0 * log10((1.0 - {p} + 1e-10) / ({p} + 1e-10)) + 2.0, 3), 0.0)"


@query(f"""WITH {_calls_sql('a', 'A')}, {_calls_sql('b', 'R')},
j AS (SELECT coalesce(a.ctg, b.ctg) AS ctg, coalesce(a.pos, b.pos) AS pos, a.ref AS ar, a.alt AS aa, a.qual AS aq, a.filter AS af, a.naf AS an, b.ref AS br, b.alt AS ba, b.qual AS bq, b.filter AS bf, b.naf AS bn FROM a FULL JOIN b ON a.ctg = b.ctg AND a.pos = b.pos),
k AS (SELECT *, CASE WHEN af = 'PASS' AND bf = 'PASS' THEN 1 WHEN bf IS NOT NULL THEN 2 WHEN af <> 'PASS' THEN 3 END AS r FROM j),
o AS (SELECT ctg, pos, CASE r WHEN 2 THEN br ELSE ar END AS ref, CASE r WHEN 2 THEN ba ELSE aa END AS alt, CASE r WHEN 2 THEN bf ELSE af END AS filter, CASE r WHEN 2 THEN bn ELSE an END AS naf,
  CASE r WHEN 1 THEN {_score_sql('((aq + bq) / 2)')} WHEN 2 THEN CASE WHEN bf IN ('Germline', 'RefCall') THEN {_score_sql('bq')} ELSE 0.0 END ELSE CASE WHEN af IN ('Germline', 'RefCall') THEN {_score_sql('aq')} ELSE 0.0 END END AS qual FROM k WHERE r IS NOT NULL),
l AS (SELECT * REPLACE (CASE WHEN qual <= 4 AND filter NOT IN ('Germline', 'RefCall') THEN 'LowQual' ELSE filter END AS filter) FROM o)
SELECT * REPLACE (CASE WHEN filter = 'PASS' AND naf > 0.1 THEN 'LowQual' ELSE filter END AS filter, CASE WHEN filter = 'PASS' AND naf > 0.1 THEN 0.0 ELSE qual END AS qual) FROM l""")
def call_merge_precedence(spark, d):
    return CALLS.merge_calls(_calls(spark, d, "A"), _calls(spark, d, "R"), min_qual=4, max_naf=0.1).select("ctg", "pos", "ref", "alt", "filter", "naf", "qual")


@query(f"SELECT l_orderkey, l_linenumber, {_score_sql('(l_quantity / 51)')} AS qual, CAST(CASE WHEN {_score_sql('(l_quantity / 51)')} > 0 THEN floor({_score_sql('(l_quantity / 51)')}) ELSE floor({_score_sql('l_discount')}) END AS INT) AS gq FROM lineitem")
def phred_qual(spark, d):
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", Q.call_quality(F.col("l_quantity") / 51).alias("qual"))
    return li.select("l_orderkey", "l_linenumber", "qual", Q.genotype_quality(F.col("qual"), F.col("l_discount")).alias("gq"))


@query("SELECT c_custkey, ctg, coalesce(list_position(['" + "','".join(A.KARYOTYPE) + "'], ctg) - 1, 48) AS place FROM (SELECT c_custkey, CASE WHEN c_nationkey < 22 THEN concat('chr', c_nationkey + 1) WHEN c_nationkey = 22 THEN 'X' ELSE c_name END AS ctg FROM customer)")
def genome_sort_rank(spark, d):
    ctg = F.expr("case when c_nationkey < 22 then concat('chr', c_nationkey + 1) when c_nationkey = 22 then 'X' else c_name end")
    c = load(spark, d, "customer").select("c_custkey", ctg.alias("ctg"), F.lit(1).alias("pos"))
    return CALLS.genome_order(c).select("c_custkey", "ctg", A.contig_rank(F.col("ctg")).alias("place"))


@query(f"WITH {_calls_sql('t', 'R')}, {_calls_sql('n', 'A')} SELECT t.ctg, t.pos, t.ref, t.alt, t.qual FROM t LEFT JOIN n ON t.ctg = n.ctg AND t.pos = n.pos WHERE (n.pos IS NULL AND t.qual >= 0.3) OR (t.ref = n.ref AND t.alt = n.alt)")
def hetero_selection(spark, d):
    return P.hetero_selection(_calls(spark, d, "R"), _calls(spark, d, "A"), 0.3).select("ctg", "pos", "ref", "alt", "qual")


@query(f"""WITH {_calls_sql('t', 'R')}, {_calls_sql('n', 'A')} SELECT n.ctg, n.pos, n.ref, n.alt, n.dp, round(n.qual, 2) AS af,
  CASE WHEN t.pos IS NULL THEN 'lost' WHEN t.ref <> n.ref OR t.alt <> n.alt OR t.dp < 15 THEN NULL WHEN t.pos % 4 > 0 THEN 'kept' WHEN round(t.qual, 2) >= 0.9 THEN 'fixed' END AS transition
FROM n LEFT JOIN t ON t.ctg = n.ctg AND t.pos = n.pos WHERE n.pos % 5 > 0 AND n.dp >= 15 AND round(n.qual, 2) BETWEEN 0.4 AND 0.6""")
def indel_transitions(spark, d):
    """Alleles of both samples differ at two thirds of the sites; every fifth normal and every fourth tumor genotype has two alternative alleles."""
    at = lambda flag, k: _calls(spark, d, flag).select("ctg", "pos", "ref", "alt", "dp", F.round("qual", 2).alias("af"), F.when(F.col("pos") % k == 0, 2).otherwise(1).alias("alts"))
    return P.indel_transitions(at("A", 5), at("R", 4)).drop("alts")


@query(f"""WITH {_calls_sql('c', 'R')}, s AS (SELECT concat('chr', p_partkey % 22 + 1) AS ctg, p_partkey AS pos, 'N' AS ref, '.' AS alt FROM part), i AS (SELECT concat('chr', l_partkey % 22 + 1) AS ctg, l_partkey AS pos, count(*) AS dp, count(*) FILTER (l_linestatus = 'F') AS ndp FROM lineitem GROUP BY ALL)
SELECT ctg, pos, ref, alt, '0/1' AS gt, CAST(dp AS BIGINT) AS dp, CAST(0 AS BIGINT) AS ndp FROM c WHERE filter = 'PASS'
UNION ALL SELECT s.ctg, s.pos, s.ref, s.alt, './.', coalesce(i.dp, 0), coalesce(i.ndp, 0) FROM s LEFT JOIN i USING (ctg, pos) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.filter = 'PASS' AND c.ctg = s.ctg AND c.pos = s.pos)""")
def missing_site_backfill(spark, d):
    c = _calls(spark, d, "R").filter("filter = 'PASS'").select("ctg", "pos", "ref", "alt", F.lit("0/1").alias("gt"), F.col("dp").cast("long").alias("dp"), F.lit(0).cast("long").alias("ndp"))
    s = load(spark, d, "part").select(F.expr("concat('chr', p_partkey % 22 + 1)").alias("ctg"), F.col("p_partkey").alias("pos"), F.lit("N").alias("ref"), F.lit(".").alias("alt"))
    i = load(spark, d, "lineitem").groupBy(F.expr("concat('chr', l_partkey % 22 + 1)").alias("ctg"), F.col("l_partkey").alias("pos")).agg(F.count("*").alias("dp"), F.count_if(F.col("l_linestatus") == "F").alias("ndp"))
    return CALLS.backfill(c, s, i, only_sites=False)


@query(f"""WITH {FRACTIONS}, t AS (SELECT DISTINCT ctg, pos, depth FROM c WHERE sample = 'tumor'), x AS (SELECT f.*, depth, CASE WHEN taf >= 0.03 AND round(taf * depth) >= 3 AND naf <= 0.03 THEN 'somatic' WHEN abs(taf - naf) <= 0.1 AND taf >= 0.1 AND naf >= 0.1 THEN 'germline' WHEN naf < 0.05 AND naf <= 0.2 * taf THEN 'reference' END AS label FROM f JOIN t USING (ctg, pos))
SELECT ctg, pos, allele, label, array_to_string([CAST(label = 'reference' AS INT), CAST(label = 'germline' AS INT), CAST(label = 'somatic' AS INT)], '') AS hot FROM x WHERE label IS NOT NULL""")
def training_labels(spark, d):
    c = C.allele_counts(observations(spark, d))
    found = P.training_labels(P.allele_fractions(c), c)
    return found.select("ctg", "pos", "allele", "label", F.array_join(F.transform(P.one_hot(), lambda x: x.cast("string")), "").alias("hot"))


SHOWN = """w AS (SELECT ctg, pos, sample, upper(base) || upper(indel) AS k, hp > 0 AS own FROM o),
g AS (SELECT ctg, pos, sample, k, count(*) FILTER (NOT own) AS n, count(*) FILTER (own) AS m FROM w GROUP BY ALL),
q AS (SELECT ctg, pos, sample, k, n / nullif(sum(n) OVER z, 0) AS af, m / nullif(sum(m) OVER z, 0) AS oaf, sum(n + m) OVER z AS depth FROM g WINDOW z AS (PARTITION BY ctg, pos, sample))"""


def _shown(spark, d, sample: str, own: bool) -> DataFrame:
    """Fractions of alleles as pileups show them, of reads with a haplotype (own) or without."""
    o = observations(spark, d).filter(F.col("sample") == sample).select("ctg", "pos", "ref", F.concat(F.upper("base"), F.upper("indel")).alias("k"), "hp")
    n = o.groupBy("ctg", "pos", "ref", "k").agg(F.count_if((F.col("hp") > 0) == own).alias("n"))
    total = n.withColumn("af", F.try_divide("n", F.sum("n").over(Window.partitionBy("ctg", "pos")))).filter(F.col("n") > 0)
    return total.filter("k <> ref").groupBy("ctg", "pos").agg(F.map_from_entries(F.collect_list(F.struct("k", "af"))).alias("alleles"))


@query(f"""WITH {OBS}, {SHOWN}, t AS (SELECT concat('chr', p_partkey % 22 + 1) AS ctg, p_partkey AS pos, substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref,
  substr('CGTA', CAST(p_partkey % 4 AS INT) + 1, 1) || CASE WHEN p_partkey % 5 = 0 THEN 'AC' ELSE '' END AS alt, CASE p_size % 3 WHEN 0 THEN 'germline' WHEN 1 THEN 'reference' ELSE 'somatic' END AS kind FROM part),
y AS (SELECT *, substr(alt, 1, 1) || CASE WHEN length(alt) > 1 THEN '+AC' ELSE '' END AS own FROM t),
a AS (SELECT DISTINCT ctg, pos, depth, true AS there FROM q WHERE sample = 'tumor'), b AS (SELECT DISTINCT q.ctg, q.pos, true AS paired FROM q JOIN y ON y.ctg = q.ctg AND y.pos = q.pos WHERE sample = 'normal' AND af > 0 AND k <> ref),
c AS (SELECT y.ctg, y.pos, max(af) AS top FROM q JOIN y USING (ctg, pos) WHERE sample = 'tumor' AND af > 0 AND k <> ref GROUP BY 1, 2), e AS (SELECT y.ctg, y.pos, count(*) AS n_own FROM q JOIN y USING (ctg, pos) WHERE sample = 'tumor' AND oaf > 0 AND k <> ref GROUP BY 1, 2),
r AS (SELECT y.ctg, y.pos, k, af, row_number() OVER (PARTITION BY y.ctg, y.pos ORDER BY af DESC, k) AS i FROM q JOIN y USING (ctg, pos) WHERE sample = 'tumor' AND af > 0 AND k <> ref AND length(k) = 1),
x AS (SELECT y.*, there, paired, a.depth, top, n_own, r.af AS best, ta.af AS taf, ta.oaf AS own_af, na.af AS naf, nb.af AS other FROM y LEFT JOIN a USING (ctg, pos) LEFT JOIN b USING (ctg, pos) LEFT JOIN c USING (ctg, pos) LEFT JOIN e USING (ctg, pos)
  LEFT JOIN r ON r.ctg = y.ctg AND r.pos = y.pos AND r.i = 1 LEFT JOIN q ta ON ta.ctg = y.ctg AND ta.pos = y.pos AND ta.sample = 'tumor' AND ta.k = y.own AND ta.k <> y.ref
  LEFT JOIN q na ON na.ctg = y.ctg AND na.pos = y.pos AND na.sample = 'normal' AND na.k = y.own AND na.k <> y.ref AND na.af > 0 LEFT JOIN q nb ON nb.ctg = y.ctg AND nb.pos = y.pos AND nb.sample = 'normal' AND nb.k = r.k AND nb.af > 0)
SELECT ctg, pos, ref, alt, kind, CASE WHEN there IS NULL THEN 'no_reads'
  WHEN kind = 'germline' THEN CASE WHEN paired IS NULL THEN 'not_in_normal' WHEN coalesce(taf, 0) = 0 OR naf IS NULL THEN 'not_in_both' WHEN abs(round(taf - naf, 9)) > 0.1 OR taf < 0.1 OR naf < 0.1 THEN 'af_gap' END
  WHEN kind = 'reference' THEN CASE WHEN best IS NULL THEN 'no_allele' WHEN other >= 0.05 OR other > best * 0.2 THEN 'af_gap' END
  ELSE CASE WHEN paired AND coalesce(top, 0) > 0.03 THEN 'in_normal' WHEN n_own > 0 AND coalesce(own_af, 0) < 0.03 THEN 'low_af' WHEN n_own > 0 AND depth * own_af < 3 THEN 'low_coverage' END END AS reason FROM x""")
def training_truths(spark, d):
    """Truths of three kinds at all parts, by their rules; reads without a haplotype stand for the normal in the tumor."""
    alt = F.concat(F.expr("substring('CGTA', cast(p_partkey % 4 as int) + 1, 1)"), F.when(F.col("p_partkey") % 5 == 0, "AC").otherwise(""))
    kind = F.expr("case p_size % 3 when 0 then 'germline' when 1 then 'reference' else 'somatic' end")
    t = load(spark, d, "part").select(F.expr("concat('chr', p_partkey % 22 + 1)").alias("ctg"), F.col("p_partkey").alias("pos"), F.expr("substring('ACGT', cast(p_partkey % 4 as int) + 1, 1)").alias("ref"), alt.alias("alt"), kind.alias("kind"))
    depth = observations(spark, d).filter("sample = 'tumor'").groupBy("ctg", "pos").agg(F.count("*").alias("depth"))
    empty = F.create_map().cast("map<string,double>")
    maps = depth.join(_shown(spark, d, "tumor", False), ["ctg", "pos"], "left").join(_shown(spark, d, "tumor", True).withColumnRenamed("alleles", "tumor_alleles"), ["ctg", "pos"], "left")
    maps = maps.withColumns({"alleles": F.coalesce("alleles", empty), "tumor_alleles": F.coalesce("tumor_alleles", empty)})
    return P.training_truths(t, maps, _shown(spark, d, "normal", False))


NEAR_TRUTHS = "t AS (SELECT concat('chr', p_partkey % 5) AS ctg, p_partkey AS pos, p_size FROM part)"


def _phasing_sql(tumor: bool) -> str:
    chosen = f"""{_calls_sql('t', 'R')}, {_calls_sql('n', 'A')}, lt AS (SELECT ctg, pos, row_number() OVER (PARTITION BY ctg ORDER BY qual, pos) - 1 AS i, count(*) OVER (PARTITION BY ctg) AS m FROM t),
ln AS (SELECT ctg, pos, row_number() OVER (PARTITION BY ctg ORDER BY qual, pos) - 1 AS i, count(*) OVER (PARTITION BY ctg) AS m FROM n), low AS (SELECT ctg, pos FROM lt WHERE i < floor(m * 0.2) UNION SELECT ctg, pos FROM ln WHERE i < floor(m * 0.2)),
s AS (SELECT t.ctg, t.pos, t.ref, t.alt FROM t LEFT JOIN n ON t.ctg = n.ctg AND t.pos = n.pos WHERE ((n.pos IS NULL AND t.qual >= 0.3) OR (t.ref = n.ref AND t.alt = n.alt)) AND NOT EXISTS (SELECT 1 FROM low WHERE low.ctg = t.ctg AND low.pos = t.pos))"""
    if tumor:
        return f"WITH {chosen} SELECT *, 'tumor' AS source FROM s"
    return f"""WITH {chosen}, i AS (SELECT n.ctg, n.pos, n.ref, n.alt FROM n LEFT JOIN t ON t.ctg = n.ctg AND t.pos = n.pos WHERE n.pos % 5 > 0 AND n.dp >= 15 AND round(n.qual, 2) BETWEEN 0.4 AND 0.6
  AND (t.pos IS NULL OR (t.ref = n.ref AND t.alt = n.alt AND t.dp >= 15 AND (t.pos % 4 > 0 OR round(t.qual, 2) >= 0.9)))),
b AS (SELECT *, 'tumor' AS source FROM s UNION ALL SELECT ctg, pos, ref, alt, 'normal' FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.ctg = n.ctg AND s.pos = n.pos))
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.ctg = b.ctg AND i.pos = b.pos) UNION ALL SELECT *, 'indel' FROM i"""


def _phasing(spark, d, tumor: bool) -> DataFrame:
    at = lambda flag, k: _calls(spark, d, flag).select("ctg", "pos", "ref", "alt", "dp", F.round("qual", 2).alias("af"), F.when(F.col("pos") % k == 0, 2).otherwise(1).alias("alts"))
    return P.phasing_sites(_calls(spark, d, "A"), _calls(spark, d, "R"), at("A", 5), at("R", 4), 0.3, 0.2, tumor)


@query(_phasing_sql(True))
def phasing_sites_of_the_tumor(spark, d):
    return _phasing(spark, d, True)


@query(_phasing_sql(False))
def phasing_sites_of_the_normal(spark, d):
    """The same calls stand for the indels."""
    return _phasing(spark, d, False)


TAGS = [f"{k}{x}u" for k in ("", "n", "f", "r") for x in "acgt"]


def _tags_sql() -> str:
    of = {"": "sample = 'tumor'", "n": "sample = 'normal'", "f": "sample = 'tumor' AND base = upper(base)", "r": "sample = 'tumor' AND base <> upper(base)"}
    cells = [f"count(*) FILTER ({of[k]} AND (CASE WHEN ref = '{x.upper()}' THEN upper(base) NOT IN ({', '.join(repr(y) for y in 'ACGT' if y != x.upper())}) ELSE upper(base) = '{x.upper()}' END)) AS {k}{x}u" for k in of for x in "acgt"]
    return f"WITH {OBS} SELECT ctg, pos, ref, {', '.join(cells)} FROM o GROUP BY ALL"


@query(_tags_sql())
def strand_tags(spark, d):
    return C.strand_tags(observations(spark, d))


# tracks: events by user in the order of their ids
EVENTS = "e AS (SELECT user_id, event_id, event_type, value FROM events)"


@query(f"""WITH {EVENTS}, l AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, min(event_id) AS start, max(event_id) AS "end", count(*) AS length FROM g GROUP BY user_id, run, event_type""")
def rle_segments(spark, d):
    return SEQ.runs(load(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query(f"""WITH {EVENTS}, b AS (SELECT user_id, event_id, event_type = 'click' AS flag FROM e), s AS (SELECT user_id, avg(CAST(flag AS INT)) AS share FROM b GROUP BY 1),
l AS (SELECT *, CASE WHEN lag(flag) OVER w IS NOT DISTINCT FROM flag THEN 0 ELSE 1 END AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
r AS (SELECT user_id, run, min(event_id) AS start, max(event_id) AS "end", count(*) AS length FROM g WHERE flag GROUP BY user_id, run)
SELECT r.user_id, r.start, r."end", r.length FROM r JOIN s USING (user_id) WHERE share > 0 AND length >= CASE WHEN share >= 1 THEN 1 ELSE ceil(ln(0.1) / ln(share)) END""")
def homozygous_stretches(spark, d):
    e = load(spark, d, "events").withColumn("flag", F.col("event_type") == "click")
    return SEQ.homozygous_stretches(e, ["user_id"], "event_id", "flag", 0.1).select("user_id", "start", "end", "length")


@query("""WITH s AS (SELECT l_partkey AS k, l_orderkey * 10 + l_linenumber AS start, l_orderkey * 10 + l_linenumber + 1 AS "end", l_returnflag AS state FROM lineitem),
l AS (SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY k ORDER BY start, "end", state)), g AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY start, "end", state ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT k, state, min(start) AS start, max("end") AS "end", count(*) AS merged FROM g GROUP BY k, g, state""")
def segment_merge(spark, d):
    s = load(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.expr("l_orderkey * 10 + l_linenumber").alias("start"), F.expr("l_orderkey * 10 + l_linenumber + 1").alias("end"), F.col("l_returnflag").alias("state"))
    return SEQ.merge_segments(s, ["k"], ["state"])


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, event_id, value, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM e) SELECT user_id, event_id, round(m, 6) AS median, round(abs(value - m), 6) AS deviation FROM m""")
def running_median_mad(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", "value")
    return SEQ.running_median(e, ["user_id"], "event_id", "value", 5).select("user_id", "event_id", F.round("median", 6).alias("median"), F.round("deviation", 6).alias("deviation"))


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, event_id, quantile_cont(value, 0.5) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l, quantile_cont(value, 0.5) OVER (w ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS r FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, round(l, 6) AS "left", round(r, 6) AS "right" FROM m""")
def neighbour_medians(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", "value")
    return SEQ.neighbour_medians(e, ["user_id"], "event_id", "value", 10).select("user_id", "event_id", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events),
b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS bx, last_value(v IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS b_y,
  first_value(CASE WHEN v IS NOT NULL THEN event_id END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ax, first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ay FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN bx IS NULL THEN ay WHEN ax IS NULL THEN b_y ELSE b_y + (ay - b_y) * (event_id - bx) / (ax - bx) END, 6) AS filled FROM b""")
def interpolated_track(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", F.expr("case when event_id % 3 = 0 then value end").alias("v"))
    return SEQ.interpolate(e, ["user_id"], "event_id", "v").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, quantile_disc(value, 0.65) AS cut FROM e GROUP BY 1) SELECT user_id, event_id, value FROM e JOIN c USING (user_id) WHERE value > cut""")
def percentile_cut(spark, d):
    return SEQ.percentile_cut(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "value", 0.65).select("user_id", "event_id", "value")


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, least(25, (n - 1) // 2) AS half FROM e), o AS (SELECT user_id, event_id, value, n, i + unnest(range(-half, half + 1)) AS j FROM h),
m AS (SELECT o.user_id, o.event_id, any_value(o.value) AS value, quantile_cont(e.value, 0.5) AS m FROM o JOIN e ON e.user_id = o.user_id AND e.i = CASE WHEN j < 0 THEN -1 - j WHEN j >= o.n THEN 2 * o.n - 1 - j ELSE j END GROUP BY o.user_id, o.event_id),
c AS (SELECT *, quantile_cont(value - m, 0.5) OVER (PARTITION BY user_id) AS c FROM m), z AS (SELECT *, 2.5 * quantile_cont(abs(value - m - c), 0.5) OVER (PARTITION BY user_id) AS z FROM c)
SELECT user_id, event_id, value, round(m + greatest(least(value - m, z), -z), 6) AS winsorised FROM z""")
def winsorised_track(spark, d):
    w = SEQ.winsorise(load(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value")
    return w.withColumn("winsorised", F.round("winsorised", 6))


# copy numbers
TRACK = """a AS (SELECT concat('chr', l_partkey % 22 + 1) AS ctg, l_partkey AS pos, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS ta, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS tb, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber % 2 = 0) AS na, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber % 2 <> 0) AS nb FROM lineitem GROUP BY ALL),
k AS (SELECT ctg, pos, na AS a, nb AS b, na + nb AS t, ta + tb AS n FROM a WHERE na + nb > 0 AND ta + tb > 0),
m AS (SELECT ctg, pos, log2((t / avg(t) OVER ()) / (n / avg(n) OVER ())) AS logr, CASE WHEN (pos * 2654435761) % 97 % 2 = 0 THEN a ELSE b END / t AS baf FROM k)"""


def _track(spark, d) -> DataFrame:
    """The normal's line items stand for the tumor here, since they have both statuses."""
    g = load(spark, d, "lineitem").groupBy(F.expr("concat('chr', l_partkey % 22 + 1)").alias("ctg"), F.col("l_partkey").alias("pos"))
    a = g.agg(*(F.count_if(F.expr(e)).alias(n) for n, e in (("ta", "l_returnflag = 'R' and l_linestatus = 'F'"), ("tb", "l_returnflag = 'R' and l_linestatus <> 'F'"), ("na", "l_returnflag <> 'R' and l_linenumber % 2 = 0"), ("nb", "l_returnflag <> 'R' and l_linenumber % 2 <> 0"))))
    own = lambda x, y: a.select("ctg", "pos", F.col(x).alias("a"), F.col(y).alias("b"))
    return CN.depth_ratios(own("na", "nb"), own("ta", "tb"))


@query(f"WITH {TRACK} SELECT ctg, pos, round(logr, 6) AS logr, round(baf, 6) AS baf FROM m")
def logr_baf(spark, d):
    return _track(spark, d).select("ctg", "pos", F.round("logr", 6).alias("logr"), F.round("baf", 6).alias("baf"))


@query(f"WITH {TRACK} SELECT ctg, pos, baf < 0.3 OR baf > 0.7 AS hom FROM m")
def genotype_track(spark, d):
    return CN.homozygous(_track(spark, d)).select("ctg", "pos", "hom")


GC = "x AS (SELECT m.*, p_size AS c1, p_retailprice AS c2, p_partkey % 37 AS c3 FROM m JOIN part ON p_partkey = pos)"


def _covariates(spark, d) -> DataFrame:
    p = load(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("double").alias("c1"), F.col("p_retailprice").alias("c2"), F.expr("cast(p_partkey % 37 as double)").alias("c3"))
    return _track(spark, d).join(p, "pos")


@query(f"WITH {TRACK}, {GC}, r AS (SELECT corr(logr, c1) AS c1, corr(logr, c2) AS c2, corr(logr, c3) AS c3 FROM x) SELECT round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, list_sort([{{'r': abs(c1), 'n': 'c1'}}, {{'r': abs(c2), 'n': 'c2'}}, {{'r': abs(c3), 'n': 'c3'}}])[3].n AS best FROM r")
def gc_correlation(spark, d):
    return CN.correlations(_covariates(spark, d), "logr", ["c1", "c2", "c3"]).select(*(F.round(c, 6).alias(c) for c in ("c1", "c2", "c3")), "best")


@query()
def logr_residual(spark, d):
    return CN.spline_residuals(_covariates(spark, d), "logr", ["c1", "c2", "c3"])


@query()
def joint_segments(spark, d):
    return CN.segments(_track(spark, d), 20.0)


GRID = f"""{TRACK}, s AS (SELECT ctg, count(*) AS n, avg(logr) AS logr, avg(least(baf, 1 - baf)) AS baf FROM m GROUP BY 1),
g AS (SELECT i, j, i / 100 AS r, j / 100 AS p, round(i / 100 + 0.01, 6) AS rho, round(j / 100 + 0.05, 6) AS psi FROM (SELECT unnest(range(10, 105)) AS i), (SELECT unnest(range(100, 600, 5)) AS j)),
y AS (SELECT g.*, n, baf, pow(2.0, logr) * (2 * (1 - r) + r * p) AS z, pow(2.0, logr) * (2 * (1 - rho) + rho * psi) AS zz, CASE WHEN baf = 0.5 THEN 0 ELSE n END AS loose, n * CASE WHEN baf = 0.5 THEN 0.05 ELSE 1.0 END AS w FROM s, g),
c AS (SELECT *, (r - 1 - (baf - 1) * z) / r AS na, (r - 1 + baf * z) / r AS nb, (rho - 1 - (baf - 1) * zz) / rho AS x, (rho - 1 + baf * zz) / rho AS yy FROM y),
e AS (SELECT *, CAST(round_even(x, 0) = 0 AS INT) + CAST(round_even(yy, 0) = 0 AS INT) AS none FROM c),
q AS (SELECT i, j, rho, psi, CASE WHEN sum(na) < sum(nb) THEN sum(pow(na - greatest(round_even(na, 0), 0.0), 2.0) * w) ELSE sum(pow(nb - greatest(round_even(nb, 0), 0.0), 2.0) * w) END AS distance, sum(0.25 * w) AS worst,
  sum((x + yy) * n) / sum(n) AS ploidy, sum(none * n) / sum(n) AS zero, coalesce(sum(none * loose) / nullif(sum(loose), 0), 0.0) AS zero_aberrant,
  sum(CASE WHEN abs(round_even(x, 0)) % 2 <> abs(round_even(yy, 0)) % 2 THEN n ELSE 0 END) / sum(n) AS uneven, sum(loose) > 0.03 * sum(n) OR max(loose) > 0.005 * sum(n) AS aberrant FROM e GROUP BY i, j, rho, psi),
f AS (SELECT *, (1 - distance / nullif(worst, 0)) * 100 AS goodness FROM q)"""


def _contig_means(spark, d) -> DataFrame:
    return _track(spark, d).groupBy("ctg").agg(F.count("*").alias("n"), F.avg("logr").alias("logr"), F.avg(Q.fold(F.col("baf"))).alias("baf"))


FIT = ("distance", "goodness", "ploidy", "zero", "zero_aberrant", "uneven")


@query(f"WITH {GRID} SELECT rho, psi, {', '.join(f'round({x}, 4) AS {x}' for x in FIT)}, aberrant FROM f")
def purity_grid(spark, d):
    """All 9,500 cells of the search."""
    g = CN.purity_grid(_contig_means(spark, d), CN.RHOS, CN.PSIS, CN.SHIFT)
    return g.select("rho", "psi", *(F.round(c, 4).alias(c) for c in FIT), "aberrant")


@query(f"""WITH {GRID}, v AS (SELECT *, k, CASE WHEN k = 3 AND rho > 1 THEN 1e20 ELSE distance END AS d FROM f, (SELECT unnest([1, 3]) AS k)),
o AS (SELECT unnest(range(-3, 4)) AS di), oo AS (SELECT di, unnest(range(-15, 16, 5)) AS dj FROM o),
b AS (SELECT v.k, v.i + di AS i, v.j + dj AS j, min(d) AS near FROM v, oo WHERE di <> 0 OR dj <> 0 GROUP BY 1, 2, 3),
h AS (SELECT v.* FROM v JOIN b USING (k, i, j) WHERE i BETWEEN 13 AND 101 AND j BETWEEN 115 AND 580 AND d < near AND rho >= 0.2 AND goodness > 60),
t AS (SELECT *, CASE WHEN k = 1 AND aberrant AND ploidy > 1.5 AND ploidy < 5.5 AND zero > 0.02 THEN 1 WHEN k = 1 AND ploidy > 1.7 AND ploidy < 2.3 AND zero_aberrant > 0.1 THEN 2
  WHEN k = 3 AND aberrant AND ploidy > 1.5 AND ploidy < 5.5 AND (zero_aberrant > 0.1 OR zero > 0.02 OR uneven > 0.05) THEN 3 WHEN k = 3 AND ploidy > 1.7 AND ploidy < 2.3 THEN 4 END AS stage FROM h)
SELECT least(rho, 1.0) AS rho, psi, stage, round(goodness, 4) AS goodness FROM t WHERE stage IS NOT NULL ORDER BY stage, d, j, i LIMIT 1""")
def purity_best(spark, d):
    """The whole search over the contigs' means."""
    return PL.fit_purity(_contig_means(spark, d)).select("rho", "psi", "stage", F.round("goodness", 4).alias("goodness"))


@query()
def purity_fit(spark, d):
    """The search over segments."""
    return PL.fit_purity(CN.segments(_track(spark, d), 20.0))


CODED = """n AS (SELECT concat('chr', l_partkey % 22 + 1) AS ctg, l_partkey AS pos, l_orderkey, upper(substr('ACGT', l_linenumber % 4 + 1, 1)) AS b, l_returnflag FROM lineitem),
u AS (SELECT DISTINCT ctg, pos, l_orderkey, b FROM n WHERE l_returnflag = 'R'),
k AS (SELECT ctg, pos, [count(*) FILTER (b = 'A'), count(*) FILTER (b = 'C'), count(*) FILTER (b = 'G'), count(*) FILTER (b = 'T')] AS c FROM u GROUP BY 1, 2)"""


@query(f"WITH {CODED} SELECT k.ctg, k.pos, coalesce(c[p_size % 6], 0) AS a, c[1 + p_partkey % 4] AS b FROM k JOIN part ON p_partkey = k.pos WHERE p_partkey % 7 > 0")
def coded_alleles(spark, d):
    """Base counts of the tumor at the places of a coded table of alleles, some codes of which are none."""
    counts = C.unique_fragment_counts(observations(spark, d).filter("sample = 'tumor'"))
    p = load(spark, d, "part").filter("p_partkey % 7 > 0")
    return CN.allele_pairs(counts, p.select(F.expr("concat('chr', p_partkey % 22 + 1)").alias("ctg"), F.col("p_partkey").alias("pos"), (F.col("p_size") % 6).alias("first"), (F.col("p_partkey") % 4 + 1).alias("second")))


BINOMIAL = """WITH c AS (SELECT p_partkey AS id, p_size AS n, p_partkey % (p_size + 1) AS k FROM part), o AS (SELECT id, n, k, unnest(range(0, n + 1)) AS i FROM c),
l AS (SELECT *, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.3) + (n - i) * ln(0.7) AS l, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.3) + (n - k) * ln(0.7) AS own FROM o)
SELECT id, round(least(sum(exp(l)) FILTER (l <= own + 1e-7), 1.0), 6) AS p FROM l GROUP BY id"""


@query(BINOMIAL)
def binomial_test(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"), F.expr("cast(p_partkey % (p_size + 1) as int)").alias("k"))
    return p.select("id", F.round(CN.binomial_p(F.col("k"), F.col("n"), F.lit(0.3)), 6).alias("p"))


VERDICTS = """WITH c AS (SELECT p_partkey, p_size + 10 AS n, CAST(p_partkey % (p_size + 11) AS INT) AS k, 0.6 AS pur, CAST(p_partkey % 3 + 1 AS INT) AS major, CAST(p_partkey % 2 AS INT) AS minor FROM part),
m AS (SELECT *, unnest([1, 2]) AS side FROM c), x AS (SELECT *, CASE WHEN side = 1 OR minor = 0 THEN major ELSE minor END AS a, pur * (major + minor) + 2 * (1 - pur) AS total FROM m),
e AS (SELECT *, (pur * a + 1 - pur) / total AS eg, pur * a / total AS es FROM x), p AS (SELECT *, unnest(['g', 's']) AS of, unnest([eg, es]) AS q FROM e),
o AS (SELECT p.*, unnest(range(0, n + 1)) AS i, greatest(least(q, 1 - 1e-12), 1e-12) AS r FROM p),
l AS (SELECT *, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(r) + (n - i) * ln(1 - r) AS l, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(r) + (n - k) * ln(1 - r) AS own FROM o),
t AS (SELECT p_partkey, n, k, pur, side, of, max(q) AS q, least(sum(exp(l)) FILTER (l <= own + 1e-7), 1.0) AS pv FROM l GROUP BY p_partkey, n, k, pur, side, of),
u AS (SELECT p_partkey, k / n AS f, pur, max(pv) FILTER (of = 'g') AS pg, max(pv) FILTER (of = 's') AS ps, max(q) FILTER (of = 'g' AND side = 1) AS eg, max(q) FILTER (of = 's' AND side = 1) AS es FROM t GROUP BY p_partkey, n, k, pur),
v AS (SELECT *, log10((pg + 1e-300) / (ps + 1e-300)) AS odds, CASE WHEN es <= eg THEN f < es / 1.5 ELSE f < eg / 2 END AS low FROM u)
SELECT p_partkey, CASE WHEN f < 0.05 AND pur > 0.2 AND pur < 0.9 THEN 'subclonal' WHEN f > 0.95 THEN 'germline'
  WHEN pg > 0.01 AND ps < 0.01 THEN CASE WHEN odds >= 2 AND f > 0.25 THEN 'germline' ELSE 'probable_germline' END WHEN pg < 0.01 AND ps > 0.01 THEN CASE WHEN odds <= -2 THEN 'somatic' ELSE 'probable_somatic' END
  WHEN pg > 0.01 AND ps > 0.01 THEN 'ambiguous' WHEN pur >= 0.3 AND f < 0.25 AND low THEN 'subclonal' WHEN odds < -5 AND ps > 1e-10 THEN 'somatic' WHEN odds > 5 AND pg > 1e-4 THEN 'germline' ELSE 'ambiguous' END AS verdict FROM v"""


@query(VERDICTS)
def verdict_class(spark, d):
    p = load(spark, d, "part").select("p_partkey", (F.col("p_size") + 10).alias("depth"), F.expr("cast(p_partkey % (p_size + 11) as int)").alias("alt"), F.lit(0.6).alias("purity"), F.expr("cast(p_partkey % 3 + 1 as int)").alias("major"), F.expr("cast(p_partkey % 2 as int)").alias("minor"))
    return CN.verdicts(p).select("p_partkey", "verdict")


# sampling
def _uniform_sql(key: str, seed: int = 0) -> str:
    return f"((((({key} + 1 + {seed * 7919}) % 2147483647) * 48271) % 2147483647 * 48271) % 2147483647) / 2147483647.0"


@query(f"SELECT o_orderkey FROM orders WHERE {_uniform_sql('o_orderkey', 3)} < 0.25")
def seeded_sample(spark, d):
    return S.sample_part(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.25, 3)


@query(f"""WITH o AS (SELECT o_orderkey, o_orderstatus, {_uniform_sql('o_orderkey')} AS u FROM orders), n AS (SELECT count(*) AS n FROM o WHERE o_orderstatus = 'P'),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) AS k FROM o) SELECT o_orderkey, o_orderstatus FROM r, n WHERE o_orderstatus = 'P' OR k <= floor(n * 2.0)""")
def ratio_cap(spark, d):
    return S.cap_ratio(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "P", {"O": 2.0, "F": 2.0}, "o_orderkey")


@query("SELECT o_orderkey, o_orderkey % 7 AS bin FROM orders")
def round_robin_bins(spark, d):
    return S.round_robin(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@query(f"WITH t AS (SELECT unnest({S.BETA_CDF}) AS c, generate_subscripts({S.BETA_CDF}, 1) - 1 AS i), o AS (SELECT o_orderkey, {_uniform_sql('o_orderkey', 1)} AS u FROM orders) SELECT o_orderkey, max(i) / 100.0 AS af FROM o JOIN t ON t.c <= o.u GROUP BY o_orderkey")
def beta_inverse_cdf(spark, d):
    return load(spark, d, "orders").select("o_orderkey", S.beta_fraction(S.uniform(F.col("o_orderkey"), 1)).alias("af"))


ALTS = """r AS (SELECT l_partkey % 40 AS pos, l_orderkey AS k, concat('q', l_orderkey) AS qname, bool_or(l_linenumber % 3 = 0) AS is_alt, l_orderkey % 2 = 1 AS reverse FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {ALTS}, s AS (SELECT pos, count(*) AS n, count(*) FILTER (is_alt) AS alts FROM r GROUP BY pos),
t AS (SELECT unnest({S.BETA_CDF}) AS c, generate_subscripts({S.BETA_CDF}, 1) - 1 AS i), u AS (SELECT pos, n, alts, {_uniform_sql('(pos * 5 + d)')} AS u FROM s, (SELECT unnest(range(0, 4)) AS d)),
z AS (SELECT pos, n, CAST(floor(round(n * (max(i) / 100.0) / (alts / n), 9)) AS BIGINT) AS size FROM u JOIN t ON t.c <= u.u GROUP BY pos, n, alts, u.u UNION SELECT pos, n, n FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY md5('0-' || qname), qname) AS rank FROM r), p AS (SELECT DISTINCT pos, size FROM z WHERE size BETWEEN 3 AND n),
g AS (SELECT p.pos, size, qname, is_alt, reverse FROM p JOIN k ON k.pos = p.pos AND rank <= size),
f AS (SELECT pos, size FROM g GROUP BY ALL HAVING count(*) FILTER (is_alt) >= 3 AND count(*) FILTER (is_alt AND reverse) BETWEEN 1 AND count(*) FILTER (is_alt) - 1)
SELECT 'chr1' AS ctg, g.pos, g.size, count(*) AS n, md5(string_agg(qname, ',' ORDER BY qname)) AS names FROM g JOIN f USING (pos, size) GROUP BY ALL""")
def beta_subsamples(spark, d):
    """Orders as reads of forty sites, in nested samples."""
    li = load(spark, d, "lineitem").groupBy((F.col("l_partkey") % 40).alias("pos"), "l_orderkey").agg(F.bool_or(F.col("l_linenumber") % 3 == 0).alias("is_alt"))
    r = li.select(F.lit("chr1").alias("ctg"), "pos", F.concat(F.lit("q"), "l_orderkey").alias("qname"), "is_alt", (F.col("l_orderkey") % 2 == 1).alias("reverse"))
    return S.beta_subsamples(r).groupBy("ctg", "pos", "size").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("qname")), ",")).alias("names"))


@query(f"""WITH i AS (SELECT concat('chr', n_nationkey + 1) AS ctg, CAST(30 + n_nationkey * 3 AS BIGINT) AS nc, CAST(80 - n_nationkey * 2 AS BIGINT) AS tc, n_nationkey + 1 AS x FROM nation),
h AS (SELECT *, CASE WHEN x <= 6 THEN 1.0 WHEN x <= 8 THEN 1.25 WHEN x > 16 THEN 0.5 ELSE 0.75 END AS share FROM i), c AS (SELECT *, least(floor(round(tc / 0.3, 9)), floor(round(nc / (1 + share - 0.3), 9))) AS cov FROM h),
p AS (SELECT *, floor(nc / 4) AS nb, floor(tc / 4) AS tb, floor(floor(round(cov * 0.3, 9)) / 4) AS tt, floor((cov - floor(round(cov * 0.3, 9))) / 4) AS nt FROM c), q AS (SELECT *, floor(round((tt + nt) * share, 9)) AS nn FROM p),
b AS (SELECT *, 'normal' AS sample, unnest(range(0, CAST(nb AS BIGINT))) AS bin FROM q UNION ALL SELECT *, 'tumor', unnest(range(0, CAST(tb AS BIGINT))) FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY ctg, sample ORDER BY {_uniform_sql('bin')}, bin) AS k FROM b),
o AS (SELECT ctg, sample, bin, 'tumor' AS part FROM r WHERE k <= CASE sample WHEN 'tumor' THEN tt ELSE nt END UNION ALL SELECT ctg, sample, bin, 'normal' FROM r WHERE sample = 'normal' AND CASE WHEN k > nt THEN k - nt ELSE k + nb - nt END <= nn),
l AS (SELECT concat('chr', l_suppkey % 25 + 1) AS ctg, CASE l_returnflag WHEN 'R' THEN 'tumor' ELSE 'normal' END AS sample, l_orderkey % 20 AS bin FROM lineitem)
SELECT ctg, sample, part, count(DISTINCT bin) AS bins, count(*) AS reads FROM o JOIN l USING (ctg, sample, bin) GROUP BY ALL""")
def mixed_samples(spark, d):
    """Line items as reads in bins of their contig, mixed to three tenths of tumor."""
    c = load(spark, d, "nation").select(F.expr("concat('chr', n_nationkey + 1)").alias("ctg"), F.expr("cast(30 + n_nationkey * 3 as bigint)").alias("normal_coverage"), F.expr("cast(80 - n_nationkey * 2 as bigint)").alias("tumor_coverage"))
    plan = S.mixing_plan(c.withColumn("share", S.normal_share(F.col("ctg"))), 0.3)
    reads = load(spark, d, "lineitem").select(F.expr("concat('chr', l_suppkey % 25 + 1)").alias("ctg"), F.expr("case l_returnflag when 'R' then 'tumor' else 'normal' end").alias("sample"), (F.col("l_orderkey") % 20).alias("bin"))
    return S.mixed_reads(reads, S.mixed_bins(plan)).groupBy("ctg", "sample", "part").agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("reads"))


@query(f"WITH {NEAR_TRUTHS} SELECT ctg, pos FROM t WHERE p_size % 4 = 0 AND NOT ({_uniform_sql('pos')} <= 0.7 AND EXISTS (SELECT 1 FROM t u WHERE u.p_size % 30 = 0 AND u.ctg = t.ctg AND u.pos <> t.pos AND abs(u.pos - t.pos) <= 16))")
def flanking_exclusion(spark, d):
    """Truths apart from others, and those that a draw lets stay."""
    t = load(spark, d, "part").select(F.expr("concat('chr', p_partkey % 5)").alias("ctg"), F.col("p_partkey").alias("pos"), "p_size")
    return P.apart_from(t.filter("p_size % 4 = 0").select("ctg", "pos"), t.filter("p_size % 30 = 0").select("ctg", "pos"), 16)


# text forms
@query("SELECT l_orderkey, l_linenumber, concat(concat('A', '+', 'ACG'[1:1 + l_linenumber % 3]), ',', 'g', ',', CASE WHEN l_linestatus = 'F' THEN 'C-NN' ELSE 'c' END, ',', '*') AS tokens FROM lineitem".replace("concat('A', '+', 'ACG'[1:1 + l_linenumber % 3])", "'A+' || substr('ACG', 1, CAST(1 + l_linenumber % 3 AS INT))"))
def pileup_tokens(spark, d):
    li = load(spark, d, "lineitem")
    n = F.col("l_linenumber") % 3 + 1
    text = F.concat(F.lit("^]A+"), n.cast("string"), F.substring(F.lit("ACG"), F.lit(1), n), F.lit("g$"), F.when(F.col("l_linestatus") == "F", "C-2NN").otherwise("c"), F.lit("*"))
    return li.select("l_orderkey", "l_linenumber", F.array_join(T.pileup_tokens(text), ",").alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, concat('S,0,0;M,', 5, ',0;I,', 5 + l_linenumber, ',', l_linenumber, ';D,', 5 + l_linenumber + 2, ',', l_linenumber, ';M,', 7 + l_linenumber, ',', l_linenumber + 3) AS ops FROM lineitem")
def cigar_walk(spark, d):
    cigar = F.concat(F.lit("5S"), F.col("l_linenumber").cast("string"), F.lit("M2I3D10M"))
    ops = T.cigar_operations(cigar)
    out = F.transform(ops, lambda o: F.concat_ws(",", o["op"], o["read"].cast("string"), o["ref"].cast("string")))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(out, ";").alias("ops"))


@query("SELECT l_orderkey, l_linenumber, concat(l_linenumber + 3, '/', l_linenumber, '-DAT 1/0 XC ', l_linenumber, '/2-') AS code, CAST(l_linenumber + 3 AS INT) AS forward, l_linenumber AS reverse, l_linenumber AS c FROM lineitem")
def alt_info_codec(spark, d):
    n = F.col("l_linenumber")
    v = lambda f, r: F.struct(f.cast("int").alias("f"), r.cast("int").alias("r"))
    li = load(spark, d, "lineitem").withColumn("code", T.alt_info(n + 3, n, F.create_map(F.lit("XC"), v(n, F.lit(2)), F.lit("DAT"), v(F.lit(1), F.lit(0)))))
    back = T.parse_alt_info(F.col("code"))
    return li.select("l_orderkey", "l_linenumber", "code", back["forward"].alias("forward"), back["reverse"].alias("reverse"), back["alleles"]["XC"]["f"].alias("c"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS VARCHAR) AS dp, concat('0/1:', l_linenumber, ':0.5') AS sample, [0, CAST(l_linenumber % 2 AS INT)]::VARCHAR AS genotype FROM lineitem")
def format_lookup(spark, d):
    s = F.concat(F.lit("0/1:"), F.col("l_linenumber").cast("string"), F.lit(":0.2"))
    gt = A.parse_genotype(F.concat((F.col("l_linenumber") % 2).cast("string"), F.lit("|.")))
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", T.format_value(F.lit("GT:DP:AF"), s, "DP").alias("dp"), T.with_format_value(F.lit("GT:DP:AF"), s, "AF", F.lit("0.5")).alias("sample"),
        F.concat(F.lit("["), F.array_join(F.transform(gt, lambda x: x.cast("string")), ", "), F.lit("]")).alias("genotype"),
    )


VARIANTS = "v AS (SELECT p_partkey, substr(upper(replace(p_name, ' ', '')), 1, CAST(1 + p_partkey % 4 AS INT)) AS ref, substr(upper(replace(p_name, ' ', '')), 1, CAST(1 + p_size % 4 AS INT)) AS alt FROM part)"


@query(f"WITH {VARIANTS} SELECT p_partkey, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNV' WHEN length(ref) < length(alt) THEN 'INS' WHEN length(ref) > length(alt) THEN 'DEL' END AS kind, CASE WHEN length(ref) < length(alt) THEN substr(ref, 1, 1) || '+' || substr(alt, 2) WHEN length(ref) > length(alt) THEN substr(ref, 1, 1) || '-' || repeat('N', length(ref) - 1) ELSE alt END AS key FROM v")
def variant_class(spark, d):
    name = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    v = load(spark, d, "part").select("p_partkey", F.substring(name, F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")).alias("ref"), F.substring(name, F.lit(1), F.col("p_size") % 4 + 1).alias("alt"))
    return v.select("p_partkey", A.variant_class(F.col("ref"), F.col("alt")).alias("kind"), A.allele_key(F.col("ref"), F.col("alt")).alias("key"))


@query("""WITH v AS (SELECT p_partkey, 'GATC' || repeat('AT', CAST(p_partkey % 3 AS INT)) AS ref, CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'GATC' END || repeat('AT', CAST(p_size % 3 AS INT)) AS alt FROM part),
k AS (SELECT *, list_max([CASE WHEN suffix(ref, substr(alt, length(alt) - i + 1)) THEN i ELSE 0 END FOR i IN range(0, least(length(ref), length(alt)))]) AS n FROM v)
SELECT p_partkey, substr(ref, 1, length(ref) - n) AS ref, substr(alt, 1, length(alt) - n) AS alt FROM k""")
def suffix_trim(spark, d):
    v = load(spark, d, "part").select("p_partkey", F.concat(F.lit("GATC"), F.repeat(F.lit("AT"), (F.col("p_partkey") % 3).cast("int"))).alias("ref"), F.concat(F.when(F.col("p_size") % 2 == 0, "C").otherwise("GATC"), F.repeat(F.lit("AT"), F.col("p_size") % 3)).alias("alt"))
    return v.select("p_partkey", A.suffix_trim(F.col("ref"), F.col("alt")).alias("t")).select("p_partkey", "t.ref", "t.alt")


@query("""SELECT p_partkey, CASE substr(p_brand, 7, 1) WHEN '1' THEN 100 WHEN '2' THEN 25 WHEN '3' THEN 75 WHEN '4' THEN 50 ELSE 0 END AS code, CASE WHEN p_size <= 20 THEN 0 WHEN p_size <= 40 THEN 20 ELSE 60 END AS mq,
CAST(floor(least(p_size, 60) / 60 * 100) AS INT) AS bq FROM part""")
def base_and_quality_codes(spark, d):
    base = F.translate(F.substring("p_brand", 7, 1), "12345", "ACGTZ")
    return load(spark, d, "part").select("p_partkey", A.base_code(base).alias("code"), Q.mapping_bucket(F.col("p_size")).alias("mq"), Q.scaled_base_quality(F.col("p_size"), F.lit("ont")).alias("bq"))


@query("SELECT ctg, chunk, start, least(start + 1000, n) AS \"end\" FROM (SELECT n_name AS ctg, n, unnest(range(0, CAST(ceil(n / 1000) AS BIGINT))) AS chunk, unnest(range(0, CAST(ceil(n / 1000) AS BIGINT))) * 1000 AS start FROM (SELECT n_name, n_nationkey * 777 + 1 AS n FROM nation))")
def contig_chunks(spark, d):
    from twinlens.sources.readers import chunks

    return chunks(load(spark, d, "nation").select(F.col("n_name").alias("ctg"), F.expr("cast(n_nationkey * 777 + 1 as bigint)").alias("length")), 1000)


# sites and examples
CONTIGS = "i AS (SELECT concat('chr', n_nationkey) AS ctg, CAST(n_nationkey * 777 + 1 AS BIGINT) AS length FROM nation)"


def _index(spark, d) -> DataFrame:
    return load(spark, d, "nation").select(F.expr("concat('chr', n_nationkey)").alias("ctg"), F.expr("cast(n_nationkey * 777 + 1 as bigint)").alias("length"))


@query(f"WITH {CONTIGS} SELECT * FROM i WHERE ctg NOT IN ('chr0', 'chr23', 'chr24')")
def default_contigs(spark, d):
    return SI.eligible_contigs(_index(spark, d))


@query(f"WITH {CONTIGS} SELECT * FROM i WHERE ctg IN ('chr0', 'chr2', 'chr3', 'chr20') AND ctg IN (SELECT concat('chr', p_partkey % 22 + 1) FROM part) AND ctg IN (SELECT concat('chr', s_suppkey % 9) FROM supplier)")
def named_contigs(spark, d):
    at = lambda t, x: load(spark, d, t).select(F.expr(x).alias("ctg"))
    return SI.eligible_contigs(_index(spark, d), ["chr0", "chr2", "chr3", "chr20"], at("part", "concat('chr', p_partkey % 22 + 1)"), at("supplier", "concat('chr', s_suppkey % 9)"))


GIVEN = "v AS (SELECT DISTINCT concat('chr', p_partkey % 22 + 1) AS ctg, p_partkey AS pos FROM part WHERE p_size > 30)"


def _given(spark, d) -> DataFrame:
    return load(spark, d, "part").filter("p_size > 30").select(F.expr("concat('chr', p_partkey % 22 + 1)").alias("ctg"), F.col("p_partkey").alias("pos"))


@query(_paired_sql().replace("WITH ", f"WITH {GIVEN}, ", 1).replace("SELECT ctg, pos, ref, sample, depth, snv, indel, top_allele, top_af, second_af, top_indel, indel_af, naf, indel_naf FROM q WHERE snv OR indel", """,
w AS (SELECT DISTINCT ctg, pos FROM q WHERE snv OR indel), t AS (SELECT DISTINCT ctg, pos, true AS found FROM s WHERE sample = 'tumor'), u AS (SELECT *, true AS hybrid FROM v)
SELECT ctg, pos, coalesce(found, false) AS found, coalesce(hybrid, false) AS hybrid FROM t FULL JOIN u USING (ctg, pos) LEFT JOIN d USING (ctg, pos)
WHERE CASE WHEN coalesce(hybrid, false) THEN coalesce(nd, 0) > 0 ELSE (ctg, pos) IN (SELECT (ctg, pos) FROM w) END"""))
def given_sites(spark, d):
    """De-novo candidates and given sites, after the paired filter, which given sites bypass."""
    c = C.allele_counts(observations(spark, d))
    found = C.candidates(c.filter("sample = 'tumor'"))
    return SI.keep_given(SI.with_given(found, _given(spark, d)), P.paired_filter(found, c), c.filter("sample = 'normal'"))


@query(f"WITH {GIVEN}, {GATE}, t AS (SELECT DISTINCT ctg, pos FROM s WHERE sample = 'tumor') SELECT * FROM t EXCEPT SELECT * FROM v")
def reference_sites(spark, d):
    found = C.candidates(C.allele_counts(observations(spark, d)).filter("sample = 'tumor'")).select("ctg", "pos").distinct()
    return SI.without_truth(found, _given(spark, d))


@query(f"""WITH {GIVEN}, {GATE}, t AS (SELECT DISTINCT ctg, pos FROM s WHERE sample = 'tumor'), n AS (SELECT DISTINCT ctg, pos FROM s WHERE sample = 'normal')
SELECT count(*) FILTER (n.pos IS NOT NULL) AS in_normal, count(*) FILTER (v.pos IS NOT NULL) AS in_tumor, count(*) FILTER (n.pos IS NOT NULL AND v.pos IS NOT NULL) AS in_both FROM t LEFT JOIN n USING (ctg, pos) LEFT JOIN v USING (ctg, pos)""")
def truth_overlaps(spark, d):
    c = C.candidates(C.allele_counts(observations(spark, d)))
    return SI.truth_overlaps(c.filter("sample = 'tumor'"), _given(spark, d), c.filter("sample = 'normal'"))


@query("""WITH v AS (SELECT p_partkey, substr('AC', 1, CAST(1 + p_size % 2 AS INT)) AS ref, substr('GT', 1, CAST(1 + p_partkey % 2 AS INT)) AS alt, p_partkey % 4 > 0 AS hom, p_partkey % 3 AS k FROM part WHERE p_partkey % 7 > 0),
o AS (SELECT *, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN alt WHEN length(ref) = 1 THEN 'G+T' WHEN length(alt) = 1 THEN 'A-N' END AS own FROM v),
h AS (SELECT CASE WHEN hom AND k = 0 AND own IS NOT NULL THEN CASE WHEN own LIKE '%+%' THEN 'ins' WHEN own LIKE '%-%' THEN 'del' ELSE 'snp' END WHEN hom AND k < 2 THEN 'signal' END AS kind FROM o UNION ALL SELECT 'total' FROM o)
SELECT kind, count(*) AS n FROM h WHERE kind IS NOT NULL GROUP BY kind""")
def truth_in_normal(spark, d):
    p = load(spark, d, "part").select(F.lit("chr1").alias("ctg"), F.col("p_partkey").alias("pos"), F.expr("substring('AC', 1, 1 + p_size % 2)").alias("ref"), F.expr("substring('GT', 1, cast(1 + p_partkey % 2 as int))").alias("alt"), F.expr("p_partkey % 4 > 0").alias("hom"))
    own = F.coalesce(SI.allele_name(F.col("ref"), F.col("alt")), F.lit("T"))
    shown = p.filter("pos % 3 < 2").select("ctg", "pos", F.create_map(F.when(F.col("pos") % 3 == 0, own).otherwise("T"), F.lit(0.2)).alias("alleles"))
    return SI.truth_in_normal(p, p.filter("pos % 7 = 0"), shown)


HP = [f"{k}{i}" for k in ("hp", "all") for i in range(3)]


@query(f"""WITH {OBS}, t AS (SELECT concat('chr', p_partkey % 22 + 1) AS ctg, p_partkey AS pos, substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref,
  unnest(CASE WHEN p_partkey % 3 = 0 THEN [substr('CGTA', CAST(p_partkey % 4 AS INT) + 1, 1), substr('GTAC', CAST(p_partkey % 4 AS INT) + 1, 1)] ELSE [substr('CGTA', CAST(p_partkey % 4 AS INT) + 1, 1) || CASE WHEN p_partkey % 5 = 0 THEN 'AC' ELSE '' END] END) AS alt, p_size FROM part),
r AS (SELECT *, substr(alt, 1, 1) || CASE WHEN length(alt) > 1 THEN '+AC' ELSE '' END AS own FROM t WHERE p_size % 2 = 1),
w AS (SELECT ctg, pos, sample, upper(base) || CASE WHEN indel LIKE '-%' THEN '-NN' ELSE indel END AS shown, CASE WHEN hp IN (1, 2) THEN hp ELSE 0 END AS hp FROM o)
SELECT ctg, pos, ref, alt, CAST(p_size AS BIGINT) AS ndp, CAST(p_size + 10 AS BIGINT) AS tdp, CAST(round(0.25 * p_size) AS BIGINT) AS nalt, CAST(round(0.5 * (p_size + 10)) AS BIGINT) AS talt, {", ".join(f"CAST(-1 AS BIGINT) AS {x}" for x in HP)} FROM t WHERE p_size % 2 = 0
UNION ALL SELECT ctg, pos, ref, alt, n.*, a.* FROM r, LATERAL (SELECT count(*) FILTER (sample = 'normal'), count(*) FILTER (sample = 'tumor'), count(*) FILTER (sample = 'normal' AND shown = own), count(*) FILTER (sample = 'tumor' AND shown = own) FROM w WHERE w.ctg = r.ctg AND w.pos = r.pos) n,
LATERAL (SELECT {", ".join(f"count(*) FILTER (sample = 'tumor' AND shown = own AND hp = {i})" for i in range(3))}, {", ".join(f"count(*) FILTER (sample = 'tumor' AND hp = {i})" for i in range(3))} FROM w WHERE w.ctg = r.ctg AND w.pos = r.pos) a""")
def allele_support(spark, d):
    """A third of the sites has two truths."""
    of = lambda x: F.substring(F.lit(x), (F.col("p_partkey") % 4).cast("int") + 1, F.lit(1))
    alts = F.when(F.col("p_partkey") % 3 == 0, F.array(of("CGTA"), of("GTAC"))).otherwise(F.array(F.concat(of("CGTA"), F.when(F.col("p_partkey") % 5 == 0, "AC").otherwise(""))))
    t = load(spark, d, "part").select(F.expr("concat('chr', p_partkey % 22 + 1)").alias("ctg"), F.col("p_partkey").alias("pos"), of("ACGT").alias("ref"), F.explode(alts).alias("alt"), "p_size")
    size = F.col("p_size").cast("long")
    called = t.filter("p_size % 2 = 0").select("ctg", "pos", (size + 10).alias("depth"), F.lit(0.5).alias("af"), size.alias("normal_depth"), F.lit(0.25).alias("normal_af")).distinct()
    return SI.allele_support(t, called, observations(spark, d)).fillna(-1, HP)  # haplotypes of called sites are not counted


@query("""WITH f AS (SELECT p_partkey AS pos, p_size % 3 > 0 AS a, p_size % 4 > 0 AS b FROM part) SELECT 'chr1' AS ctg, pos, 'PASS' AS filter FROM f WHERE a AND b""")
def confirmed_calls(spark, d):
    p = load(spark, d, "part").select(F.lit("chr1").alias("ctg"), F.col("p_partkey").alias("pos"), F.col("p_size"))
    by = lambda k: p.select("ctg", "pos", F.when(F.col("p_size") % k > 0, "PASS").otherwise("LowQual").alias("filter"))
    return SI.confirmed(by(3), by(4))


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE 0.1 END + l_linenumber / 100, 6) AS ins, 0.2 AS del FROM lineitem")
def indel_fraction_sum(spark, d):
    n = F.col("l_linenumber")
    m = F.create_map(F.lit("A"), F.lit(0.3), F.lit("A+C"), F.when(n % 2 == 0, 0.5).otherwise(0.1), F.lit("A+CC"), n / 100, F.lit("A-NN"), F.lit(0.2))
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(SI.indel_fraction(m, "+"), 6).alias("ins"), SI.indel_fraction(m, "-").alias("del"))


@query("""WITH r AS (SELECT l_partkey AS pos, l_orderkey, l_returnflag AS f, l_quantity AS q, l_linestatus AS s FROM lineitem)
SELECT concat('chr', a.pos % 22 + 1) AS ctg, a.pos, a.q AS normal, b.q AS tumor, a.s AS normal_info, b.s AS tumor_info FROM r a JOIN r b ON a.pos = b.pos WHERE a.f = 'A' AND b.f = 'R'""")
def paired_tensors(spark, d):
    t = load(spark, d, "lineitem").select(F.expr("concat('chr', l_partkey % 22 + 1)").alias("ctg"), F.col("l_partkey").alias("pos"), F.array("l_quantity").alias("features"), F.col("l_linestatus").alias("alt_info"), "l_returnflag")
    both = EX.paired_tensors(t.filter("l_returnflag = 'A'"), t.filter("l_returnflag = 'R'"))
    return both.withColumns({"normal": F.get("normal", 0), "tumor": F.get("tumor", 0)})


@query("""WITH x AS (SELECT p_partkey, CAST(p_partkey % 120 AS DOUBLE) AS depth, [CAST(p_size AS DOUBLE), p_retailprice] AS f FROM part)
SELECT p_partkey, array_to_string([printf('%.6f', CASE WHEN depth > 50 THEN v * 50.0 / depth ELSE v END) FOR v IN f], ',') AS features FROM x""")
def rescaled_tensors(spark, d):
    f = EX.rescaled(F.array(F.col("p_size").cast("double"), "p_retailprice"), (F.col("p_partkey") % 120).cast("double"))
    return load(spark, d, "part").select("p_partkey", F.array_join(F.transform(f, lambda x: F.format_string("%.6f", x)), ",").alias("features"))


@query("""WITH x AS (SELECT p_partkey, CAST(p_size % 5 AS INT) AS a, CAST(p_partkey % 4 AS INT) AS b FROM part), y AS (SELECT *, 15 - 2 - a - b AS r FROM x)
SELECT p_partkey, repeat('0', 2 * CAST(floor(r / 2) AS INT)) || repeat('1', 2 * a) || '0000' || repeat('2', 2 * b) || repeat('0', 2 * (r - CAST(floor(r / 2) AS INT))) AS matrix FROM y""")
def padded_tensors(spark, d):
    of = lambda k, n: F.array_repeat(F.lit(k), (2 * n).cast("int"))
    m = EX.padded(of(1, F.col("p_size") % 5), of(2, F.col("p_partkey") % 4), 15, 2)
    return load(spark, d, "part").select("p_partkey", F.array_join(F.transform(m, lambda x: x.cast("string")), "").alias("matrix"))


@query("""WITH r AS (SELECT concat('chr', l_partkey % 22 + 1) AS ctg, l_partkey AS pos, l_orderkey * 10 + l_linenumber AS k FROM lineitem)
SELECT ctg, pos, k, coalesce(lead(pos) OVER (PARTITION BY ctg ORDER BY pos, k) <> pos, true) AS is_last FROM r""")
def duplicate_run_ends(spark, d):
    r = load(spark, d, "lineitem").select(F.expr("concat('chr', l_partkey % 22 + 1)").alias("ctg"), F.col("l_partkey").alias("pos"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return EX.last_of_position(r, "k")


@query("""WITH x AS (SELECT p_partkey % 3 AS label, [p_size % 7, p_size % 5, p_size % 3 + 2] AS p FROM part), y AS (SELECT label, list_position(p, list_max(p)) - 1 AS best FROM x)
SELECT count(*) FILTER (best = 2 AND label = 2) AS tp, count(*) FILTER (best = 2 AND label <> 2) AS fp, count(*) FILTER (best <> 2 AND label = 2) AS fn FROM y""")
def validation_counts(spark, d):
    p = load(spark, d, "part").select((F.col("p_partkey") % 3).alias("label"), F.array(F.col("p_size") % 7, F.col("p_size") % 5, F.col("p_size") % 3 + 2).alias("p"))
    return EX.validation_counts(p)


@query()
def read_rows(spark, d):
    """Ten reads of each site at most, in the order of a matrix's rows."""
    o = observations(spark, d).select("ctg", "pos", "qname", F.col("bq").alias("start"), "hp")
    return EX.read_rows(o, 10)


CODE = "CASE {x} WHEN 'A' THEN 100 WHEN 'C' THEN 25 WHEN 'G' THEN 75 WHEN 'T' THEN 50 ELSE 0 END"
NEAR = """o AS (SELECT concat('chr', l_orderkey % 22 + 1) AS ctg, l_partkey % 120 AS pos, substr('ACGTN', CAST(l_partkey % 5 AS INT) + 1, 1) AS ref, CASE l_returnflag WHEN 'A' THEN 'normal' ELSE 'tumor' END AS sample,
  CASE WHEN l_quantity % 13 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN '#' ELSE '*' END WHEN l_orderkey % 2 = 0 THEN lower(substr('ACGT', l_linenumber % 4 + 1, 1)) ELSE substr('ACGT', l_linenumber % 4 + 1, 1) END AS base,
  CASE WHEN l_quantity % 13 = 0 THEN '' WHEN l_quantity % 7 = 0 THEN '+' || substr('ACGTTGCAACGT', 1, CAST(l_quantity AS INT) // 4) WHEN l_quantity % 11 = 0 THEN '-NN' ELSE '' END AS indel,
  CAST(l_quantity AS INT) AS bq, CAST(l_suppkey % 60 AS INT) AS mq, CAST(l_orderkey % 3 AS INT) AS hp, CAST(l_orderkey AS VARCHAR) AS qname, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R'))"""


def _near_reads(spark, d) -> DataFrame:
    """Orders as reads: the line items of an order on its contig, at places of a window or two; one a place, of equal line
    numbers the first in the files, since such are not rare and the order of tasks is not fixed."""
    li = load(spark, d, "lineitem").filter("l_returnflag in ('A', 'R')")
    mark = F.expr("case when l_quantity % 13 = 0 then '' when l_quantity % 7 = 0 then concat('+', substring('ACGTTGCAACGT', 1, cast(l_quantity as int) div 4)) when l_quantity % 11 = 0 then '-NN' else '' end")
    base = F.expr("case when l_quantity % 13 = 0 then case when l_orderkey % 2 = 0 then '#' else '*' end when l_orderkey % 2 = 0 then lower(substring('ACGT', l_linenumber % 4 + 1, 1)) else substring('ACGT', l_linenumber % 4 + 1, 1) end")
    o = li.select(
        F.expr("concat('chr', l_orderkey % 22 + 1)").alias("ctg"), (F.col("l_partkey") % 120).alias("pos"), F.expr("substring('ACGTN', cast(l_partkey % 5 as int) + 1, 1)").alias("ref"),
        F.expr("case l_returnflag when 'A' then 'normal' else 'tumor' end").alias("sample"), base.alias("base"), mark.alias("indel"), F.expr("cast(l_quantity as int)").alias("bq"),
        F.expr("cast(l_suppkey % 60 as int)").alias("mq"), F.expr("cast(l_orderkey % 3 as int)").alias("hp"), F.expr("cast(l_orderkey as string)").alias("qname"), "l_linenumber",
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
    )
    one = F.row_number().over(Window.partitionBy("ctg", "pos", "sample", "qname").orderBy("l_linenumber", "_file", "_row"))
    return o.withColumn("k", one).filter("k = 1").drop("k", "l_linenumber", "_file", "_row")


@query(f"""WITH {NEAR}, u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY ctg, pos, sample, qname ORDER BY l_linenumber) = 1),
s AS (SELECT DISTINCT ctg, pos AS site FROM u WHERE pos % 10 = 0), w AS (SELECT u.*, site, CAST(u.pos - site + 16 AS INT) AS place FROM u JOIN s ON s.ctg = u.ctg AND u.pos BETWEEN site - 16 AND site + 16 WHERE ref <> 'N'),
q AS (SELECT ctg, site, sample, qname, max(hp) AS hp, min(place) AS first FROM w GROUP BY ALL), r AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY ctg, site, sample ORDER BY md5('0-' || qname), qname) <= CASE sample WHEN 'normal' THEN 52 ELSE 76 END),
i AS (SELECT ctg, site, sample, qname, place + k AS place, max_by({CODE.format(x="substr(indel, 2 + CAST(k AS INT), 1)")}, place) AS ins FROM (SELECT *, unnest(range(0, length(indel) - 1)) AS k FROM w WHERE indel LIKE '+%' AND place < 32) WHERE place + k <= 32 GROUP BY ctg, site, sample, qname, place + k),
g AS (SELECT *, unnest(range(0, 33)) AS place FROM r),
c AS (SELECT g.*, CASE WHEN w.base IS NULL THEN '0,0,0,0,0,0' WHEN base IN ('*', '#') THEN '0,-100,0,0,0,0' ELSE concat_ws(',', {CODE.format(x="ref")}, CASE WHEN indel LIKE '+%' THEN -50 WHEN indel LIKE '-%' THEN -100 WHEN upper(base) <> ref THEN {CODE.format(x="upper(base)")} ELSE 0 END,
  CASE WHEN base = upper(base) THEN -100 ELSE 100 END, CAST(floor(100 * least(bq, 60) / 60) AS INT), CASE WHEN mq <= 20 THEN 0 WHEN mq <= 40 THEN 33 ELSE 100 END,
  CASE g.sample WHEN 'normal' THEN CASE g.hp WHEN 1 THEN -90 WHEN 0 THEN -60 ELSE -30 END ELSE CASE g.hp WHEN 1 THEN 30 WHEN 0 THEN 60 ELSE 90 END END) END || ',' || coalesce(i.ins, 0) AS v
  FROM g LEFT JOIN w USING (ctg, site, sample, qname, place) LEFT JOIN i USING (ctg, site, sample, qname, place))
SELECT ctg, site AS pos, sample, count(DISTINCT qname) AS n, md5(string_agg(v, ',' ORDER BY hp, first, qname, place)) AS matrix FROM c GROUP BY ALL""")
def read_matrices(spark, d):
    """Matrices of reads at every tenth place, of which many have more reads than fit."""
    o = _near_reads(spark, d)
    m = MX.read_matrices(o.filter("pos % 10 = 0").select("ctg", "pos"), o)
    return m.select("ctg", "pos", "sample", "n", F.md5(F.array_join(F.transform("cells", lambda x: x.cast("string")), ",")).alias("matrix"))


@query()
def training_matrices(spark, d):
    """Examples of truths at every tenth place, an alternative base each, at several fractions: their sizes and sums."""
    reverse = F.floor(F.col("qname").cast("long") / 22) % 2 == 1
    o = _near_reads(spark, d).withColumns({"ctg": F.lit("chr1"), "base": F.when(F.col("base").isin("*", "#"), F.col("base")).when(reverse, F.lower("base")).otherwise(F.upper("base"))})
    sites = o.filter("pos % 10 = 0 and ref <> 'N'").select("ctg", "pos", "ref").distinct()
    truths = sites.withColumn("alt", F.translate("ref", "ACGT", "CGTA"))
    m = MX.training_matrices(truths, o, least=2, reads={"normal": 200, "tumor": 300})
    return m.select("ctg", "pos", "ref", "alt", "size", F.aggregate("features", F.lit(0), lambda a, x: a + x).alias("total"))


@query()
def jittered_qualities(spark, d):
    o = observations(spark, d).groupBy("ctg", "pos").agg(F.sort_array(F.collect_list("bq")).alias("bq"))
    return o.select("ctg", "pos", F.array_join(F.transform(EX.jittered(F.col("bq"), F.col("pos")), lambda x: x.cast("string")), ",").alias("bq"))


# sources and sinks, over files written from the tables
def _scratch(spark) -> str:
    """A new folder beside the checkpoints, which driver and executors share."""
    return f"{shared_folder(spark)}/files-{uuid4().hex}"


@query("""SELECT concat('chr', p_partkey % 22 + 1) AS ctg, p_partkey AS pos, 'A' AS ref, substr('CGT', CAST(p_partkey % 3 AS INT) + 1, 1) AS alt, CAST(p_size AS DOUBLE) AS qual, round(p_size / 100, 2) AS af
FROM part WHERE p_size >= 10 AND p_partkey % 4 > 0 AND p_partkey % 5 > 0""")
def vcf_round_trip(spark, d):
    """Calls written as compressed VCF and read again with filters: quality, FILTER, no reference calls."""
    p = load(spark, d, "part").select(
        F.expr("concat('chr', p_partkey % 22 + 1)").alias("ctg"), F.col("p_partkey").alias("pos"), F.lit("A").alias("ref"), F.expr("substring('CGT', cast(p_partkey % 3 as int) + 1, 1)").alias("alt"),
        F.col("p_size").alias("qual"), F.expr("case when p_partkey % 4 = 0 then 'LowQual' else 'PASS' end").alias("filter"), F.expr("case when p_partkey % 5 = 0 then '0/0' else '0/1' end").alias("gt"), F.round(F.col("p_size") / 100, 2).alias("af"),
    )
    path = f"{_scratch(spark)}/calls"
    writers.write_vcf(p, path, {"GT": "gt", "AF": "af"}, [("chr1", 1000)], gzip=True)
    return readers.vcf(spark, path, filters=["PASS"], min_qual=10.0, drop_reference=True).select("ctg", "pos", "ref", "alt", "qual", "af")


@query("SELECT concat('chr', o_custkey % 3 + 1) AS ctg, o_orderkey AS pos, 'A' AS ref, substr('CGT', CAST(o_orderkey % 3 AS INT) + 1, 1) AS alt FROM orders WHERE o_custkey % 3 = 1 AND o_orderkey BETWEEN 2000 AND 9000")
def vcf_region(spark, d):
    """Calls at all orders, written in ranges with an index, and those of a region read from the parts that have some."""
    o = load(spark, d, "orders").select(
        F.expr("concat('chr', o_custkey % 3 + 1)").alias("ctg"), F.col("o_orderkey").alias("pos"), F.lit("A").alias("ref"), F.expr("substring('CGT', cast(o_orderkey % 3 as int) + 1, 1)").alias("alt"),
        F.lit(9.0).alias("qual"), F.lit("PASS").alias("filter"), F.lit("0/1").alias("gt"),
    )
    path = f"{_scratch(spark)}/indexed"
    writers.write_indexed_vcf(o, path, {"GT": "gt"}, [(f"chr{k}", 1 << 30) for k in (1, 2, 3)], parts=24)
    return readers.vcf_region(spark, path, "chr2", 2000, 9000).select("ctg", "pos", "ref", "alt")


@query("SELECT concat('chr', p_partkey % 3) AS ctg, p_partkey * 10 + 3 AS start, p_partkey * 10 + 3 + p_size - 2 AS \"end\" FROM part WHERE p_size > 2 AND p_partkey % 3 = 1")
def bed_round_trip(spark, d):
    """Intervals written as text and read again, one contig, one place shorter on both sides."""
    p = load(spark, d, "part").select(F.expr("concat('chr', p_partkey % 3)").alias("ctg"), (F.col("p_partkey") * 10 + 2).alias("start"), (F.col("p_partkey") * 10 + 2 + F.col("p_size")).alias("end"))
    path = f"{_scratch(spark)}/intervals"
    writers.write_bed(p, path)
    return readers.bed(spark, path, "chr1", padding=1).select("ctg", "start", "end")


@query("""WITH r AS (SELECT p_partkey AS id, 100 + p_partkey * 7 AS pos, p_partkey % 2 = 1 AS rev FROM part WHERE p_size <= 40),
c AS (SELECT * FROM (VALUES (0, 'A', '', 'm'), (1, 'C', '+GG', 'm'), (2, 'T', '', 'm'), (3, 'A', '-NN', 'm'), (4, '*', '', 'd'), (5, '*', '', 'd'), (6, 'C', '', 'm')) v(k, b, i, t))
SELECT 'chr1' AS ctg, pos + k AS pos, CASE WHEN rev THEN CASE WHEN t = 'd' THEN '#' ELSE lower(b) END ELSE b END AS base, CASE WHEN rev THEN lower(i) ELSE i END AS indel, CAST(CASE WHEN t = 'd' THEN 0 ELSE 40 END AS INT) AS bq, concat('q', id) AS qname FROM r, c""")
def sam_observations(spark, d):
    """Reads written as SAM text, read with their filters, and cut into observations."""
    p = load(spark, d, "part")
    line = F.concat_ws("\t", F.concat(F.lit("q"), F.col("p_partkey")), F.when(F.col("p_partkey") % 2 == 1, "16").otherwise("0"), F.lit("chr1"), (F.col("p_partkey") * 7 + 100).cast("string"), F.when(F.col("p_size") > 40, "5").otherwise("60"),
                       F.lit("1S2M2I2M2D1M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("NACGGTAC"), F.lit("IIIIIIII"))
    path = f"{_scratch(spark)}/reads"
    p.select(line.alias("value")).write.text(path)
    return readers.observations(readers.sam(spark, path, min_mq=20), "tumor").select("ctg", "pos", "base", "indel", "bq", "qname")


@query("""SELECT 'chr' || (p_partkey % 5) AS ctg, p_partkey AS pos, unnest(['A', 'c', 'G', '*']) AS base, unnest(['', '-n', CASE WHEN p_size % 2 = 0 THEN '+TT' ELSE '' END, '']) AS indel, unnest([30, 31, 32, 33]) AS bq FROM part""")
def pileup_text(spark, d):
    bases = F.concat(F.lit("^IA$c-1nG"), F.when(F.col("p_size") % 2 == 0, "+2TT").otherwise(""), F.lit("*"))
    line = F.concat_ws("\t", F.expr("concat('chr', p_partkey % 5)"), F.col("p_partkey").cast("string"), F.lit("N"), F.lit("4"), bases, F.lit("?@AB"))
    path = f"{_scratch(spark)}/pileup"
    load(spark, d, "part").select(line.alias("value")).write.text(path)
    return readers.pileup(spark, path, "tumor").select("ctg", "pos", "base", "indel", "bq")


@query("""WITH s AS (SELECT s_suppkey AS k, repeat('ACGTTGCA', CAST(s_suppkey % 40 + 1 AS INT)) AS seq FROM supplier), p AS (SELECT concat('c', p_partkey % 90 + 1) AS ctg, p_partkey AS id, p_size AS pos FROM part)
SELECT p.ctg, p.id, p.pos, CASE WHEN p.pos <= length(s.seq) THEN substr(s.seq, p.pos, 1) END AS ref FROM p LEFT JOIN s ON p.ctg = concat('c', s.k)""")
def reference_bases(spark, d):
    """A reference written as FASTA, read in blocks, and its bases at sites."""
    seq = F.repeat(F.lit("ACGTTGCA"), (F.col("s_suppkey") % 40 + 1).cast("int"))
    path = f"{_scratch(spark)}/reference"
    load(spark, d, "supplier").select(F.concat(F.lit(">c"), F.col("s_suppkey"), F.lit(" made\n"), F.regexp_replace(F.lower(seq), "(.{60})", "$1\n")).alias("value")).coalesce(1).write.text(path)
    at = load(spark, d, "part").select(F.expr("concat('c', p_partkey % 90 + 1)").alias("ctg"), F.col("p_partkey").alias("id"), F.col("p_size").alias("pos"))
    return readers.bases_at(at, readers.fasta(spark, path, 50), 50)


# composed plans and kernels
@query()
def pair_calls(spark, d):
    """Candidates, windows, scores by a network of fixed weights, and rows: the whole calling plan."""
    r = np.random.default_rng(11)
    w = {f"{k}{x}": r.normal(0, 0.2, s).astype(np.float32) for x in "fb" for k, s in (("w", (len(C.CHANNELS), 24)), ("u", (8, 24)), ("b", (24,)))}
    model = K.recurrent_model(w | {"o": r.normal(0, 1, (16, 3)).astype(np.float32), "bo": np.array([-1, -1, 1], np.float32)})
    o = observations(spark, d)
    return PL.call_pair(o.filter("sample = 'tumor'"), o.filter("sample = 'normal'"), model)


@query()
def matrix_scores(spark, d):
    """Read-level matrices of both samples at every tenth place, scored by a residual network of fixed weights."""
    o = _near_reads(spark, d)
    most = {"normal": 14, "tumor": 16}
    m = MX.pair_matrices(o.filter("pos % 10 = 0").select("ctg", "pos"), o, reads=most)
    shape = (sum(most.values()) + EX.BETWEEN, 2 * MX.FLANK + 1, len(MX.CELL))
    model = K.residual_model(K.random_residual_weights(shape, 3, (16, 24, 32), (40, 32, 3)))
    return K.score(m, lambda x: model(x / 100), shape).select("ctg", "pos", F.round(F.get("p", 0), 5).alias("p0"), F.round(F.get("p", 1), 5).alias("p1"), F.round(F.get("p", 2), 5).alias("p2"))


@query()
def realigned_reads(spark, d):
    """Line items as reads of their part's window: a third has another base, some lack three bases, the rest is like the
    reference; all were aligned without gaps."""
    ref = F.translate(F.sha2(F.concat_ws("-", "p_partkey", "p_name"), 512), "0123456789abcdef", "ACGTACGTACGTACGT")
    win = load(spark, d, "part").select(F.col("p_partkey").alias("window"), (F.col("p_partkey") * 1000).alias("start"), ref.alias("ref"), F.lit(20).alias("prefix"), F.lit(53).alias("suffix"))
    other = F.concat(F.substring("ref", 1, 63), F.when(F.substring("ref", 64, 1) == "A", "C").otherwise("A"), F.substring("ref", 65, 64))
    shorter = F.concat(F.substring("ref", 1, 60), F.substring("ref", 64, 65))
    own = F.when(F.col("l_returnflag") == "R", other).when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_suppkey") % 2 == 0), shorter).otherwise(F.col("ref"))
    at, n = (F.col("l_suppkey") % 20).cast("int"), F.col("l_linenumber") * 5 + 70
    reads = load(spark, d, "lineitem").join(win, F.col("l_partkey") == F.col("window")).withColumn("seq", F.substring(own, at + 1, n))
    rank = F.row_number().over(Window.partitionBy("window").orderBy("l_orderkey", "l_linenumber"))
    reads = reads.select(
        "window", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("qname"), "seq", F.array_repeat(F.lit(30), F.length("seq")).alias("quals"), rank.alias("rank"),
        (F.col("start") + at).alias("pos"), F.concat(F.length("seq").cast("string"), F.lit("M")).alias("cigar"),
    )
    return RE.realign(reads, win)


HAPLOTYPES = f"""WITH {OBS}, r AS (SELECT ctg, pos, qname, upper(base) <> ref AS is_alt, upper(base) AS allele, bq, hp, mq % 5 = 0 AS edge, CASE WHEN bq % 20 = 0 THEN repeat('ACGT', mq % 4) ELSE '' END AS ins FROM o WHERE sample = 'tumor'),
calls AS (SELECT ctg, pos, avg(CASE WHEN is_alt THEN 1.0 ELSE 0.0 END) AS af, avg(bq) / 50 AS qual FROM r GROUP BY 1, 2),
s AS (SELECT ctg, pos, count(*) AS depth, count(*) FILTER (is_alt) AS alt, avg(bq) FILTER (is_alt) AS alt_bq, count(*) FILTER (edge) AS edges, count(*) FILTER (edge AND is_alt) AS alt_edges,
  count(*) FILTER (hp = 1) AS h1, count(*) FILTER (hp = 2) AS h2, count(*) FILTER (is_alt AND hp = 1) AS a1, count(*) FILTER (is_alt AND hp = 2) AS a2 FROM r GROUP BY 1, 2),
b AS (SELECT ctg, pos, qual, coalesce(alt_bq <= 20 AND qual < 0.9, false) OR (edges >= 0.2 * depth AND alt_edges >= 0.3 * alt AND alt > 0)
    OR (af < 0.1 AND qual < 0.9 AND a1 * a2 > 0 AND greatest(a1, a2) <= 10 * least(a1, a2)) AS f,
  CASE WHEN h1 > 0 AND h2 > 0 AND (a1 > 0) <> (a2 > 0) AND greatest(a1, a2) > 2 THEN CASE WHEN a1 > 0 THEN 1 ELSE 2 END END AS hap FROM calls JOIN s USING (ctg, pos)),
own AS (SELECT DISTINCT ctg, pos, qname FROM r WHERE is_alt),
n AS (SELECT c.ctg, c.pos, d.pos AS opos, d.pos % 3 = 0 AS germline, d.af < 0.75 AS het, d.af, r.hp, r.is_alt AS carries, r.allele, r.ins, own.qname IS NOT NULL AS mine
  FROM calls c JOIN calls d ON c.ctg = d.ctg AND d.pos <> c.pos AND d.pos > c.pos - 100 AND d.pos <= c.pos + 100 JOIN r ON r.ctg = d.ctg AND r.pos = d.pos
  LEFT JOIN own ON own.ctg = c.ctg AND own.pos = c.pos AND own.qname = r.qname),
g AS (SELECT ctg, pos, opos, het, hap, max(af) AS af, count(*) FILTER (carries) AS carriers, count(*) FILTER (carries AND hp = hap) AS same, count(*) FILTER (carries AND mine) AS shared,
  count(*) FILTER (mine) AS covered FROM n JOIN b USING (ctg, pos) WHERE germline GROUP BY ALL),
k AS (SELECT ctg, pos, bool_or(het AND hap IS NOT NULL AND same > 0 AND 2 * same >= carriers AND shared = 0) OR bool_or(NOT het AND af >= 0.75 AND covered > 0 AND shared < 0.2 * covered) AS f FROM g GROUP BY 1, 2),
m AS (SELECT ctg, pos, opos, allele, count(*) FILTER (mine) AS mine, count(*) AS a FROM n WHERE carries AND NOT germline GROUP BY ALL),
i AS (SELECT ctg, pos, sum(least(length(ins), 200)) AS inserted FROM n WHERE NOT germline AND length(ins) >= 3 GROUP BY 1, 2),
j AS (SELECT i.ctg, i.pos, inserted / depth > 6 AND qual < 0.9 AS f FROM i JOIN s USING (ctg, pos) JOIN calls USING (ctg, pos)),
t AS (SELECT m.ctg, m.pos, count(*) FILTER (abs(mine - alt) <= 0.2 * alt AND mine > 0 AND a <= 1.2 * mine) > 2 AS f FROM m JOIN (SELECT ctg, pos, count(*) AS alt FROM own GROUP BY 1, 2) USING (ctg, pos) GROUP BY 1, 2)
SELECT ctg, pos, CASE WHEN b.f OR coalesce(k.f, false) OR coalesce(t.f, false) OR coalesce(j.f, false) THEN 0.0 ELSE round(qual, 6) END AS qual,
  CASE WHEN b.f OR coalesce(k.f, false) OR coalesce(t.f, false) OR coalesce(j.f, false) THEN 'LowQual' ELSE 'PASS' END AS filter, hap IS NOT NULL AS phased
FROM b LEFT JOIN k USING (ctg, pos) LEFT JOIN t USING (ctg, pos) LEFT JOIN j USING (ctg, pos)"""


@query(HAPLOTYPES)
def haplotype_rules(spark, d):
    """All groups of rules: a call's own reads, the sites around it, every third of which is germline, what they carry,
    and what reads insert at the others."""
    o = observations(spark, d).filter("sample = 'tumor'").withColumns({"is_alt": F.upper("base") != F.col("ref"), "allele": F.upper("base")})
    inserted = F.when(F.col("bq") % 20 == 0, F.concat(F.lit("+"), F.repeat(F.lit("ACGT"), F.col("mq") % 4))).otherwise("")
    reads = o.select("ctg", "pos", "qname", "is_alt", "allele", "bq", "hp", (F.col("mq") % 5 == 0).alias("edge"), inserted.alias("indel"))
    calls = reads.groupBy("ctg", "pos").agg(F.avg(F.col("is_alt").cast("double")).alias("af"), (F.avg("bq") / 50).alias("qual"))
    base = H.base_rules(calls, reads)
    others = calls.select("ctg", F.col("pos").alias("opos"), "af", (F.col("af") < H.HOM_AF).alias("het"), (F.col("pos") % 3 == 0).alias("germline"))
    there = reads.select("ctg", F.col("pos").alias("opos"), "qname", "hp", "allele", "indel", F.col("is_alt").alias("carries"), F.lit(True).alias("cover"))
    near = IV.neighbours(calls.select("ctg", "pos"), others, 100).join(there, ["ctg", "opos"])
    germline, rest = near.filter("germline"), near.filter("not germline")
    together = H.coexisting(base, reads, rest.filter("carries").select("ctg", "pos", "opos", "allele", "qname"))
    return H.judge(base, H.neighbour_rules(base, reads, germline), together, H.long_insertions(base, reads, rest)).withColumn("qual", F.round("qual", 6))


@query(f"""WITH e AS (SELECT time_bucket(INTERVAL '60 minutes', ts, TIMESTAMP '1970-01-01') AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def event_windows(spark, d):
    return live.window_counts(load(spark, d, "events"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def event_sessions(spark, d):
    return live.sessions(load(spark, d, "events"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE value > 10 GROUP BY 1")
def stream_event_counts(spark, d):
    """The rows of a file stream, filtered on the way into a table, and counted there."""
    out = _scratch(spark)
    schema = load(spark, d, "events").schema
    rows = live.drain(spark, d, "events.parquet", schema, lambda s: s.filter("value > 10").select("event_type"), out)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


@query(_paired_sql())
def stream_candidates(spark, d):
    """The paired candidates from a scan: observations in files along the contigs, one file a batch, then the ends."""
    path = _scratch(spark)
    o = observations(spark, d).drop("flag")
    ends = o.select("ctg").distinct().select("ctg", F.lit(live.END).alias("pos"))
    for k, part in enumerate([*(o.filter(F.floor(F.col("pos") * 4 / (F.lit(1) + F.lit(o.agg(F.max("pos")).first()[0] or 0))) == q) for q in range(4)), ends]):
        part.coalesce(1).write.parquet(f"{path}/scan/{k}")
    sites, _ = live.scan_candidates(spark, f"{path}/scan", o.schema, f"{path}/out")
    return sites
