"""Read-level matrices of both samples around candidate sites: rows are reads, columns places, and each cell has the
channels of CELL.

Observations meet the windows by an equi join on bins; a read's cells are gathered by read before reads are drawn, so
that a deep site never meets in one task as more than its drawn reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.functions.alleles import BASE_CODES, STRAND_CODE, haplotype_code
from twinlens.operators.counts import SITE
from twinlens.operators.examples import BETWEEN, padded
from twinlens.operators.lineage import reliable
from twinlens.operators.sampling import beta_subsamples

#: Channels of a cell, in order.
CELL = ("reference", "alternative", "strand", "base_quality", "mapping_quality", "haplotype", "insertion")
#: Reads of a sample in a matrix, by platform.
READS = {"ont": {"normal": 52, "tumor": 76}, "ilmn": {"normal": 84, "tumor": 84}, "hifi": {"normal": 64, "tumor": 64}}
FLANK = 16
#: Alternative bases below this normalised quality count as none where low qualities are masked.
MASKED = 33
_CODES = np.zeros(256, np.int8)
for _base, _code in BASE_CODES.items():
    _CODES[ord(_base)] = _CODES[ord(_base.lower())] = _code


def window_cells(sites: DataFrame, obs: DataFrame, flank: int = FLANK) -> DataFrame:
    """Observations (ctg, pos, ...) of a window around each site as (ctg, pos, at, ...): pos is the site's, at their
    place in the window from 0."""
    width = 4 * flank
    bin_ = lambda c: F.floor(c / width)
    wide = sites.select(*SITE).distinct().withColumn("_bin", F.explode(F.array_distinct(F.array(bin_(F.col("pos") - flank), bin_(F.col("pos") + flank)))))
    o = obs.withColumnRenamed("pos", "_pos").withColumn("_bin", bin_(F.col("_pos")))
    at = (F.col("_pos") - F.col("pos") + flank).cast("int")
    return o.join(wide, ["ctg", "_bin"]).withColumn("at", at).filter((at >= 0) & (at <= 2 * flank)).drop("_bin", "_pos")


def encode_cells(at: np.ndarray, owner: np.ndarray, n: int, ref: list[str], base: list[str], indel: list[str], bq: np.ndarray, mq: np.ndarray, hap: np.ndarray, width: int, mask: bool) -> np.ndarray:
    """Matrix rows [n, width, channels] of cells of n reads; bq and mq are normalised, hap is the code of the cell's
    read. An insertion's bases stand in its own column and those after it, of two the later one's; one in the last
    column is left out."""
    out = np.zeros((n, width, len(CELL)), np.int8)
    first = lambda x: np.frombuffer("".join((v or "\0")[0] for v in x).encode("latin-1", "replace"), np.uint8)
    b, r, mark = first(base), first(ref), first(indel)
    upper = np.where((b >= 97) & (b <= 122), b - 32, b)
    gap = (b == ord("*")) | (b == ord("#"))
    known = np.isin(upper, np.frombuffer(b"ACGT", np.uint8))
    alt = np.where(mark > 0, _CODES[mark], np.where(known & (upper != r), _CODES[upper], 0))
    if mask:
        low = (mark == 0) & (alt != 0) & (bq < MASKED)
        alt, bq = np.where(low, 0, alt), np.where(low, 0, bq)
    strand = np.where(np.isin(b, np.frombuffer(b"ACGT", np.uint8)), -STRAND_CODE, STRAND_CODE)
    cells = np.stack([_CODES[r], alt, strand, bq, mq, hap, np.zeros(len(b), int)], axis=1)
    cells[gap] = 0
    cells[gap, 1] = _CODES[ord("*")]
    out[owner, at] = cells
    inserts = np.flatnonzero((mark == ord("+")) & ~gap & (at < width - 1))
    for k in inserts[np.lexsort((at[inserts], owner[inserts]))].tolist():
        codes = _CODES[np.frombuffer(indel[k][1:].encode("latin-1", "replace"), np.uint8)][: width - at[k]]
        out[owner[k], at[k] : at[k] + len(codes), 6] = codes
    return out


def _rows(width: int, mask: bool):
    names = ["ctg", "pos", "sample", "hp", "first", "start", "qname", "cells"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                b = batch.slice(k, 2048)
                seen = b.column("seen")
                n = np.asarray(seen.value_lengths(), np.int64)
                flat = seen.flatten()
                take = lambda c: flat.field(c)
                number = lambda c: take(c).to_numpy(zero_copy_only=False).astype(int)
                owner = np.repeat(np.arange(b.num_rows), n)
                text = lambda c: take(c).to_pylist()
                hap = b.column("code").to_numpy(zero_copy_only=False)[owner]
                out = encode_cells(number("at"), owner, b.num_rows, text("ref"), text("base"), text("indel"), number("bq"), number("mq"), hap, width, mask)
                size = width * len(CELL)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * size), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), rows], names)

    return run


def normalised(bq: Column, mq: Column, platform: str) -> tuple[Column, Column]:
    """Qualities as whole numbers up to 100."""
    bq = F.coalesce(bq, F.lit(0))
    top = 40 if platform == "ilmn" else 60
    own = F.floor(bq / 10) * 10 if platform == "ilmn" else bq
    bucket = F.when(F.coalesce(mq, F.lit(0)) <= 20, 0).when(mq <= 40, 20).otherwise(60)
    return F.floor(100 * F.least(own, F.lit(top)) / top).cast("int"), F.floor(100 * bucket / 60).cast("int")


def read_matrices(sites: DataFrame, obs: DataFrame, platform: str = "ont", flank: int = FLANK, reads: dict[str, int] | None = None, mask: bool = False, seed: int = 0) -> DataFrame:
    """(ctg, pos, sample, n, cells): the matrix of each site and sample that has reads, row after row.

    obs has ctg, pos, ref, sample, base, indel, bq, mq, hp, qname, and start, where reads begin, if known. Places whose
    reference base is none of A, C, G and T are left out. Rows are in order of haplotype, of the first place in the
    window at which a read is seen, of start and of name. Of more reads than fit, those with the smallest hashes of name
    and seed stay, whatever the order. Short reads of one name and two strands are two rows.
    """
    return assembled(matrix_rows(sites, obs, platform, flank, reads, mask, seed), [*SITE, "sample"])


def assembled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, cells) of matrix_rows: the rows of each key on end, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("hp", "first", "start", "qname", "cells")))  # as many as fit
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.flatten(F.transform(ordered, lambda x: x["cells"])).alias("cells"))


def matrix_rows(sites: DataFrame, obs: DataFrame, platform: str = "ont", flank: int = FLANK, reads: dict[str, int] | None = None, mask: bool = False, seed: int = 0) -> DataFrame:
    """(ctg, pos, sample, hp, first, start, qname, cells): the rows that read_matrices puts together."""
    most = reads or READS[platform]
    bq, mq = normalised(F.col("bq"), F.col("mq"), platform)
    start = F.col("start") if "start" in obs.columns else F.lit(0)
    name = F.concat_ws("_", "qname", F.when(F.col("base").rlike("^[#a-z]"), 1).otherwise(0)) if platform == "ilmn" else F.col("qname")
    o = obs.filter(F.upper("ref").isin("A", "C", "G", "T")).select(
        *SITE, F.upper("ref").alias("ref"), "sample", "base", F.coalesce("indel", F.lit("")).alias("indel"), bq.alias("bq"), mq.alias("mq"),
        F.when(F.col("hp").isin(1, 2), F.col("hp")).otherwise(0).alias("hp"), name.alias("qname"), start.cast("long").alias("start"),
    )
    by = window_cells(sites, o, flank).groupBy(*SITE, "sample", "qname").agg(
        F.max("hp").alias("hp"), F.min("at").alias("first"), F.min("start").alias("start"),
        F.collect_list(F.struct("at", "ref", "base", "indel", "bq", "mq")).alias("seen"),  # a read's places in a window
    )
    limit = F.lit(0)
    for sample, n in most.items():
        limit = F.when(F.col("sample") == sample, n).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy(*SITE, "sample").orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), "qname")), "qname"))
    drawn = by.withColumn("_rank", rank).filter(F.col("_rank") <= max(most.values())).filter(F.col("_rank") <= limit)
    rows = drawn.withColumn("code", haplotype_code(F.col("sample"), F.col("hp"))).select(*SITE, "sample", "hp", "first", "start", "qname", "code", "seen")
    kind = {c: obs.schema[c].dataType.simpleString() for c in (*SITE, "qname")}
    schema = f"ctg {kind['ctg']}, pos {sites.schema['pos'].dataType.simpleString()}, sample string, hp int, first int, start long, qname string, cells array<tinyint>"
    return rows.mapInArrow(_rows(2 * flank + 1, mask), schema)


def shows(base: Column, indel: Column, ref: Column, alt: Column) -> Column:
    """If an observation at a variant's place has it: its base without an indel, what it inserts, or how much it deletes."""
    indel, n = F.coalesce(indel, F.lit("")), F.length(alt) - F.length(ref)
    same = F.upper(base) == F.substring(alt, 1, 1)
    inserted = indel.startswith("+") & same & (F.upper(F.substring(indel, F.lit(2), F.length(indel))) == F.substring(alt, F.lit(2), F.length(alt)))
    deleted = indel.startswith("-") & (F.length(indel) - 1 == -n)
    return F.when(n > 0, inserted).when(n < 0, deleted).otherwise((indel == "") & (F.upper(base) == alt))


def training_matrices(truths: DataFrame, obs: DataFrame, platform: str = "ont", flank: int = FLANK, draws: int = 4, least: int = 3, **options) -> DataFrame:
    """(ctg, pos, ref, alt, size, features): examples of truths (ctg, pos, ref, alt), one a place, at several fractions.

    The tumor's reads of a matrix are subsampled by beta_subsamples, by whether they show the variant and on which strand;
    each sample is a matrix beside the normal's. A truth without enough reads of both strands gives none.
    """
    rows = reliable(matrix_rows(truths, obs, platform, flank, **options))
    mine = rows.filter("sample = 'tumor'")
    at = obs.filter("sample = 'tumor'").join(truths.select(*SITE, F.col("ref").alias("_ref"), F.col("alt").alias("_alt")), SITE)
    seen = at.groupBy(*SITE, "qname").agg(F.bool_or(shows(F.col("base"), F.col("indel"), F.col("_ref"), F.col("_alt"))).alias("is_alt"), F.bool_or(F.col("base").rlike("^[#a-z]")).alias("reverse"))
    no = F.lit(False)
    names = mine.select(*SITE, "qname").join(seen, [*SITE, "qname"], "left").select(*SITE, "qname", F.coalesce("is_alt", no).alias("is_alt"), F.coalesce("reverse", no).alias("reverse"))
    samples = beta_subsamples(names, draws, least)
    tumor = assembled(mine.join(samples, [*SITE, "qname"]), [*SITE, "size"]).select(*SITE, "size", F.col("cells").alias("t"))
    normal = assembled(rows.filter("sample = 'normal'"), SITE).select(*SITE, F.col("cells").alias("n"))
    total = sum((options.get("reads") or READS[platform]).values()) + BETWEEN
    both = truths.join(tumor, SITE).join(normal, SITE)
    return both.select(*truths.columns, "size", padded(F.col("n"), F.col("t"), total, (2 * flank + 1) * len(CELL)).alias("features"))


def pair_matrices(sites: DataFrame, obs: DataFrame, platform: str = "ont", flank: int = FLANK, **options) -> DataFrame:
    """(ctg, pos, features): one matrix of the normal's and the tumor's reads for each site at which both have some, with
    empty rows between and around them, as many rows for every site."""
    most = options.get("reads") or READS[platform]
    m = read_matrices(sites, obs, platform, flank, **options)
    side = lambda s: m.filter(F.col("sample") == s).select(*SITE, F.col("cells").alias(s))
    both = side("normal").join(side("tumor"), SITE)
    total = sum(most.values()) + BETWEEN
    return both.select(*SITE, padded(F.col("normal"), F.col("tumor"), total, (2 * flank + 1) * len(CELL)).alias("features"))
