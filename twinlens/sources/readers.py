"""Readers: calls, intervals, references, reads and pileups, from text to typed columns. All parse in native columns, so
that filters and column pruning reach the scan of lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinlens.functions.alleles import parse_genotype
from twinlens.functions.text import aligned_part, format_value, pileup_tokens
from twinlens.operators.lineage import reliable, small
from twinlens.sources.writers import INDEX_BINS


def vcf(
    spark: SparkSession, path: str | list[str], contig: str | None = None, start: int | None = None, end: int | None = None, filters: list[str] | None = None,
    min_qual: float | None = None, max_qual: float | None = None, snv_only: bool = False, single_alt: bool = False, drop_reference: bool = False,
    max_naf: float | None = None, naf_factor: float | None = None,
) -> DataFrame:
    """Calls: ctg, pos, id, ref, alt, qual, filter, info, fmt, sample, genotype, af, naf.

    Of lines with one place the last stays, by the file and the line's offset. A missing value is null. Where the last
    column of the header is a tumor's, a paired file's genotype is in the column before it.
    """
    lines = spark.read.text(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id().alias("n")))
    head = lines.filter(F.col("value").startswith("#CHROM")).limit(1).collect()
    names = head[0]["value"].split("\t") if head else []
    which = len(names) - 2 if len(names) > 10 and names[-1].lower() == "tumor" else 9
    c = F.split("value", "\t")
    dot = lambda x: F.when(x != ".", x)
    d = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select(
        c[0].alias("ctg"), c[1].cast("long").alias("pos"), dot(c[2]).alias("id"), c[3].alias("ref"), c[4].alias("alt"), dot(c[5]).try_cast("double").alias("qual"),
        c[6].alias("filter"), c[7].alias("info"), F.get(c, F.lit(8)).alias("fmt"), F.get(c, F.lit(which)).alias("sample"), "_at",
    )
    if contig is not None:
        d = d.filter(F.col("ctg") == contig)
    if start is not None:
        d = d.filter(F.col("pos") >= start)
    if end is not None:
        d = d.filter(F.col("pos") <= end)
    last = d.groupBy("ctg", "pos").agg(F.max_by(F.struct(*(x for x in d.columns if x not in ("ctg", "pos", "_at"))), "_at").alias("r"))
    d = last.select("ctg", "pos", "r.*").withColumns({
        "genotype": parse_genotype(format_value(F.col("fmt"), F.col("sample"), "GT")),
        "af": format_value(F.col("fmt"), F.col("sample"), "AF").try_cast("double"),
        "naf": format_value(F.col("fmt"), F.col("sample"), "NAF").try_cast("double"),
    })
    if filters is not None:
        d = d.filter(F.arrays_overlap(F.split("filter", ";"), F.array(*(F.lit(x) for x in filters))))
    if min_qual is not None:
        d = d.filter(F.col("qual") >= min_qual)
    if max_qual is not None:
        d = d.filter(F.col("qual") <= max_qual)
    if snv_only:
        d = d.filter((F.length("ref") == 1) & (F.length("alt") == 1))
    if single_alt:
        d = d.filter(~F.col("alt").contains(","))
    if drop_reference:
        d = d.filter(~((F.col("alt") == ".") | (F.array_max("genotype") == 0)))
    if max_naf is not None:
        d = d.filter(F.coalesce("naf", F.lit(0.0)) < max_naf)
    if naf_factor is not None:
        d = d.filter(F.col("af") * naf_factor >= F.coalesce("naf", F.lit(0.0)))
    return d


def indexed_parts(spark: SparkSession, path: str, contig: str, start: int, end: int) -> list[str]:
    """The files of a folder of write_indexed_vcf that may have calls of a region (1-based, both ends in): those under the
    bins, of every width, that the region touches, whose places meet it. A name for each part comes to the driver."""
    touched = F.lit(False)
    for level, width in enumerate(INDEX_BINS):
        touched = touched | F.col("bin").between((level << 40) + start // width, (level << 40) + end // width)
    found = spark.read.parquet(f"{path}/_index").filter((F.col("ctg") == contig) & touched & (F.col("low") <= end) & (F.col("high") >= start))
    return sorted({r.file for r in found.select("file").collect()})


def vcf_region(spark: SparkSession, path: str, contig: str, start: int, end: int, **options) -> DataFrame:
    """vcf() of a region, which opens no part without calls there."""
    files = indexed_parts(spark, path, contig, start, end)
    return vcf(spark, files, contig, start, end, **options) if files else vcf(spark, path, contig, start, end, **options).limit(0)


def bed(spark: SparkSession, path: str, contig: str | None = None, padding: int = 0, within: tuple[int, int] | None = None) -> DataFrame:
    """Intervals: ctg, start, end, tag. An empty one gets length 1; padding shrinks an interval from both sides; within
    keeps those that overlap a range."""
    c = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(
        c[0].alias("ctg"), c[1].cast("long").alias("start"), c[2].cast("long").alias("end"), F.get(c, F.lit(3)).alias("tag")
    )
    if contig is not None:
        d = d.filter(F.col("ctg") == contig)
    d = d.withColumn("end", F.when(F.col("start") == F.col("end"), F.col("end") + 1).otherwise(F.col("end")))
    if within is not None:
        d = d.filter((F.col("end") > within[0]) & (F.col("start") < within[1]))
    return d.withColumns({"start": F.col("start") + padding, "end": F.col("end") - padding}).filter("start < end")


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """The contigs and lengths of a reference's index."""
    c = F.split("value", "\t")
    return spark.read.text(path).filter("value <> ''").select(c[0].alias("ctg"), c[1].cast("long").alias("length"))


def chunks(index: DataFrame, size: int = 5_000_000) -> DataFrame:
    """Pieces (ctg, chunk, start, end) of contigs."""
    n = F.ceil(F.col("length") / size)
    d = index.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return d.select("ctg", "chunk", (F.col("chunk") * size).alias("start"), F.least((F.col("chunk") + 1) * size, F.col("length")).alias("end"))


def _fasta_parts(most: int):
    """Lines of splits (value, file, at) to parts of records: record counts the headers of a split, 0 before the first."""

    def run(batches):
        split, record, start, held, size, out = None, 0, 0, [], 0, []

        def part(name=None):
            nonlocal held, size, start
            seq = "".join(held)
            out.append((*split, record, name, start, seq))
            start += len(seq)
            held, size = [], 0

        def flushed():
            nonlocal out
            columns = list(zip(*out, strict=True))
            out = []
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "at", "record", "name", "start", "seq"])

        for b in batches:
            for line, *own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tuple(own) != split:
                    if held:
                        part()
                    split, record, start = tuple(own), 0, 0
                if line.startswith(">"):
                    if held:
                        part()
                    record, start = record + 1, 0
                    part((line[1:].split() or [""])[0])
                    continue
                held.append("".join(line.split()).upper())
                size += len(held[-1])
                if size >= most:
                    part()
            if len(out) > 64:
                yield flushed()
        if held:
            part()
        if out:
            yield flushed()

    return run


def fasta(spark: SparkSession, path: str, block: int = 1000) -> DataFrame:
    """A reference as blocks (ctg, start, seq), 1-based, in capitals.

    Files are read line by line in Spark's splits, so that a contig is as many tasks as its file has splits. Where a split
    begins within a record follows from the lengths of the splits before it: a row for each record of a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    parts = reliable(lines.mapInArrow(_fasta_parts(max(block, 1 << 16)), "file string, at long, record long, name string, start long, seq string"))
    order = Window.partitionBy("file").orderBy("at", "record")
    sizes = parts.groupBy("file", "at", "record").agg(F.max("name").alias("name"), F.sum(F.length("seq")).alias("n"))
    sizes = sizes.withColumn("of", F.sum(F.col("name").isNotNull().cast("int")).over(order))
    within = Window.partitionBy("file", "of").orderBy("at", "record")
    before = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = reliable(sizes.select("file", "at", "record", "of", F.first("name", True).over(within).alias("ctg"), before.alias("before")))
    d = parts.drop("name").join(small(sizes, sizes.count()), ["file", "at", "record"]).filter("ctg is not null and seq <> ''")
    d = d.withColumn("from", F.col("before") + F.col("start"))
    d = d.withColumn("b", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("from") + F.length("seq") - 1) / block))))
    at = F.greatest(F.col("b") * block - F.col("from"), F.lit(0))
    piece = F.substring("seq", (at + 1).cast("int"), ((F.col("b") + 1) * block - F.col("from") - at).cast("int"))
    joined = F.array_sort(F.collect_list(F.struct("from", piece.alias("seq"))))  # the lines of a block
    by = d.groupBy("file", "of", "ctg", "b").agg(joined.alias("x"))
    return by.select("ctg", (F.col("b") * block + 1).alias("start"), F.array_join(F.transform("x", lambda x: x["seq"]), "").alias("seq"))


def bases_at(sites: DataFrame, reference: DataFrame, block: int = 1000) -> DataFrame:
    """sites with the reference base of their position, by an equi join on the block; null outside."""
    d = sites.withColumn("_start", F.floor((F.col("pos") - 1) / block) * block + 1)
    r = reference.select("ctg", F.col("start").alias("_start"), "seq")
    base = F.substring("seq", (F.col("pos") - F.col("_start") + 1).cast("int"), F.lit(1))
    return d.join(r, ["ctg", "_start"], "left").withColumn("ref", F.when(base != "", base)).drop("_start", "seq")


def sam(spark: SparkSession, path: str, exclude: int = 2316, min_mq: int = 0, min_aligned: float | None = None) -> DataFrame:
    """Reads of SAM text: qname, flag, ctg, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, hp. min_aligned: the least
    part of a read's bases, but for clipped ones, that its CIGAR aligns."""
    c = F.split("value", "\t")
    d = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.col("value") != "")).select(
        c[0].alias("qname"), c[1].cast("int").alias("flag"), c[2].alias("ctg"), c[3].cast("long").alias("pos"), c[4].cast("int").alias("mapq"), c[5].alias("cigar"),
        c[6].alias("rnext"), c[7].cast("long").alias("pnext"), c[8].cast("long").alias("tlen"), c[9].alias("seq"), c[10].alias("qual"),
        F.regexp_extract("value", r"\tHP:i:(\d+)", 1).try_cast("int").alias("hp"),
    )
    d = d.filter((F.col("flag").bitwiseAND(exclude) == 0) & (F.col("mapq") >= min_mq))
    return d if min_aligned is None else d.filter(aligned_part(F.col("cigar")) >= min_aligned)


def mapped_contigs(reads: DataFrame) -> DataFrame:
    return reads.groupBy("ctg").agg(F.count("*").alias("n")).filter("n > 0")


def mean_depth(counts: DataFrame) -> DataFrame:
    """By contig and, under total, over all."""
    return counts.rollup("ctg").agg(F.avg("depth").alias("depth")).withColumn("ctg", F.coalesce("ctg", F.lit("total")))


def observations(reads: DataFrame, sample: str) -> DataFrame:
    """Rows (ctg, pos, sample, base, indel, bq, mq, qname, hp, flag) of aligned reads. A read is first cut into its CIGAR
    operations, each with its own bases, so that no row carries the whole read. Reverse reads have small letters;
    deletions are * and #."""
    from twinlens.functions.text import cigar_operations

    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    own = F.struct(chars(F.col("seq")).alias("seq"), chars(F.col("qual")).alias("qual"), cigar_operations(F.col("cigar")).alias("ops"), (F.col("flag").bitwiseAND(16) > 0).alias("reverse"))

    def runs(v):
        """Each aligned operation with its own bases and qualities only, and the indel after it."""

        def one(o, i):
            gap, follows = o["op"] == "D", F.get(v["ops"], i + 1)
            mark = F.when(v["reverse"], "#").otherwise("*")
            joined = lambda x: F.array_join(F.slice(v["seq"], x["read"] + 1, x["n"]), "")
            after = F.when(follows["op"] == "I", F.concat(F.lit("+"), joined(follows))).when(follows["op"] == "D", F.concat(F.lit("-"), F.repeat(F.lit("N"), follows["n"])))
            return F.struct(
                o["op"].alias("op"), o["ref"].alias("ref"), o["n"].alias("n"), F.when(gap, "").otherwise(F.coalesce(after, F.lit(""))).alias("after"),
                F.when(gap, F.array_repeat(mark, o["n"])).otherwise(F.slice(v["seq"], o["read"] + 1, o["n"])).alias("bases"),
                F.when(gap, F.array().cast("array<string>")).otherwise(F.slice(v["qual"], o["read"] + 1, o["n"])).alias("quals"),
            )

        return F.filter(F.transform(v["ops"], one), lambda r: r["op"].isin("M", "=", "X", "D"))

    names = ["ctg", "pos", "mapq", "qname", "hp", "flag"]
    d = reads.filter("cigar <> '*'").select(*names, F.explode(F.get(F.transform(F.array(own), runs), 0)).alias("r"))
    d = d.select(*names, "r.op", "r.ref", "r.n", "r.after", F.posexplode(F.arrays_zip("r.bases", "r.quals")).alias("k", "z"))
    reverse = F.col("flag").bitwiseAND(16) > 0
    cased = lambda c: F.when(reverse, F.lower(c)).otherwise(F.upper(c))
    return d.select(
        "ctg", (F.col("pos") + F.col("ref") + F.col("k")).alias("pos"), F.lit(sample).alias("sample"), cased(F.col("z.bases")).alias("base"),
        F.when(F.col("k") == F.col("n") - 1, cased(F.col("after"))).otherwise("").alias("indel"),
        F.when(F.col("op") == "D", 0).otherwise(F.ascii("z.quals") - 33).alias("bq"), F.col("mapq").alias("mq"), "qname", "hp", "flag",
    )


def pileup(spark: SparkSession, path: str, sample: str, strict: bool = False) -> DataFrame:
    """Observations of pileup text: ctg, pos, N, depth, bases, qualities[, mapping qualities][, names][, haplotypes].

    A line whose parts differ in number is left out, or ends the job if strict.
    """
    c = F.split("value", "\t")
    d = spark.read.text(path).filter("value <> ''").select(
        c[0].alias("ctg"), c[1].cast("long").alias("pos"), pileup_tokens(c[4]).alias("t"), F.filter(F.split(c[5], ""), lambda x: x != "").alias("q"),
        F.filter(F.split(F.coalesce(F.get(c, F.lit(6)), F.lit("")), ""), lambda x: x != "").alias("m"), F.split(F.coalesce(F.get(c, F.lit(7)), F.lit("")), ",").alias("names"), F.split(F.coalesce(F.get(c, F.lit(8)), F.lit("")), ",").alias("hps"),
    )
    whole = F.size("t") == F.size("q")
    broken = F.raise_error(F.concat(F.lit("a pileup line's parts differ in number at "), "ctg", F.lit(":"), F.col("pos").cast("string")))
    d = d.filter(F.when(whole, True).otherwise(broken.cast("boolean")) if strict else whole).withColumn("z", F.explode(F.arrays_zip("t", "q", "m", "names", "hps")))
    z = F.col("z")
    return d.select(
        "ctg", "pos", F.lit(sample).alias("sample"), F.substring(z["t"], 1, 1).alias("base"), F.substring(z["t"], F.lit(2), F.length(z["t"])).alias("indel"),
        (F.ascii(z["q"]) - 33).alias("bq"), F.coalesce(F.ascii(z["m"]) - 33, F.lit(60)).alias("mq"), z["names"].alias("qname"), z["hps"].try_cast("int").alias("hp"), F.lit(0).alias("flag"),
    )


def table(spark: SparkSession, path: str, columns: list[str], prefix: str = "") -> DataFrame:
    """A tab-separated table of numbers by place, its contigs with a prefix: loci, alleles, covariates, segments."""
    c = F.split("value", r"\s+")
    d = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|\s*$)"))
    return d.select(*(F.concat(F.lit(prefix), c[i]).alias(n) if n == "ctg" else (c[i].cast("long") if n in ("pos", "start", "end") else c[i].try_cast("double")).alias(n) for i, n in enumerate(columns)))


def fraction_table(spark: SparkSession, path: str) -> DataFrame:
    """ctg, pos, ref, depth, fractions of alleles, of the tumor's alone, and tags."""
    c = F.split("value", "\t")
    m = lambda x: F.transform_values(F.str_to_map(F.trim(x), F.lit(" "), F.lit(":")), lambda _, v: v.try_cast("double"))
    return spark.read.text(path).filter("value <> ''").select(
        c[0].alias("ctg"), c[1].cast("long").alias("pos"), c[2].alias("ref"), c[3].cast("long").alias("depth"),
        F.transform(F.split(c[4], ","), lambda x: x.try_cast("double")).alias("fractions"), m(c[5]).alias("alleles"), m(c[6]).alias("tumor_alleles"), F.split(c[7], ",").alias("tags"),
    )


def hybrid_info(spark: SparkSession, folder: str) -> DataFrame:
    """ctg, pos, ref, and the alleles of both samples at given sites, from all files of a folder whose names end so."""
    c = F.split("value", "\t")
    d = spark.read.option("pathGlobFilter", "*hybrid_info").text(folder).filter("value <> ''")
    return d.select(c[0].alias("ctg"), c[1].cast("long").alias("pos"), c[2].alias("ref"), F.get(c, F.lit(3)).alias("normal_info"), F.get(c, F.lit(4)).alias("tumor_info"))


def purity(spark: SparkSession, path: str) -> DataFrame:
    """sample, purity, ploidy, goodness: the one line below the header."""
    c = F.split("value", r"\s+")
    d = spark.read.text(path).filter(~F.col("value").rlike(r"^(Sample\b|\s*$)"))
    return d.select(c[0].alias("sample"), *(c[i].cast("double").alias(n) for i, n in enumerate(("purity", "ploidy", "goodness"), 1)))


def tensor_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tensor text, gzipped or not: ctg, pos, ref_seq, both samples' numbers and alleles, kind."""
    c = F.split("value", "\t")
    numbers = lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda v: v.cast("double"))
    return spark.read.text(path).filter("value <> ''").select(
        c[0].alias("ctg"), c[1].cast("long").alias("pos"), c[2].alias("ref_seq"), numbers(c[3]).alias("normal"), c[4].alias("normal_info"),
        numbers(c[5]).alias("tumor"), c[6].alias("tumor_info"), F.get(c, F.lit(7)).alias("kind"),
    )
