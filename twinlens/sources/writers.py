"""Writers: calls and intervals as text, features and tables as Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.functions.alleles import contig_rank

COLUMNS = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT SAMPLE".split()


def vcf_header(contigs: list[tuple[str, int]], command: str = "", sample: str = "SAMPLE") -> list[str]:
    fields = [("GT", "1", "String", "Genotype"), ("GQ", "1", "Integer", "Genotype quality"), ("DP", "1", "Integer", "Depth"), ("AF", "1", "Float", "Allele fraction"), ("NAF", "1", "Float", "Normal allele fraction")]
    out = ["##fileformat=VCFv4.2"] + ([f"##cmdline={command}"] if command else [])
    out += [f'##FILTER=<ID={k},Description="{k}">' for k in ("PASS", "LowQual", "RefCall", "Germline")]
    out += [f'##FORMAT=<ID={k},Number={n},Type={t},Description="{d}">' for k, n, t, d in fields]
    return [*out, *(f"##contig=<ID={c},length={n}>" for c, n in contigs), "\t".join([*COLUMNS[:9], sample])]


def add_to_header(header: list[str], lines: list[str]) -> list[str]:
    """A header with further lines before its last one, without those that it has."""
    new = [x for x in dict.fromkeys(lines) if x not in header]
    return [*header[:-1], *new, header[-1]]


def vcf_lines(calls: DataFrame, fields: dict[str, str], show_reference: bool = False) -> DataFrame:
    """Lines (value) of calls in karyotype order; fields maps FORMAT keys to columns. Calls of 0/0 and ./. go unless
    wanted."""
    return vcf_line(calls, fields, show_reference).orderBy(contig_rank(F.col("ctg")), "ctg", "pos").select("value")


def vcf_line(calls: DataFrame, fields: dict[str, str], show_reference: bool = False) -> DataFrame:
    """calls with the line of each as value."""
    d = calls if show_reference else calls.filter(~F.col("gt").isin("0/0", "./."))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    values = F.concat_ws(":", *(text(c) for c in fields.values()))
    line = F.concat_ws("\t", "ctg", F.col("pos").cast("string"), F.lit("."), "ref", "alt", text("qual"), "filter", F.lit("."), F.lit(":".join(fields)), values)
    return d.withColumn("value", line)


def write_vcf(calls: DataFrame, path: str, fields: dict[str, str], contigs: list[tuple[str, int]], command: str = "", show_reference: bool = False, gzip: bool = False) -> None:
    """Parts in order, range-partitioned by place, and the header as a part before them. A reader of the folder gets
    the file."""
    lines = vcf_lines(calls, fields, show_reference)
    head = calls.sparkSession.createDataFrame([(h,) for h in vcf_header(contigs, command)], "value string").coalesce(1)
    codec = "gzip" if gzip else "none"
    head.write.mode("overwrite").option("compression", codec).text(path)
    lines.write.mode("append").option("compression", codec).text(path)


#: Places of a bin of the index, from small to large: a part is filed under the smallest bin that holds all of a contig's
#: places in it.
INDEX_BINS = (1 << 14, 1 << 17, 1 << 20, 1 << 23, 1 << 26, 1 << 40)


def index_bin(low: Column, high: Column) -> Column:
    """level * 2**40 + number of the smallest bin that has both places."""
    out = None
    for level, width in enumerate(INDEX_BINS):
        fits, name = F.floor(low / width) == F.floor(high / width), F.lit(level << 40) + F.floor(low / width)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def write_indexed_vcf(calls: DataFrame, path: str, fields: dict[str, str], contigs: list[tuple[str, int]], parts: int = 64, **options) -> None:
    """write_vcf in so many ranges of places, and under _index a row for each contig of each part: file, ctg, low, high,
    bin. A reader of the folder does not see the index."""
    rank = F.coalesce(contig_rank(F.col("ctg")), F.lit(-1))
    dealt = calls.withColumn("_rank", rank).repartitionByRange(parts, "_rank", "ctg", "pos")
    head = calls.sparkSession.createDataFrame([(h,) for h in vcf_header(contigs, options.get("command", ""))], "value string").coalesce(1)
    codec = "gzip" if options.get("gzip") else "none"
    head.write.mode("overwrite").option("compression", codec).text(path)
    line = vcf_line(dealt, fields, options.get("show_reference", False))
    line.sortWithinPartitions("_rank", "ctg", "pos").select("value").write.mode("append").option("compression", codec).text(path)
    c = F.split("value", "\t")
    lines = calls.sparkSession.read.text(path).filter(~F.col("value").startswith("#")).select(F.col("_metadata.file_path").alias("file"), c[0].alias("ctg"), c[1].cast("long").alias("pos"))
    index = lines.groupBy("file", "ctg").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).withColumn("bin", index_bin(F.col("low"), F.col("high")))
    index.coalesce(1).write.mode("overwrite").parquet(f"{path}/_index")  # a row for each contig of a part


def write_bed(df: DataFrame, path: str, shift: int = 0) -> None:
    d = df.select("ctg", (F.col("start") + shift).alias("start"), (F.col("end") + shift).alias("end"))
    d.write.mode("overwrite").option("sep", "\t").csv(path)


def write_windows(sites: DataFrame, path: str, flank: int = 16, rows: int = 10_000) -> None:
    """Windows around sites, a folder for each contig and so many in a file."""
    d = sites.select("ctg", (F.col("pos") - flank - 1).alias("start"), (F.col("pos") + flank + 1).alias("end"))
    d.write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("ctg").parquet(path)


def write_outcomes(classified: DataFrame, path: str) -> None:
    classified.write.mode("overwrite").partitionBy("outcome").parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
