"""Streams of observations and events: counts by window with late data, sessions, a file source to a table, and candidate
sites of a scan that goes along contigs."""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from twinlens.functions.alleles import BASES
from twinlens.operators import counts, paired

#: A scan's last row on a contig has this place and no base.
END = 1 << 62


def window_counts(events: DataFrame, minutes: int = 60, late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window; on a stream, rows later than the watermark are left out."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return d.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n"
    )


def drain(spark: SparkSession, folder: str, pattern: str, schema, shape, out: str, mode: str = "append") -> DataFrame:
    """Runs shape over a stream of Parquet files until all are read, into a table of files, and returns that."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    query = shape(stream).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def scanned_counts(obs: DataFrame, reach: int = 200) -> DataFrame:
    """counts.allele_counts of a stream of observations that goes along each contig, with late.

    The state of a contig holds the counts of places that the scan has not left by more than reach; a place is handed on
    once, whole, when it has. Reads of a place that is already out are late: they come as rows of their own, marked so,
    and change nothing. A row at END without a base closes a contig.
    """
    base = F.upper("base")
    own = F.when(base.isin(*BASES), base).when(base.isin("*", "#"), "*")
    indel = F.when(F.coalesce("indel", F.lit("")) != "", counts.allele(F.col("base"), F.col("indel")))
    rows = obs.select("ctg", "pos", "ref", "sample", F.array_join(F.array_compact(F.array(own, indel)), ",").alias("alleles"))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, left, held = state.get if state.exists else (-1, -1, pickle.dumps({}))
        known: dict = pickle.loads(held)
        late: Counter = Counter()
        for f in frames:
            n = f.groupby(["pos", "ref", "sample", "alleles"], dropna=False).size()
            for (pos, ref, sample, names), k in n.items():
                top = max(top, int(pos))
                if pos == END:
                    continue
                for x in filter(None, names.split(",")):
                    if pos <= left:
                        late[pos, ref, sample, x] += int(k)
                    else:
                        known.setdefault((pos, ref, sample), Counter())[x] += int(k)
        left = max(left, top - reach - 1)
        out = [(key[0], *place, x, n, sum(v for a, v in seen.items() if len(a) == 1), False) for place, seen in known.items() if place[0] <= left for x, n in seen.items()]
        known = {place: seen for place, seen in known.items() if place[0] > left}
        state.update((top, left, pickle.dumps(known)))
        by: dict = defaultdict(int)
        for (pos, ref, sample, x), n in late.items():
            by[pos, ref, sample] += n if len(x) == 1 else 0
        out += [(key[0], pos, ref, sample, x, n, by[pos, ref, sample], True) for (pos, ref, sample, x), n in late.items()]
        yield pd.DataFrame(out, columns=["ctg", "pos", "ref", "sample", "allele", "n", "depth", "late"])

    schema = "ctg string, pos long, ref string, sample string, allele string, n long, depth long, late boolean"
    return rows.groupBy("ctg").applyInPandasWithState(run, schema, "top long, left_ long, held binary", "append", "NoTimeout")


def scan_candidates(spark: SparkSession, folder: str, schema, out: str, reach: int = 200, files: int = 1, **thresholds) -> tuple[DataFrame, DataFrame]:
    """Candidate sites of a pair, as pair_candidates finds them, from a stream of Parquet files of observations; and the
    late reads' counts. Each batch judges the sites that the scan has left, whole, and appends them to a table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(folder)

    def judged(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        c = batch.filter("not late").drop("late")
        found = paired.paired_filter(counts.candidates(c.filter("sample = 'tumor'"), **thresholds), c)
        found.write.mode("overwrite").parquet(f"{out}/sites/batch={number}")
        batch.filter("late").drop("late").write.mode("overwrite").parquet(f"{out}/late/batch={number}")
        batch.unpersist()

    query = scanned_counts(stream, reach).writeStream.foreachBatch(judged).outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/sites").drop("batch"), spark.read.parquet(f"{out}/late").drop("batch")
