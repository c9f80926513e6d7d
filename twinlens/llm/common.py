"""What the corpus operators share: reading tables, cutting lineage, guarded broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator
from contextlib import suppress
from functools import wraps
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Tables up to so many rows may be broadcast; above, the join shuffles.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; one is chosen only where the session names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def reliable(df: DataFrame) -> DataFrame:
    """df from files in the shared folder: computed once, and safe against lost executors."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    make_room(df.sparkSession)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df from a Parquet table in the shared folder: like reliable(), smaller on disk for many rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid4().hex}"
    df.write.parquet(path)
    make_room(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The columns of documents; a pipeline stage works on these.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def sheltered(stage):
    """A pipeline stage to which columns beyond those of documents are one struct, so that their names clash with none
    of its own; they come out as they went in."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in DOCUMENT]
        if not more:
            return stage(spark, docs, sf_dir)
        own = [F.col(c) for c in docs.columns if c in DOCUMENT]
        out = stage(spark, docs.select(*own, F.struct(*(F.col(f"`{c}`") for c in more)).alias("_rest")), sf_dir)
        return out.select(*(F.col("_rest").getField(c).alias(c) if c in more else F.col(c) for c in docs.columns))

    return run


def give_back() -> None:
    """What a worker has freed goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(kernel):
    """A function of a task's batches, whose worker gives back what it has freed between batches, and at the task's end
    what the function itself has held. Workers outlive their stage, and an executor's memory holds all of them beside its
    heap."""

    def each(batches: Iterator) -> Iterator:
        for b in batches:
            yield b
            del b
            give_back()

    def run(batches: Iterator) -> Iterator:
        for out in kernel(each(batches)):
            yield out
            del out
        gc.collect()
        give_back()

    return run


def tidy_groups(kernel):
    """A function of a key and its rows, whose worker gives back what it has freed after each group."""

    @wraps(kernel)
    def run(key, rows):
        out = kernel(key, rows)
        give_back()
        return out

    return run


#: Bytes of a batch of rows between an executor and its workers, about.
BATCH = "4m"


def small_batches(spark: SparkSession) -> None:
    """Batches of so many bytes from here on, unless the session names a size. Spark's own are of up to 64 MB, a whole split,
    which the executor and its workers hold at once for each task, and what comes back as well."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def let_go(spark: SparkSession) -> None:
    """Between the rounds of a loop: what earlier rounds have shuffled and kept goes once the driver has forgotten their
    tables, which else waits until its memory is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def make_room(spark: SparkSession) -> None:
    """What plans and tasks have left on the driver goes once its heap is beyond a third of what it may have. Otherwise the
    heap grows to all of it on a large input, though little of it is in use, and the JVM's other memory comes on top."""
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 3 * heap.totalMemory() > heap.maxMemory():
        let_go(spark)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df
