"""Cutting lineage and guarded broadcasts for the engine's operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables up to so many rows may be broadcast; above, the join shuffles.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. One is chosen only where the session names none, and only
    in a single process: elsewhere a folder of one machine would lose what others need."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def reliable(df: DataFrame) -> DataFrame:
    """df from files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def in_ranges(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df dealt out by ranges of keys and order, with _part, the number of a row's range, and _at, which tells equal rows
    apart. Rows of a key lie in successive ranges, so that a running value needs a row for each range from the others, and
    no task holds a key."""
    return reliable(df.repartitionByRange(*keys, *order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def running(d: DataFrame, keys: list[str], order: list[str | Column], name: str, how: str, value: Column, before: bool = False) -> DataFrame:
    """d of in_ranges with a column: the sum or max of the value in rows of the key up to a row, or before it (then null
    for the first)."""
    agg = {"sum": F.sum, "max": F.max}[how]
    within = Window.partitionBy(*keys, "_part").orderBy(*order, "_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    d = d.withColumn("_value", value)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy(*keys, "_part").agg(agg("_value").alias("_sum"))
    parts = parts.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col("_part").alias("_of"), agg("_sum").over(earlier).alias("_carry"))
    on = F.col("_part") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    own = agg("_value").over(within)
    joined = d.withColumn("_own", own).join(parts, on)
    carry, own = F.col("_carry"), F.col("_own")
    both = F.greatest(own, carry) if how == "max" else F.when(own.isNull() & carry.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)))
    return joined.withColumn(name, both).drop("_value", "_own", "_carry", "_of", *(f"_key_{k}" for k in keys))
