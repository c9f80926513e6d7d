"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets each text's bits in a counting Bloom filter of bounded size and keeps the bits that were set more than
once. Pass two tests each row against these bits: a row with a bit that only it has set is unique and passes straight
through; the others, possible repeats, are the only rows that are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import SPACE, reliable, table

#: Groups up to this size are never counted as hot.
HOT_ROWS = 1000


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 26
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty. The row with the most code points stays,
    then the smallest id (a null id counts as smallest); of repeated rows, exactly one stays. An empty table gives an
    empty result. Columns other than the two named are ignored.

    The filter has bits_per_row bits for each row, rounded up to a power of two, and never more than max_bits, which
    bounds the broadcast (max_bits / 64 words). A full filter costs precision, not correctness: more rows shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = reliable(
        docs.select(
            F.col(id_col).alias("id"),
            F.char_length(text).alias("points"),
            F.sha2(F.regexp_replace(text, SPACE, "").cast("binary"), 256).alias("sha"),
        ).withColumn("row", F.monotonically_increasing_id())
    )
    rows = slim.count()
    wanted = max(1 << 12, rows * bits_per_row)
    words = min(1 << (wanted - 1).bit_length(), max_bits) // 64

    # a register-blocked filter: one word of 64 bits per text, two bits within it
    h = F.xxhash64("sha")
    slots = F.array(h.bitwiseAND(63), F.shiftrightunsigned(h, 6).bitwiseAND(63))
    slim = slim.withColumns({"word": F.pmod(F.shiftrightunsigned(h, 12), F.lit(words)), "slots": slots})
    bit = F.expr("shiftleft(1L, cast(slot as int))")
    twice = (
        slim.select("word", F.explode(F.array_distinct("slots")).alias("slot"))
        .groupBy("word", "slot").agg(F.count("*").alias("n")).filter("n > 1")
        .groupBy("word").agg(F.bit_or(bit).alias("bits"))
    )
    need = F.expr("shiftleft(1L, cast(slots[0] as int)) | shiftleft(1L, cast(slots[1] as int))")
    tested = slim.join(F.broadcast(twice), "word", "left").withColumn(
        "maybe", F.coalesce(F.col("bits").bitwiseAND(need) == need, F.lit(False))
    )

    unique = tested.filter(~F.col("maybe")).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    maybe = tested.filter("maybe").select("id", "points", "row", "sha")
    groups = maybe.groupBy("sha").agg(
        F.min(F.struct((-F.col("points")).alias("p"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best"),
        F.count("*").alias("group_size"),
    )
    # groups of over a thousandth of the rows, a thousand at most, are broadcast, so that none of them meets in one task
    large = F.col("group_size") > max(HOT_ROWS, rows // 1000)
    verdict = "id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "sha"
    hot = maybe.join(F.broadcast(groups.filter(large)), "sha", "left")
    repeated = hot.filter("best is not null").select(*verdict)
    other = hot.filter("best is null").drop("best", "group_size").join(groups.filter(~large), "sha").select(*verdict)
    return unique.unionByName(repeated).unionByName(other).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")
    )


def op10_exact_dedup(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER w = 1 AS kept, sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY points DESC, doc_id)
"""
