"""Fill-in-the-middle transformation over an index of distinct texts.

Documents of one text are grouped by the text itself, so that the content, not a hash of it, says what is equal. Of each
distinct text the ends of its lines are held once, as two Elias-Fano lists (bytes and code points). The documents that
have the text are then joined back to it, and each takes its own seeded pair of cuts by two selections from the lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import reliable, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts of more documents than this, and than a thousandth of the rows, are indexed in several parts.
HOT_ROWS = 1000
#: Bytes of output that a task gathers before it hands them on.
FLUSH = 4 << 20


class EliasFano:
    """A sorted list of numbers below 2**63: the low bits of each one packed, the high bits in unary with one bit for
    each number, and the count of ones before every 512th bit."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.width = max(0, (top // max(1, self.n)).bit_length() - 1)
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(self.width, dtype=np.uint64)) & np.uint64(1)
        self.low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        high = (v >> np.uint64(self.width)).astype(np.int64) + np.arange(self.n)
        marks = np.zeros(-(-((int(high[-1]) if self.n else 0) + 1) // 512) * 512, np.uint8)
        marks[high] = 1
        self.high = np.packbits(marks, bitorder="little")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.high).reshape(-1, 64).sum(1, dtype=np.int64)))

    def select(self, ks: np.ndarray) -> np.ndarray:
        """The numbers at places ks, from 0."""
        out = np.zeros(len(ks), np.int64)
        for at, k in enumerate(ks.tolist()):
            block = int(np.searchsorted(self.before, k, side="right")) - 1
            ones = np.flatnonzero(np.unpackbits(self.high[block * 64 : block * 64 + 64], bitorder="little"))
            high = block * 512 + int(ones[k - self.before[block]]) - k
            first = k * self.width
            piece = np.unpackbits(self.low[first // 8 : (first + self.width + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.width]
            low = int((piece.astype(np.int64) << np.arange(self.width)).sum())
            out[at] = (high << self.width) + low
        return out

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.before.nbytes


def line_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the lines of a text in bytes and in code points; the last line may lack its newline."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    if text.isascii():
        return ends, ends
    heads = np.cumsum((raw & 0xC0) != 0x80)
    return ends, heads[ends - 1].astype(np.int64)


def cuts(seed: int, key: str, n: int) -> tuple[int, int, int, int]:
    """Lines before the middle and up to its end, and two numbers for the form, from the seed and the document's name."""
    h = sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3, h4


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, ids): each text once with the ids of its documents, null as empty.

    Rows meet by their whole text; the hash before it only makes comparisons short. A text of more than HOT_ROWS
    documents, and of a thousandth of all, is in several rows, by the partition its documents are read from: then none
    of its rows has many ids, and each partition still hands it on once.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    counts = reliable(own.groupBy("h").agg(F.count("*").alias("n")))
    limit = max(HOT_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) // 1000)
    hot = counts.filter(F.col("n") > limit).select("h", F.ceil(F.col("n") / limit).alias("parts"))  # a thousand rows at most
    dealt = own.withColumn("from", F.spark_partition_id()).join(F.broadcast(hot), "h", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod("from", "parts")).otherwise(F.lit(0))
    return dealt.withColumn("part", part).groupBy("h", "part", "text").agg(F.collect_list(F.struct("id")).alias("ids")).select("text", F.col("ids.id").alias("ids"))


def _transformed(seed: int, rate: int, spm: int, kind: pa.DataType):
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for text, ids in zip(b.column(0), b.column(1), strict=True):
                raw = text.as_py().encode()
                in_bytes, in_points = line_ends(raw)
                ends, points, n = EliasFano(np.append(0, in_bytes)), EliasFano(np.append(0, in_points)), len(in_bytes)
                always_plain = not raw or any(m in raw for m in marks)
                for i in ids.as_py():
                    a, b_, h3, h4 = cuts(seed, "" if i is None else str(i), n)
                    if always_plain or h3 % 100 >= rate:
                        rows.append((i, n, "plain", None, None, raw.decode()))
                    else:
                        (p, m), (pc, mc) = ends.select(np.array([a, b_])).tolist(), points.select(np.array([a, b_])).tolist()
                        prefix, middle, suffix = raw[:p], raw[p:m], raw[m:]
                        form = "spm" if h4 % 100 < spm else "psm"
                        parts = (marks[1], suffix, marks[0], prefix) if form == "spm" else (marks[0], prefix, marks[1], suffix)
                        rows.append((i, n, form, pc, mc - pc, b"".join((*parts, marks[2], middle)).decode()))
                    size += len(raw) + 64
                    if size > FLUSH:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per row of docs: id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output.

    A text is cut between lines at two places that follow from the seed and the document's id alone. Texts that are
    empty or hold a marker stay plain, as do those outside of rate percent; spm percent of the rest put the suffix
    first. A null text is empty; a null id counts as an empty name; repeated rows each give a row; other columns are
    ignored; an empty table gives an empty result. Texts of any length are cut whole.
    """
    kind = docs.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"id {kind.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    out = distinct_texts(docs, id_col, text_col).mapInArrow(_transformed(seed, rate, spm, to_arrow_type(kind)), schema)
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    digest = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256")
    back = F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, back)


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l,
             ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
p AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p
"""
