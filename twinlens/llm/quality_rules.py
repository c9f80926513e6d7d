"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with its language's, which are counted
over all documents, by Jensen-Shannon distance. Documents too short for a histogram to mean anything are not judged.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinlens.llm.common import reliable, table

#: The base rules: words at least, and repeated words in percent at most.
MIN_WORDS, MAX_REPEATED = 50, 50
#: Common words of a language, and languages whose references are held at once; more go in further passes.
COMMON_WORDS, MAX_LANGS = 200, 200
#: Largest distances to the reference, for texts of this many characters and words at least.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.3, 200
MAX_WORD_DISTANCE, MIN_COUNTED_WORDS = 0.52, 100
SYMBOLS = "#*$%&|<>"
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000
#: Bytes of text for each bucket of words, about.
BUCKET_BYTES = 64 << 20

CLASSES = ["lower", "upper", "digit", "space", "newline", "stop", "symbol", "other_ascii", "accented", "wide"]


def _class_of() -> np.ndarray:
    """The class of each byte of UTF-8; bytes that continue a character have none."""
    c = np.full(256, CLASSES.index("other_ascii"))
    for name, members in (
        ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("space", b" \t"),
        ("newline", b"\n\r\x0b\x0c"), ("stop", b".,;:!?'\"()-"), ("symbol", SYMBOLS.encode()),
    ):
        c[list(members)] = CLASSES.index(name)
    c[0x80:0xC0], c[0xC0:0xE0], c[0xE0:] = -1, CLASSES.index("accented"), CLASSES.index("wide")
    return c


_CLASS = _class_of()
_TO_CLASS = (np.arange(len(CLASSES))[None, :] == _CLASS[:, None]).astype(np.float64)


def class_counts(raw: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _TO_CLASS


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 1 if just one of them is empty."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return float(a != b)
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that occur twice or more. Equal words have equal ids."""
    if len(ids) < 4:
        return 0
    if ids.max() < 1 << 21:
        keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:
        keys = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(keys)] |= twice
    return int(covered.sum())


def corpus_counts(docs: DataFrame, common: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, kind, item, n over all of (lang, text): counts of classes, of all words (total), and of words, which have
    the common most frequent ones of each bucket.

    Tasks count and hand on packed counts by language and hash of the word; a bucket sums them. Every word of a bucket
    is counted in full before the bucket's most frequent ones are taken.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    buckets = max(16, -(-size // bucket_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict = defaultdict(Counter)
        classes: dict = defaultdict(lambda: np.zeros(len(CLASSES), np.int64))

        def out():
            for lang in classes:
                parts: dict = defaultdict(list)
                for w in words[lang]:
                    parts[zlib.crc32(w) % buckets].append(w)
                parts[0]  # the classes go with bucket 0
                rows = []
                for k, own in parts.items():
                    own.sort()
                    n = np.array([words[lang][w] for w in own], np.int64)
                    rows.append((k, zstandard.compress(b"\n".join(own)), zstandard.compress(n.tobytes()), classes[lang].tobytes() if k == 0 else None))
                k, w, n, c = zip(*rows, strict=True)
                columns = [pa.array([lang] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(w, pa.binary()), pa.array(n, pa.binary()), pa.array(c, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "words", "counts", "classes"])
            words.clear()
            classes.clear()

        for b in batches:
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    classes[lang] += class_counts(raw).astype(np.int64)
                    words[lang].update(raw.lower().split())
                if sum(map(len, words.values())) > FLUSH:
                    yield from out()
        yield from out()

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        classes = np.zeros(len(CLASSES), np.int64)
        for w, n, c in zip(frame["words"], frame["counts"], frame["classes"], strict=True):
            counts = np.frombuffer(zstandard.decompress(n), np.int64).tolist()
            own = zstandard.decompress(w).split(b"\n") if counts else []
            for x, k in zip(own, counts, strict=True):
                total[x] = total.get(x, 0) + k
            if c is not None:
                classes += np.frombuffer(c, np.int64)
        rows = [("word", w.decode(), n) for w, n in heapq.nsmallest(common, total.items(), key=lambda x: (-x[1], x[0]))]
        rows.append(("total", "", sum(total.values())))
        if key[1] == 0:
            rows += [("class", name, int(n)) for name, n in zip(CLASSES, classes, strict=True)]
        out = pd.DataFrame(rows, columns=["kind", "item", "n"])
        out.insert(0, "lang", key[0])
        return out

    packed = docs.select("lang", "text").mapInArrow(run, "lang string, bucket long, words binary, counts binary, classes binary")
    return packed.groupBy("lang", "bucket").applyInPandas(add, "lang string, kind string, item string, n long")


def references(docs: DataFrame, common: int = COMMON_WORDS, langs: int = MAX_LANGS) -> Iterator[tuple[dict, bool, Column]]:
    """For each language, the null one among them: its class histogram, its common words and their counts, all others
    as the last. At most langs languages times common words come to the driver at once, about; then if these are all, and
    a condition on lang that only they meet."""
    counts = reliable(corpus_counts(docs, common))
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    top = reliable(counts.filter("kind <> 'total'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= common))
    total = reliable(counts.filter("kind = 'total'").groupBy("lang").agg(F.sum("n").alias("total")))
    parts = -(-total.count() // langs)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    for k in range(parts):
        by: dict = {}
        for r in total.filter(part("lang") == k).collect():
            by[r.lang] = {"total": r.total, "classes": np.zeros(len(CLASSES)), "words": {}}
        for r in top.filter(part("lang") == k).orderBy("lang", "kind", "rank").collect():
            if r.kind == "class":
                by[r.lang]["classes"][CLASSES.index(r.item)] = r.n
            else:
                by[r.lang]["words"][r.item.encode()] = r.n
        for x in by.values():
            n = list(x["words"].values())
            x["counts"] = np.array([*n, x["total"] - sum(n)], float)
            x["place"] = {w: i for i, w in enumerate(x["words"])}
        yield by, parts == 1, part("lang") == k


def measure(docs: DataFrame, known: dict, id_col: str = "doc_id") -> DataFrame:
    """Base figures, distances and verdicts of (id, text, lang), in one pass."""
    kind = docs.schema["id"].dataType.simpleString()
    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    types = [None, *[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]

    def figures(text: str, lang: str | None, ids: dict) -> tuple:
        raw = text.encode()
        words = raw.split()
        if len(ids) + len(words) > FLUSH:
            ids.clear()
        at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
        n = len(words)
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        again = repeated_words(at)
        failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
        ref, far = known.get(lang), [0.0, 0.0]
        if ref and len(text) >= MIN_CHARS:
            far[0] = distance(class_counts(raw), ref["classes"])
        if ref and n >= MIN_COUNTED_WORDS:
            own = np.zeros(len(ref["counts"]))
            get = ref["place"].get
            found = [k for k in map(get, raw.lower().split()) if k is not None]
            own[:-1] = np.bincount(found, minlength=len(own) - 1) if found else 0
            own[-1] = n - len(found)
            far[1] = distance(own, ref["counts"])
        kept = not failed and far[0] <= MAX_CLASS_DISTANCE and far[1] <= MAX_WORD_DISTANCE
        return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, failed, kept, *far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict = {}
        for b in batches:
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                rows = [figures(t or "", lang, ids) for t, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)] if rows else [pa.array([], t) for t in types[1:]]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    schema = f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return docs.select("id", "text", "lang").mapInArrow(run, schema)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id, the base figures, base_failed, kept, class_distance, word_distance.

    A null text is empty and fails the base rules. Documents of one language, the null one too, share a reference. A
    text below the minimum lengths has distance 0. Repeated rows are judged each for itself; other columns are ignored;
    an empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = None
    for known, whole, of in references(own):
        part = measure(own if whole else own.filter(of), known, id_col)
        found = part if found is None else found.unionByName(part)
    return measure(own, {}, id_col) if found is None else found


def op7_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
