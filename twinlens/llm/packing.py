"""Best-fit packing of tokenised documents into sequences, hierarchically.

Pieces are dealt into groups of bounded size; each group best-fits them in decreasing order and emits its nearly full
bins. Underfull bins go up a tree as items of their own: groups merge and best-fit them again, until one group is left
or a round no longer joins bins.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import reliable, small_batches, table, tidy, tidy_groups
from twinlens.llm.words import LETTERS, LOWER, byte_signs, hashes, pieces, spans

CAPACITY = 2048
#: Bins with fewer free places than this are final.
NEARLY_FULL = 16
#: Items of a group, and groups that merge in a round at least.
GROUP_ITEMS, FAN_IN = 20_000, 4
#: Words that a task keeps.
KEPT_WORDS = 800_000
#: The vocabulary's special token between words that are encoded in one call, and so many words.
SEPARATOR, JOINED = "<|endoftext|>", 400
_WORD = re.compile(f"[{LETTERS}]+")
#: A round that joins less than this part of its bins is the last.
LEAST_GAIN = 0.01


class Ids:
    """Token ids of words, each encoded by the library once for each task and kept in one flat array.

    The vocabulary's normalizer and pre-tokenizer drop white space and match nothing across it, so a text's ids are its
    words' ids in order. ASCII letters are lower-cased by the normalizer, and a full stop or comma at a word's end after
    an ASCII letter or digit is a match of its own, so that many words share one encoding. Words are known by 64-bit
    hashes of their bytes, made for a piece of the column at once; only a word that is new is looked at by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.direct = all(self._letters(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in ("The", "Übermaß", "DÉJÀ", "xqzjøÿ"))
        self.flat, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.starts, self.sizes, self.hits = np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and their words' numbers
        # the first three: the id 0 after a document, and the two tails
        tails = [self.tokenizer.encode(k, add_special_tokens=False).ids for k in (".", ",")]
        self._add([0, 1, 2], np.concatenate([np.array(x, np.uint32) for x in ([0], *tails)]), np.array([1, *map(len, tails)]))

    def forget(self) -> None:
        """Keeps the more frequent half of the words."""
        self.starts, self.sizes, self.hits = (x[: self.n] for x in (self.starts, self.sizes, self.hits))
        often = self.hits > np.median(self.hits)
        often[:3] = True
        new = np.cumsum(often) - 1
        stays = often[self.at]
        self.keys, self.at = self.keys[stays], new[self.at[stays]]
        sizes = self.sizes[often]
        upto = np.cumsum(sizes)
        self.flat = self.flat[np.arange(upto[-1]) + np.repeat(self.starts[often] - (upto - sizes), sizes)]
        self.used = len(self.flat)
        self.starts, self.sizes, self.hits, self.n = upto - sizes, sizes, self.hits[often] // 2, len(sizes)

    def _add(self, keys: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat) // 4, len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        end = self.n + len(keys)
        if end > len(self.sizes):
            self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros(max(len(x) // 4, end), x.dtype)]) for x in (self.starts, self.sizes, self.hits))
        own = np.array(keys, np.uint64)
        order = np.argsort(own)
        places = np.searchsorted(self.keys, own[order])
        self.keys, self.at = np.insert(self.keys, places, own[order]), np.insert(self.at, places, self.n + order)
        self.starts[self.n : end] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : end] = sizes
        self.n, self.used = end, self.used + len(ids)

    def _letters(self, word: str) -> list[int]:
        """The ids of a word of ASCII and Latin-1 letters: in lower case it is one match of the pre-tokenizer, which the
        library's model takes as it is."""
        return [t.id for t in self.model.tokenize(word.lower().translate(self.signs))]

    def learn(self, words: dict[int, bytes]) -> None:
        """Words of letters go to the library's model. Between others a special token keeps them apart in one call; a
        word that might hold one has a call alone."""
        found, plain = {}, []
        for k, w in words.items():
            if b"<" not in w:
                if self.direct and _WORD.fullmatch(word := w.decode()):
                    found[k] = self._letters(word)
                else:
                    plain.append((k, w))
        if found:
            sizes = np.fromiter(map(len, found.values()), np.int64, len(found))
            self._add(list(found), np.fromiter(chain.from_iterable(found.values()), np.uint32, int(sizes.sum())), sizes)
        for lo in range(0, len(plain), JOINED * JOINED):
            part = plain[lo : lo + JOINED * JOINED]
            texts = [SEPARATOR.join(w.decode() for _, w in part[k : k + JOINED]) + SEPARATOR for k in range(0, len(part), JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.flatnonzero(ids == self.separator)
            self._add([k for k, _ in part], ids[ids != self.separator], np.diff(ends, prepend=-1) - 1)
        for k, w in words.items():
            if b"<" in w:
                ids = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, np.uint32)
                self._add([k], ids, np.array([len(ids)]))

    def _known(self, keys: np.ndarray) -> np.ndarray:
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def _units(self, a: np.ndarray, heads: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the known words of the bytes, with tails and document ends, and the places of the ends."""
        starts, ends = spans(a, heads)
        n = len(starts)
        if n:
            last = a[ends - 1]
            before = a[np.maximum(ends - 2, starts)]
            letter = ((before | 32) - np.uint8(97) < 26) | (before - np.uint8(48) < 10)
            dot, comma = last == 46, last == 44
            tail = (dot | comma) & letter & (ends - starts > 1)
            odd = np.zeros(len(a) + 1, np.int64)
            np.cumsum((a >= 128) | (a == 60), out=odd[1:])
            as_is = odd[ends] > odd[starts]  # not ASCII alone, or with <
            key = hashes(a, starts, ends - tail, LOWER)
            if as_is.any():
                key[as_is] = hashes(a, starts[as_is], ends[as_is] - tail[as_is])
            distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            known = self._known(distinct)
            if not known.all():
                new = np.flatnonzero(~known)
                i = first[new]
                data = {True: a.tobytes()}
                data[False] = data[True].lower()
                found = zip(distinct[new].tolist(), as_is[i].tolist(), starts[i].tolist(), (ends[i] - tail[i]).tolist(), strict=True)
                self.learn({k: data[odd][s:e] for k, odd, s, e in found})
            stems = self.at[np.searchsorted(self.keys, distinct)][inverse]
            n_tails = np.cumsum(tail)
        else:
            stems, tail, comma, n_tails = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
        closing = np.append(np.searchsorted(starts, heads[1:]), n) if len(heads) else np.array([n])  # words before a text's end
        closing = closing if whole else closing[:-1]
        ends_before = np.zeros(n + 1, np.int64)
        np.add.at(ends_before, closing, 1)
        place = np.arange(n) + n_tails - tail + np.cumsum(ends_before)[:n]
        out = np.zeros(n + int(tail.sum()) + len(closing), np.int64)
        out[place] = stems
        out[place[tail] + 1] = np.where(comma[tail], 2, 1)
        return out, closing + np.append(0, n_tails)[closing] + np.arange(len(closing))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts on end, each followed by id 0, and the number of each text's."""
        found, sizes, open_ = [], [], 0
        for a, heads, whole in pieces(texts):
            if self.n > KEPT_WORDS:
                self.forget()
            at, ends = self._units(a, heads, whole)
            self.hits[: self.n] += np.bincount(at, minlength=self.n).astype(np.int32)
            own = self.sizes[at]
            upto = np.cumsum(own)
            if len(at):
                found.append(self.flat[np.arange(upto[-1]) + np.repeat(self.starts[at] - (upto - own), own)])
            closed = upto[ends]
            n = np.diff(closed, prepend=0)
            if len(n):
                n[0] += open_
                open_ = 0
            open_ += int(upto[-1] - (closed[-1] if len(n) else 0)) if len(at) else 0
            sizes.append(n)
        return (np.concatenate(found), np.concatenate(sizes)) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def token_pieces(
    docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Each document's ids and a closing id 0, cut into pieces of capacity: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        own = Ids(path)
        for b in batches:
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                ids, sizes = own.encode(part.column(1))
                raw, begin = ids.astype("<u4").tobytes(), np.cumsum(sizes) - sizes
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                first = begin[row] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist(), strict=True)]
                columns = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        tidy(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, best fit in decreasing order of size."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, np.empty(len(sizes), np.int64)
    n = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = (fits & -fits).bit_length() - 1 + size
            k = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            k, room, n = n, capacity, n + 1
        bins[i] = k
        left = room - size
        if left:
            open_bins[left].append(k)
            mask |= 1 << left
    return bins


def _joined(level: int, capacity: int):
    """Best fit of a group's items into bins, which keep their parts' places."""

    def join(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("size", ascending=False, kind="stable").reset_index(drop=True)
        frame["bin"] = best_fit(frame["size"].to_numpy(), capacity)
        frame["shift"] = frame.groupby("bin")["size"].cumsum() - frame["size"]
        out = {k: [] for k in ("group", "id", "size", "parts", "offsets")}
        for k, f in frame.groupby("bin", sort=True):
            out["group"].append(key[0])
            out["id"].append((level << 56) | (int(key[0]) << 24) | int(k))
            out["size"].append(int(f["size"].sum()))
            out["parts"].append(np.concatenate(f["parts"].to_list()))
            out["offsets"].append(np.concatenate([o + s for o, s in zip(f["offsets"], f["shift"], strict=True)]))
        return pd.DataFrame(out)

    return join


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """pieces with sequence_id and offset: no sequence is longer than capacity, none has gaps.

    Every length must be 1 to capacity. Repeated rows are packed each for itself. A group has about group_items items
    at most, whatever the size of the table; an item never has more than capacity pieces.
    """
    rows = reliable(pieces.withColumn("at", F.monotonically_increasing_id()))
    n = rows.count()
    groups = max(1, -(-n // group_items))
    # full pieces are sequences already
    full = F.col(length_col) == capacity
    whole = rows.filter(full).select("at", (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = rows.filter(~full).select(
        F.pmod(F.xxhash64("at"), F.lit(groups)).cast("long").alias("group"), F.col(length_col).cast("long").alias("size"),
        F.array("at").alias("parts"), F.array(F.lit(0).cast("long")).alias("offsets"),
    )
    done, level = [], 0
    while True:
        schema = "group long, id long, size long, parts array<long>, offsets array<long>"
        bins = reliable(items.groupBy("group").applyInPandas(tidy_groups(_joined(level, capacity)), schema))
        last = groups == 1
        if not last:
            before, left = n, bins.filter(F.col("size") <= capacity - NEARLY_FULL).count()
            last = level > 0 and left > (1 - LEAST_GAIN) * before
        if last:
            done.append(bins)
            break
        nearly = F.col("size") > capacity - NEARLY_FULL
        done.append(bins.filter(nearly))
        fewer = max(1, min(-(-left // group_items), groups // fan_in))
        items = bins.filter(~nearly).select(
            F.floor(F.col("group") * fewer / groups).alias("group"), "size", "parts", "offsets"
        )
        n, groups, level = left, fewer, level + 1
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)
    placed = packed.select("id", F.explode(F.arrays_zip("parts", "offsets")).alias("p")).select(
        F.col("p.parts").alias("at"), F.col("id").alias("sequence_id"), F.col("p.offsets").alias("offset")
    )
    return rows.join(placed.unionByName(whole), "at").drop("at")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and has the closing id 0 alone, as one piece. Rows with one id are documents of their own. An
    empty table gives an empty result; other columns are ignored.
    """
    return pack(token_pieces(docs, vocabulary, id_col, text_col, capacity), "length", capacity)


def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents, a row for each, and their places in sequences.

    A null text is one piece of the closing id alone; repeated rows and rows with a null id are documents of their own; an
    empty table gives an empty result. Other columns are left out, whatever their names: the result is about pieces.
    """
    small_batches(spark)
    return pack_documents(docs.select("doc_id", "text"))
