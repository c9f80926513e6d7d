"""Token counts of whole texts by a byte-level BPE, with overlap resynchronisation for long documents.

A document longer than a chunk is encoded in overlapping chunks with offsets. Two encodings are spliced at a common boundary: a word
that both start as a token of its own after one space, with no other white space beside it. The pre-tokenizer looks forward only
and no match spans such a space, so from there on the encoding depends on nothing before it. Where an overlap has no
common boundary it is doubled, up to the rest of the document.

Texts are cut where a match of the pre-tokenizer ends, and each piece is encoded by the library once for each worker and
kept. A text, or a long text's chunk, of ASCII and Latin-1 letters is cut into its matches, and a match of letters goes
straight to the library's model; other texts are cut before words as above, and one with other white space beside
its spaces goes to the library as it is.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.llm.common import table
from twinlens.llm.words import LETTERS, byte_signs

#: Characters of a chunk and of its first overlap with the next one.
CHUNK, OVERLAP = 8_192, 512
#: Pieces that a worker keeps.
KEPT_PIECES = 600_000
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"\s | \s|^ | $")
#: Texts of which the pre-tokenizer's matches are known without its tables of Unicode, these matches, and those of letters.
_PLAIN = re.compile(rf"[\t-\r -~{LETTERS}]*")
_MATCH = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
_WORD = re.compile(rf" ?[{LETTERS}]+")


def splice(text: str, encode: Callable, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of text, from chunks of it. encode(part) gives (ids, starts, opens): opens tells if a token begins with
    a space; its start is the space's. What encode gives for ids, and for what stretches, is all one to the splices."""
    ids: list[int] = []
    at = 0  # ids has the tokens of text[:at]
    stop = min(chunk, len(text))
    left = encode(text[at:stop])
    while stop < len(text):
        wide = overlap
        while True:
            begin = max(at, stop - wide)
            end = min(begin + wide + chunk, len(text))
            right = encode(text[begin:end])
            # a boundary's next word ends before the left chunk does, so that more text would not change it
            starts = {begin + s: i for i, (s, o) in enumerate(zip(right[1], right[2], strict=True)) if o}
            cut = None
            for i in range(len(left[1]) - 1, -1, -1):
                p = at + left[1][i]
                if p <= begin:
                    break
                if left[2][i] and p in starts and _BOUNDARY.match(text, p) and _BOUNDARY.search(text, p + 1, stop):
                    cut = p, i, starts[p]
                    break
            if cut or begin == at:
                break
            wide *= 2
        if cut is None:  # one run without a boundary: the chunk grows over it
            stop = end
            left = right
            continue
        p, i, j = cut
        ids += left[0][:i]
        left = right[0][j:], [begin + s - p for s in right[1][j:]], right[2][j:]
        at, stop = p, end
    return ids + list(left[0])


class Counter:
    """Counts tokens as the library does; one for each worker and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.pieces = Tokenizer.from_file(path), {}
        self.model, self.signs, t = self.tokenizer.model, byte_signs(), self.tokenizer.pre_tokenizer
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.direct = self.tokenizer.normalizer is None and isinstance(self.model, BPE) and isinstance(t, ByteLevel) and t.use_regex and not t.add_prefix_space

    def plain(self, text: str) -> bool:
        return self.direct and _PLAIN.fullmatch(text) is not None and not any(x in text for x in self.added)

    def encode(self, text: str):
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, [s for s, _ in e.offsets], [t[:1] == "Ġ" for t in e.tokens]

    def matches(self, text: str):
        """A plain text's matches as splice() takes them, with their numbers of tokens for ids."""
        pieces = _MATCH.findall(text)
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        self.learn({w for w in pieces if w not in self.pieces})
        return [self.pieces[w] for w in pieces], list(accumulate(map(len, pieces[:-1]), initial=0)), [w[0] == " " for w in pieces]

    def learn(self, new: set[str]) -> None:
        rest = []
        for w in new:
            if self.direct and _WORD.fullmatch(w):
                self.pieces[w] = len(self.model.tokenize(w.translate(self.signs)))
            else:
                rest.append(w)
        found = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        self.pieces.update(zip(rest, map(len, found), strict=True))

    def count(self, texts: list[str | None], chunk: int, overlap: int) -> list[int]:
        out, todo = [0] * len(texts), []
        for i, text in enumerate(texts):
            if not text:
                continue
            plain = self.plain(text)
            if len(text) > chunk:
                out[i] = sum(splice(text, self.matches, chunk, overlap)) if plain else len(splice(text, self.encode, chunk, overlap))
            elif plain:
                todo.append((i, _MATCH.findall(text)))
            elif _OTHER_SPACE.search(text):
                out[i] = len(self.tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                first, *more = text.split(" ")
                todo.append((i, [first, *(" " + w for w in more)]))
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        late, new = [], set()
        for i, words in todo:
            n = list(map(self.pieces.get, words))
            if None in n:
                late.append((i, words))
                new.update(w for w, k in zip(words, n, strict=True) if k is None)
            else:
                out[i] = sum(n)
        self.learn(new)
        for i, words in late:
            out[i] = sum(map(self.pieces.__getitem__, words))
        return out


_COUNTERS: dict[str, Counter] = {}


def count_tokens(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text",
    limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit. No shuffle.

    A null text is empty: no bytes, no tokens. Rows with one id or one text are counted each for itself; other columns
    are ignored; an empty table gives an empty result. vocabulary names a file of public_tokenizers or is a path that
    executors can read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for b in batches:
            for part in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
                n = pa.array(counter.count(part.column(1).to_pylist(), chunk, overlap), pa.int64())
                size = pc.fill_null(pc.binary_length(part.column(1)), 0).cast(pa.int64())
                over = pc.greater(n, limit)
                yield pa.RecordBatch.from_arrays([part.column(0), size, n, over], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
