"""Words of whole batches of texts at once: their places and 64-bit hashes, in numpy over the column's bytes; and words of
letters alone, which a byte-level vocabulary's model takes without normalizer and pre-tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are hashed at once.
PIECE = 1 << 20
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Letters of ASCII and Latin-1, as a set of a regular expression.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BASE = 0xD6E8FEB86659FD93
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_NONE = np.zeros(1, np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A number for each byte, and the same with A-Z as a-z.
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * GOLD)
LOWER = BYTE.copy()
LOWER[65:91] = LOWER[97:123]
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def byte_signs() -> dict[int, str]:
    """The signs of a byte-level vocabulary for the bytes of a space and of each letter, for str.translate."""
    from tokenizers.pre_tokenizers import ByteLevel

    by = ByteLevel(add_prefix_space=False, use_regex=False)
    letters = " " + "".join(c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c))
    return {ord(c): "".join(x for x, _ in by.pre_tokenize_str(c)) for c in letters}


def _powers(piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if piece not in _POWERS:
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(piece + 1, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _POWERS[piece] = tuple(both)
    return _POWERS[piece]


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """The bytes of successive texts (null: empty), the places where texts begin, and if the last one is all there.

    A text above PIECE bytes comes in parts, cut between words; a part is longer only if one word fills it.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        if at[k + 1] - at[k] > PIECE:
            yield from _parts(raw[at[k] : at[k + 1]])
            k += 1
            continue
        j = max(k + 1, int(np.searchsorted(at, at[k] + PIECE, side="right")) - 1)
        yield raw[at[k] : at[j]], at[k:j] - at[k], True
        k = j


def _parts(a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    at = 0
    while at < len(a):
        stop = min(at + PIECE, len(a))
        if stop < len(a):
            spaces = np.flatnonzero(_SPACE[a[at:stop]])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
            else:  # one word fills the part
                while stop < len(a) and not _SPACE[a[stop]]:
                    step = np.flatnonzero(_SPACE[a[stop : stop + PIECE]])
                    stop = stop + int(step[0]) if len(step) else min(stop + PIECE, len(a))
        yield a[at:stop], _NONE if at == 0 else _NONE[:0], stop == len(a)
        at = stop


def spans(a: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the bytes; a word ends where a text begins."""
    word = ~_SPACE[a]
    new, end = word.copy(), word.copy()
    new[1:] &= _SPACE[a[:-1]]
    end[:-1] &= _SPACE[a[1:]]
    inner = heads[heads < len(a)]
    new[inner] = word[inner]
    inner = inner[inner > 0]
    end[inner - 1] = word[inner - 1]
    return np.flatnonzero(new), np.flatnonzero(end) + 1


def hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray = BYTE) -> np.ndarray:
    """64-bit hashes of stretches of the bytes, of at least one byte each. numbers: one for each byte."""
    if len(a) > PIECE:
        data = bytes(a) if numbers is BYTE else bytes(a).translate(_FOLD)
        return np.array([xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)
    power, inverse = _powers(PIECE)
    upto = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(numbers[a] * power[: len(a)], out=upto[1:])
    return mixed((upto[ends] - upto[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * GOLD)


def text_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words, A-Z as a-z, of successive texts on end, and the number of each text's."""
    open_ = []
    for a, heads, whole in pieces(texts):
        starts, ends = spans(a, heads)
        h = hashes(a, starts, ends, LOWER) if len(a) else np.zeros(0, np.uint64)
        if whole and not open_:
            yield h, np.diff(np.append(np.searchsorted(starts, heads), len(starts)))
            continue
        open_.append(h)
        if whole:
            h, open_ = np.concatenate(open_), []
            yield h, np.array([len(h)])
