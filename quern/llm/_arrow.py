"""Whole Arrow batches of texts as numpy arrays: words, their hashes, shingles.

Texts stay UTF-8 bytes, end to end in one buffer; nothing here loops over words
in Python. A word hash is a polynomial over the word's bytes, read off prefix
sums modulo 2**64 and then mixed, so it depends on the bytes alone and is the
same in every task, on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; bounds the memory of the prefix sums.
SEGMENT = 1 << 19
#: Bytes of text that callers take at a time.
CHUNK = 1 << 21

_powers = np.ones(1, U64)
_inverses = np.ones(1, U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SEGMENT + 4096)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            t = np.full(size, base, U64)
            t[0] = 1
            globals()[name] = np.cumprod(t, dtype=U64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def fold_table(is_word: np.ndarray | None = None) -> np.ndarray:
    """For each byte the byte with A-Z lowered, or 0 where it ends a word."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if is_word is None:
        is_word = np.ones(256, bool)
        is_word[[0x20, 9, 10, 11, 12, 13]] = False
    t[0] = 1  # U+0000 is part of a word
    t[~is_word] = 0
    return t


WORDS = fold_table()
_letters = np.zeros(256, bool)
_letters[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LETTERS = fold_table(_letters)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or not n:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of Python byte strings."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=at[1:])
    return np.frombuffer(b"".join(texts), np.uint8), at


def chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to ``limit`` bytes; a longer document is alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of all words; ``first[d]:first[d + 1]`` are document d's."""
    inside = np.zeros(len(data) + 2, bool)
    folded = table[data]
    inside[1:-1] = folded != 0
    begins = inside[1:-1] & ~inside[:-2]
    bounds = at[:-1][at[:-1] < len(data)]
    begins[bounds] = inside[1:-1][bounds]
    starts = np.flatnonzero(begins)
    ends_here = inside[1:-1] & ~inside[2:]
    inner = at[1:][at[1:] > 0] - 1
    ends_here[inner] = inside[1:-1][inner]
    ends = np.flatnonzero(ends_here) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = WORDS) -> np.ndarray:
    """64-bit hashes of the byte spans ``starts[i]:ends[i]``, which ascend; A-Z lowered."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SEGMENT, "right")))
        hi = int(ends[j - 1])
        powers, inverses = _tables(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[data[lo:hi]].astype(U64) * powers[: hi - lo], dtype=U64, out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def word_hashes(data: np.ndarray, at: np.ndarray, table: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of all words."""
    starts, ends, first = words(data, at, table)
    return span_hashes(data, starts, ends, table), first


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct value is first, ascending; each value's number among these)."""
    coded = pa.array(h).dictionary_encode()
    code = coded.indices.to_numpy()
    where = np.empty(len(coded.dictionary), np.int64)
    where[code[::-1]] = np.arange(len(h) - 1, -1, -1)  # of several the last that is set stays
    return where, code


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the spans of ``sizes`` bytes from ``starts``, end to end; where each begins)."""
    begin = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=begin[1:])
    return data[np.repeat(starts - begin[:-1], sizes) + np.arange(begin[-1])], begin[:-1]


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of the runs of ``width`` words, repeats included, by document.

    A document of fewer words, but at least one, has its whole sequence as its
    one shingle; without words it has none.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=begin[1:])
    doc = np.repeat(np.arange(len(n)), count)
    pos = first[:-1][doc] + (np.arange(begin[-1]) - begin[:-1][doc])
    length = np.minimum(n, width)[doc]
    total = length.astype(U64)
    padded = np.concatenate([h, np.zeros(width, U64)])
    for k in range(width):
        term = padded[pos + k]
        term[length <= k] = 0
        total = total * U64(0x9FB21C651E98DF25) + term
    return mix(total), begin


def unique(x: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    if len(x) < 2:
        return x
    s = np.sort(x)
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def unique_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values sorted and without repeats: (values, first)."""
    parts = [unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    begin = np.zeros(len(first), np.int64)
    np.cumsum([len(p) for p in parts], out=begin[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), begin


class Bits:
    """A set of hashes by their top bits: says yes to all that are in it, and to a few others."""

    def __init__(self, width: int, parts: dict[int, bytes]):
        self.width = width
        self.raw = np.zeros(1 << max(0, width - 3), np.uint8)
        for i, part in parts.items():
            own = np.frombuffer(part, np.uint8)[: len(self.raw)]
            self.raw[i * 4096 : i * 4096 + len(own)] = own

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h.view(U64) >> U64(64 - self.width)).astype(np.int64)
        return (self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
