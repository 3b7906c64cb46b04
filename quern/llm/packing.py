"""Operator 10: best-fit packing of documents into fixed-length sequences.

Documents are tokenized, and those over the capacity are cut so that only a first
piece is shorter. Packing is bulk-synchronous: pieces and gaps are sorted by length,
each piece is matched with its successor among the gaps (the smallest that holds it),
the longer and then the lower-ranked piece has the right of way, gaps are updated,
and the next round begins.

Pieces of one length are interchangeable, so a sweep needs not the pieces but their
runs: (length, first rank, count), and likewise (gap, first sequence, count). There
are at most ``capacity`` lengths, however many documents; rounds over runs are
therefore short loops over a table whose size doesn't depend on the data, and the
distributed work is what surrounds them: ranking every piece within its length, by
prefix sums over hash buckets so that a common length isn't one task, and looking up
each rank's place.
"""

from __future__ import annotations

import bisect
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import chunks, span_hashes, utf8
from ._spark import durable, shuffle_partitions

CAPACITY = 1024
END = 2
#: Bytes that a task's memory of parts and their ids may take; it forgets all of them beyond that.
REMEMBER = 64 << 20
#: Pre-tokens of byte-level BPE files without a pattern of their own (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """A tokenizer file's ids, equal to ``tokenizers``' own.

    A single space that begins a word always begins a pre-token, so texts are cut
    before their spaces and the ids of each part are remembered by the part's 64-bit
    hash; new parts are encoded together, in one text. The ids of a batch are turned back
    into bytes and compared with it, so that no chance equality of hashes goes unseen.
    Texts that differ there, or in which white space meets a space, or a special token's
    string appears, are left to ``tokenizers``, and so are files that aren't plain
    byte-level BPE in merge order.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.quick = None
        self._forget()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        plain = plain and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.specials = [t["content"].encode() for t in spec.get("added_tokens", [])]
        if plain:
            self._plain(model)

    def _forget(self) -> None:
        #: Parts' hashes in order, and where their ids are in ``ids``; the recent ones apart.
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
        self.ids = np.zeros(1 << 16, "<u4")
        self.used = 0

    def _plain(self, model: dict) -> None:
        import tiktoken

        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocab = {t: i for t, i in model["vocab"].items() if t.encode() not in self.specials}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if [vocab.get(a + b) for a, b in merges] != sorted(vocab.values())[-len(merges) :] or not all(c in byte_of for t in vocab for c in t):
            return
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
        self.quick = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        by_id = {i: t for t, i in ranks.items()}
        self.spelt = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self.spelt_at = np.cumsum(self.lengths) - self.lengths

    def _slow(self, raw: bytes) -> np.ndarray:
        return np.asarray(self.whole.encode(raw.decode(), add_special_tokens=False).ids, "<u4")

    def _append(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(ids), "<u4")])
        self.ids[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        at, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        # A space, then a character, and no other white space at either end.
        second = data[np.minimum(starts + 1, len(data) - 1)]
        even = (data[starts] == 32) & (ends > starts + 1) & (second > 32) & ~np.isin(second, (0xC2, 0xE1, 0xE2, 0xE3)) & (data[ends - 1] != 32) & ~_after_space(data, ends)
        for k in np.flatnonzero(~even).tolist():
            ids = self.quick.encode_ordinary(data[starts[k] : ends[k]].tobytes().decode())
            at[k], count[k] = self._append(np.asarray(ids, "<u4")), len(ids)
        where = np.flatnonzero(even)
        if len(where):
            sizes = (ends - starts)[where]
            upto = np.cumsum(sizes)
            text = data[np.repeat(starts[where] - upto + sizes, sizes) + np.arange(upto[-1])].tobytes().decode()
            ids = np.asarray(self.quick.encode_to_numpy(text, disallowed_special=()), "<u4")
            cuts = np.searchsorted(np.cumsum(self.lengths[ids]), upto, "left") + 1
            begin = np.concatenate([[0], cuts[:-1]])
            at[where], count[where] = self._append(ids) + begin, cuts - begin
        both = [np.concatenate([a, b]) for a, b in zip(self.tables[1], (hashes, at, count))]
        order = np.argsort(both[0])
        self.tables[1] = tuple(x[order] for x in both)
        if len(order) > 0.3 * len(self.tables[0][0]):
            both = [np.concatenate([a, b]) for a, b in zip(*self.tables)]
            order = np.argsort(both[0])
            self.tables = [tuple(x[order] for x in both), tuple(x[:0] for x in both)]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, count, known) of the hashes, which ascend."""
        at, count, known = (np.zeros(len(hashes), t) for t in (np.int64, np.int64, bool))
        for keys, where, n in self.tables:
            if len(keys):
                k = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[k] == hashes
                at[hit], count[hit] = where[k[hit]], n[k[hit]]
                known |= hit
        return at, count, known

    def encode(self, data: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """Little-endian ids of the documents at ``begin[d]:begin[d + 1]`` in UTF-8 bytes."""
        whole = range(len(begin) - 1)
        raw = data.tobytes()
        if self.quick is None:
            return [self._slow(raw[begin[d] : begin[d + 1]]).tobytes() for d in whole]
        cut = data == 32
        spaces = np.flatnonzero(cut)
        cut[begin[:-1][begin[:-1] < begin[1:]]] = True
        cuts = np.flatnonzero(cut)
        doc_first = np.searchsorted(cuts, begin)
        h = span_hashes(data, cuts, np.append(cuts[1:], len(data)), _BYTES)
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if 24 * sum(len(t[0]) for t in self.tables) + 4 * len(self.ids) > REMEMBER:
            self._forget()
        at, count, known = self._find(unique)
        if not known.all():
            new = np.flatnonzero(~known)
            ends = np.append(cuts, len(data))
            self._learn(unique[new], data, cuts[first[new]], ends[first[new] + 1])
            at, count, known = self._find(unique)
        at, count = at[inverse], count[inverse]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        flat = self.ids[np.repeat(at - total[:-1], count) + np.arange(total[-1])]
        ids = flat.tobytes()
        bounds = (4 * total[doc_first]).tolist()
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        odd = set((np.searchsorted(begin, spaces[_after_space(data, spaces)], "right") - 1).tolist())
        odd |= self._unequal(flat, data, total[doc_first], begin)
        if any(s in raw for s in self.specials):
            odd |= {d for d in whole if any(s in raw[begin[d] : begin[d + 1]] for s in self.specials)}
        for d in odd:
            out[d] = self._slow(raw[begin[d] : begin[d + 1]]).tobytes()
        return out


    def _unequal(self, ids: np.ndarray, data: np.ndarray, first: np.ndarray, begin: np.ndarray) -> set[int]:
        """The documents whose ids, ``ids[first[d]:first[d + 1]]``, don't spell their bytes."""
        sizes = self.lengths[ids]
        upto = np.cumsum(sizes)
        spelt = self.spelt[np.repeat(self.spelt_at[ids] - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]
        if len(spelt) == len(data) and np.array_equal(spelt, data):
            return set()
        at = np.concatenate([[0], upto])[first]
        return {d for d in range(len(begin) - 1) if not np.array_equal(spelt[at[d] : at[d + 1]], data[begin[d] : begin[d + 1]])}


_BYTES = np.arange(256, dtype=np.uint8)


def _after_space(data: np.ndarray, spaces: np.ndarray) -> np.ndarray:
    """Whether a white-space character ends right before each space."""
    a, b, c = (np.where(spaces >= k, data[np.maximum(spaces - k, 0)], 0) for k in (1, 2, 3))
    found = (a == 32) | ((a >= 9) & (a <= 13)) | ((a >= 28) & (a <= 31))
    found |= (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    found |= (c == 0xE1) & (b == 0x9A) & (a == 0x80)
    found |= (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) & (a >= 0x80) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    found |= (c == 0xE2) & (b == 0x81) & (a == 0x9F)
    return found | ((c == 0xE3) & (b == 0x80) & (a == 0x80))


@lru_cache(maxsize=2)
def encoder(path: str | None) -> Encoder:
    return Encoder(path or default_tokenizer())


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids and the end id."""
    tail = np.asarray([end], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            data, at = utf8(b.column("text"))
            for i, j in chunks(at):
                doc, piece, start, length, crc = [], [], [], [], []
                for d, raw in zip(ids[i:j], enc.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])):
                    raw += tail
                    total = len(raw) // 4
                    s, k = 0, 0
                    step = total % capacity or capacity
                    while s < total:
                        doc.append(d)
                        piece.append(k)
                        start.append(s)
                        length.append(step)
                        crc.append(zlib.crc32(raw[4 * s : 4 * (s + step)]))
                        s, k, step = s + step, k + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for runs of pieces: (length, first rank, count, first sequence, offset, per sequence).

    Rank r of a length lies in sequence ``first + (r - rank) // per``, at ``offset +
    (r - rank) % per * length``. Rounds: every run, longest first, takes the smallest
    gaps of the round's start that hold its pieces, and fills each. What is left of a
    run opens sequences if no gap, old or new, could hold it; otherwise it waits.
    """
    todo = [[n, 0, c] for n, c in sorted(counts.items(), reverse=True) if c]
    gaps: dict[int, list[list[int]]] = {}
    placed: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0
    while todo:
        sizes = sorted(gaps)
        fresh: dict[int, list[list[int]]] = {}
        largest_new = 0

        def give(run: list[int], first: int, bins: int, gap: int) -> tuple[int, int]:
            """Fills up to ``bins`` sequences from ``first`` on; (how many it used, the largest gap left)."""
            n, rank, left = run
            per = gap // n
            full = min(bins, left // per)
            most = 0
            if full:
                placed.append((n, rank, full * per, first, capacity - gap, per))
                if gap - per * n:
                    fresh.setdefault(gap - per * n, []).append([first, full])
                    most = gap - per * n
                rank, left = rank + full * per, left - full * per
            if left and full < bins:
                placed.append((n, rank, left, first + full, capacity - gap, per))
                if gap - left * n:
                    fresh.setdefault(gap - left * n, []).append([first + full, 1])
                    most = max(most, gap - left * n)
                rank, left, full = rank + left, 0, full + 1
            run[1], run[2] = rank, left
            return full, most

        waiting = []
        for run in todo:
            k = bisect.bisect_left(sizes, run[0])
            while run[2] and k < len(sizes):
                gap = sizes[k]
                while run[2] and gaps[gap]:
                    first, bins = gaps[gap][-1]
                    used, most = give(run, first, bins, gap)
                    largest_new = max(largest_new, most)
                    if used == bins:
                        gaps[gap].pop()
                    else:
                        gaps[gap][-1] = [first + used, bins - used]
                if gaps[gap]:
                    break
                k += 1
            if run[2] and largest_new < run[0]:
                bins = -(-run[2] // (capacity // run[0]))
                _, most = give(run, sequences, bins, capacity)
                largest_new = max(largest_new, most)
                sequences += bins
            if run[2]:
                waiting.append(run)
        gaps = {g: r for g, r in gaps.items() if r}
        for g, runs in fresh.items():
            gaps.setdefault(g, []).extend(runs)
        todo = waiting
    return placed


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... within each length.

    Prefix sums over (length, bucket) counts give each bucket's first rank; windows
    only order within a bucket, so the rows of a common length spread over all tasks.
    """
    buckets = shuffle_partitions(items.sparkSession)
    keyed = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return keyed.withColumn("rank", F.row_number().over(within) - 1).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("first")).drop("bucket", "first")


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: its ids' place in their document, and its place in a sequence.

    Input: doc_id and text; other columns are ignored. A null or empty text is the end
    id alone; a very long one is many pieces. Repeated rows, and rows without a doc_id,
    are packed like any others.
    No rows give no rows. Sequences are numbered from 0, offsets have no holes.
    """
    items = durable(pieces(docs, capacity, end, tokenizer))
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = np.asarray(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    keys = (places[:, 0] << 44) + places[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            p = places[np.searchsorted(keys, (n << 44) + rank, "right") - 1]
            k = rank - p[:, 1]
            cols = {c: b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols["sequence_id"] = pa.array(p[:, 3] + k // p[:, 5])
            cols["offset"] = pa.array(p[:, 4] + k % p[:, 5] * n)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return ranked(items).mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
