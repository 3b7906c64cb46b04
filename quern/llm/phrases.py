"""Operator 11: collocations by contiguous pattern growth over projected occurrences.

Frequent words are counted first, then frequent pairs of them; each occurrence of a
frequent pair is a pointer, projected to the words that may follow it: up to the longest
phrase, the end of the piece, or a pair that isn't frequent. Equal projections are one row
with a count. Sorted by their words they lie in ranges of prefixes; a task walks its range
and grows each frequent prefix to the right, depth first, within the rows that have it. A
prefix that two tasks or batches share is reported by both and summed, so a hot one is
spread like any other. Words and phrases are known by 64-bit hashes; texts of words come
back for what is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order import numbered

from . import _arrow as A
from ._spark import Stored, bits, durable, small

LEAST, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
_BETWEEN = np.ones(256, bool)
_BETWEEN[[0x20, 9, *b".,;:!?", 10, 11, 12, 13]] = False
WORDS = A.fold_table(_BETWEEN)
_FORTY = np.uint64((1 << 64) - (1 << 24))
_BREAKS = np.zeros(256, np.int64)
_BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = 1


def _pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, documents, whether the next word is in the same piece) of all words."""
    starts, ends, first = A.words(data, at, WORDS)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(_BREAKS[data])])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (doc[1:] == doc[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1]])
    return starts, ends, doc, joined


def _languages(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """(languages, the number of each row's)."""
    coded = batch.column("lang").fill_null(UNKNOWN).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, ends, hashes, languages, joined) of the words of some documents at a time."""
    _, code = _languages(batch)
    data, at = A.utf8(batch.column("text"))
    for i, j in A.chunks(at):
        own, place = data[at[i] : at[j]], at[i : j + 1] - at[i]
        starts, ends, doc, joined = _pieces(own, place)
        if len(starts):
            yield own, starts, ends, A.span_hashes(own, starts, ends, WORDS), code[i:j][doc], joined


def _key(lang: np.ndarray, salt: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a language and two words."""
    return A.mix(A.mix(a * np.uint64(0x9FB21C651E98DF25) + salt[lang]) * np.uint64(0xD6E8FEB86659FD93) + b)


def _salts(names: list[str]) -> np.ndarray:
    data, at = A.joined([n.encode() for n in names])
    return A.span_hashes(data, at[:-1], at[1:], np.arange(256, dtype=np.uint8))


def _with_language(h: np.ndarray, lang: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return A.mix(h + salt[lang])


def _source(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))


def words(docs: DataFrame) -> DataFrame:
    """(lang, w, n): how often each word occurs; w is null for the sum over all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _ = _languages(b)
            for data, starts, ends, h, lang, _ in _parts(b):
                order = np.lexsort((h, lang))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (lang[order][1:] != lang[order][:-1])
                at = np.flatnonzero(new)
                first, n = order[at], np.diff(np.append(at, len(order)))
                folded = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8).tobytes()
                text = [folded[s:e].decode() for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                every = np.bincount(lang, minlength=len(names))
                some = np.flatnonzero(every)
                langs = [names[i] for i in lang[first].tolist()] + [names[i] for i in some.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(text + [None] * len(some), pa.string()), pa.array(np.append(n, every[some]))],
                    names=["lang", "w", "n"],
                )

    return _source(docs).mapInArrow(run, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))


def _with_hash(counts: DataFrame) -> DataFrame:
    """(lang, h, w, n) of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = A.utf8(b.column("w"))
            h = A.span_hashes(data, at[:-1], at[1:], WORDS)
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(h.view(np.int64)), b.column("w"), b.column("n")], names=["lang", "h", "w", "n"])

    return counts.mapInArrow(run, "lang string, h long, w string, n long")


def _hashed(frequent: DataFrame) -> DataFrame:
    """(h): each frequent word's hash with its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, lang = _languages(b)
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(_with_language(h, lang, _salts(names)).view(np.int64))], names=["h"])

    return durable(frequent.select("lang", "h").mapInArrow(run, "h long"))


def pairs(docs: DataFrame, among: A.Bits, least: int) -> DataFrame:
    """(k): hashes of the adjacent pairs of frequent words that are frequent, by their first 40 bits: a filter, not a count."""
    known = docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            salt = _salts(_languages(b)[0])
            for _, _, _, h, lang, joined in _parts(b):
                ok = known.value.has(_with_language(h, lang, salt))
                i = np.flatnonzero(joined[:-1] & ok[:-1] & ok[1:])
                k, n = np.unique(_key(lang[i], salt, h[i], h[i + 1]) & _FORTY, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["k", "n"])

    counted = _source(docs).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least).select("k")


def pointers(docs: DataFrame, among: A.Bits, longest: int) -> DataFrame:
    """(lang, p, n): the words that follow from each occurrence of a frequent pair on, as hashes; equal ones counted."""
    known = docs.sparkSession.sparkContext.broadcast(among)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _ = _languages(b)
            salt = _salts(names)
            for _, _, _, h, lang, joined in _parts(b):
                chained = joined.copy()
                i = np.flatnonzero(joined)
                chained[i] = known.value.has(_key(lang[i], salt, h[i], h[i + 1]))
                i = np.flatnonzero(chained)
                # Row: language, length, words; what isn't in the projection is 0.
                rows = np.zeros((len(i), longest + 2), np.uint64)
                rows[:, 0], rows[:, 2] = lang[i].astype(np.uint64), h[i]
                on = np.ones(len(i), bool)
                for d in range(1, longest):
                    on &= chained[np.minimum(i + d - 1, len(h) - 1)]
                    rows[on, 1] = d + 1
                    rows[on, 2 + d] = h[i[on] + d]
                order = np.lexsort(rows.T)
                rows = rows[order]
                at = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1))) if len(rows) else np.zeros(0, np.int64)
                n, rows = np.diff(np.append(at, len(rows))), rows[at]
                size = rows[:, 1].astype(np.int64)
                flat = rows[:, 2:][np.arange(longest) < size[:, None]]
                p = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in rows[:, 0].tolist()], pa.string()), p, pa.array(n)], names=["lang", "p", "n"])

    return _source(docs).mapInArrow(run, "lang string, p array<long>, n long").groupBy("lang", "p").agg(F.sum("n").alias("n"))


def _grow(lang: np.ndarray, p: np.ndarray, size: np.ndarray, n: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a row that begins with it, length, count) of the prefixes in sorted rows.

    Prefixes that the first or last row has are reported whatever their count.
    """
    out: list[tuple[int, int, int]] = []
    total = np.append(0, np.cumsum(n))

    def grow(lo: int, hi: int, depth: int) -> None:
        """Rows lo to hi share ``depth`` words; those that go on come after those that end here."""
        lo += int(np.searchsorted(size[lo:hi], depth, "right")) if depth else 0
        if lo >= hi:
            return
        own = p[lo:hi, depth]
        new = own[1:] != own[:-1]
        if not depth:
            new |= lang[1:] != lang[:-1]
        begin = np.append(lo, lo + 1 + np.flatnonzero(new))
        end = np.append(begin[1:], hi)
        count = total[end] - total[begin]
        for a, b, c in zip(begin.tolist(), end.tolist(), count.tolist()):
            if c >= least or a == 0 or b == len(p):
                if depth:
                    out.append((a, depth + 1, c))
                if depth + 1 < p.shape[1]:
                    grow(a, b, depth + 1)

    if len(p):
        grow(0, len(p), 0)
    return out


def grown(projected: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, p, a): phrases of two words or more that occur ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            names, lang = _languages(b)
            size = b.column("p").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            p = np.zeros((b.num_rows, longest), np.int64)
            p[np.arange(longest) < size[:, None]] = b.column("p").flatten().to_numpy(zero_copy_only=False)
            found = _grow(lang, p, size, b.column("n").to_numpy(zero_copy_only=False), least)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[lang[i]] for i, _, _ in found], pa.string()), pa.array([p[i, :k].tolist() for i, k, _ in found], pa.list_(pa.int64())), pa.array([c for _, _, c in found], pa.int64())],
                names=["lang", "p", "a"],
            )

    ranges = projected.repartitionByRange("lang", "p").sortWithinPartitions("lang", "p")
    return ranges.mapInArrow(run, "lang string, p array<long>, a long").groupBy("lang", "p").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _slice(p: Column, start: Column | int, length: Column | int) -> Column:
    return F.slice(p, F.lit(start) if isinstance(start, int) else start, F.lit(length) if isinstance(length, int) else length)


def mined(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases.

    Input: text and lang; other columns are ignored. A null text is empty, a null lang is
    ``und``. Repeated rows count as often as they are there. A piece may be as long as a
    text; memory grows with the longest text. Ties of score and count go by the phrase's
    bytes. No rows, or no frequent phrase, give no rows.
    """
    counts = durable(words(docs).where(F.col("w").isNull() | (F.col("n") >= least)))
    all_words, frequent = counts.where("w IS NULL").select("lang", "n"), durable(_with_hash(counts.where("w IS NOT NULL")))
    twos = durable(pairs(docs, bits(_hashed(frequent), "h"), least))
    projected = Stored(pointers(docs, bits(twos, "k"), longest))
    found = durable(grown(projected.rows, least, longest))
    projected.drop()
    return ranked(found, frequent, all_words, top)


def scored(found: DataFrame, frequent: DataFrame, all_words: DataFrame) -> DataFrame:
    """(lang, p, a, l, r, n, score) of the phrases that no longer one explains; arithmetic in 38 digits.

    found: (lang, p, a); frequent: (lang, h, n) of words; all_words: (lang, n).
    """
    of = frequent.select("lang", F.array("h").alias("p"), F.col("n").alias("f")).unionByName(found.select("lang", "p", F.col("a").alias("f")))
    m = F.size("p")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
    cuts = cuts.withColumns({"left": _slice(F.col("p"), 1, F.col("k")), "right": _slice(F.col("p"), F.col("k") + 1, m - F.col("k"))})
    side = lambda name, f: of.select("lang", F.col("p").alias(name), F.col("f").alias(f))
    both = durable(cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]))
    # A phrase inside one longer by a word is its left or right side there; longer ones go by these.
    ends = [both.where((F.size("p") > 2) & at).select("lang", F.col(c).alias("p"), F.col("a").alias("la")) for c, at in (("left", F.size("right") == 1), ("right", F.size("left") == 1))]
    longer = ends[0].unionByName(ends[1]).groupBy("lang", "p").agg(F.max("la").alias("la"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    value = F.expr("CAST(1000 * CAST(a AS DECIMAL(16,0)) AS DECIMAL(19,0))") * wide("n")
    rows = both.join(small(all_words), "lang").withColumn("score", F.call_function("div", value, wide("l") * wide("r")))
    best = rows.groupBy("lang", "p", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    kept = best.join(longer, ["lang", "p"], "left").where(F.col("la").isNull() | (F.col("la") < F.col("a")))
    return kept.select("lang", "p", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, from 1, in their language; no task sees a whole language."""
    out = durable(numbered(rows, F.asc("lang"), *order))
    first = out.groupBy("lang").agg(F.min("place").alias("first"))
    return out.join(small(durable(first)), "lang").withColumn("rank", F.col("place") - F.col("first") + 1).drop("place", "first")


def ranked(found: DataFrame, frequent: DataFrame, all_words: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language; phrases are spelled for them and their ties alone."""
    order = _placed(scored(found, frequent, all_words), F.desc("score"), F.desc("a"), F.asc("p"))
    last = durable(order.where(F.col("rank") == top).select("lang", F.struct("score", "a").alias("last")))
    near = order.join(small(last), "lang", "left").where(F.col("last").isNull() | (F.struct("score", "a") >= F.col("last"))).drop("rank", "last")
    near = durable(near)
    spelled = near.select("lang", "p", F.posexplode("p").alias("i", "h")).join(frequent.select("lang", "h", "w"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ").alias("phrase"))
    out = _placed(near.join(spelled, ["lang", "p"]), F.desc("score"), F.desc("a"), F.asc("phrase"))
    return out.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, greatest(len(w) - {m - 2}, 1)), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS p, {m} AS m FROM s" for m in range(1, longest + 1))
    return f"""WITH t AS (SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
g AS (SELECT lang, p, m, count(*) AS f, string_split(p, ' ') AS w FROM ({grams}) GROUP BY ALL HAVING f >= {least}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM s GROUP BY lang),
k AS (SELECT *, unnest(range(1, m)) AS k FROM g WHERE m > 1),
e AS (SELECT *, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM k),
c AS (SELECT e.lang, e.p, e.m, e.f AS a, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * e.f * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM e JOIN n ON n.lang = e.lang JOIN g l ON l.lang = e.lang AND l.p = e.lp JOIN g r ON r.lang = e.lang AND r.p = e.rp
  QUALIFY row_number() OVER (PARTITION BY e.lang, e.p ORDER BY score, k) = 1),
x AS (SELECT lang, unnest([array_to_string(w[:-2], ' '), array_to_string(w[2:], ' ')]) AS p, f FROM g WHERE m > 2),
o AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = c.lang AND x.p = c.p AND x.f >= c.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM o QUALIFY rank <= {top}"""


ORACLE = _oracle()
