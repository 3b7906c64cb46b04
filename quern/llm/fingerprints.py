"""Operator 1: bottom-k fingerprints of documents.

A fingerprint holds the k smallest of the 64-bit hashes (their top 48 bits) of a
document's distinct five-word shingles. Sketches of parts merge into the sketch
of the whole, and estimate resemblance, containment and the number of distinct
shingles. As text a fingerprint is base64 of the hashes, ascending, six bytes
each; a document without words has the empty one.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow as A
from ._spark import shuffle_partitions

K = 128
WIDTH = 5
_SPACE = 2.0**48


def sketches(texts: list[bytes], k: int = K, width: int = WIDTH) -> list[np.ndarray]:
    """The k smallest 48-bit shingle hashes of each text, ascending."""
    out: list[np.ndarray] = []
    data, at = A.joined(texts)
    for i, j in A.chunks(at):
        h, first = A.word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        s, first = A.shingles(h, first, width)
        s >>= np.uint64(16)
        for a, b in zip(first[:-1], first[1:]):
            part = s[a:b]
            if len(part) > 4 * k:
                # Repeats among the smallest only make the cut larger, never lose one.
                low = A.unique(np.partition(part, 2 * k)[: 2 * k])
                out.append(low[:k] if len(low) >= k else A.unique(part)[:k])
            else:
                out.append(A.unique(part)[:k])
    return out


def encode(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 2:] = raw
    return wide.reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the two documents' shingles together."""
    return A.unique(np.concatenate([a, b]))[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact while fewer than k."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / (float(a[k - 1]) + 1)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated size of the intersection over the union; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.sort(np.concatenate([a, b]))
    both = both[1:][both[1:] == both[:-1]]
    return float(np.searchsorted(both, union[-1], "right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / distinct(a, k))


def merged(fingerprints: DataFrame, by: list[str], column: str = "fingerprint", k: int = K) -> DataFrame:
    """One fingerprint per group: (``by``..., fingerprint, distinct_shingles).

    Hashes are deduplicated map-side and reach the group's task at most k per
    input partition, so a hot group sends k values from each task, not its rows.
    """
    keys = [F.col(c) for c in by]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            cols = [b.column(c).to_pylist() for c in by]
            for key, text in zip(zip(*cols), b.column(column).to_pylist()):
                s = decode(text or "")
                held[key] = merge(held[key], s, k) if key in held else s
        names = [*by, "fingerprint"]
        rows = [dict(zip(names, (*key, encode(s)))) for key, s in held.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, schema.field(c).type) for c in by] + [("fingerprint", pa.string())]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    narrow = fingerprints.select(*keys, F.col(column))
    out = StructType([narrow.schema[c] for c in by] + [StructField("fingerprint", StringType())])
    schema = to_arrow_schema(narrow.schema)

    def final(pdf):
        total = np.zeros(0, np.uint64)
        for text in pdf["fingerprint"]:
            total = merge(total, decode(text), k)
        row = pdf.iloc[:1][by].copy()
        row["fingerprint"], row["distinct_shingles"] = encode(total), distinct(total, k)
        return row

    done = StructType([*out.fields]).add("distinct_shingles", "double")
    return narrow.mapInArrow(partial, out).groupBy(*by).applyInPandas(final, done)


def _cuts(keys: list[int]) -> list[tuple[int, int]]:
    """(key, tie) bounds, descending, from quantiles of the key.

    A key that is several quantiles holds that share of the rows, which its ties, being
    hashes, are cut into evenly.
    """
    out = []
    for key, n in Counter(keys).items():
        step = (1 << 64) // (n if n > 1 else 1)
        out += [(key, -(1 << 63) + j * step) for j in range(n)]
    return sorted(out, reverse=True)


def _longs(values: list[int]) -> Column:
    """One literal, however many values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _above(key: Column, tie: Column, cuts: list[tuple[int, int]]) -> Column:
    """How many of the cuts are above (key, tie): first among every step-th, then among those between."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    pairs = lambda c: F.arrays_zip(_longs([k for k, _ in c]).alias("k"), _longs([t for _, t in c]).alias("t"))
    count = lambda c: F.size(F.filter(c, lambda x: (x["k"] > key) | ((x["k"] == key) & (x["t"] > tie))))
    whole = count(pairs(cuts[step - 1 :: step])) * step
    return whole + count(F.slice(pairs(cuts), whole + 1, step))


def _ordered(docs: DataFrame) -> DataFrame:
    """``docs`` range-partitioned and sorted by descending doc_id (null last), equal ones by a hash of the text.

    Each range also gets the row that follows its last one (column ``ghost``), so
    a task knows every row's successor. Bounds are quantiles of doc_id, one per
    partition; the rows that follow are found by id, never gathered on the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key")).withColumn("tie", F.xxhash64("text"))
    parts = shuffle_partitions(spark)
    found = rows.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 100 * max(100, parts))).head()[0]
    cuts = _cuts(found or []) if parts > 1 else []
    ranged = lambda df: df.withColumn("part", _above(F.col("key"), F.col("tie"), cuts))
    # One row per partition: bounded by the plan's width, whatever the data.
    tops = {r["part"]: r["top"] for r in ranged(rows.select("key", "tie")).groupBy("part").agg(F.max(F.struct("key", "tie")).alias("top")).collect()}
    filled = sorted(tops)
    follows = [(p, *tops[filled[(i + 1) % len(filled)]]) for i, p in enumerate(filled)]
    with_ghosts = ranged(rows).withColumn("ghost", F.lit(0))
    if follows:
        ghost_of = F.broadcast(spark.createDataFrame(follows, "part int, key long, tie long"))
        ghosts = rows.join(ghost_of, ["key", "tie"])
        with_ghosts = with_ghosts.unionByName(ghosts.select("doc_id", "text", "key", "tie", "part", F.lit(1).alias("ghost")))
    return with_ghosts.repartitionById(max(1, parts), F.col("part")).sortWithinPartitions("part", "ghost", F.desc("key"), F.desc("tie")).drop("tie", "key")


def with_successor(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, in which the next document's
    start replaces the last third.

    Input: doc_id and text; other columns are ignored. A null text is empty; a null
    doc_id comes last; rows of equal doc_id follow each other by a hash of their
    text. An only row follows itself. A very long text is one like others, whole. No
    rows give no rows.
    """

    def scored(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        """rows and following: (doc_id, text)."""
        ids = [r[0] for r in rows]
        texts = [r[1] for r in rows]
        edited = []
        for t, n in zip(texts, [*texts[1:], following[1]]):
            m = len(t) // 3
            edited.append((t[: len(t) - m] + n[:m]).encode())
        own = sketches([*(t.encode() for t in texts), following[1].encode()], k, width)
        new = sketches(edited, k, width)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array([encode(s) for s in own[:-1]]),
                pa.array([encode(s) for s in new]),
                pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
                pa.array([distinct(s, k) for s in own[:-1]], pa.float64()),
                pa.array([containment(b, a, k) for a, b in zip(own, new)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "distinct_shingles", "edited_contained"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one part whose successor isn't seen yet
        size, part, closed = 0, None, False
        for b in batches:
            for i, t, p, g in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("part").to_pylist(), b.column("ghost").to_pylist()):
                if p != part:
                    part, closed = p, False
                if closed:  # rows that are equal to the part's successor in their id
                    continue
                row = (i, t.as_py())
                if g:
                    yield scored(held, row)
                    held, size, closed = [], 0, True
                    continue
                if size > A.CHUNK:
                    yield scored(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])

    return _ordered(docs).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, edited_contained double",
    )
