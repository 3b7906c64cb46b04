"""Operator 2: importance resampling for quality.

Two bags of hashed word n-grams are generative models: of the target, learned from
labelled good documents, and of the raw corpus, counted over all documents. A
document's importance is the log ratio of the models on its n-grams, and a sample
without replacement in proportion to importance is the top k of log importance plus
Gumbel noise, which a hash of the doc_id supplies.

A document's log importance is the sum over its n-grams, which is the ratio of the
models' likelihoods of the whole text. Counts are summed in each task into one array of
fixed size before they are shuffled; the k-th largest key is found by refining a
histogram, so that keys are never sorted or gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _arrow as A
from ._spark import durable

BUCKETS = 1 << 14
#: Labelled good documents that the target model reads at most, by a hash of doc_id.
TARGETS = 4000
#: The log importance of a text without n-grams, which puts it last.
LAST = -1e9
SHARE = 0.85
SEED = 11

_kind = np.full(256, 2, np.uint8)
_kind[[0x20, 9, 10, 11, 12, 13]] = 0
_kind[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1
_BYTES = A.fold_table(np.ones(256, bool))


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the 1- and 2-grams of words and of runs of punctuation."""
    kind = _kind[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[at] = True
    cuts = np.flatnonzero(change)
    full = kind[cuts[:-1]] != 0
    starts, ends = cuts[:-1][full], cuts[1:][full]
    h = A.span_hashes(data, starts, ends, _BYTES)
    doc = np.searchsorted(at, starts, "right") - 1
    pair = A.mix(h[:-1] * A.U64(3) + h[1:])[doc[:-1] == doc[1:]] if len(h) else h
    both = np.concatenate([h, pair])
    docs = np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]]]) if len(h) else doc
    return (both >> A.U64(50)).astype(np.int64), docs


def _counted(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target): counts over all documents and over those with ``_target``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            data, at = A.utf8(b.column("text"))
            chosen = b.column("_target").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in A.chunks(at):
                bucket, doc = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[chosen[i:j][doc]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], names=["bucket", "raw", "target"])

    parts = docs.select("text", "_target").mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(docs: DataFrame, labels: DataFrame, targets: int = TARGETS) -> np.ndarray:
    """log p_target - log p_raw of every bucket; zeros if nothing is labelled good."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(targets).withColumn("_target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left").withColumn("_target", F.coalesce("_target", F.lit(False)))
    counts = np.zeros((2, BUCKETS))
    for r in _counted(marked).collect():  # BUCKETS rows at most
        counts[:, r["bucket"]] = r["raw"], r["target"]
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    # A target bucket leans on the raw model where it has little text.
    raw = (counts[0] + 0.5) / (counts[0].sum() + 0.5 * BUCKETS)
    target = (counts[1] + 50 * BUCKETS / 1000 * raw) / (counts[1].sum() + 50 * BUCKETS / 1000)
    return np.log(target) - np.log(raw)


def scored(docs: DataFrame, w: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key); a document without n-grams has the weight LAST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = A.utf8(b.column("text"))
            for i, j in A.chunks(at):
                bucket, doc = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.bincount(doc, minlength=j - i)
                s = np.bincount(doc, w[bucket], minlength=j - i)
                value = np.where(n > 0, s, LAST)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(n), pa.array(value)], names=["doc_id", "n_grams", "log_weight"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(2**53)
    return out.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024) -> float:
    """The exact k-th largest value of a durable table's column, -inf if there are fewer.

    Each pass counts one histogram and goes on in the bin that holds the rank; values
    are gathered once a bin has ``bins`` rows at most, or is one value.
    """
    lo, hi, n = rows.agg(F.min(column), F.max(column), F.count(column)).head()
    if n < k or k < 1:
        return -math.inf if n < k else math.inf
    inside = rows.select(column)
    while n > bins and lo < hi:
        width = (hi - lo) / bins
        spot = F.least(F.lit(bins - 1), F.floor((F.col(column) - lo) / width)).cast("int")
        found = {r["spot"]: r for r in inside.groupBy(spot.alias("spot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for s in sorted(found, reverse=True):
            if found[s]["n"] >= k:
                break
            k -= found[s]["n"]
        lo, hi, n = found[s]["lo"], found[s]["hi"], found[s]["n"]
        inside = inside.where(F.col(column).between(lo, hi))
    return lo if lo == hi else sorted((r[0] for r in inside.collect()), reverse=True)[k - 1]


def resampled(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept): every document, and whether it is sampled.

    ``share`` of the rows are kept; rows that tie at the threshold all are. Null and
    empty texts are last; a very long text counts whole. A null doc_id is a row like
    others. Repeated rows agree. Without good labels the sample is uniform. Other columns
    are ignored; no rows give no rows.
    """
    rows = durable(scored(docs, weights(docs, labels), seed))
    least = kth_largest(rows, "key", math.ceil(share * rows.count()))
    return rows.withColumn("kept", F.col("key") >= F.lit(least))
