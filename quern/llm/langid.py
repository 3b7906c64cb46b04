"""Operator 9: language identification by a string kernel.

A text is cut into blocks of bytes, and a block is the set of its 1- to 4-grams of
lower-cased letters (the blended spectrum; presence, not counts), hashed. The kernel
of two blocks is the size of their sets' intersection over the geometric mean of
their sizes. Landmark blocks give Nyström features, and ridge regression on them has
one output per language against the rest. As the kernel is an inner product of
presence vectors, landmarks, whitening and regression multiply into one matrix, with
which batches of blocks are scored; a document is the mean of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _arrow as A
from ._spark import durable, small

ORDERS = (1, 2, 3, 4)
SIZE = 4096
BLOCK = 1500
#: Labelled documents per language that training reads at most, none over LONGEST bytes.
PER_LANGUAGE, LONGEST = 300, 200_000
LANDMARKS = 128
RIDGE = 1e-2
UNKNOWN = "und"
_FOLD = A.LETTERS.copy()
_FOLD[(_FOLD == 0)] = 32
_FOLD[48:58] = 32


def blocks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(presence matrix, document) of all blocks of the documents at ``at``."""
    n = at[1:] - at[:-1]
    count = -(-n // BLOCK)
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    out = np.zeros((first[-1], SIZE), np.float32)
    if not len(out):
        return out, np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(data)) - at[:-1][doc]
    row = (first[:-1][doc] + place // BLOCK) * SIZE
    left = n[doc] - place
    x = _FOLD[data].astype(np.uint32)
    code = np.zeros(len(data), np.uint32)
    flat = out.reshape(-1)
    for k in range(max(ORDERS)):
        code[: len(data) - k] |= x[k:] << np.uint32(8 * k)
        if k + 1 in ORDERS:
            ok = left > k
            h = (code[ok] * np.uint32(0x9E3779B1) ^ np.uint32(k * 0x632BE59B & 0xFFFFFFFF)) * np.uint32(0x85EBCA77)
            flat[row[ok] + (h >> np.uint32(20)).astype(np.int64)] = 1
    out /= np.sqrt(out.sum(axis=1, keepdims=True))
    return out, np.repeat(np.arange(len(n)), count)


class Model:
    """languages, and the matrix that scores presence vectors."""

    def __init__(self, languages: list[str], matrix: np.ndarray, bias: np.ndarray):
        self.languages, self.matrix, self.bias = languages, matrix, bias

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each document's mean score per language; zeros without bytes."""
        total = np.zeros((len(at) - 1, len(self.languages)), np.float64)
        n = np.zeros(len(at) - 1)
        for i, j in A.chunks(at, 400_000):
            lo = at[i]
            # A very long document is taken in whole blocks, a part at a time.
            step = BLOCK * 256
            for s in range(0, max(1, int(at[j] - lo)), step) if j == i + 1 else [0]:
                part = at[i : j + 1] - lo if j > i + 1 else np.array([0, min(step, int(at[j] - lo) - s)])
                x, doc = blocks(data[lo + s : lo + s + part[-1]], part)
                np.add.at(total, i + doc, x @ self.matrix + self.bias)
                n += np.bincount(i + doc, minlength=len(n))
        return total / np.maximum(n, 1)[:, None]


def fit(texts: list[bytes], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    names = sorted(set(languages))
    data, at = A.joined(texts)
    x, doc = blocks(data, at)
    y = np.array([names.index(v) for v in languages])[doc]
    # The same number of landmarks from each language, evenly over its blocks.
    picks = []
    for c in range(len(names)):
        own = np.flatnonzero(y == c)
        picks.append(own[np.unique(np.linspace(0, len(own) - 1, max(1, landmarks // len(names))).astype(int))] if len(own) else own)
    marks = x[np.concatenate(picks)]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = x @ (marks.T @ whiten).astype(np.float32)
    z = np.column_stack([z, np.ones(len(z))]).astype(np.float64)
    w = (1 / np.maximum(1, np.bincount(y, minlength=len(names))))[y] * len(y) / len(names)
    targets = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    penalty = ridge * len(y) / z.shape[1] * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    coef = np.linalg.solve(z.T @ (z * w[:, None]) + penalty, z.T @ (targets * w[:, None]))
    return Model(names, (marks.T @ (whiten @ coef[:-1])).astype(np.float32), coef[-1])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of at most ``per_language`` labelled documents a language, chosen by hash.

    Ids are chosen on narrow rows: of each language those with small hashes, about four
    times as many as are wanted, meet to be ranked, however many there are; texts are
    fetched by a broadcast of the ids. Texts over LONGEST bytes aren't learned from. A
    doc_id with several languages is an example of each; of several texts of one id and
    language that with the smallest hash is learned from, so that no more rows reach the
    driver, however often an id repeats.
    """
    able = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (F.octet_length("text") <= LONGEST))
    able = able.withColumn("th", F.xxhash64("text"))
    slim = durable(able.groupBy("lang", "doc_id").agg(F.min("th").alias("th")).withColumn("h", F.xxhash64("doc_id")))
    counts = small(durable(slim.groupBy("lang").agg(F.count("*").alias("n"))))  # joined where rows are, not by language
    below = (F.shiftrightunsigned("h", 11) / float(2**53)) * F.col("n") < 4 * per_language
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = slim.join(counts, "lang").where(below).withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language).select("lang", "doc_id", "th")
    found = able.join(small(durable(ids)), ["doc_id", "lang", "th"]).select("doc_id", "lang", "text").distinct()
    rows = sorted((r["doc_id"], r["lang"], r["text"]) for r in found.collect())
    return fit([t.encode() for _, _, t in rows], [v for _, v, _ in rows]) if rows else None


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), from a given model or one trained on ``docs``.

    A null text, and one without a letter, is ``und`` with score 0, and so is every
    text if nothing could be learned. A null doc_id is scored but never learned from.
    Repeated rows agree; a very long text is scored whole, block by block; no rows give
    no rows; columns beyond doc_id, text and lang are ignored.
    """
    model = model or trained(docs)
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letters"))
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = np.array([*model.languages, UNKNOWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = model.scores(*A.utf8(b.column("text")))
            p = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
            p /= p.sum(axis=1, keepdims=True)
            known = b.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(known, p.argmax(axis=1), len(names) - 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(known, p.max(axis=1), 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
