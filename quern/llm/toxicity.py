"""Operator 5: toxicity by a convolutional network over hashed word embeddings.

A word's embedding is the sum of rows of one table: two for the word, chosen by two
hashes, so that a word is mistaken for another only if both collide, and two for each
proper prefix of some lengths, so that a stem is known with any ending. Filters of one,
two and three words pass over a document, each keeps its largest response (max
pooling), and a logistic unit reads these. It is trained in numpy, by Adam, on shards
of all labelled rows, whose parameters are averaged; the table starts from each
bucket's association with the label. For scoring, the table is multiplied with the filters once, so that a
document costs additions of table rows and a running maximum. The rows are summed once
for each distinct word of a batch.

The threshold is calibrated on rows kept from training: scores are shifted so that it
is THRESHOLD for all, and each language's own threshold is reported beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.order import numbered

from . import _arrow as A
from ._spark import bits, durable

BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Bytes of the prefixes.
PREFIXES = (5, 6, 7, 8)
THRESHOLD = 0.7
#: Labelled rows that are trained together, about; characters of an example.
SHARD, LONGEST = 2000, 100_000
EPOCHS, RATE, BATCH, DECAY = 6, 0.01, 32, 1e-4


def vocabulary(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the table, (distinct words, 2 + 2 * prefixes); each word's number among these; first).

    Words are runs of letters and digits. One that isn't longer than a prefix has the last
    row there, which stays zero.
    """
    starts, ends, first = A.words(data, at, A.LETTERS)
    h = A.span_hashes(data, starts, ends, A.LETTERS)
    where, code = A.distinct(h)
    h, size = h[where], (ends - starts)[where]
    heads, places = A.gathered(data, starts[where], np.minimum(size, max(PREFIXES)))
    out = np.full((len(where), 2 + 2 * len(PREFIXES)), BUCKETS, np.int32)
    for k, n in enumerate((0, *PREFIXES)):
        some = np.flatnonzero(size > n)
        own = A.mix(A.span_hashes(heads, places[some], places[some] + n, A.LETTERS) + A.U64(n)) if n else h
        out[some, 2 * k] = (own >> A.U64(47)).astype(np.int32)
        out[some, 2 * k + 1] = (own & A.U64(BUCKETS - 1)).astype(np.int32)
    return out, code, first


def word_ids(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the table, (words, 2 + 2 * prefixes); first)."""
    rows, code, first = vocabulary(data, at)
    return rows[code], first


class Net:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.02, (BUCKETS + 1, DIMS)).astype(np.float32), "v": r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, 0.3, (w * DIMS, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["E"][BUCKETS] = 0
        # One filter of single words reads the association that the table starts with.
        self.p["W1"][:, 0] = 0
        self.p["W1"][0, 0] = 1
        self.p["v"][0] = 1
        self.scale, self.shift = 1.0, 0.0

    def start(self, ids: np.ndarray, first: np.ndarray, y: np.ndarray) -> None:
        """The table's first column: how far a bucket's documents are more often toxic than expected."""
        n, k = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for d in range(len(y)):
            own = A.unique(ids[first[d] : first[d + 1]].reshape(-1))
            n[own] += 1
            k[own] += y[d]
        self.associate(n, k, max(1e-6, y.mean()))

    def associate(self, n: np.ndarray, k: np.ndarray, share: float) -> None:
        self.p["E"][:, 0] = np.clip((k - share * n) / np.sqrt(share * n + 1) / 4, -0.5, 1)
        self.p["E"][BUCKETS] = 0

    def forward(self, ids: np.ndarray, first: np.ndarray, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, pooled, positions): positions are of the largest responses, -1 if none is positive.

        ids: the rows of each word or, with ``words``, of each distinct one, whose number words has.
        """
        e = sum(np.take(self.p["E"], ids[:, c], axis=0) for c in range(ids.shape[1]))
        e = e if words is None else e[words]
        n = len(first) - 1
        pooled, spots = np.zeros((n, len(WIDTHS) * FILTERS), np.float32), np.full((n, len(WIDTHS) * FILTERS), -1)
        for k, w in enumerate(WIDTHS):
            full = np.flatnonzero(np.diff(first) >= w)
            if not len(full):
                continue
            x = np.concatenate([e[i : len(e) - w + 1 + i] for i in range(w)], axis=1)
            r = x @ self.p[f"W{w}"] + self.p[f"b{w}"]
            top = np.array([s + r[s:t].argmax(axis=0) for s, t in zip(first[full].tolist(), (first[full + 1] - w + 1).tolist())])
            value = r[top, np.arange(FILTERS)]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            pooled[full, cols] = np.maximum(value, 0)
            spots[full, cols] = np.where(value > 0, top, -1)
        return pooled @ self.p["v"] + self.p["c"][0], pooled, spots

    def gradients(self, ids, first, y, weight, words=None) -> dict:
        z, pooled, spots = self.forward(ids, first, words)
        of = lambda at: ids[at if words is None else words[at]]
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        g = {"v": pooled.T @ dz, "c": np.array([dz.sum()], np.float32)}
        dp = dz[:, None] * self.p["v"]
        rows, values = [], []
        for k, w in enumerate(WIDTHS):
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            d, f = np.nonzero(spots[:, cols] >= 0)
            at, by = spots[:, cols][d, f], dp[:, cols][d, f]
            x = np.concatenate([self.p["E"][of(at + i)].sum(axis=1) for i in range(w)], axis=1)
            gw = np.zeros_like(self.p[f"W{w}"])
            np.add.at(gw.T, f, x * by[:, None])
            g[f"W{w}"], g[f"b{w}"] = gw, np.bincount(f, by, minlength=FILTERS).astype(np.float32)
            back = self.p[f"W{w}"].T[f] * by[:, None]
            for i in range(w):
                part = back[:, i * DIMS : (i + 1) * DIMS]
                rows.append(of(at + i).reshape(-1))
                values.append(np.repeat(part, ids.shape[1], axis=0))
        rows = np.concatenate(rows)
        some, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(some), DIMS), np.float32)
        np.add.at(total.reshape(-1), (inverse[:, None] * DIMS + np.arange(DIMS)).reshape(-1), np.concatenate(values).reshape(-1))
        total[some == BUCKETS] = 0
        g["E"] = (some, total)
        return g

    def train(self, ids, code, first, y, epochs: int = EPOCHS, seed: int = 5) -> None:
        """ids, code, first: a vocabulary. A batch sums the table's rows once for each of its distinct words."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        pos = max(1, y.sum())
        weight = np.where(y > 0, np.sqrt(max(1, len(y) - y.sum()) / pos), 1.0)
        step, seen, number = 0, np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                pick = np.concatenate([np.arange(first[d], first[d + 1]) for d in some]).astype(np.int64)
                own = np.concatenate([[0], np.cumsum(first[some + 1] - first[some])])
                pick = code[pick]
                seen[pick] = True
                used = np.flatnonzero(seen)
                seen[used], number[used] = False, np.arange(len(used))
                step += 1
                for k, g in self.gradients(ids[used], own, y[some], weight[some], number[pick]).items():
                    rows, g = g if k == "E" else (slice(None), g)
                    g = g + DECAY * self.p[k][rows]
                    m[k][rows] = 0.9 * m[k][rows] + 0.1 * g
                    s[k][rows] = 0.99 * s[k][rows] + 0.01 * g * g
                    self.p[k][rows] -= RATE * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(s[k][rows] / (1 - 0.99**step)) + 1e-6)

    def tables(self) -> dict:
        """For each width and place the table times its part of the filters."""
        return {(w, i): self.p["E"] @ self.p[f"W{w}"][i * DIMS : (i + 1) * DIMS] for w in WIDTHS for i in range(w)}

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _tops(net: Net, tables: dict, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, widths * filters): the largest response of each filter, -inf without a window."""
    ids, code, first = vocabulary(data, at)
    out = np.full((len(at) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    for k, w in enumerate(WIDTHS):
        full = np.flatnonzero(np.diff(first) >= w)
        if not len(full):
            continue
        m = len(code) - w + 1
        r = np.zeros((m, FILTERS), np.float32)
        for i in range(w):
            own = sum(np.take(tables[w, i], ids[:, c], axis=0) for c in range(ids.shape[1]))
            r += np.take(own, code[i : m + i], axis=0)
        # Windows that cross into the next document lie outside each [first, last].
        bounds = np.column_stack([first[full], first[full + 1] - w + 1]).reshape(-1)
        inner = bounds[:-1] if bounds[-1] >= m else bounds
        out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(r, inner, axis=0)[::2]
    return out


def _segments(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A text in parts of about ``limit`` bytes that end between words and share enough words for every window.

    Only a word of more than ``limit`` bytes is cut.
    """
    letter = A.LETTERS[data] != 0
    s = 0
    while s < len(data):
        e = s + limit
        if e >= len(data):
            yield data[s:]
            return
        gap = np.flatnonzero(~letter[e : e + limit])
        e = e + int(gap[0]) if len(gap) else min(len(data), e + limit)
        part = data[s:e]
        yield part
        starts, _, _ = A.words(part, np.array([0, len(part)]), A.LETTERS)
        back = max(WIDTHS) - 1
        s = max(s + int(starts[-back]) if len(starts) > back else e, s + 1) if e < len(data) else e


def scores(net: Net, tables: dict, data: np.ndarray, at: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """Calibrated scores of documents, as ``logits`` finds them."""
    return net.calibrated(logits(net, tables, data, at, limit))


def logits(net: Net, tables: dict, data: np.ndarray, at: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """What the last unit says of documents, by sums of table rows; a text over ``limit`` bytes a part at a time."""
    tops = np.full((len(at) - 1, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    for i, j in A.chunks(at, limit):
        if j == i + 1 and at[j] - at[i] > limit:
            for part in _segments(data[at[i] : at[j]], limit):
                tops[i] = np.maximum(tops[i], _tops(net, tables, part, np.array([0, len(part)]))[0])
        else:
            tops[i:j] = _tops(net, tables, data[at[i] : at[j]], at[i : j + 1] - at[i])
    bias = np.concatenate([net.p[f"b{w}"] for w in WIDTHS])
    # A sum for each row, not a matrix product, whose rounding depends on the rows beside.
    return net.p["c"][0] + (np.maximum(tops + bias, 0) * net.p["v"]).sum(axis=1)


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Halfway between the neighbouring scores where F1 is largest."""
    if not y.any() or y.all():
        return THRESHOLD
    order = np.argsort(-score)
    s, hits = score[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    k = int(f1.argmax())
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else s[k])) / 2)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, text, lang, toxic, aside): all labelled rows outside the fold, a fifth of them aside.

    A doc_id with both labels is no example. Of several texts of one id that with the
    smallest hash is learned from. A text over LONGEST characters is an example for each
    LONGEST of them.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_m")).where("toxic = _m").drop("_m")
    known = durable(known)
    key = F.xxhash64(F.col("doc_id").cast("long")).alias("h")
    among = docs.sparkSession.sparkContext.broadcast(bits(known.select(key), "h"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(among.value.has(b.column("h").to_numpy()))).select(["doc_id", "text", "lang"])

    # Texts without a label stay where they are read; the join is exact.
    some = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("doc_id", "text", "lang", key)
    texts = some.mapInArrow(labelled, some.drop("h").schema).join(known, "doc_id")
    one = texts.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), "lang")).alias("r")).select("doc_id", "toxic", "r.*")
    part = F.explode(F.sequence(F.lit(0), F.call_function("div", F.greatest(F.length("text") - 1, F.lit(0)), F.lit(LONGEST)).cast("int")))
    parts = one.withColumn("part", part).withColumn("text", F.substring(F.col("text"), F.col("part") * LONGEST + 1, F.lit(LONGEST)))
    return parts.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 4)


def _associated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many examples, and toxic ones, each bucket is in."""
    n, k = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for b in batches:
        ids, code, first = vocabulary(*A.utf8(b.column("text")))
        for d, y in enumerate(b.column("toxic").to_pylist()):
            own = A.unique(ids[A.unique(code[first[d] : first[d + 1]])].reshape(-1))
            n[own] += 1
            k[own] += y
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(k[at])], names=["bucket", "n", "k"])


#: Parameters are averaged as whole numbers of this part, so that no order of adding matters.
_STEP = 2.0**-32


def _flat(p: dict) -> np.ndarray:
    """All parameters as rows of DIMS = FILTERS numbers, the table first."""
    rest = np.concatenate([p[k].reshape(-1) for k in sorted(p) if k != "E"])
    return np.concatenate([p["E"].reshape(-1), rest, np.zeros(-len(rest) % DIMS, np.float32)]).reshape(-1, DIMS)


def _unflat(p: dict, flat: np.ndarray) -> None:
    p["E"], rest, s = flat[: BUCKETS + 1].astype(np.float32), flat[BUCKETS + 1 :].reshape(-1).astype(np.float32), 0
    for k in sorted(p):
        if k != "E":
            p[k] = rest[s : s + p[k].size].reshape(p[k].shape)
            s += p[k].size


def _thresholds(z: DataFrame, by: str) -> dict:
    """For each ``by`` the neighbouring logits between which F1 is largest, None without both labels; z: doc_id, part, z, hit."""
    order = (F.asc(by), F.desc("z"), F.asc("doc_id"), F.asc("part"))
    placed = numbered(numbered(z, *order), *order, name="hits", flag="hit")
    size = placed.groupBy(by).agg(F.min("place").alias("_p"), F.min("hits").alias("_h"), F.sum(F.col("hit").cast("long")).alias("pos"), F.count("*").alias("n"))
    j = placed.join(F.broadcast(size), by).withColumn("r", F.col("place") - F.col("_p"))  # a row for each language
    f1 = 2 * (F.col("hits") - F.col("_h") + F.col("hit").cast("long")) / (F.col("r") + 1 + F.col("pos"))
    best = j.groupBy(by).agg(F.max_by("r", F.struct(f1, -F.col("r"))).alias("best"), F.first("pos").alias("pos_"), F.first("n").alias("n_"))
    ends = j.join(F.broadcast(best), by).where("r = best OR r = best + 1").groupBy(by).agg(F.max("z").alias("a"), F.min("z").alias("b"), F.first("pos").alias("pos"), F.first("n").alias("n")).collect()
    return {e[by]: (e["a"], e["b"]) if 0 < e["pos"] < e["n"] else None for e in ends}


def trained(docs: DataFrame, labels: DataFrame, seed: int = 5) -> tuple[Net, dict[str, float]] | None:
    """A net and thresholds from all labelled rows outside the fold; None without both labels.

    Words' associations are counted over all examples that aren't aside. Shards of about
    SHARD of them start from these and are trained apart, and their parameters are
    averaged, a row of the table over the shards that changed it. Thresholds are found
    over all rows aside. Only parameters, whose number is fixed, reach the driver.
    """
    rows = durable(_examples(docs, labels))
    count = {(r["aside"], r["toxic"]): r["n"] for r in rows.groupBy("aside", "toxic").agg(F.count("*").alias("n")).collect()}
    if not all(count.get((True, y), 0) + count.get((False, y), 0) for y in (0, 1)):
        return None
    used = rows.where("NOT aside")
    many = sum(n for (aside, _), n in count.items() if not aside)
    net, share = Net(seed), max(1e-6, count.get((False, 1), 0) / max(1, many))
    n, k = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for r in used.mapInArrow(_associated, "bucket long, n long, k long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():  # a row for each bucket
        n[r["bucket"]], k[r["bucket"]] = r["n"], r["k"]
    net.associate(n, k, share)
    shards = max(1, -(-many // SHARD))
    start = docs.sparkSession.sparkContext.broadcast(net)

    def train(shard: pa.Table) -> pa.Table:
        own = Net(seed)
        own.p = {k: v.copy() for k, v in start.value.p.items()}
        shard = shard.sort_by([("doc_id", "ascending"), ("part", "ascending")])
        own.train(*vocabulary(*A.utf8(shard.column("text"))), shard.column("toxic").to_numpy().astype(np.float64))
        flat = _flat(own.p)
        at = np.flatnonzero((flat != _flat(start.value.p)).any(axis=1) | (np.arange(len(flat)) > BUCKETS))
        return pa.table([pa.array(at)] + [pa.array(np.rint(flat[at, i].astype(np.float64) / _STEP).astype(np.int64)) for i in range(DIMS)], names=["at", *[f"v{i}" for i in range(DIMS)]])

    kind = "at long, " + ", ".join(f"v{i} long" for i in range(DIMS))
    dealt = used.select("doc_id", "part", "text", "toxic", F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).alias("shard")).repartition(min(shards, 10_000), "shard")
    mean = dealt.groupBy("shard").applyInArrow(train, kind).groupBy("at").agg(*[(F.sum(f"v{i}") / F.count("*") * _STEP).alias(f"v{i}") for i in range(DIMS)])
    flat = _flat(net.p).astype(np.float64)
    found = np.array([tuple(r) for r in mean.collect()]).reshape(-1, DIMS + 1)  # a row for each of the table's and the filters'
    flat[found[:, 0].astype(np.int64)] = found[:, 1:]
    _unflat(net.p, flat)

    judge = rows.where("aside") if count.get((True, 0)) and count.get((True, 1)) else rows
    model = docs.sparkSession.sparkContext.broadcast((net, net.tables()))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = logits(*model.value, *A.utf8(b.column("text"))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("lang"), pa.array(b.column("toxic").to_numpy() > 0), pa.array(z)], names=["doc_id", "part", "lang", "hit", "z"])

    z = durable(judge.select(F.col("doc_id").cast("long"), "part", "lang", F.col("toxic").cast("int"), "text").mapInArrow(judged, "doc_id long, part int, lang string, hit boolean, z double").withColumn("whole", F.lit("")))
    a, b = _thresholds(z, "whole")[""]
    spread = max(0.25, float(z.agg(F.stddev_pop("z")).first()[0]))
    net.scale = 2.0 / spread
    net.shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - net.scale * (a + b) / 2)
    by = {name: float(net.calibrated(np.array(ends)).mean()) if ends else THRESHOLD for name, ends in _thresholds(z.where("lang IS NOT NULL"), "lang").items()}
    return net, by


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, by_language): every document of ``docs``.

    predicted is 1 from THRESHOLD on; by_language applies the threshold of the row's
    lang, or THRESHOLD if that is null or unknown, to the same score. Null and empty
    texts have the score of no words. Without examples of both labels all scores are 0.
    Null doc_ids are scored, never learned from. A very long text is scored whole.
    Repeated rows agree; no rows give none; other columns are ignored.
    """
    learned = trained(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), "text", "lang", held_out().alias("held_out"))
    if learned is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0).alias("by_language"))
    net, by = learned
    model = docs.sparkSession.sparkContext.broadcast((net, net.tables()))  # some MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = model.value
        for b in batches:
            s = scores(net, tables, *A.utf8(b.column("text"))).astype(np.float64)
            own = np.array([by.get(v, THRESHOLD) for v in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array((s >= own).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted", "by_language"],
            )

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, by_language int")
