"""Operator 13: exact k-means by filtering metric trees.

Every batch of a partition becomes a ball tree: a node knows its centre, radius, count
and integer sum of vectors. In a round the trees meet all centroids. By the triangle
inequality a ball whose nearest centroid leads by more than its diameter goes to it
whole, as a count and a sum; other balls are opened, down to leaves, whose vectors are
compared exactly. Trees are built once and kept in the shared folder; a round sends one
row per centroid and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import durable

DIM = 64
SCALE = 256
CLUSTERS, ROUNDS = 40, 5
#: Vectors of a leaf.
LEAF = 32
#: Components are held within this, so that squared distances fit 64 bits.
WIDEST = 1 << 27
#: Up to this size products of components are exact in doubles.
_DOUBLE = 1 << 22


def quantised(embeddings: DataFrame, column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): integer components of the vectors that have ``dim`` finite ones."""
    x = F.col(column)
    whole = F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False)))
    part = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(float(WIDEST))), F.lit(-float(WIDEST)))).cast("int")
    return embeddings.where((F.size(x) == dim) & whole).select("vec_id", F.transform(x, part).alias("q"))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c; both int64."""
    small = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _DOUBLE
    a, b = (x.astype(np.float64), c.astype(np.float64)) if small else (x, c)
    out = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    return out.astype(np.int64)


class Tree:
    """A ball tree: vectors in the order of its leaves, and for each node the range of them."""

    def __init__(self, order, points, lo, hi, child, centre, radius, sums):
        self.order, self.points, self.lo, self.hi = order, points, lo, hi
        self.child, self.centre, self.radius, self.sums = child, centre, radius, sums

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        """Balls are halved across the line of two far points, until a leaf or equal vectors are left."""
        order = np.arange(len(points))
        lo, hi, child, centre, radius, sums = [0], [len(points)], [], [], [], []
        i = 0
        while i < len(lo):
            own = order[lo[i] : hi[i]]
            x = points[own].astype(np.float64)
            middle = x.mean(axis=0)
            off = ((x - middle) ** 2).sum(axis=1)
            same = bool((points[own] == points[own[0]]).all())
            sums.append(points[own].sum(axis=0))
            centre.append(x[0] if same else middle)
            radius.append(0.0 if same else float(np.sqrt(off.max())))
            if same or len(own) <= leaf:
                child.append(-1)
            else:
                a = x[off.argmax()]
                b = x[((x - a) ** 2).sum(axis=1).argmax()]
                half = len(own) // 2
                order[lo[i] : hi[i]] = own[np.argsort(x @ (b - a), kind="stable")]
                child.append(len(lo))
                lo += [lo[i], lo[i] + half]
                hi += [lo[i] + half, hi[i]]
            i += 1
        at = lambda v: np.array(v, np.int64)
        return cls(order, points[order], at(lo), at(hi), at(child), np.array(centre), np.array(radius), np.array(sums, np.int64))

    def nearest(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
        """([(node, cluster)] of whole balls, places of other vectors, their clusters); ties go to the smaller number."""
        c = centroids.astype(np.float64)
        slack = 1e-6 * (1 + np.sqrt(max((c * c).sum(axis=1).max(), (self.centre**2).sum(axis=1).max())))
        balls, places = [], []
        nodes = np.zeros(1, np.int64)
        while len(nodes):
            m, r = self.centre[nodes], self.radius[nodes]
            d = np.sqrt(np.maximum((m * m).sum(axis=1)[:, None] - 2 * (m @ c.T) + (c * c).sum(axis=1), 0))
            reach = d.min(axis=1) + 2 * r * (1 + 1e-9) + 2 * slack
            alone = (d <= reach[:, None]).sum(axis=1) == 1
            balls += zip(nodes[alone].tolist(), d[alone].argmin(axis=1).tolist())
            rest = nodes[~alone]
            equal = rest[self.radius[rest] == 0]  # one vector, however often: exact, once
            if len(equal):
                balls += zip(equal.tolist(), squares(self.points[self.lo[equal]], centroids).argmin(axis=1).tolist())
            rest = rest[self.radius[rest] > 0]
            leaf = self.child[rest] < 0
            places += [np.arange(self.lo[i], self.hi[i]) for i in rest[leaf]]
            nodes = np.concatenate([self.child[rest[~leaf]], self.child[rest[~leaf]] + 1])
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        return balls, at, squares(self.points[at], centroids).argmin(axis=1) if len(at) else at


_TREE = "ids array<long>, points binary, lo binary, hi binary, child binary, centre binary, radius binary, sums binary"
_KINDS = {"points": np.int32, "lo": np.int64, "hi": np.int64, "child": np.int64, "centre": np.float64, "radius": np.float64, "sums": np.int64}


def forest(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """One row per tree, a tree per Arrow batch of (vec_id, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            t = Tree.build(b.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim))
            ids = b.column("vec_id").cast(pa.int64()).take(pa.array(t.order))
            cols = [pa.array([ids.to_pylist()], pa.list_(pa.int64()))]
            cols += [pa.array([getattr(t, k).astype(kind).tobytes()], pa.binary()) for k, kind in _KINDS.items()]
            yield pa.RecordBatch.from_arrays(cols, names=["ids", *_KINDS])

    return vectors.mapInArrow(run, _TREE)


def _trees(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        raw = {k: np.frombuffer(batch.column(k)[i].as_py(), kind) for k, kind in _KINDS.items()}
        shaped = {k: v.reshape(-1, dim) if k in ("points", "centre", "sums") else v for k, v in raw.items()}
        shaped["points"] = shaped["points"].astype(np.int64)
        yield batch.column("ids")[i].values, Tree(None, **shaped)


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; empty ones stay."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            for _, t in _trees(b, dim):
                balls, at, cluster = t.nearest(centroids)
                for node, j in balls:
                    n[j] += t.hi[node] - t.lo[node]
                    sums[j] += t.sums[node]
                n += np.bincount(cluster, minlength=k)
                np.add.at(sums, cluster, t.points[at])
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster long, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("i", "s"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out = [list(map(int, c)) for c in centroids]
    for r in parts.groupBy("cluster", "i").agg(exact("n"), exact("s")).collect():  # centroids times components
        out[r["cluster"]][r["i"]] = int(r["s"]) // int(r["n"])
    return np.array(out, np.int64).reshape(k, dim)


def _seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash of their id; equal ids by their components, ids that are null last."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["q"] for r in vectors.orderBy(F.asc_nulls_last(by), "q").limit(k).collect()], np.int64)


def clustered(embeddings: DataFrame, column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    Input: vec_id and ``column``, an array of numbers; other columns are ignored. Null,
    short and long vectors and those with a component that is null or not finite are left
    out; components beyond 2**27 in size after scaling count as that. A null vec_id is
    kept. Repeated rows are vectors of their own; ties go to the smaller number. Fewer
    than k vectors make as many centroids; no vectors, no rows.
    """
    vectors = quantised(embeddings.select("vec_id", column), column, dim, scale)
    centroids = _seeds(vectors, k, seed)
    trees = durable(forest(vectors, dim))
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, t in _trees(b, dim):
                balls, at, own = t.nearest(centroids)
                cluster = np.zeros(len(t.points), np.int64)
                for node, j in balls:
                    cluster[t.lo[node] : t.hi[node]] = j
                cluster[at] = own
                distance = ((t.points - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    rows = durable(trees.mapInArrow(run, "vec_id long, cluster int, distance long"))
    return _with_sums(rows, centroids)


def _with_sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    names: Column = F.array(*[F.lit(",".join(map(str, c.tolist()))) for c in centroids]) if len(centroids) else F.array().cast("array<string>")
    per = per.select("cluster", "cluster_inertia", F.sha2(F.get(names, F.col("cluster")), 256).alias("centroid_sha256"))
    every = per.agg(F.sum("cluster_inertia").alias("inertia"))  # a row a cluster
    return rows.join(F.broadcast(per.join(F.broadcast(every))), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The rounds written out."""
    near = lambda c: f"SELECT v.id, v.vec_id, v.q, arg_min(c.k, struct_pack(d := list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))), k := c.k)) AS k FROM v, {c} c GROUP BY ALL"
    parts = [
        f"""WITH v AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < {k})"""
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS ({near(f'c{i}')})")
        parts.append(f"s{i} AS (SELECT k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {DIM + 1}) t(i) GROUP BY k, i)")
        parts.append(f"m{i} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{i} GROUP BY k)")
        parts.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    parts.append(f"a AS ({near(f'c{rounds}')})")
    parts.append(f"d AS (SELECT a.vec_id, a.k, list_sum(list_transform(range(1, {DIM + 1}), lambda i: (a.q[i] - c.q[i]) * (a.q[i] - c.q[i])))::BIGINT AS distance, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.k = a.k)")
    return ",\n".join(parts) + "\nSELECT vec_id, k::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d"


ORACLE = _oracle()
