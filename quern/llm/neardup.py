"""Operator 6: near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's signature has one b-bit value per slot. Two signatures are within the
distance if at most ``limit`` slots differ. The slots are split into chunks of four;
by pigeonhole, of two signatures within ``chunks * 2 - 1`` some chunk differs in at
most one slot, so that they share one of the keys made by leaving out each slot of
each chunk in turn. Every pair within the distance therefore shares a key: candidates
are found by equality alone. ``shape`` chooses the number of chunks so that a pair at
the similarity itself is within the distance but for one in a million.

Equal sets are one class from the start. Links are confirmed on full shingle sets, and
pairs are never emitted for it. First a key's members within the distance of its hub, the
member that shares most keys with others, are compared with it; what a hub links is one
component. Members of keys that still have several components are narrowed: with shingles
ordered from the rarest among them, two sets as similar as that share one of their first
n - ceil(similarity * n) + 1. Pages of one template that differ enough share none, so a
group of them ends here, whatever its size. The others are compared hub by hub, in blocks
of bounded size, by products of the blocks' membership matrices, of which a task returns
a spanning forest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import components

from . import _arrow as A
from ._spark import durable, shuffle_partitions, small

#: Slots in a chunk, of which one may differ.
CHUNK = 4
#: Members of a block; a task compares two blocks. Their sets are multiplied in slices of COLUMNS.
BLOCK, COLUMNS = 128, 4096


def shape(similarity: float, miss: float = 1e-6) -> int:
    """Chunks for which a pair at ``similarity`` is missed with probability ``miss`` at most."""
    p = 1 - similarity
    for m in range(2, 64):
        k, limit = CHUNK * m, 2 * m - 1
        if sum(math.comb(k, x) * p**x * (1 - p) ** (k - x) for x in range(limit + 1, k + 1)) <= miss:
            return m
    raise ValueError("similarity is too low for this signature")


def signatures(values: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """16-bit MinHash values, (documents, slots); zeros for an empty set."""
    out = np.zeros((len(first) - 1, slots), np.uint16)
    full = np.flatnonzero(first[1:] > first[:-1])
    if not len(full):
        return out
    seeds = A.mix(np.arange(1, 2 * slots + 1, dtype=A.U64) * A.U64(0x9E3779B97F4A7C15))
    starts = first[:-1][full]
    for j in range(slots):
        v = (values ^ seeds[2 * j]) * (seeds[2 * j + 1] | A.U64(1))
        out[full, j] = (A.mix(np.minimum.reduceat(v, starts)) >> A.U64(48)).astype(np.uint16)
    return out


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = A.utf8(texts)
    for i, j in A.chunks(at):
        h, first = A.word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i])
        yield i, j, *A.unique_sets(*A.shingles(h, first, width))


def signed(docs: DataFrame, width: int, slots: int) -> DataFrame:
    """(doc_id, n, h1, h2, sig): size, 128-bit hash and signature of each shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for i, j, values, first in _sets(b.column("text"), width):
                raw, at = values.tobytes(), (8 * first).tolist()
                hashes = np.frombuffer(b"".join(hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(at, at[1:])), np.int64).reshape(-1, 2)
                sig = signatures(values, first, slots)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(np.diff(first)), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _keys(classes: DataFrame, slots: int) -> DataFrame:
    """(key, id): each signature's chunks with one slot left out."""
    seeds = A.mix(np.arange(1, slots + 1, dtype=A.U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            data, _ = A.utf8(b.column("sig"))
            sig = data.view(np.uint16).reshape(len(ids), slots)
            terms = A.mix((sig.astype(A.U64) + A.U64(1)) * seeds | A.U64(1) << A.U64(63))
            sums = terms.reshape(len(ids), slots // CHUNK, CHUNK).sum(axis=2, dtype=A.U64)
            # A sum without one term stands for the chunk without that slot; the slot's number is mixed in.
            keys = A.mix((np.repeat(sums, CHUNK, axis=1) - terms) ^ A.mix(seeds + A.U64(7)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, slots))], names=["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def _near(pairs: DataFrame, classes: DataFrame, limit: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) within the distance, and of sizes that allow the similarity."""
    of = small(classes.select(F.col("id"), "n", "sig"), 20_000)
    both = pairs.join(of.withColumnsRenamed({"id": "a", "n": "na", "sig": "sa"}), "a").join(of.withColumnsRenamed({"id": "b", "n": "nb", "sig": "sb"}), "b")
    both = both.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))

    def run(batches):
        for b in batches:
            x, y = (A.utf8(b.column(c))[0].view(np.uint16).reshape(b.num_rows, -1) for c in ("sa", "sb"))
            yield b.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= limit))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The hub of a star is ``a``: it is joined first, on narrow rows, and the wide ones
    then spread by ``b``.
    """

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("xa"), b.column("xb")):
                p, q = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([p, q]))
                n = int((both[1:] == both[:-1]).sum())
                keep.append(100 * n >= percent * (len(p) + len(q) - n))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("xb")), "b")
    return wide.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` after more edges: components of components."""
    if labels is None:
        return durable(components(edges))
    of = labels.select(F.col("id").alias("k"), F.col("comp").alias("c"))
    raised = edges.join(of.withColumnsRenamed({"k": "a", "c": "ca"}), "a", "left").join(of.withColumnsRenamed({"k": "b", "c": "cb"}), "b", "left")
    upper = components(raised.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct())
    upper = durable(upper).select(F.col("id").alias("comp"), F.col("comp").alias("top"))
    moved = labels.join(upper, "comp", "left").select("id", F.coalesce("top", "comp").alias("comp"))
    # Components of one are in no label yet.
    new = upper.select(F.col("comp").alias("id"), F.col("top").alias("comp")).join(labels.select("id"), "id", "left_anti")
    return durable(moved.unionByName(new))


def _forest(ids: np.ndarray, comp: np.ndarray, own: np.ndarray, same: bool, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links across components among the rows (of two blocks, unless ``same``), without cycles."""
    sizes = np.array([len(x) for x in sets])
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    fresh = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(fresh) - 1
    shared = np.bincount(col) > 1  # what one row alone has is in no intersection
    col, row = (np.cumsum(shared) - 1)[col[shared[col]]], row[shared[col]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(col, (at, at + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[i:j], col[i:j] - at] = 1
        both += m @ m.T
    ok = 100 * both >= percent * (sizes[:, None] + sizes[None] - both)
    ok &= comp[:, None] != comp[None]
    if not same:
        ok &= own[:, None] != own[None]
    x, y = np.nonzero(np.triu(ok, 1))
    top: dict[int, int] = {}

    def find(c: int) -> int:
        while top.get(c, c) != c:
            c = top[c]
        return c

    out = []
    for p, q in zip(x.tolist(), y.tolist()):
        c, d = find(int(comp[p])), find(int(comp[q]))
        if c != d:
            top[max(c, d)] = min(c, d)
            out.append((int(ids[p]), int(ids[q])))
    return out


def _meeting(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id): those of the ``rows`` (id, comp) that may still be linked with one of another component.

    A shingle that one row alone has comes first in its row's order and meets nothing.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = A.utf8(b.column("set"))
            n = np.diff(at) // 8
            ids, comps = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), n) for c in ("id", "comp"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(comps), pa.array(np.repeat(n, n)), pa.array(np.frombuffer(data.tobytes(), np.int64))], names=["id", "comp", "n", "shingle"])

    every = rows.join(sets, "id").select("id", "comp", "set").mapInArrow(spread, "id long, comp long, n long, shingle long")
    common = every.groupBy("shingle").agg(F.count("*").alias("rows")).where("rows > 1")
    own = Window.partitionBy("id")
    placed = every.join(common, "shingle").withColumns({"place": F.row_number().over(own.orderBy("rows", "shingle")), "m": F.count("*").over(own)})
    first = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1
    front = durable(placed.where(F.col("place") + F.col("n") - F.col("m") <= first).select("id", "comp", "shingle"))
    meets = front.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("shingle")
    return front.join(small(durable(meets)), "shingle", "left_semi").select("id").distinct()


def _across(rows: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Links (a, b) between members of one hub that are in different components.

    rows: (hub, id, comp), durable. A hub's largest component is its inner one: blocks of
    inner members are compared with blocks of others, never with each other.
    """
    of_comp = rows.groupBy("hub", "comp").agg(F.count("*").alias("n"))
    n = of_comp.groupBy("hub").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("total"))
    n = n.select("hub", F.col("most.comp").alias("main"), F.col("most.n").alias("n_in"), (F.col("total") - F.col("most.n")).alias("n_out")).where("n_out > 0")
    blocks_in, blocks_out = F.ceil(F.col("n_in") / BLOCK).cast("int"), F.ceil(F.col("n_out") / BLOCK).cast("int")
    spread = lambda k: F.pmod(F.xxhash64("hub", "id"), k).cast("int")
    none = F.array().cast("array<int>")
    upto = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(none)
    zero = F.lit(0)
    inner = F.col("comp") == F.col("main")
    placed = rows.join(small(durable(n)), "hub").withColumns(
        {
            "own": F.when(inner, blocks_out + spread(F.greatest(F.lit(1), blocks_in))).otherwise(spread(blocks_out)),
            "others": F.when(inner, upto(zero, blocks_out)).otherwise(upto(zero, blocks_out + blocks_in)),
        }
    )
    wide = placed.select("hub", "id", "comp", "own", "others").join(sets, "id")
    dealt = wide.withColumn("other", F.explode("others")).select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "set")

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, comp, own, i, j = (rows.column(c).to_numpy() for c in ("id", "comp", "own", "i", "j"))
        if len(ids) > 1 and comp.min() != comp.max():
            found = _forest(ids, comp, own, i[0] == j[0], [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("set")], percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = [held.column(c).to_numpy() for c in ("hub", "i", "j")]
            cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:]):
                yield from compare(held.slice(s, e - s))
            held = held.slice(cuts[-1])
        if held is not None:
            yield from compare(held)

    grouped = dealt.repartition(parts, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of
    ``width``-word shingles, and a component is what links reach; kept is its smallest
    doc_id. A document of fewer words has its sequence as its one shingle; a document
    without words, or a null text, is linked with nothing. Repeated rows agree; a doc_id
    with several texts has a row for each. A null doc_id is linked with nothing, has no
    component, and is kept. A very long text is compared whole. Other columns are ignored;
    no rows give no rows.
    """
    chunks = shape(percent / 100)
    slots, limit = CHUNK * chunks, 2 * chunks - 1
    parts = shuffle_partitions(docs.sparkSession)
    found = durable(signed(docs, width, slots))
    able = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = durable(able.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.min("n").alias("n"), F.min("sig").alias("sig")))
    keys = _keys(classes, slots)
    shared = durable(keys.groupBy("key").agg(F.count("*").alias("total")).where("total > 1"))
    members = durable(keys.join(shared, "key"))
    involved = durable(members.select("id").distinct())

    whole = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    if not found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        whole = whole.distinct()

    def sets_of(batches):
        for b in batches:
            for i, j, values, first in _sets(b.column("text"), width):
                raw, at = values.tobytes(), (8 * first).tolist()
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), pa.array([raw[s:e] for s, e in zip(at, at[1:])], pa.binary())], names=["id", "set"])

    sets = durable(whole.join(small(involved), "id", "left_semi").mapInArrow(sets_of, "id long, set binary"))

    # A key's hub is the member that shares most keys with most others: the text that
    # near copies were made from, if it is there.
    weight = members.groupBy("id").agg(F.sum("total").alias("w"))
    hubs = members.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("hub"))
    members = durable(members.join(hubs, "key").select("key", "id", "hub"))
    star = _near(members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), classes, limit, percent)
    labels = _merged(None, durable(_linked(star, sets, percent)))

    of = labels.select(F.col("id").alias("_i"), F.col("comp").alias("_c"))
    now = members.join(of, F.col("id") == F.col("_i"), "left").select("key", "id", "hub", F.coalesce("_c", "id").alias("comp"))
    several = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    left = durable(now.join(several, "key", "left_semi").select("hub", "id", "comp").distinct())
    left = durable(left.join(_meeting(left.select("id", "comp").distinct(), sets, percent), "id", "left_semi"))
    labels = _merged(labels, durable(_across(left, sets, percent, parts)))

    # From classes to documents: every document of a set has its class's component.
    top = classes.select("h1", "h2", "id")
    top = top.join(labels, "id", "left").select("h1", "h2", F.coalesce("comp", "id").alias("component_id"))
    out = found.join(top, ["h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
