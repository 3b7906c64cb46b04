"""Operator 4: mixing sources to target weights by entropy balancing.

Each source has a target number of words. Document rates stay as close to one, in
entropy, as the targets allow; the solution is an exponential tilt of a document's
rate by its size, min(3, exp(lambda * size / mean size)), with one multiplier per
source. The multipliers maximise the concave dual, which is separable by source:
Newton's steps run for all sources at once as aggregations over the histogram of
(source, size), so neither a hot source nor the number of documents matters after
one pre-aggregated pass.

Rates become copies by controlled rounding over the same histogram. Down the sizes of
a source, each cell of n documents at rate r gets whole copies so that the running
totals of copies and of n * r never differ by more than half a copy; what that leaves
of the target, less than about the longest document, is made up by a few single
copies, from the largest that fits on. A cell's copies are dealt to its documents
by the rank of a hash, told by one threshold per cell. So a source misses its target
by less than its shortest document that can still gain or lose a copy.

DataFrame functions only: no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.order import numbered

from ._spark import durable, nested, small

MOST = 3
#: Newton's steps, bisections included, before the failure to converge is an error; the
#: share of a target that the rates may leave open, which rounding then makes up.
STEPS, OPEN = 200, 1e-4
#: Sizes within a factor of 2 ** (1 / OCTAVE) give one candidate for single copies.
OCTAVE = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) with ``target``, in words.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of all
    sizes. A target is min(3 * source_size, level * weight). The level rises from that
    of no full source, each time by the words that the sources it fills can't take,
    until it fills no more of them.
    """
    placed = numbered(sizes, F.col("source").asc_nulls_last())  # no task sees all sources
    weighed = durable(placed.select("source", "source_size", (1 + F.col("place") % 3).cast("double").alias("w")))
    cap = F.col("source_size") * MOST
    level = F.lit(0.0)
    filled = -1
    while True:
        full = cap < level * F.col("w")
        total, taken, open_, n = weighed.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).head()
        if not open_ or n == filled:
            break
        filled = n
        level = F.lit(float(total - (taken or 0)) / open_)
    return weighed.withColumn("target", F.least(cap.cast("double"), level * F.col("w"))).drop("w")


def _tilt(lam: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(F.lit(30.0), lam * size / mean)))


def multipliers(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with ``lam`` and ``mean``, by safeguarded Newton steps.

    histogram: (source, size, n). goals: (source, source_size, target). A target of
    three times its source's size has every document three times (``full``).
    """
    start = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.greatest(F.lit(1), F.sum(F.when(F.col("size") > 0, F.col("n"))))).alias("mean"))
    state = goals.join(start.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    state = durable(
        state.select(
            "source", "source_size", "target", F.greatest("mean", F.lit(1.0)).alias("mean"), full.alias("full"),
            F.lit(0.0).alias("lam"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), F.lit(float("inf")).alias("gap"),
        )
    )
    narrow = small(state) is not state
    hint = F.broadcast if narrow else (lambda df: df)
    keys = ["source", "source_size", "target", "mean", "full", "lam", "lo", "hi"]
    hist = histogram.withColumnRenamed("source", "_s")
    same = F.col("source").eqNullSafe(F.col("_s"))
    rate = _tilt(F.col("lam"), F.col("size"), F.col("mean"))
    got = F.col("n") * F.col("size") * rate
    sums = F.sum(got).alias("got"), F.sum(F.when(rate < MOST, got * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope")
    over = F.col("got") - F.col("target")
    lo, hi = F.when(over < 0, F.col("lam")).otherwise(F.col("lo")), F.when(over > 0, F.col("lam")).otherwise(F.col("hi"))
    reach = F.greatest(F.lit(4.0), F.abs("lam"))
    step = F.when(F.col("slope") > 0, -over / F.col("slope")).otherwise(-F.signum(over) * reach)
    newton = F.col("lam") + F.greatest(-reach, F.least(reach, step))
    gap = F.when(F.col("full"), F.lit(0.0)).otherwise(F.abs(over) / F.greatest(F.lit(1.0), F.col("target")))
    lam = F.when(gap <= OPEN, F.col("lam")).otherwise(F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2))
    moved = [F.col(c) for c in keys[:5]] + [lam.alias("lam"), lo.alias("lo"), hi.alias("hi"), gap.alias("gap")]
    for _ in range(STEPS):
        # A source's state is part of its group, so a step is one join and one aggregation.
        found = hist.join(hint(state), same).groupBy(*keys).agg(*sums).select(*moved)
        state = durable(found.coalesce(1) if narrow else found)
        if state.where(F.col("gap") > OPEN).isEmpty():
            return state.select("source", "source_size", "target", "mean", "full", "lam")
    raise RuntimeError(f"mixing: the multipliers of some source did not converge in {STEPS} steps")


def _rounded(histogram: DataFrame, params: DataFrame) -> DataFrame:
    """(source, size, n, source_size, target, rate, m): copies m of each cell, m <= 3 * n.

    A window is over one source's distinct sizes, and what single copies are chosen from
    is at most OCTAVE cells for each doubling of the size.
    """
    hint = F.broadcast if small(params) is not params else (lambda df: df)
    p = hint(params.withColumnRenamed("source", "_s"))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(F.when(F.col("full"), F.lit(float(MOST))).otherwise(_tilt(F.col("lam"), F.col("size"), F.col("mean"))))
    cells = histogram.join(p, F.col("source").eqNullSafe(F.col("_s"))).select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    upto = F.floor(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 0.5)
    cells = cells.withColumn("upto", upto)
    m = F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0))
    cells = durable(cells.withColumn("m", F.least(MOST * F.col("n"), F.greatest(F.lit(0), m)).cast("long")).drop("upto"))

    open_ = cells.groupBy("source").agg((F.max("target") - F.sum(F.col("m") * F.col("size"))).alias("open"))
    able = cells.where("size > 0").join(open_.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    free = F.when(F.col("open") > 0, MOST * F.col("n") - F.col("m")).otherwise(F.col("m"))
    able = able.withColumn("free", free).where("free > 0")
    # The shortest of each range of sizes, so that one fits wherever a size of the range would.
    best = able.groupBy("source", "open", F.floor(F.log2("size") * OCTAVE)).agg(F.min(F.struct("size", "free")).alias("c"))
    lists = best.groupBy("source", "open").agg(F.sort_array(F.collect_list("c"), asc=False).alias("c"))
    k = lambda s, c: F.least(c["free"], F.floor(s["rest"] / c["size"]).cast("long"))
    none = F.array().cast("array<struct<size:bigint,k:bigint>>")
    picks = F.aggregate(
        "c",
        F.struct(F.abs("open").alias("rest"), none.alias("picks")),
        lambda s, c: F.struct((s["rest"] - k(s, c) * c["size"]).alias("rest"), F.when(k(s, c) > 0, F.concat(s["picks"], F.array(F.struct(c["size"].alias("size"), k(s, c).alias("k"))))).otherwise(s["picks"]).alias("picks")),
        lambda s: s["picks"],
    )
    fixes = lists.select(F.col("source").alias("_s"), F.signum("open").cast("long").alias("sign"), F.explode(picks).alias("x")).select("_s", F.col("x.size").alias("_z"), (F.col("sign") * F.col("x.k")).alias("delta"))
    fixed = cells.join(fixes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return durable(fixed.withColumn("m", F.col("m") + F.coalesce("delta", F.lit(0))).drop("_s", "_z", "delta"))


def _thresholds(slim: DataFrame, cells: DataFrame) -> DataFrame:
    """(_s, _z, most): the largest hash of a cell's documents that get one copy more than the others.

    slim: (source, size, h). A cell's documents are counted by ranges of hashes, so that
    only the range with the threshold in it is sorted; there are as many ranges as rows
    in a range of the largest cell, and so the square root of its rows in a task.
    """
    uneven = cells.withColumn("more", F.col("m") % F.col("n")).where("more > 0").select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "more")
    uneven = durable(uneven)
    bits = (uneven.agg(F.max("n")).head()[0] or 1).bit_length() // 2
    uneven = small(uneven.drop("n"))
    at = lambda df: df.join(uneven, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")))
    rows = at(slim).select("_s", "_z", "more", "h", F.shiftright("h", 63 - bits).alias("range"))
    counts = rows.groupBy("_s", "_z", "more", "range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_s", "_z").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at_range = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("n") < F.col("more")))
    wanted = at_range.select(F.col("_s").alias("_t"), F.col("_z").alias("_y"), F.col("range").alias("_r"), (F.col("more") - F.col("upto") + F.col("n")).alias("nth"))
    same = F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_z") == F.col("_y")) & (F.col("range") == F.col("_r"))
    rank = F.row_number().over(Window.partitionBy("_s", "_z").orderBy("h"))
    return rows.join(wanted, same).withColumn("rank", rank).where("rank = nth").select("_s", "_z", F.col("h").alias("most"))


def copies(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc, size, source_size, target, rate, copies, taken): ``doc`` is the whole input row.

    Input: doc_id, text, source; other columns may have any name. A text of any length
    counts whole. A null or empty text, or one without words, has size 0 and one copy.
    Equal rows get equal copies, which may move a source from its target by their size.
    Null sources are one source, the last. A document longer than its source's target is
    taken once or not at all, whichever is nearer. No rows give no rows.
    """
    h = lambda c: F.shiftrightunsigned(F.xxhash64(F.lit(seed), c("doc_id"), c("text")), 1)
    slim = durable(docs.select("source", n_words(F.col("text")).alias("size"), h(F.col).alias("h")))
    histogram = durable(slim.groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = targets(histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")))
    cells = _rounded(histogram, multipliers(histogram, durable(goals)))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    base = cells.join(_thresholds(slim, cells), same, "left").select(
        F.col("source").alias("_f"), F.col("size").alias("_y"), "source_size", "target", "rate", F.floor(F.col("m") / F.col("n")).alias("base"), F.coalesce("most", F.lit(-1)).alias("most")
    )
    rows = nested(docs).withColumns({"size": n_words(F.col("doc.text")), "h": h(lambda c: F.col(f"doc.{c}"))})
    out = rows.join(small(durable(base)), F.col("doc.source").eqNullSafe(F.col("_f")) & (F.col("size") == F.col("_y")))
    out = out.withColumn("copies", (F.col("base") + (F.col("h") <= F.col("most")).cast("long")).cast("long"))
    return out.select("doc", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each document's row as often as it has copies, columns unchanged."""
    out = copies(docs, seed).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
