"""Sinks [W1, W2, W6]: single files, snapshots, and keyed tables in buckets.

A table's state is a numbered pointer to files that are never changed. Pointers are taken
by a rename that fails if the number is there, so that of two writers one must look again.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.procure import upserted


class Conflict(RuntimeError):
    """Another writer was first."""


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Moves a file; False if there is a target that may not be replaced."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = (_path(spark, p).getFileSystem(conf).makeQualified(_path(spark, p)) for p in (source, target))
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), conf).rename(a, b, how)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def _one_file(df: DataFrame, path: str) -> None:
    """The only column of a small result as one text file, put in place whole."""
    spark, aside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    df.coalesce(1).write.text(aside)
    fs = _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath().toString() for s in fs.listStatus(_path(spark, aside)) if s.getPath().getName().startswith("part-"))
    _rename(spark, part, path, overwrite=True)
    fs.delete(_path(spark, aside), True)


def write_text(df: DataFrame, path: str) -> None:
    """A single row's text as one file."""
    _one_file(df, path)


def write_json(df: DataFrame, path: str) -> None:
    """A small, ordered result as one file with a JSON array; dates and times as text."""
    at = F.monotonically_increasing_id().alias("at")
    rows = df.coalesce(1).select(at, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "j"))), lambda x: x["j"])
    _one_file(rows.agg(F.concat(F.lit("["), F.array_join(listed, ",\n"), F.lit("]")).alias("value")), path)


def write_run(outputs: dict[str, DataFrame], root: str) -> None:
    """A digest's three files [W6]: top_stories.json, digest.md and run_report.json."""
    write_json(outputs["stories"], f"{root}/top_stories.json")
    write_text(outputs["digest"], f"{root}/digest.md")
    write_json(outputs["report"], f"{root}/run_report.json")


def last_report(spark: SparkSession, root: str) -> DataFrame:
    """The report that the last run wrote under ``root``, one row ``text`` [Q10]; without one, a line that says so."""
    try:
        kept = spark.read.json(f"{root}/run_report.json", multiLine=True)
    except AnalysisException:
        return spark.range(1).select(F.lit("No previous run found. Run a digest first.").alias("text"))
    failed = F.filter("source_details", lambda s: s["status"] != "ok")
    errors = F.transform(failed, lambda s: F.concat(F.lit("    - "), s["source"], F.lit(": "), F.substring(F.coalesce(s["error"].cast("string"), F.lit("?")), 1, 80)))
    lines = [
        F.lit("Last news run"),
        F.lit("=" * 40),
        F.concat(F.lit("  Sources:  "), F.col("sources_succeeded").cast("string"), F.lit("/"), F.col("sources_attempted").cast("string"), F.lit(" OK")),
        F.concat(F.lit("  Stories:  "), F.col("raw_count").cast("string"), F.lit(" raw → "), F.col("final_count").cast("string"), F.lit(" final")),
        F.when(F.size(failed) > 0, F.concat(F.lit("  Errors:   "), F.size(failed).cast("string"), F.lit("\n"), F.array_join(errors, "\n"))),
    ]
    return kept.select(F.concat_ws("\n", *lines).alias("text"))


_POINTER = "n long, path string"


def _last(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(number, path) of the last pointer."""
    try:
        got = spark.read.schema(_POINTER).json(f"{root}/pointers").agg(F.max(F.struct("n", "path")).alias("p")).head()["p"]
    except AnalysisException:  # the table's first write: there's no folder of pointers yet
        got = None
    return (got["n"], got["path"]) if got else (0, None)


def last_number(spark: SparkSession, root: str) -> int:
    """The number of the last state or snapshot under ``root``; 0 before the first."""
    return _last(spark, root)[0]


def _claim(spark: SparkSession, root: str, n: int, path: str) -> bool:
    """Pointer n, made by one writer alone."""
    conf = spark._jsc.hadoopConfiguration()
    aside, fs = f"{root}/aside/{uuid.uuid4().hex}.json", _path(spark, root).getFileSystem(conf)
    for folder in ("aside", "pointers"):
        fs.mkdirs(_path(spark, f"{root}/{folder}"))
    out = fs.create(_path(spark, aside), True)
    out.write(bytearray(json.dumps({"n": n, "path": path}).encode()))
    out.close()
    if _rename(spark, aside, f"{root}/pointers/{n:012d}.json"):
        return True
    fs.delete(_path(spark, aside), False)
    return False


def save_snapshot(df: DataFrame, root: str, after: int | None = None) -> int:
    """``df`` as a new snapshot of a table, which a new pointer names once all of it is written; its number.

    Pointers are numbered and only added, never replaced: a reader at any moment finds the
    last whole snapshot, from which the new one may be computed. With ``after``, the number
    of the snapshot that ``df`` was computed from, a snapshot in between is a ``Conflict``;
    without it the next free number is taken.
    """
    spark = df.sparkSession
    path = f"{root}/data-{uuid.uuid4().hex}"
    df.write.parquet(path)
    n = _last(spark, root)[0] if after is None else after
    while not _claim(spark, root, n + 1, path):
        if after is not None:
            raise Conflict(f"snapshot {n + 1} of {root} is another writer's")
        n += 1
    return n + 1


def load_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The current snapshot; additive columns merge [W11]."""
    return spark.read.option("mergeSchema", "true").parquet(_last(spark, root)[1])


#: Buckets of a keyed table; a key's is a hash of it.
BUCKETS = 64


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int"))


def upsert(batch: DataFrame, root: str, key: str = "cr_number", buckets: int = BUCKETS, tries: int = 20) -> int:
    """A batch put into a keyed table [W1, W2], as ``procure.upserted`` does it; the new state's number.

    Only the buckets that the batch touches are read and written anew; a state lists each
    bucket's folder. If another writer's state comes first, the batch is put into that.
    A table keeps the number of buckets it began with.
    """
    spark, batch = batch.sparkSession, _bucketed(batch, key, buckets)
    touched = {r["_bucket"] for r in batch.select("_bucket").distinct().collect()}  # no more than there are buckets
    for _ in range(tries):
        n, state = _last(spark, root)
        held = {r["bucket"]: r["path"] for r in spark.read.schema("bucket int, path string").json(state).collect()} if state else {}
        old = [held[b] for b in sorted(touched & held.keys())]
        rows = batch.drop("_bucket")
        table = spark.read.option("mergeSchema", "true").parquet(*old) if old else rows.drop("ord").limit(0)
        table = table.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in [*table.columns, "ord"]])
        path = f"{root}/data-{uuid.uuid4().hex}"
        _bucketed(upserted(table, rows, key), key, buckets).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        held |= {b: f"{path}/_bucket={b}" for b in touched}
        listed = f"{root}/states/{uuid.uuid4().hex}"
        spark.createDataFrame(sorted(held.items()), "bucket int, path string").coalesce(1).write.json(listed)
        if _claim(spark, root, n + 1, listed):
            return n + 1
    raise Conflict(f"{root} was written {tries} times meanwhile")


def load_table(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a keyed table's last state; columns that were added later are null in older buckets [W11]."""
    paths = [r["path"] for r in spark.read.schema("bucket int, path string").json(_last(spark, root)[1]).collect()]
    return spark.read.option("mergeSchema", "true").parquet(*paths)
