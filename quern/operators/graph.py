"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. On one machine, where none is named, one beside the warehouse's tables; on a cluster that is an error."""
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return jsc.getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lost executors don't lose it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over (a, b), for ids that have an edge.

    Each round takes the smallest label among neighbours, pre-aggregated before the
    shuffle, then that label's own label, and stops when nothing changes.
    """
    e = durable(edges.select("a", "b").where("a <> b"))
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = durable(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")))
    while not labels.isEmpty():
        seen = labels.select(F.col("id").alias("b"), F.col("comp").alias("c"))
        near = both.join(seen, "b").groupBy("a").agg(F.min("c").alias("near")).withColumnRenamed("a", "id")
        own = labels.join(near, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("comp").alias("top"))
        step = durable(own.join(up, "low", "left").select("id", F.least("low", "top").alias("new"), "comp"))
        labels = step.select("id", F.col("new").alias("comp"))
        if step.where("new <> comp").isEmpty():
            break
    return labels
