"""Places in a global order without a task that sees all rows [T2]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable

_ROWS = (1 << 33) - 1


def numbered(df: DataFrame, *order: Column, name: str = "place", flag: str | None = None) -> DataFrame:
    """``df``, made durable, with ``name``: 0, 1, ... in ``order``, which must tell all rows apart.

    Ranges are sorted apart and get the number of rows in the ranges before them. With
    ``flag``, a boolean column, ``name`` is how many of the rows before have it.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = durable(local.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROWS))}))
    if flag is None:
        parts = local.groupBy("_part").agg(F.count("*").alias("n"))  # one row per partition
    else:
        own = F.col(flag).cast("long")
        parts = local.groupBy("_part").agg(F.sum(own).alias("n"))
        window = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)  # a range's rows
        local = local.withColumn("_row", F.coalesce(F.sum(own).over(window), F.lit(0)))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return local.join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def ranked_within(df: DataFrame, by: str, *order: Column, name: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in each ``by``, and ``size``, its number of rows, without a task that sees all of one; ``order`` must tell its rows apart."""
    placed = numbered(df, F.asc(by), *order, name="_place")
    groups = placed.groupBy(by).agg(F.min("_place").alias("_first"), F.count("*").alias(size or "_size"))
    out = placed.join(groups, by).withColumn(name, (F.col("_place") - F.col("_first") + 1).cast("int"))
    return out.drop("_place", "_first", "_size")
