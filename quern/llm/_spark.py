"""Helpers shared by the operators: durable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.graph import durable, shared_dir

from ._arrow import Bits

__all__ = ["bits", "durable", "nested", "shared_dir", "shuffle_partitions", "small", "Stored"]

#: Rows up to which a side with a few narrow columns may be broadcast.
BROADCAST_ROWS = 100_000

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already durable) with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def nested(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``doc``: an operator's own columns beside it can't clash with the input's."""
    return docs.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]).alias("doc"))


class Stored:
    """A DataFrame written as Parquet in the shared folder and read back, until it is dropped."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.rows = spark.read.parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; nothing may read them afterwards."""
        spark = self.rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A set of hashes has 64 bits for each, but no more than this power of two: 16 MB.
WIDEST_BITS = 27


def bits(hashes: DataFrame, column: str) -> Bits:
    """The column's hashes (already durable) as a set that tasks ask first; its size is bounded, whatever the data.

    Where there are so many that most bits are set, it lets through more, and loses none.
    """
    width = min(WIDEST_BITS, max(15, (64 * hashes.count()).bit_length()))
    at = F.shiftrightunsigned(F.col(column), 64 - width)
    parts = hashes.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits"))
    return Bits(width, {r["part"]: bytes(r["bits"]) for r in parts.collect()})  # at most 4,096 rows of 4 kB
