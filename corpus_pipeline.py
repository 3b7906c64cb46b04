"""The corpus pipeline: rules, line dedup, near-dedup, mixing and packing of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import linededup, mixing, neardup, packing, rules
from quern.llm._spark import Stored, durable, nested, small


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy keeps.

    A null or empty text has no words and goes. Rows are judged one by one: equal rows stay
    or go together, ties don't arise, a very long text is judged whole, an empty table
    stays empty, and columns of any other name pass untouched.
    """
    return rules.apply_policy(rules.judged(docs)).where("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines; n_chars follows the text.

    Copies keep what makes them copies, which the next stage judges. Every row stays, if
    need be with an empty text; a null text stays null. Equal rows lose the same lines, a
    line that reaches the number of documents exactly is dropped, a very long text loses
    lines like any other; an empty table stays empty, other columns pass untouched.
    """
    return linededup.deduplicated(docs, copy=linededup.COPY).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id.

    Rows that are equal in every column are one, too. Rows of one doc_id with different
    columns stay apart if their doc_id stays. Texts that are null or without words have no
    copies and stay; a null doc_id stays. A pair exactly at the similarity is linked; a very
    long text is compared whole; an empty table stays empty, other columns pass untouched.
    """
    kept = neardup.near_duplicates(docs).where("kept").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = durable(kept.withColumnRenamed("doc_id", "kept_id"))
    of = lambda ids: nested(docs).join(ids, F.col("doc.doc_id").eqNullSafe(F.col("kept_id"))).select("doc.*")
    return of(kept.where("n = 1")).unionByName(of(small(durable(kept.where("n > 1")))).distinct())


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    A null or empty text has no words to take and changes nothing in the mix. A null source
    is a source of its own; equal rows move together, ties are broken by hashes of rows. A very long text counts whole; an empty
    table stays empty, other columns pass untouched.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens.

    A null or empty text is its end token alone. Equal rows are packed each by itself, equal
    lengths in any order. A very long text is cut into pieces; an empty table gives none;
    columns beyond doc_id and text aren't returned.
    """
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Hash rounding, minimal hashes and tokens have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each one's rows are written and read again.

    A stage's rows are deleted once the next one's are written, so a run leaves one copy.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: Stored | None = None
    for _, stage in STAGES[:-1]:
        after = Stored(stage(spark, docs, sf_dir))
        if before is not None:
            before.drop()
        before, docs = after, after.rows
    return STAGES[-1][1](spark, docs, sf_dir)
