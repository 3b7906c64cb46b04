"""The SQL report commands [Q1-Q6, G1, G2, K2, K3, F15] over a view ``rfqs``, at an explicit date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .order import numbered

COLUMNS = "cr_number, title, agency, due_date, relevance_score, is_mwbe_sdvob, status"
REPORTS = {
    "top": f"SELECT {COLUMNS} FROM {{rfqs}} WHERE relevance_score >= 0.80D AND (due_date IS NULL OR due_date >= :as_of) ORDER BY is_mwbe_sdvob DESC, relevance_score DESC, due_date ASC NULLS FIRST, cr_number LIMIT :n",
    "flagged": f"SELECT {COLUMNS} FROM {{rfqs}} WHERE is_mwbe_sdvob AND (due_date IS NULL OR due_date >= :as_of) ORDER BY due_date ASC NULLS FIRST, cr_number",
    "due": f"SELECT {COLUMNS} FROM {{rfqs}} WHERE due_date >= :as_of AND due_date <= date_add(:as_of, :n) ORDER BY due_date, cr_number",
    "open": f"SELECT {COLUMNS} FROM {{rfqs}} WHERE due_date >= :as_of ORDER BY due_date, cr_number",
    "detail": "SELECT * FROM {rfqs} WHERE cr_number = :n",
    "by_status": "SELECT status, count(*) AS cnt FROM {rfqs} GROUP BY status ORDER BY cnt DESC, status",
    "kpi": "SELECT count(*) AS total, count_if(is_mwbe_sdvob) AS flagged, count_if(due_date BETWEEN :as_of AND date_add(:as_of, 14)) AS due_soon, count_if(relevance_score >= 0.90D) AS relevant FROM {rfqs}",
}


def report(spark: SparkSession, name: str, rfqs: DataFrame, as_of: date, n: int = 10) -> DataFrame:
    """One report; ``n`` is its limit, its days or its key. KPIs are one pass, not four."""
    text = REPORTS[name]
    args = {k: v for k, v in (("as_of", as_of), ("n", n)) if f":{k}" in text}
    return spark.sql(text, args=args, rfqs=rfqs)


#: What a report says before its lines, by their number, and what it says without any.
HEADS = {
    "top": ("Top %d RFQs to focus on:\n\n", "No qualifying RFQs found."),
    "flagged": ("MWBE/SDVOB Opportunities (%d):\n\n", "No open MWBE/SDVOB opportunities found."),
    "due": ("RFQs due in the next {n} days (%d):\n\n", "No RFQs due in the next {n} days."),
    "open": ("", ""),
}


def _order(name: str) -> list[Column]:
    first = [F.desc("is_mwbe_sdvob"), F.desc("relevance_score")] if name == "top" else []
    return [*first, F.col("due_date").asc_nulls_first(), F.asc("cr_number")]


def _line(name: str, rows: DataFrame, as_of: date) -> Column:
    """A report's text of one request [W7]; columns that ``rows`` lacks count as empty."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    key, score = F.concat(F.lit("CR# "), F.col("cr_number").cast("string")), F.format_number("relevance_score", 2)
    tag = F.when(F.col("is_mwbe_sdvob"), " [MWBE/SDVOB]").otherwise("")
    due = F.coalesce(F.col("due_date").cast("string"), F.lit("TBD"))
    drive = F.coalesce(F.concat(F.lit("\n   Drive: "), F.nullif(have("gdrive_folder_url").cast("string"), F.lit(""))), F.lit(""))
    place = F.concat(F.lit("Agency: "), "agency", F.lit(" | Due: "), due)
    if name == "top":
        return F.concat(F.format_string("%2d. ", "rank"), key, F.lit(" | Score: "), score, tag, F.lit("\n    "), "title", F.lit("\n    "), place, F.lit(" | Status: "), "status", drive, F.lit("\n"))
    if name == "flagged":
        goal = lambda g: F.when(F.coalesce(have(g).cast("double"), F.lit(0.0)) != 0, F.concat(F.lit(f"{g.split('_')[0].upper()}="), have(g).cast("string"), F.lit("%")))
        goals = F.coalesce(F.nullif(F.concat_ws(" | ", goal("sdvob_goal"), goal("mbe_goal"), goal("wbe_goal")), F.lit("")), F.lit("goals not specified"))
        kind = F.coalesce(have("procurement_type").cast("string"), F.lit(""))
        return F.concat(key, F.lit(" | "), kind, F.lit("\n  "), "title", F.lit("\n  "), place, F.lit(" | "), goals, drive, F.lit("\n"))
    if name == "due":
        left = F.datediff("due_date", F.lit(as_of)).cast("string")
        return F.concat(key, F.lit(" | Due: "), due, F.lit(" ("), left, F.lit("d left)"), tag, F.lit("\n  "), "title", F.lit("\n  Agency: "), "agency", F.lit(" | Score: "), score, F.lit(" | Status: "), "status", F.lit("\n"))
    star = F.when(F.col("is_mwbe_sdvob"), " *").otherwise("")
    return F.concat(key, F.lit(" | "), due, F.lit(" | "), score, star, F.lit(" | "), F.rpad("status", 10, " "), F.lit(" | "), F.substring("title", 1, 50))


def lines(spark: SparkSession, name: str, rfqs: DataFrame, as_of: date, n: int = 10) -> DataFrame:
    """(rank, line): a report's requests in order, as text [W7]; ``top``, ``flagged``, ``due`` or ``open``."""
    rows = report(spark, name, rfqs, as_of, n).select("cr_number")
    rows = rfqs.join(rows, "cr_number", "left_semi")
    rows = numbered(rows, *_order(name)).withColumn("rank", (F.col("place") + 1).cast("int"))
    return rows.select("rank", _line(name, rows, as_of).alias("line"))


def text(spark: SparkSession, name: str, rfqs: DataFrame, as_of: date, n: int = 10) -> DataFrame:
    """One row ``text``: the report as it is printed [W7, Q1-Q3, Q6]."""
    head, none = (x.replace("{n}", str(n)) for x in HEADS[name])
    every = lines(spark, name, rfqs, as_of, n).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("a"))
    whole = F.concat(F.format_string(head, "n") if "%d" in head else F.lit(head), F.array_join(F.transform("a", lambda x: x["line"]), "\n"))
    return every.select(F.when(F.col("n") == 0, none).otherwise(whole).alias("text"))


def summary_text(spark: SparkSession, rfqs: DataFrame, as_of: date) -> DataFrame:
    """One row ``text``: the counts of the whole table and by status [Q5]."""
    k = report(spark, "kpi", rfqs, as_of)
    by = report(spark, "by_status", rfqs, as_of).agg(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("c"), "status"))).alias("a"))
    rows = F.array_join(F.transform("a", lambda x: F.concat(F.lit("  "), F.rpad(x["status"], 12, " "), F.lit(" "), (-x["c"]).cast("string"))), "\n")
    field = lambda label, c: F.concat(F.rpad(F.lit(f"{label}:"), 24, " "), F.col(c).cast("string"))
    head = F.concat_ws("\n", F.lit("Procurement Pipeline Summary"), F.repeat(F.lit("="), 40), field("Total RFQs tracked", "total"), field("MWBE/SDVOB", "flagged"), field("High relevance (>=0.9)", "relevant"), field("Due in next 14 days", "due_soon"), F.lit(""), F.lit("By status:"))
    return k.join(by).select(F.concat(head, F.lit("\n"), rows).alias("text"))  # one row each
