"""The stages of procurement, end to end, as functions of tables [Q7, W3-W5, W10, S17, G3, U2].

A stage takes the keyed table of requests and returns it after the stage, with the rows
that the stage would have sent elsewhere: leads, folders, mails, bids, proposals. Nothing
is sent. ``keys`` makes a stage work on those requests whatever their status; unknown keys
are skipped.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import config as C
from quern.sources import files

from . import procure
from .graph import durable
from .order import ranked_within

#: The keyed table of requests [S17, W11]: lists are JSON text, as they are stored.
TABLE = (
    "cr_number string, title string, agency string, category string, issue_date date, due_date date, ad_end_date date, division string, location string, "
    "ad_type string, note string, detail_url string, source_site string, raw_text string, line_items_json string, attachment_paths_json string, "
    "procurement_type string, is_mwbe_sdvob boolean, sdvob_goal double, mbe_goal double, wbe_goal double, relevance_score double, odoo_lead_id bigint, "
    "gdrive_folder_id string, gdrive_folder_url string, status string, created_at timestamp"
)
COLUMNS = [c.split()[0] for c in TABLE.split(", ")]
GOALS = ("sdvob_goal", "mbe_goal", "wbe_goal")
COMPANY = "the bidder"


def encoded(rows: DataFrame) -> DataFrame:
    """Requests with lists as rows of the table [S17]: items keep their eight fields, attachments their names."""
    items = F.to_json(F.transform("line_items", lambda x: F.struct(*[x[f] for f in ("description", "quantity", "unit", "part_number", "vendor", "unit_price", "extended_price", "notes")])), {"ignoreNullFields": "false"})
    names = F.to_json(F.transform("attachments", lambda x: x["filename"]))
    kinds = dict(c.split() for c in TABLE.split(", "))
    out = rows.withColumns({"line_items_json": F.coalesce(items, F.lit("[]")), "attachment_paths_json": F.coalesce(names, F.lit("[]"))})
    return out.select(*[(F.col(c) if c in out.columns else F.lit("" if c.startswith("gdrive") else None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def decoded(table: DataFrame) -> DataFrame:
    """The table with ``line_items`` and ``attachment_paths`` as lists; null or broken text is an empty list [S17]."""
    items = F.coalesce(F.from_json("line_items_json", f"array<{files.ITEM}>"), F.array().cast(f"array<{files.ITEM}>"))
    paths = F.coalesce(F.from_json("attachment_paths_json", "array<string>"), F.array().cast("array<string>"))
    return table.withColumns({"line_items": items, "attachment_paths": paths})


def _due(table: DataFrame, keys: list[str] | None, *statuses: str) -> Column:
    return F.col("cr_number").isin(*keys) if keys is not None else F.col("status").isin(*statuses)


def scan(new: DataFrame, stored: DataFrame, as_of: date, pages: DataFrame, tables: DataFrame, sheet_rows: DataFrame) -> dict[str, DataFrame]:
    """``table`` with every new request, whatever became of it, and the ``kept`` ones [F14, A27, W1].

    new: rows of ``files.assembled``. Attachments are read of those only that pass the first two rules.
    """
    rows = procure.disposed(new, stored, as_of, lambda r: files.with_attachments(r, pages, tables, sheet_rows))
    return {"table": procure.upserted(stored, encoded(rows)), "kept": rows.where("disposition = 'kept'"), "dispositions": rows.select("cr_number", "disposition", "relevance_score")}


def alerted(new: DataFrame, stored: DataFrame, as_of: date, pages: DataFrame, tables: DataFrame, sheet_rows: DataFrame) -> dict[str, DataFrame]:
    """A scheduled scan: ``table`` after it, and the ``alert`` for what it keeps [Q8]."""
    out = scan(new, stored, as_of, pages, tables, sheet_rows)
    return {"table": out["table"], "alert": procure.alert(out["kept"].withColumn("items", F.size("line_items")), as_of)}


def lead_values(rfqs: DataFrame, as_of: date) -> DataFrame:
    """A request's lead [W10]: name, priority, deadline, description and tags."""
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    line = lambda label, n, optional=False: F.when(~F.lit(optional) | (c(n) != ""), F.concat(F.lit(f"{label}: "), c(n)))
    notes = [line("CR#", "cr_number"), line("Agency", "agency"), line("Category", "category"), line("Ad Type", "ad_type"), line("Location", "location"), line("Division", "division"), line("Source", "source_site")]
    notes += [line("URL", "detail_url", True), line("Google Drive", "gdrive_folder_url", True), line("Note", "note", True)]
    tag = lambda label, n, most: F.concat(F.lit(f"{label}:"), F.substring(c(n), 1, most))
    urgent = F.coalesce(F.datediff("due_date", F.lit(as_of)) <= 7, F.lit(False))
    return rfqs.select(
        "cr_number", F.concat(F.lit("["), "cr_number", F.lit("] "), F.substring("title", 1, 120)).alias("name"), F.lit("opportunity").alias("type"), F.concat_ws("\n", *notes).alias("description"),
        F.array(tag("source", "source_site", 1000), tag("category", "category", 50), tag("agency", "agency", 50)).alias("tags"), F.when(urgent, "2").otherwise("1").alias("priority"), F.col("due_date").alias("date_deadline"),
    )


def folder_plan(rfqs: DataFrame) -> DataFrame:
    """(cr_number, ord, path): a request's folder and those in it [W10]."""
    name = F.concat("cr_number", F.lit(" - "), F.rtrim(F.substring("title", 1, 60)), F.lit(" - "), "agency")
    paths = F.array(name, *[F.concat(name, F.lit(f"/{s}")) for s in C.SUBFOLDERS])
    return rfqs.select("cr_number", F.posexplode(paths).alias("ord", "path"))


def process(table: DataFrame, as_of: date, deals: DataFrame | None = None, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """New requests get a lead, if no deal's name has their key, and folders; they move on in any case [Q7, T13, A29].

    deals: id, name. A deal that is found becomes the request's lead.
    """
    todo = table.where(_due(table, keys, "new"))
    after = table.withColumn("status", F.when(_due(table, keys, "new"), "processed").otherwise(F.col("status")))
    leads = lead_values(todo, as_of)
    if deals is not None:
        found = deals.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("name"), F.lit(r"\[([^\[\]]*)\]"), F.lit(1)))).alias("_k")).groupBy("_k").agg(F.min("id").alias("_id"))
        leads = leads.join(found, F.lower("cr_number") == F.col("_k"), "left_anti")
        after = after.join(found, F.lower("cr_number") == F.col("_k"), "left").withColumn("odoo_lead_id", F.when(_due(table, keys, "processed") & F.col("_id").isNotNull(), F.col("_id")).otherwise(F.col("odoo_lead_id"))).drop("_k", "_id")
    return {"table": after, "leads": leads, "folders": folder_plan(todo)}


def items_table(items: Column) -> Column:
    """Items as a fixed-width table of plain text [W10]."""
    text = lambda x, empty, n: F.substring(F.coalesce(F.nullif(x, F.lit("")), F.lit(empty)), 1, n)
    quantity = lambda q: F.coalesce(F.nullif(q, F.lit(0.0)).cast("string"), F.lit("TBD"))
    row = lambda x, i: F.format_string("%-4s %-20s %-45s %-8s %-8s", (i + 1).cast("string"), text(x["part_number"], "N/A", 18), text(x["description"], "", 43), F.substring(quantity(x["quantity"]), 1, 6), text(x["unit"], "ea", 6))
    head = F.format_string("%-4s %-20s %-45s %-8s %-8s", F.lit("#"), F.lit("Part/SKU"), F.lit("Description"), F.lit("Qty"), F.lit("Unit"))
    return F.when(F.size(items) == 0, "(No line items were read; see the attached documents)").otherwise(F.array_join(F.concat(F.array(head, F.repeat(F.lit("-"), 90)), F.transform(items, row)), "\n"))


def quote(table: DataFrame, contacts: DataFrame, as_of: date, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """Processed requests' items by rep, as ``mails``; requests without items or matches keep their status [Q7, T13, C5].

    contacts: ord, text, rep_email, rep_name, distributor_name.
    """
    todo = decoded(table).where(_due(table, keys, "processed"))
    items = todo.select("cr_number", F.posexplode("line_items").alias("at", "x"))
    part = lambda f: F.nullif(F.col(f"x.{f}"), F.lit(""))
    matched = procure.matches(items.select(F.struct("cr_number", "at").alias("item"), F.lower(F.concat_ws(" ", part("vendor"), part("description"), part("part_number"))).alias("text")), contacts)
    per = matched.groupBy(F.col("item.cr_number").alias("cr_number"), "rep_email").agg(
        F.min_by(F.struct("rep_name", "distributor_name"), F.struct("item", -F.col("ratio"), F.col("ord"))).alias("f"), F.array_sort(F.collect_set("item.at")).alias("at")
    )
    j = per.join(todo.select("cr_number", "title", "agency", "due_date", "line_items"), "cr_number").select("*", "f.*")
    due = F.when(F.col("due_date").isNull(), "TBD").otherwise(F.date_format("due_date", "MMMM dd, yyyy"))
    deadline = F.when(F.col("due_date").isNull(), "ASAP").otherwise(F.date_format(F.greatest(F.date_sub("due_date", 5), F.date_add(F.lit(as_of), 3)), "MMMM dd, yyyy"))
    own = F.transform("at", lambda i: F.get("line_items", i))
    body = F.concat_ws("\n", F.concat(F.lit("Dear "), "rep_name", F.lit(",")), F.concat(F.lit("we ask "), "distributor_name", F.lit(" for prices for this request:")), F.concat(F.lit("Reference: "), "title"), F.concat(F.lit("CR#: "), "cr_number"), F.concat(F.lit("Agency: "), "agency"), F.concat(F.lit("Due: "), due), F.lit(""), items_table(own), F.lit(""), F.concat(F.lit("Please answer by "), deadline, F.lit(".")))
    subject = F.concat(F.lit("Quote Request - "), F.substring("title", 1, 60), F.lit(" - CR# "), "cr_number", F.lit(" - Due "), due)
    mails = j.select("cr_number", F.col("rep_email").alias("to"), subject.alias("subject"), body.alias("body"), F.size("at").alias("n_items"))
    done = per.select("cr_number").distinct().withColumn("status", F.lit("quoted"))
    return {"table": procure.with_status(table, done), "mails": mails}


def ready(table: DataFrame) -> DataFrame:
    """Quoted requests, then processed ones, each by due date, none first, with ``ord`` [U2, A30]."""
    branch = lambda s, i: table.where(F.col("status") == s).withColumn("branch", F.lit(i))
    both = branch("quoted", 0).unionByName(branch("processed", 1))
    return ranked_within(both, "branch", F.col("due_date").asc_nulls_first(), F.asc("cr_number"), name="ord")


def analyze(table: DataFrame, deals: DataFrame, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """Bids of quoted and processed requests, and the revenue to expect of those with a lead [Q7, C6].

    deals: deal, text, revenue, ord.
    """
    todo = decoded(table).where(_due(table, keys, "quoted", "processed"))
    bids = procure.bids(_asks(todo), deals)
    revenue = bids.join(todo.select("cr_number", "odoo_lead_id"), "cr_number").where("odoo_lead_id IS NOT NULL AND mid > 0").select("odoo_lead_id", F.col("mid").alias("expected_revenue"))
    after = table.withColumn("status", F.when(_due(table, keys, "quoted", "processed"), "analyzed").otherwise(F.col("status")))
    return {"table": after, "bids": bids, "revenue": revenue}


def _asks(rfqs: DataFrame) -> DataFrame:
    words = F.concat_ws(" ", "title", "category", "agency", F.substring("raw_text", 1, 2000))
    return rfqs.select("cr_number", words.alias("text"), procure.cost(F.col("line_items")).alias("cost"))


def proposals(rfqs: DataFrame, bids: DataFrame, as_of: date, company: str = COMPANY) -> DataFrame:
    """(cr_number, title, sections): each proposal's headings and texts in order [W10]. rfqs: decoded rows."""
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 2))
    some = lambda x: F.coalesce(x, F.lit("")) != ""
    number = lambda i: F.concat((i + 1).cast("string"), F.lit(". "))
    solution = lambda x, i: F.concat(number(i), F.concat_ws("  ", x["description"], F.when(some(x["vendor"]), F.concat(F.lit("Vendor: "), x["vendor"])), F.when(some(x["part_number"]), F.concat(F.lit("Part#: "), x["part_number"])), F.when(F.coalesce(x["quantity"], F.lit(0.0)) != 0, F.concat(F.lit("Qty: "), x["quantity"].cast("string"), F.lit(" "), F.coalesce(x["unit"], F.lit(""))))))
    price = lambda x: F.coalesce(money(F.nullif(x, F.lit(0.0))), F.lit("TBD"))
    priced = lambda x, i: F.concat(number(i), F.concat_ws(" | ", F.substring(x["description"], 1, 50), F.concat(F.lit("Qty: "), F.coalesce(F.nullif(x["quantity"], F.lit(0.0)).cast("string"), F.lit("TBD"))), F.concat(F.lit("Unit: "), price(x["unit_price"])), F.concat(F.lit("Extended: "), price(x["extended_price"]))))
    lines = lambda f, empty: F.when(F.size("line_items") == 0, empty).otherwise(F.array_join(F.transform("line_items", f), "\n"))
    goal = lambda g, label: F.when(F.col(g).isNotNull(), F.concat(F.lit(f"{label} Goal: "), F.col(g).cast("string"), F.lit("%")))
    goals = F.nullif(F.concat_ws(" | ", *[goal(g, g.split("_")[0].upper()) for g in GOALS]), F.lit(""))
    special = F.col("is_mwbe_sdvob") | F.greatest(*[F.coalesce(F.col(g), F.lit(0.0)) for g in GOALS]).cast("boolean")
    bid = F.when(F.col("mid") > 0, F.concat(F.lit("Recommended bid: "), money(F.col("mid")), F.lit("\nBid range: "), money(F.col("low")), F.lit(" - "), money(F.col("high")), F.lit("\nConfidence: "), "confidence"))
    kind = F.when(F.col("is_mwbe_sdvob"), F.concat(F.lit("Procurement Type: "), F.initcap(F.replace("procurement_type", F.lit("_"), F.lit(" ")))))
    section = lambda h, text: F.struct(F.lit(h).alias("heading"), text.alias("text"))
    head = F.concat_ws("\n", F.concat(F.lit("CR#: "), "cr_number"), F.concat(F.lit("Agency: "), "agency"), F.lit(f"Submitted by: {company}"), F.lit(f"Date: {as_of:%B %d, %Y}"))
    fixed = [
        section("Response", F.concat(F.lit("Response to: "), "title", F.lit("\n"), head)),
        section("Cover Letter", F.concat(F.lit(f"{company} submits this proposal for "), "title", F.lit(" (CR# "), "cr_number", F.lit(") of "), "agency", F.lit("."))),
        section("Company Overview", F.lit(f"{company} supplies software licences, subscriptions and related services to public agencies.")),
        section("Proposed Solution", lines(solution, "[to be added]")),
        section("Pricing", F.concat_ws("\n", bid, lines(priced, "[to be completed]"))),
        section("Delivery Timeline", F.lit("Licences are delivered electronically within 5 business days of the purchase order.")),
        section("Terms and Conditions", F.lit("Prices hold for 90 days. Licences follow the manufacturer's terms. Payment is due 30 days after delivery.")),
    ]
    compliance = section("MWBE / SDVOB Compliance", F.concat_ws("\n", kind, goals, F.lit(f"{company} will meet the participation goals of this request.")))
    last = [section("Past Performance", F.lit("[to be added]")), section("Contact Information", F.lit(company))]
    every = F.filter(F.array(*fixed, F.when(special, compliance), *last), lambda x: x.isNotNull())
    title = F.concat(F.lit("Proposal - "), "cr_number", F.lit(" - "), F.substring("title", 1, 60))
    j = rfqs.join(bids.select("cr_number", "low", "mid", "high", "confidence"), "cr_number", "left")
    return j.select("cr_number", title.alias("title"), F.transform(every, lambda x, i: F.struct((i).alias("number"), x["heading"].alias("heading"), x["text"].alias("text"))).alias("sections"))


def propose(table: DataFrame, deals: DataFrame, as_of: date, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """Proposals of analyzed requests, from bids made again [Q7, W10]."""
    todo = decoded(table).where(_due(table, keys, "analyzed"))
    out = proposals(todo, procure.bids(_asks(todo), deals), as_of)
    return {"table": table.withColumn("status", F.when(_due(table, keys, "analyzed"), "proposed").otherwise(F.col("status"))), "proposals": out}


def run_all(table: DataFrame, contacts: DataFrame, deals: DataFrame, as_of: date, crm: DataFrame | None = None, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """process, quote, analyze and propose, one after another; all outputs, and the table at the end [Q7]."""
    out: dict[str, DataFrame] = {}
    for stage in (lambda t: process(t, as_of, crm, keys), lambda t: quote(t, contacts, as_of, keys), lambda t: analyze(t, deals, keys), lambda t: propose(t, deals, as_of, keys)):
        step = stage(table)
        table = durable(step.pop("table"))
        out |= step
    return out | {"table": table}


def deep_dive(table: DataFrame, keys: list[str], contacts: DataFrame, deals: DataFrame, as_of: date, details: DataFrame | None = None, pages: DataFrame | None = None, tables: DataFrame | None = None, sheet_rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """The keys' requests from the start [W5]; with ``details`` they are first read again.

    A rescan replaces text, attachments, items and goals, null goals too, and scores again.
    A page without attachments leaves those that there are.
    """
    if details is not None:
        old = decoded(table).where(F.col("cr_number").isin(*keys))
        one = details.groupBy("cr_number").agg(F.min_by(F.struct(F.col("raw_text").alias("_raw"), "attachments", *[F.col(g).alias(f"_{g}") for g in GOALS]), "file").alias("d"))
        rows = old.join(one, "cr_number").select(*[c for c in old.columns if c not in ("line_items", "raw_text", *GOALS)], F.col("d._raw").alias("raw_text"), *[F.col(f"d._{g}").alias(g) for g in GOALS], F.when(F.size("d.attachments") > 0, F.col("d.attachments")).otherwise(F.transform("attachment_paths", lambda p: F.struct(F.lit("").alias("url"), p.alias("filename")))).alias("attachments"))
        rows = files.with_attachments(rows, pages, tables, sheet_rows)
        kind = procure.procurement_type(F.col("ad_type"))
        rows = rows.withColumns({"procurement_type": kind["procurement_type"], "is_mwbe_sdvob": kind["flagged"]})
        rows = rows.withColumn("relevance_score", procure.boosted(procure.relevance(procure.scored_text()), F.col("is_mwbe_sdvob")))
        table = procure.upserted(table, encoded(rows))
    return run_all(procure.reset(table, keys), contacts, deals, as_of, keys=keys)


def backfilled(table: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """``table`` with types from ad_type and goals from saved pages, and the ``changed`` rows, the only ones to write [W4, J8]."""
    kind = procure.procurement_type(F.col("ad_type"))
    typed = table.withColumns({"_k": kind["procurement_type"], "_f": kind["flagged"]})
    other = ~F.col("_k").eqNullSafe(F.col("procurement_type")) | ~F.col("_f").eqNullSafe(F.col("is_mwbe_sdvob"))
    typed = typed.withColumns({"_c": other, "procurement_type": F.col("_k"), "is_mwbe_sdvob": F.col("_f")}).drop("_k", "_f")
    out = procure.refreshed(typed, pages, list(GOALS)).withColumn("changed", F.col("changed") | F.col("_c")).drop("_c")
    return {"table": out.drop("changed"), "changed": out.where("changed").drop("changed")}


def status_listing(table: DataFrame, as_of: date) -> DataFrame:
    """(section, status, n, rank, cr_number, line): requests by status, in the fixed order [G3].

    A status that isn't one of the five has no section, but its rows count in the total.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in C.STATUSES]), F.col("status")).cast("int")
    goal = lambda g: F.when(F.coalesce(F.col(g), F.lit(0.0)) != 0, F.concat(F.lit(f"{g.split('_')[0].upper()}="), F.col(g).cast("string"), F.lit("%")))
    goals = F.when(F.col("is_mwbe_sdvob"), F.nullif(F.concat_ws(" ", *[goal(g) for g in GOALS]), F.lit("")))
    n = F.size("line_items")
    urgent = F.when(F.datediff("due_date", F.lit(as_of)) <= 7, " URGENT").otherwise("")
    line = F.concat(
        F.lit("CR# "), "cr_number", F.lit(" | "), F.substring("title", 1, 45), F.lit(" | Due: "), F.coalesce(F.col("due_date").cast("string"), F.lit("TBD")), urgent, F.when(F.col("is_mwbe_sdvob"), " [MWBE/SDVOB]").otherwise(""),
        F.coalesce(F.concat(F.lit(" | "), goals), F.lit("")), F.when(n > 0, F.concat(F.lit(" | "), n.cast("string"), F.lit(" items"))).otherwise(""),
    )
    rows = decoded(table).select(place.alias("section"), "status", "due_date", "cr_number", line.alias("line")).where("section > 0")
    placed = ranked_within(rows, "section", F.col("due_date").asc_nulls_first(), F.asc("cr_number"), size="n")
    return placed.select("section", "status", "n", "rank", "cr_number", "line")


def detail(table: DataFrame, cr_number: str) -> DataFrame:
    """One request's ``text`` with up to 25 items [Q4, K8]; no row for an unknown key."""
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    field = lambda label, x: F.concat(F.rpad(F.lit(f"{label}:"), 13, " "), x)
    flag = F.col("is_mwbe_sdvob")
    goals = [F.when(flag, field(f"{g.split('_')[0].upper()} Goal", F.concat(F.coalesce(F.nullif(F.col(g), F.lit(0.0)).cast("string"), F.lit("0")), F.lit("%")))) for g in GOALS]
    one = lambda x, i: F.concat_ws(" | ", F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.substring(F.coalesce(x["description"], F.lit("")), 1, 60)), F.when(F.coalesce(x["quantity"], F.lit(0.0)) != 0, F.concat(F.lit("Qty: "), x["quantity"].cast("string"))), F.when(F.coalesce(x["vendor"], F.lit("")) != "", F.concat(F.lit("Vendor: "), x["vendor"])))
    n = F.size("line_items")
    items = F.when(n > 0, F.concat_ws("\n", F.format_string("\nLine Items (%d):", n), F.array_join(F.transform(F.slice("line_items", 1, C.SHOWN_ITEMS), one), "\n"), F.when(n > C.SHOWN_ITEMS, F.format_string("  ... and %d more items", n - C.SHOWN_ITEMS))))
    head = F.concat(F.lit("CR# "), "cr_number", F.lit(": "), "title", F.when(flag, " [MWBE/SDVOB]").otherwise(""), F.lit("\n"), F.repeat(F.lit("="), 70))
    body = [field(a, t(b)) for a, b in (("Agency", "agency"), ("Division", "division"), ("Category", "category"), ("Ad Type", "ad_type"), ("Proc. Type", "procurement_type"), ("Issue Date", "issue_date"), ("Due Date", "due_date"))]
    body += [field("Score", F.format_number("relevance_score", 2)), field("Status", t("status")), *goals, F.when(t("gdrive_folder_url") != "", field("Drive", t("gdrive_folder_url"))), F.when(t("detail_url") != "", field("Page", t("detail_url")))]
    text = F.concat_ws("\n", head, *body, items, F.when(t("note") != "", F.concat(F.lit("\nNote: "), "note")))
    return decoded(table).where(F.col("cr_number") == cr_number).select("cr_number", n.alias("n_items"), text.alias("text"))
