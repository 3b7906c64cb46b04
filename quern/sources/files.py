"""Readers of saved files [A1-A10, A12, A18-A28]: feeds, listings, details, contacts, sheets.

Files are read whole by Spark's binary reader, so that any store it reaches will do, and
parsed with the standard library in Arrow batches; a file that can't be parsed gives no
rows and one row in the error report.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from datetime import datetime
from functools import partial, reduce
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern import config as C
from quern.functions import text as T
from quern.functions.html import HtmlElements, Node, parse_html
from quern.operators.graph import durable
from quern.operators.order import numbered

STORY = "title string, url string, published array<string>, snippet string, content string, author string, tags array<string>"
ATTACHMENTS = "array<struct<url:string,filename:string>>"


def _scan(spark: SparkSession, path: str, parse: Callable[[str, bytes], list[dict]], schema: str, most: int | None = None) -> DataFrame:
    """Rows of all files under ``path`` (of ``most`` bytes), with ``file`` and ``item_ord``; failures have ``error``."""
    names = [c.strip().split()[0] for c in _columns(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = parse(file, bytes(content))
                    rows += [dict.fromkeys(names) | {"file": file, "item_ord": i, "error": None} | r for i, r in enumerate(found)]
                except Exception as e:  # noqa: BLE001  a broken file is recorded, as a source that fails is
                    rows.append(dict.fromkeys(names) | {"file": file, "item_ord": -1, "error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(rows, columns=["file", "item_ord", "error", *names], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = (files if most is None else files.where(F.col("length") <= most)).select("path", "content")
    return files.mapInPandas(run, f"file string, item_ord long, error string, {schema}")


def _columns(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]





def _feed(file: str, content: bytes) -> list[dict]:
    root = ET.fromstring(content)
    local = lambda e: e.tag.rpartition("}")[2]
    out = []
    for e in root.iter():
        if local(e) not in ("item", "entry"):
            continue
        kids: dict[str, list] = {}
        for c in e:
            kids.setdefault(local(c), []).append(c)
        text = lambda *names: next((("".join(k.itertext())).strip() for n in names for k in kids.get(n, []) if "".join(k.itertext()).strip()), None)  # noqa: E731, B023
        title = text("title")
        if not title:
            continue
        link = text("link") or next((k.get("href") for k in kids.get("link", []) if k.get("href")), "")
        tags = [t for t in (k.get("term") or (k.text or "").strip() for k in kids.get("category", [])) if t]
        out.append({"title": title, "url": link, "published": [t for t in map(text, ("pubDate", "published", "updated", "date")) if t], "snippet": text("description", "summary"), "content": text("encoded", "content"), "author": text("author", "creator"), "tags": tags})
    return out


def _first_date(texts: Column) -> Column:
    """The first of several date texts that can be parsed [A4]."""
    return F.get(F.filter(F.transform(texts, T.parse_timestamp), lambda x: x.isNotNull()), 0)


def _finished(raw: DataFrame, source: str, section: str | None, extra_tags: list[str]) -> DataFrame:
    clean = lambda c: F.nullif(T.clean_text(T.strip_html(F.col(c))), F.lit(""))
    return raw.select(
        F.lit(source).alias("source"), T.clean_text(F.col("title")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), _first_date(F.col("published")).alias("published_at"),
        "author", F.lit(section).cast("string").alias("section"), clean("snippet").alias("snippet"), clean("content").alias("content"),
        F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*[F.lit(t) for t in extra_tags]).cast("array<string>")).alias("tags"), "file", "item_ord", "error",
    )


#: Bytes up to which a feed is parsed as a whole; a larger one is split, and its records are parsed by Spark.
WHOLE = 64 << 20
_XML = (
    "title string, link array<struct<_VALUE:string,_href:string>>, pubDate string, published string, updated string, date string, description string, summary string, encoded string,"
    " content string, author string, creator string, category array<struct<_VALUE:string,_term:string>>, _corrupt_record string"
)


def _split_feed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The items and entries of large feeds, a record at a time; one that is malformed is an error row, not its whole file."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = lambda *names: F.coalesce(*[blank(n) for n in names])
    filled = lambda x: F.nullif(F.trim(x), F.lit(""))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}

    atom = [p for p in paths if any("<feed" in r["value"] for r in spark.read.text(p, lineSep=">").limit(20).collect())]  # by the first tags

    def read(tag: str, paths: list[str]) -> DataFrame:
        """Text cut after each end tag, a cut that Spark finds in any part of a file."""
        record = F.nullif(F.regexp_extract("value", f"(?s)<{tag}[\\s>].*$", 0), F.lit(""))
        cut = spark.read.text(paths, lineSep=f"</{tag}>").select(F.concat(record, F.lit(f"</{tag}>")).alias("x"), *place)
        return cut.where("x IS NOT NULL").select(F.from_xml("x", _XML, options).alias("r"), "file", "_block", "_id").select("r.*", "file", "_block", "_id")

    kinds = [read(tag, own) for tag, own in (("item", [p for p in paths if p not in atom]), ("entry", atom)) if own]
    rows = reduce(lambda a, b: a.unionByName(b), kinds)
    links = F.filter(F.transform("link", lambda x: filled(x["_VALUE"])), lambda x: x.isNotNull())
    hrefs = F.filter(F.transform("link", lambda x: x["_href"]), lambda x: F.coalesce(x, F.lit("")) != "")
    terms = F.transform("category", lambda x: F.coalesce(x["_term"], filled(x["_VALUE"])))
    dates = F.array(*[blank(c) for c in ("pubDate", "published", "updated", "date")])
    error = F.when(F.col("_corrupt_record").isNotNull(), "malformed record")
    out = rows.where(first("title").isNotNull() | F.col("_corrupt_record").isNotNull()).select(
        "file", "_block", "_id", error.alias("error"), first("title").alias("title"), F.coalesce(F.get(links, 0), F.get(hrefs, 0), F.lit("")).alias("url"),
        F.filter(dates, lambda x: x.isNotNull()).alias("published"), first("description", "summary").alias("snippet"), first("encoded", "content").alias("content"),
        F.nullif(F.trim(F.regexp_replace(first("author", "creator"), "<[^>]*>", "")), F.lit("")).alias("author"),
        F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("tags"),
    )
    placed = numbered(out, F.col("file"), F.col("_block"), F.col("_id"))
    begun = placed.groupBy("file").agg(F.min("place").alias("_first"))
    return placed.join(begun, "file").withColumn("item_ord", F.when(F.col("error").isNull(), F.col("place") - F.col("_first")).otherwise(-1)).drop("place", "_first", "_block", "_id")


def feed(spark: SparkSession, path: str, source: str, section: str | None = None, tags: tuple[str, ...] = (), whole: int = WHOLE) -> DataFrame:
    """RSS or Atom files as raw stories [A3-A7]; ``tags`` are appended (``official``).

    A file that can't be read is one row with ``error`` and without a title, for the run's
    report. Files over ``whole`` bytes are read record by record, by many tasks.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = [r["path"] for r in listed.where(F.col("length") > whole).select("path").collect()]  # names of the few that are that large
    raw = _scan(spark, path, _feed, STORY, whole if large else None)
    if large:
        raw = raw.unionByName(_split_feed(spark, large), allowMissingColumns=True)
    return _finished(raw, source, section, list(tags))


def cards_in(html: str, cards: str, host: str = "", snippet: str = "") -> list[dict]:
    """The cards of a page that have a link and a title, as raw stories [A8-A10]."""
    out = []
    for card in parse_html(html).find(cards):
        links = card.find("a[href]")
        if not links:
            continue
        href = links[0].attrs["href"]
        heads = card.find("h1,h2,h3,h4")
        title = (heads[0].text() if heads else "") or links[0].text()
        if not title:
            continue
        times = card.find("time")
        when = (times[0].attrs.get("datetime") or times[0].text()) if times else None
        notes = card.find(snippet) if snippet else []
        url = host + href if host and not href.startswith("http") else href
        out.append({"title": title, "url": url, "published": [when] if when else [], "snippet": notes[0].text() if notes else None, "content": None, "author": None, "tags": []})
    return out


def listing(spark: SparkSession, path: str, source: str, host: str, cards: str, section: str | None = None, tags: tuple[str, ...] = (), snippet: str = ".description,.summary,p") -> DataFrame:
    """Cards of saved HTML listings [A8-A10]. An empty host leaves links relative."""

    parse = lambda file, content: cards_in(content.decode(errors="replace"), cards, host, snippet)
    return _finished(_scan(spark, path, parse, STORY), source, section, list(tags))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The fallback's rows if the primary scan has none [A10]."""
    none = primary.where("error IS NULL").limit(1).agg((F.count("*") == 0).alias("_none"))
    return primary.unionByName(fallback.join(F.broadcast(none)).where("_none").drop("_none"))


def fan_in(sources: list[DataFrame]) -> DataFrame:
    """Sources one after another, in list order, with ``ord`` [A1, A12, U1, T2].

    Order is that of the list, then of file paths, then of items in a file; ``ord`` is
    unique. Files are numbered in sorted ranges, so no task sees all of them.
    """
    return _in_order(reduce(lambda a, b: a.unionByName(b), [s.withColumn("source_ord", F.lit(i)) for i, s in enumerate(sources)]))


def _in_order(every: DataFrame) -> DataFrame:
    places = numbered(every.select(F.col("source_ord").alias("_s"), F.col("file").alias("_f")).distinct(), F.col("_s"), F.col("_f"), name="_n")
    fits = F.col("item_ord") < (1 << 24) - 1
    ord_ = F.when(fits, F.col("_n") * F.lit(1 << 24) + F.col("item_ord") + 1).otherwise(F.raise_error(F.lit("a file has more than 16 million items")))
    return every.join(places, (F.col("source_ord") == F.col("_s")) & (F.col("file") == F.col("_f"))).withColumn("ord", ord_.cast("long")).drop("_s", "_f", "_n", "source_ord")


def sound(rows: DataFrame) -> DataFrame:
    """Rows of the files that could be read."""
    return rows.where("error IS NULL").drop("error")


class Counters:
    """What a scan finds, counted by the one run that reads it [A12, G18].

    Put ``of(rows)`` into the plan; after a job has run it, ``report`` has each source's
    status, rows and an error, those without a row, too. A source failed if none of its
    files could be read. Spark runs all scans as one job, so there's no time per source.
    """

    def __init__(self, names: list[str]):
        self.names, self._seen = list(dict.fromkeys(names)), Observation()

    def of(self, rows: DataFrame) -> DataFrame:
        sound_ = F.col("error").isNull() if "error" in rows.columns else F.lit(True)
        error = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
        per = [x for i, n in enumerate(self.names) for x in (F.count_if((F.col("source") == n) & sound_).alias(f"n{i}"), F.min(F.when(F.col("source") == n, error)).alias(f"e{i}"))]
        return rows.observe(self._seen, F.count_if(sound_).alias("n"), *per)

    @property
    def total(self) -> int:
        return self._seen.get["n"]

    def report(self, spark: SparkSession) -> DataFrame:
        got = self._seen.get
        rows = [(n, "error" if not got[f"n{i}"] and got[f"e{i}"] is not None else "ok", got[f"n{i}"], got[f"e{i}"]) for i, n in enumerate(self.names)]
        return spark.createDataFrame(rows, "source string, status string, raw_count long, error string")


def source_report(rows: DataFrame, names: list[str]) -> DataFrame:
    """(source, status, raw_count, error) of every source in ``names`` [A12]; runs the scan."""
    seen = Counters(names)
    seen.of(rows.select("source", "error")).write.format("noop").mode("overwrite").save()
    return seen.report(rows.sparkSession)


CARD = "cr_number string, title string, agency string, division string, issue_date string, due_date string, ad_end_date string, location string, category string, ad_type string, note string, detail_url string"
LABELS = {"cr#": "cr_number", "agency": "agency", "division": "division", "issue date": "issue_date", "due date": "due_date", "ad end date": "ad_end_date", "location": "location", "category": "category", "ad type": "ad_type"}


def rfq_cards(spark: SparkSession, path: str, host: str = "", max_pages: int = 0) -> DataFrame:
    """Opportunity cards of saved listing pages [A18-A20]; a folder holds the pages.

    Pages come by the last number in their name, then by path, and end with the first that
    has no button to the next, or after ``max_pages`` (0: no limit).
    """

    def parse(file: str, content: bytes) -> list[dict]:
        page = parse_html(content.decode(errors="replace"))
        more = any("disabled" not in b.attrs for b in page.find("button.Next"))
        out = [{"cr_number": "", "more": more}]
        for card in page.find("div.opp-list-item[data-ad-id]"):
            row = dict.fromkeys(LABELS.values(), "") | {"cr_number": card.attrs["data-ad-id"], "title": "", "note": "", "detail_url": ""}
            for bar in card.find("div.bg-primary.text-light")[:1]:
                full = bar.attrs.get("title", "")
                full = full.removeprefix("Full Title:").strip()
                row["title"] = " ".join(full.split()) or bar.text()
            for label in card.find("div.w-exact-8"):
                peers = label.up.children
                after = [p for p in peers[peers.index(label) + 1 :] if isinstance(p, Node) and p.tag == "div"]
                key = LABELS.get(label.text().rstrip(":").lower())
                if key and after:
                    row[key] = after[0].text()
            row["note"] = next((n.text() for n in card.find("div.alert")), "")
            href = next((n.attrs.get("href", "") for n in card.find("a.ad-action-link")), "")
            good = href and "/Account/Login" not in href
            row["detail_url"] = (href if href.startswith("http") else host + href) if good else f"{host}/Ads/View?ID={card.attrs['data-ad-id']}"
            if row["cr_number"]:
                out.append(row)
        return out

    rows = durable(_scan(spark, path, parse, f"{CARD}, more boolean").where("error IS NULL"))
    number = F.coalesce(F.regexp_extract("file", "([0-9]+)[^0-9/]*$", 1).try_cast("long"), F.lit(0))
    pages = numbered(rows.where("more IS NOT NULL").select("file", "more", number.alias("number")), F.col("number"), F.col("file"))
    last = pages.agg(F.coalesce(F.min(F.when(~F.col("more"), F.col("place"))), F.max("place")).alias("last"))
    limit = F.least(F.col("last"), F.lit(max_pages - 1)) if max_pages else F.col("last")
    read = pages.join(F.broadcast(last)).where(F.col("place") <= limit).select("file")
    rows = rows.where("cr_number <> ''").join(read, "file", "left_semi").drop("more")
    return rows.withColumns({c: T.parse_date(F.col(c)) for c in ("issue_date", "due_date", "ad_end_date")})



#: What marks an attachment's address (fixed values).
MARKERS = ("Step6Download", "GeneratePdf")


def detail_in(html: str, markers: tuple[str, ...], host: str = "") -> dict:
    """A page's text (up to 50,000 characters) and its attachments: distinct addresses with a marker, the first kept [A21, U4]."""
    page = parse_html(html)
    found: dict[str, str] = {}
    for a in page.find("a[href]"):
        href = a.attrs["href"]
        if any(m in href for m in markers):
            url = href if href.startswith("http") else host + href
            found.setdefault(url, a.attrs.get("download") or href.split("/")[-1].split("?")[0] or "attachment")
    return {"raw_text": page.text()[:50000], "attachments": [{"url": u, "filename": f} for u, f in found.items()]}


@F.udtf(returnType=f"item_ord int, {STORY}", useArrow=True)
class HtmlCards:
    """``html_cards(html, cards, host, snippet)``: the cards of a page [A8-A10]; null has none."""

    def eval(self, html: str, cards: str, host: str, snippet: str):
        for i, card in enumerate(cards_in(html or "", cards, host, snippet)):
            yield (i, *(card[c] for c in ("title", "url", "published", "snippet", "content", "author", "tags")))


@F.udtf(returnType=f"raw_text string, attachments {ATTACHMENTS}", useArrow=True)
class HtmlDetail:
    """``html_detail(html, markers, host)``: text and attachments of a page [A21]; markers by commas."""

    def eval(self, html: str, markers: str, host: str):
        got = detail_in(html or "", tuple(markers.split(",")), host)
        yield got["raw_text"], got["attachments"]


def register(spark: SparkSession) -> None:
    """The functions over columns of html for SQL, to be used laterally."""
    spark.udtf.register("html_elements", HtmlElements)
    spark.udtf.register("html_cards", HtmlCards)
    spark.udtf.register("html_detail", HtmlDetail)


def rfq_details(spark: SparkSession, path: str, markers: tuple[str, ...] = MARKERS, host: str = "") -> DataFrame:
    """cr_number (from ``detail_<key>.html``), raw_text (up to 50,000), attachments (distinct addresses, first kept), goals [A21, S14, U4]."""

    def parse(file: str, content: bytes) -> list[dict]:
        html = content.decode(errors="replace")
        return [detail_in(html, markers, host) | {"html": html}]

    rows = _scan(spark, path, parse, f"raw_text string, attachments {ATTACHMENTS}, html string").where("error IS NULL")
    rows = rows.withColumn("cr_number", F.regexp_extract("file", "(?:detail_)?([^/]*)\\.[^./]*$", 1))
    return rows.withColumns({f"{g}_goal": T.goal(F.col("html"), g) for g in ("sdvob", "mbe", "wbe")}).drop("html")


def assembled(cards: DataFrame, details: DataFrame, as_of: datetime, site: str = "nyscr") -> DataFrame:
    """Requests from listing cards and detail pages [A22]: every card once, with its detail's text, attachments and goals if there is one.

    Keyed by cr_number; a key's first card, by file and place, wins, and a page without a
    card is left out.
    """
    first = cards.groupBy("cr_number").agg(F.min_by(F.struct(*[c for c in cards.columns if c != "cr_number"]), F.struct("file", "item_ord")).alias("c"))
    one = details.groupBy("cr_number").agg(F.min_by(F.struct("raw_text", "attachments", "sdvob_goal", "mbe_goal", "wbe_goal"), "file").alias("d"))
    text = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit("")).alias(c)
    return first.join(one, "cr_number", "left").select(
        "cr_number", *[text(c) for c in ("title", "agency", "category", "division", "location", "ad_type", "note", "detail_url")], "c.issue_date", "c.due_date", "c.ad_end_date",
        F.lit(site).alias("source_site"), F.coalesce("d.raw_text", F.lit("")).alias("raw_text"), F.coalesce("d.attachments", F.array().cast(ATTACHMENTS)).alias("attachments"),
        "d.sdvob_goal", "d.mbe_goal", "d.wbe_goal", F.lit(as_of).cast("timestamp").alias("created_at"),
    )


ITEM = "struct<description:string,quantity:double,unit:string,part_number:string,vendor:string,unit_price:double,extended_price:double,notes:string>"


def with_attachments(rfqs: DataFrame, pages: DataFrame, tables: DataFrame, sheet_rows: DataFrame) -> DataFrame:
    """``rfqs`` (cr_number, raw_text, attachments) with ``line_items``, and PDF text after their own [A26, A27].

    Attachments are routed by the ending of their names. pages: (filename, page, text) and
    tables: (filename, table_idx, row_idx, cells) of PDFs, extracted before; sheet_rows:
    (file, row_idx, cells) of sheets, by the last part of their path. Texts of files come
    in the order of attachments, pages under one another; so do items.
    """
    listed = rfqs.select("cr_number", F.posexplode("attachments").alias("at", "a")).select("cr_number", "at", F.col("a.filename").alias("filename"), F.lower("a.filename").alias("low"))
    pdf, sheet = F.col("low").endswith(".pdf"), F.col("low").rlike("\\.(xlsx|xls|csv)$")
    text = pages.groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
    texts = listed.where(pdf).join(text, "filename").groupBy("cr_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n\n").alias("more"))
    of_tables = line_items(tables.withColumn("file", F.concat_ws("\x01", "filename", F.col("table_idx").cast("string"))), C.TABLE_ALIASES, first_rows=1, normal=table_header, least=1, needs="description")
    of_tables = of_tables.withColumns({"filename": F.split("file", "\x01")[0], "part": F.split("file", "\x01")[1].cast("int")})
    of_sheets = line_items(sheet_rows).withColumns({"filename": F.regexp_extract("file", "([^/]*)$", 1), "part": F.lit(0)})
    item = F.struct("at", "part", "row_idx", *C.SHEET_ALIASES).alias("x")
    found = listed.where(pdf).join(of_tables, "filename").select("cr_number", item).unionByName(listed.where(sheet).join(of_sheets, "filename").select("cr_number", item))
    fields = ("description", "quantity", "unit", "part_number", "vendor", "unit_price", "extended_price")
    items = found.groupBy("cr_number").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(*[x[f].alias(f) for f in fields], F.lit("").alias("notes"))).alias("line_items"))
    out = rfqs.join(texts, "cr_number", "left").join(items, "cr_number", "left")
    raw = F.when(F.col("more").isNotNull(), F.concat(F.coalesce("raw_text", F.lit("")), F.lit("\n\n--- ATTACHMENTS ---\n\n"), "more")).otherwise(F.col("raw_text"))
    return out.withColumns({"raw_text": raw, "line_items": F.coalesce("line_items", F.array().cast(f"array<{ITEM}>"))}).drop("more")


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """The contact list [A24]: header row, optional byte-order mark, stripped cells."""
    names = ["distributor_name", "rep_name", "rep_email", "vendor", "product_line", "notes"]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names), enforceSchema=True)
    return raw.select(*[F.coalesce(F.trim(n), F.lit("")).alias(n) for n in names])


def _cells(file: str, content: bytes) -> list[list[str]]:
    if file.lower().endswith(".csv"):
        return list(csv.reader(io.StringIO(content.decode("utf-8-sig", errors="replace"))))
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rows = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{{{ns['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        for name in sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet")):
            for r in ET.fromstring(z.read(name)).iter(f"{{{ns['m']}}}row"):
                row: list[str] = []
                for c in r.findall("m:c", ns):
                    letters = re.match(r"[A-Z]+", c.get("r", "")) or [""]
                    at = reduce(lambda n, ch: n * 26 + ord(ch) - 64, letters[0], 0) - 1
                    v = c.find("m:v", ns)
                    value = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    row += [""] * (max(at, len(row)) - len(row)) + [shared[int(value)] if c.get("t") == "s" and value else value]
                rows.append(row)
    return rows


def sheets(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, cells) of CSV and XLSX files [A25]."""
    rows = _scan(spark, path, lambda f, c: [{"cells": r} for r in _cells(f, c)], "cells array<string>")
    return rows.where("error IS NULL").select("file", F.col("item_ord").alias("row_idx"), F.transform("cells", lambda x: F.coalesce(x, F.lit(""))).alias("cells"))


def sheet_header(x: Column) -> Column:
    return F.lower(F.trim(x))


def table_header(x: Column) -> Column:
    """A header cell of a PDF's table: its lower-case letters and digits [S12]."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def line_items(rows: DataFrame, aliases: dict[str, tuple[str, ...]] = C.SHEET_ALIASES, first_rows: int = 15, normal: Callable = sheet_header, least: int = 2, needs: str | None = None) -> DataFrame:
    """Line items of sheets whose header is among the first rows [S9-S13, T16-T18].

    The header is the first row with ``least`` cells or more that contain an alias, and
    one for the role ``needs`` if that is given; a role's column is its leftmost such
    cell. Headers, one row a file, join back by file.
    """
    holds = lambda x, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda a: F.contains(x, a))
    every = sorted({w for ws in aliases.values() for w in ws})
    cells = rows.withColumn("head", F.transform("cells", lambda x: normal(F.coalesce(x, F.lit("")))))
    hits = F.size(F.filter("head", lambda x: holds(x, every))) >= least
    if needs:
        hits = hits & F.exists("head", lambda x: holds(x, aliases[needs]))
    header = cells.where((F.col("row_idx") < first_rows) & hits).groupBy("file").agg(F.min_by("head", "row_idx").alias("head"), F.min("row_idx").alias("at"))
    spot = lambda words: F.array_min(F.filter(F.transform("head", lambda x, i: F.when(holds(x, words), i)), lambda i: i.isNotNull()))
    roles = header.select("file", "at", *[spot(w).alias(f"_{r}") for r, w in aliases.items()])
    j = rows.join(roles, "file").where("row_idx > at")
    cell = lambda r: F.trim(F.coalesce(F.get("cells", F.col(f"_{r}")), F.lit("")))
    number = ("quantity", "unit_price", "extended_price")
    return j.select("file", "row_idx", *[(T.safe_float(cell(r)) if r in number else cell(r)).alias(r) for r in aliases]).where("description <> ''")


def won_deals(deals: DataFrame, tag: str | None = None, n: int = 300) -> DataFrame:
    """Won deals, latest first, up to the limit of the source [A28]. deals: is_won, name, description, expected_revenue, date_closed, tags."""
    rows = deals.where("is_won")
    rows = rows if tag is None else rows.where(F.exists("tags", lambda t: F.lower(t).contains(tag.lower())))
    return rows.orderBy(F.desc("date_closed"), "name").limit(n)


def deal_of(deals: DataFrame, cr_number: str) -> DataFrame:
    """The first deal, by id, whose name holds the key in brackets, or no row [A29]."""
    return deals.where(F.contains(F.lower("name"), F.lit(f"[{cr_number}]".lower()))).orderBy("id").limit(1)


class Adapter(ABC):
    """A source of raw stories or of requests: a name and a scan [A2, A23]."""

    name: str

    @abstractmethod
    def scan(self, spark: SparkSession) -> DataFrame:
        """Rows with ``source``, ``file``, ``item_ord`` and ``error``."""


class Scan(Adapter):
    """An adapter made of a function, such as a partial of ``feed`` or ``listing``."""

    def __init__(self, name: str, read: Callable[[SparkSession], DataFrame]):
        self.name, self._read = name, read

    def scan(self, spark: SparkSession) -> DataFrame:
        return self._read(spark)


#: Card selectors, hosts and sections of saved HTML listings (fixed values), and the sources in their order [A1].
SOURCES = ("wgrz", "spectrum_buffalo", "city_of_buffalo", "ub", "wkbw", "wgr550", "wivb")
CARDS = {"wkbw": "article,.story-card,.card-content", "wgr550": "article,.content-card,[data-testid='content-card'],.topic-card", "wivb": "article,.article-list__article"}


def registry(root: str, cards: dict[str, str] | None = None) -> list[Adapter]:
    """The adapters in their fixed order, reading saved files under ``root``/<source> [A1, A6-A10].

    Two sources are HTML listings, one is a feed with a listing (``root``/<source>_html) to
    fall back on, one is tagged official; the others are feeds.
    """
    select = CARDS | (cards or {})
    page = lambda n, **k: partial(listing, path=f"{root}/{n}", source=n, cards=select[n], **k)
    read: dict[str, Callable[[SparkSession], DataFrame]] = {n: partial(feed, path=f"{root}/{n}", source=n) for n in SOURCES}
    read["city_of_buffalo"] = partial(feed, path=f"{root}/city_of_buffalo", source="city_of_buffalo", tags=("official",))
    read["wkbw"] = page("wkbw", host="https://www.wkbw.com")
    read["wgr550"] = page("wgr550", host="https://www.audacy.com", section="sports", tags=("sports",), snippet="p")
    primary, other = read["wivb"], partial(listing, path=f"{root}/wivb_html", source="wivb", host="", cards=select["wivb"], section="news", snippet="")
    read["wivb"] = lambda spark: with_fallback(primary(spark), other(spark))
    return [Scan(n, read[n]) for n in SOURCES]


def source_list(spark: SparkSession) -> DataFrame:
    """(ord, source, kind, priority): the sources in their order, and how they are read [Q9]."""
    kind = lambda n: "feed, else html" if n == "wivb" else "html" if n in CARDS else "feed"
    return spark.createDataFrame([(i, n, kind(n), C.SOURCE_PRIORITY.get(n, C.SOURCE_DEFAULT)) for i, n in enumerate(SOURCES)], "ord int, source string, kind string, priority double")


def fetched(spark: SparkSession, adapters: list[Adapter]) -> dict[str, DataFrame]:
    """``rows`` of all adapters in order, with ``ord``, and their ``report`` [A1, A12]; files are read once."""
    names = [a.name for a in adapters]
    seen = Counters(names)
    scans = [a.scan(spark).withColumn("source_ord", F.lit(i)) for i, a in enumerate(adapters)]
    every = durable(seen.of(reduce(lambda a, b: a.unionByName(b), scans)))
    return {"rows": sound(_in_order(every)), "report": seen.report(spark)}
