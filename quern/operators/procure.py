"""Procurement: classification, disposition, matching, bids, keyed state [F9-F14, J2-J4, J8, G10-G16, W1-W5, W10]."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import config as C
from quern.functions import rules as R
from quern.functions.fuzzy import token_set_ratio

from .graph import durable


def has(x: Column, *words: str) -> Column:
    out = F.contains(x, F.lit(words[0]))
    for w in words[1:]:
        out = out & F.contains(x, F.lit(w))
    return out


def procurement_type(ad_type: Column) -> Column:
    """(type, flagged), from the most special rule to none [F9]."""
    x = F.lower(F.coalesce(ad_type, F.lit("")))
    kind = lambda t, f: F.struct(F.lit(t).alias("procurement_type"), F.lit(f).alias("flagged"))
    rules = [
        (has(x, "mwbe", "sdvob", "discretionary"), kind("mwbe_sdvob_discretionary", True)),
        (has(x, "sdvob", "set", "aside"), kind("sdvob_set_aside", True)),
        (has(x, "sdvob", "discretionary"), kind("sdvob_discretionary", True)),
        (has(x, "mwbe", "discretionary"), kind("mwbe_discretionary", True)),
        (has(x, "discretionary"), kind("discretionary", False)),
        (has(x, "continuous"), kind("continuous", False)),
    ]
    return R.first_match(rules, kind("general", False))


def competitive(ad_type: Column) -> Column:
    return ~R.any_keyword(F.lower(F.coalesce(ad_type, F.lit(""))), C.EXCLUDED_TYPES)


def relevance(text: Column, keywords: tuple[str, ...] = C.RELEVANCE) -> Column:
    """Distinct hits over 15% of the vocabulary, at most 1 [F11]."""
    return _relevance(F.lower(text), keywords)


def _relevance(lowered: Column, keywords: tuple[str, ...] = C.RELEVANCE) -> Column:
    return F.least(R.keyword_hits(lowered, keywords) / F.lit(max(len(keywords) * 0.15, 1.0)), F.lit(1.0))


def boosted(score: Column, flagged: Column) -> Column:
    return F.when(flagged, F.least(score + F.lit(C.BOOST), F.lit(1.0))).otherwise(score)


def urgency(days: Column) -> Column:
    """[F13]"""
    return R.first_match([(days.isNull(), "unknown"), (days < 0, "expired"), (days <= 3, "critical"), (days <= 7, "urgent"), (days <= 14, "normal")], "low")


def derived(rfqs: DataFrame, as_of: date) -> DataFrame:
    """days_until_due, is_urgent and folder_name [S16]."""
    days = F.datediff("due_date", F.lit(as_of))
    name = F.concat("cr_number", F.lit(" - "), F.rtrim(F.substring("title", 1, 60)), F.lit(" - "), "agency")
    return rfqs.withColumns({"days_until_due": days, "is_urgent": F.coalesce(days <= 7, F.lit(False)), "folder_name": name})


def scored_text() -> Column:
    """What relevance is read from [F11]."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "category", "agency")], F.substring(F.coalesce("raw_text", F.lit("")), 1, 5000), F.coalesce("note", F.lit("")))


def first_of(rows: DataFrame, key: str) -> DataFrame:
    """One row per key: the first by ``ord`` if there is one, else the least by its columns that can be compared.

    Only rows whose key comes twice are moved and sorted.
    """
    again = durable(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    n = again.count()
    if not n:
        return rows
    again = F.broadcast(again) if n <= 100_000 else again
    same = F.col(key).eqNullSafe(F.col("_key"))
    once, rows = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
    able = [c for c, kind in rows.dtypes if not kind.startswith(("map", "array<map", "variant")) and c not in ("ord", key)]
    order = Window.partitionBy(key).orderBy(*(["ord"] if "ord" in rows.columns else []), *able)
    return once.unionByName(rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place"))


def disposed(new: DataFrame, stored: DataFrame, as_of: date, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows whose key isn't stored, classified, with ``disposition`` [F14, J4]. All are stored as new [T12].

    Of a key that comes twice the first counts: by ``ord`` if there is one, else the least row.
    Rows that pass the first two rules are enriched, as with their attachments, and scored;
    the others keep a score of 0 and what they came with.
    """
    kind = procurement_type(F.col("ad_type"))
    soon = F.coalesce(F.datediff("due_date", F.lit(as_of)) < C.MIN_DAYS, F.lit(False))
    early = R.first_match([(~competitive(F.col("ad_type")), "not_competitive"), (soon, "due_too_soon")], F.lit(None).cast("string"))
    fresh = lambda rows: rows.join(stored.select("cr_number"), "cr_number", "left_anti")
    rows = first_of(new, "cr_number").withColumns({"procurement_type": kind["procurement_type"], "is_mwbe_sdvob": kind["flagged"], "disposition": early})
    if enrich is None:
        # Scored before they are moved, so that texts needn't be; lowered once for all words.
        rows = rows.withColumn("_said", F.when(F.col("disposition").isNull(), F.lower(scored_text())))
        scored = rows.withColumn("relevance_score", F.when(F.col("disposition").isNull(), boosted(_relevance(F.col("_said")), F.col("is_mwbe_sdvob"))).otherwise(0.0)).drop("_said")
        kept = F.when(F.col("relevance_score") >= C.RELEVANT, "kept").otherwise("not_relevant")
        return fresh(scored.withColumns({"disposition": F.coalesce("disposition", kept), "status": F.lit("new")}))
    rows, score = fresh(rows), boosted(relevance(scored_text()), F.col("is_mwbe_sdvob"))
    passed = enrich(rows.where("disposition IS NULL")).withColumn("relevance_score", score)
    passed = passed.withColumn("disposition", F.when(F.col("relevance_score") >= C.RELEVANT, "kept").otherwise("not_relevant"))
    out = passed.unionByName(rows.where("disposition IS NOT NULL").withColumn("relevance_score", F.lit(0.0)), allowMissingColumns=True)
    return out.withColumn("status", F.lit("new"))


def upserted(table: DataFrame, batch: DataFrame, key: str = "cr_number") -> DataFrame:
    """The table with the batch's values in place of or beside its own [W1].

    A batch's last row of a key wins: by ``ord`` if it has one, else the greatest by its
    columns in order. Columns that the batch lacks keep their values; in new rows they are
    null. ``table`` has every column of the batch but ``ord``, and each key once.
    """
    cols = [c for c in batch.columns if c != "ord"]
    whole = F.struct(*cols)
    last = batch.groupBy(key).agg(F.max_by(whole, F.struct("ord", *cols) if "ord" in batch.columns else whole).alias("b"))
    j = table.select(F.col(key), F.struct(*table.columns).alias("t")).join(last, key, "full")
    value = lambda c: F.when(F.col("b").isNotNull(), F.col("b")[c]).otherwise(F.col("t")[c]) if c in cols else F.col("t")[c]
    return j.select(*[value(c).alias(c) for c in table.columns])


def migrated(table: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Missing columns added with their type and default [W11]."""
    return table.withColumns({c: F.lit(v).cast(t) for c, (t, v) in columns.items() if c not in table.columns})


def with_status(table: DataFrame, moves: DataFrame) -> DataFrame:
    """Statuses from (cr_number, status, and ord if there is one); unknown statuses are refused by being left out [W2, W3].

    Of several moves of a key the last by ``ord`` counts, else the one furthest along.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in C.STATUSES]), F.col("status"))
    by = F.struct("ord", place) if "ord" in moves.columns else place
    ok = moves.where(F.col("status").isin(*C.STATUSES)).groupBy("cr_number").agg(F.max_by("status", by).alias("_s"))
    return table.join(ok, "cr_number", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


#: Columns that a point update may set (fixed values).
FIELDS = ("procurement_type", "is_mwbe_sdvob", "sdvob_goal", "mbe_goal", "wbe_goal", "relevance_score", "odoo_lead_id", "gdrive_folder_id", "gdrive_folder_url", "status", "raw_text")


def with_field(table: DataFrame, cr_number: str, field: str, value) -> DataFrame:
    """One field of one key set [W2]; a field that may not be set is an error."""
    if field not in FIELDS or field not in table.columns:
        raise ValueError(f"not a column that can be set: {field}")
    return table.withColumn(field, F.when(F.col("cr_number") == cr_number, F.lit(value).cast(table.schema[field].dataType)).otherwise(F.col(field)))


def reset(table: DataFrame, cr_numbers: list[str], to: str = "new") -> DataFrame:
    """The keys' rows back at a stage before the last [W3]; keys that aren't there change nothing."""
    if to not in C.STATUSES[:-1]:
        raise ValueError(f"can't reset to {to}")
    return table.withColumn("status", F.when(F.col("cr_number").isin(*cr_numbers), F.lit(to)).otherwise(F.col("status")))


def next_status(status: Column, action: Column, items: Column, matches: Column) -> Column:
    """A stage's effect on a row [W3, T13]."""
    return R.first_match(
        [
            ((action == "process") & (status == "new"), "processed"),
            ((action == "quote") & (status == "processed") & (items > 0) & (matches > 0), "quoted"),
            ((action == "analyze") & status.isin("quoted", "processed"), "analyzed"),
            ((action == "propose") & (status == "analyzed"), "proposed"),
        ],
        status,
    )


def refreshed(stored: DataFrame, pages: DataFrame, goals: list[str]) -> DataFrame:
    """Stored rows with goals from saved pages, and ``changed`` [J8, W4]: only parsed, different values."""
    p = pages.select("cr_number", *[F.col(g).alias(f"_{g}") for g in goals])
    j = stored.join(p, "cr_number", "left")
    moved = [F.col(f"_{g}").isNotNull() & ~F.col(f"_{g}").eqNullSafe(F.col(g)) for g in goals]
    changed = moved[0]
    for m in moved[1:]:
        changed = changed | m
    return j.withColumn("changed", changed).withColumns({g: F.coalesce(f"_{g}", g) for g in goals}).drop(*[f"_{g}" for g in goals])


def cost(items: Column) -> Column:
    """Price or 0, times quantity or 1, over line items; a quantity of 0 is 1 [G13, T9]."""
    one = lambda x: F.coalesce(x["unit_price"], F.lit(0.0)) * F.coalesce(F.nullif(x["quantity"], F.lit(0.0)), F.lit(1.0))
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + one(x))


def fallback(total: Column, digits: int = 2) -> dict[str, Column]:
    """[G14]"""
    return {k: F.round(total * m, digits) for k, m in (("low", 1.08), ("mid", 1.15), ("high", 1.25))} | {"confidence": F.lit("low")}


def tokens(text: Column) -> Column:
    """Distinct words of three letters or more, without stop words [U3]."""
    words = F.regexp_extract_all(F.lower(text), F.lit("\\b[a-z]{3,}\\b"), F.lit(0))
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in C.STOP_WORDS]))


def _set_key(words: Column) -> Column:
    return F.array_join(F.array_sort(words), " ")


def _sharing(left: DataFrame, right: DataFrame, top: int, few: int = 256, levels: int = 4) -> DataFrame:
    """(a, d): sets that share a word, without those that ``top`` others are sure to beat.

    left: (a); right: (d, first); sets are words joined by spaces. A word that few sets of
    the right have joins them all. For one that more have, the smallest ``top`` of its
    sets, equal ones by ``first``, are taken, and it is followed together with a second
    such word, and so on: whatever shares just the frequent words of a key is no more
    similar than the smallest sets that have the key. Keys of ``levels`` words join all.
    """
    words = lambda df, c: df.select(c, F.explode(F.split(F.col(c), " ")).alias("key")).withColumn("last", F.col("key"))
    a, d = words(left, "a"), words(right, "d")
    pairs, frequent = None, None
    for level in range(1, levels + 1):
        hot = durable(d.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > (few if level < levels else F.lit(None))).select("key"))
        found = a.join(hot, "key", "left_anti").join(d, "key").select("a", "d")
        pairs = found if pairs is None else pairs.unionByName(found)
        if hot.isEmpty():
            break
        a, d = (durable(x.join(hot, "key", "left_semi")) for x in (a, d))
        order = Window.partitionBy("key").orderBy(F.size(F.split("d", " ")), "first")
        best = d.join(right, "d").withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
        pairs = pairs.unionByName(a.join(best.select("key", "d"), "key").select("a", "d"))
        frequent = frequent or tuple(x.select(c, F.col("key").alias("w")) for x, c in ((a, "a"), (d, "d")))
        longer = lambda x, c, more: x.join(more, c).where("w > last").select(c, F.concat_ws(" ", "key", "w").alias("key"), F.col("w").alias("last"))
        a, d = longer(a, "a", frequent[0]), longer(d, "d", frequent[1])
    return pairs.distinct()


def comparables(rfqs: DataFrame, deals: DataFrame, least: float = C.SIMILAR, top: int = C.COMPARABLES) -> DataFrame:
    """(cr_number, deal, revenue, similarity, rank): the most similar won deals [J3, G19, K4].

    Similarity is one of sets of words, so equal sets are compared once. A set's deals are
    equals, of which only the first ``top`` in their order can be anyone's; deals and asks
    come back by their set. Words that very many sets have don't join them all.
    """
    asks = rfqs.select("cr_number", _set_key(tokens(F.col("text"))).alias("a"))
    won = deals.where("revenue > 0").select("deal", "revenue", "ord", _set_key(tokens(F.col("text"))).alias("d"))
    first = won.where("d <> ''").withColumn("place", F.row_number().over(Window.partitionBy("d").orderBy("ord", "deal"))).where(F.col("place") <= top).drop("place")
    sets = durable(first.groupBy("d").agg(F.min(F.struct("ord", "deal")).alias("first")))
    words = lambda c: F.split(F.col(c), " ")
    both = _sharing(durable(asks.where("a <> ''").select("a").distinct()), sets, top).withColumn("n", F.size(F.array_intersect(words("a"), words("d"))))
    sim = (F.col("n") / (F.size(words("a")) + F.size(words("d")) - F.col("n"))).alias("similarity")
    near = both.select("a", "d", sim).where(F.col("similarity") > least).join(first, "d")
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), "ord", "deal")  # few candidates, however many deals
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return asks.join(ranked, "a").select("cr_number", "deal", "revenue", "similarity", "rank")


def bids(rfqs: DataFrame, deals: DataFrame, margin: float = C.MARGIN, digits: int = 2) -> DataFrame:
    """Price range and confidence per RFQ, from comparables or from cost [G10-G12, G14, C6]. rfqs: cr_number, text, cost."""
    top = comparables(rfqs, deals)
    stats = top.groupBy("cr_number").agg(
        F.count("*").alias("n"), F.avg("revenue").alias("avg"), F.min("revenue").alias("min"), F.max("revenue").alias("max"), F.avg("similarity").alias("sim"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "deal", "revenue", F.round("similarity", 2).alias("similarity")))), 1, 5), lambda x: x.dropFields("rank")).alias("comparable_deals"),
    )
    j = rfqs.select("cr_number", "cost").join(stats, "cr_number", "left")
    mid = F.col("avg") * (1 + margin)
    mid = F.when(F.col("cost") > 0, (mid + F.col("cost") * (1 + margin)) / 2).otherwise(mid)
    f, none = fallback(F.col("cost"), digits), F.col("n").isNull()
    sure = R.first_match([((F.col("n") >= 5) & (F.col("sim") > 0.25), "high"), ((F.col("n") >= 3) & (F.col("sim") > 0.15), "medium")], "low")
    return j.select(
        "cr_number", F.coalesce("n", F.lit(0)).alias("n"),
        F.when(none, f["low"]).otherwise(F.round(F.col("min") * (1 + margin * 0.5), digits)).alias("low"),
        F.when(none, f["mid"]).otherwise(F.round(mid, digits)).alias("mid"),
        F.when(none, f["high"]).otherwise(F.round(F.col("max") * (1 + margin * 1.5), digits)).alias("high"),
        F.when(none, "low").otherwise(sure).alias("confidence"), "comparable_deals",
    )


def search_text(*parts: str) -> Column:
    """Non-empty parts, joined and lowered [S15]."""
    return F.lower(F.concat_ws(" ", *[F.nullif(F.btrim(F.coalesce(F.col(p), F.lit(""))), F.lit("")) for p in parts]))


def _plain_words(text: Column) -> Column:
    """The words that a ratio of sets compares: lower-case ASCII letters and digits."""
    ascii_ = F.regexp_replace(F.lower(text), "[^\\x00-\\x7F]", "")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(ascii_, "[^a-z0-9]", " "), " "), lambda w: w != ""))


def _candidates(texts: DataFrame, ctexts: DataFrame, least: int) -> DataFrame:
    """Different (text, ctext) that can reach the ratio; none that does is lost.

    Pairs that share a word meet by it. Of others the ratio is that of the sorted words,
    whose lengths then lie within a factor, so they meet by a class of length.
    """
    r = (least - 0.5) / 100  # ratios are rounded
    words = lambda df, c, w: df.select(c, _plain_words(F.col(c)).alias(w)).where(F.size(w) > 0)
    a, b = words(texts, "text", "aw"), words(ctexts, "ctext", "bw")
    by_word = a.select("text", F.explode("aw").alias("w")).join(b.select("ctext", F.explode("bw").alias("w")), "w").select("text", "ctext").distinct()
    factor = math.log((2 - r) / r)
    klass = lambda n: F.floor(F.log(n.cast("double")) / factor + 1e-9)
    sized = lambda df, w, n: df.withColumn(n, F.length(F.array_join(w, " ")))
    a = sized(a, "aw", "na").select("text", "aw", F.explode(F.array(*[klass(F.col("na")) + d for d in (-1, 0, 1)])).alias("k"))
    b = sized(b, "bw", "nb").select("ctext", "bw", klass(F.col("nb")).alias("k"))
    apart = a.join(b, "k").where(~F.arrays_overlap("aw", "bw")).select("text", "ctext")
    return by_word.unionByName(apart)


def _contacts(contacts: DataFrame) -> DataFrame:
    return contacts.where(F.length(F.trim("text")) > 0).select("ord", F.col("text").alias("ctext"), "rep_email", "rep_name", "distributor_name")


def close_texts(items: DataFrame, contacts: DataFrame, least: int = C.MATCH_RATIO) -> DataFrame:
    """(text, ctext, ratio): different texts of items and contacts that are similar enough, each pair compared once [J2]."""
    texts = items.where(F.length(F.trim("text")) > 0).select("text").distinct()
    pairs = _candidates(texts, _contacts(contacts).select("ctext").distinct(), least)
    return pairs.withColumn("ratio", token_set_ratio(F.col("text"), F.col("ctext"), least)).where(F.col("ratio") >= least)


def matches(items: DataFrame, contacts: DataFrame, least: int = C.MATCH_RATIO) -> DataFrame:
    """(item, contact columns, ratio): every contact similar enough to an item [J2], a row each.

    items: item, text. contacts: ord, text, rep_email, rep_name, distributor_name.
    """
    close = close_texts(items, contacts, least)
    return items.join(close, "text").join(_contacts(contacts), "ctext").select("item", "ord", "rep_email", "rep_name", "distributor_name", "ratio")


def ranked(matched: DataFrame) -> DataFrame:
    """``matched`` with ``rank`` in the item: the best ratio first, equal ones in the order of contacts [K5]."""
    return matched.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("ratio"), "ord")))


def quote_requests(matched: DataFrame) -> DataFrame:
    """Per rep the names of the first contact seen and the items in order of match [G15, G16, T15]; for one request's items."""
    first = F.min_by(F.struct("rep_name", "distributor_name"), F.struct("item", -F.col("ratio"), F.col("ord")))
    grouped = matched.groupBy("rep_email").agg(first.alias("f"), F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(F.collect_set("distributor_name")).alias("distributors"))
    return grouped.select("rep_email", "f.*", "items", "distributors")


def reps(items: DataFrame, contacts: DataFrame, least: int = C.MATCH_RATIO) -> tuple[DataFrame, DataFrame]:
    """(heads, lines) of the quote requests of a whole table of items, as in ``quote_requests`` [J2, G15, G16, K5].

    heads: rep_email, rep_name, distributor_name, n_items, n_first, distributors; n_first
    counts the items whose best contact is the rep's. lines: (rep_email, item). Matches are
    of texts: a rep's first contact of each text meets the items' texts, and items are only
    counted; no row is made for an item, or an item's text, and a contact.
    """
    texts = items.groupBy("text").agg(F.count("*").alias("n"), F.min("item").alias("item"))
    close, c = durable(close_texts(items, contacts, least)), _contacts(contacts)
    first = c.groupBy("ctext", "rep_email").agg(F.min("ord").alias("ord"), F.min_by(F.struct("rep_name", "distributor_name"), "ord").alias("f"))
    place = F.struct((-F.col("ratio")).alias("worse"), "ord")
    per = durable(close.join(first, "ctext").groupBy("text", "rep_email").agg(F.min(place).alias("place"), F.min_by("f", place).alias("f")))
    best = per.groupBy("text").agg(F.min("place").alias("best"))
    j = per.join(best, "text").join(texts, "text")
    heads = j.groupBy("rep_email").agg(
        F.min_by("f", F.struct("item", "place")).alias("f"), F.sum("n").alias("n_items"), F.sum(F.when(F.col("place") == F.col("best"), F.col("n")).otherwise(0)).alias("n_first")
    )
    named = c.where("distributor_name IS NOT NULL").select("ctext", "rep_email", F.col("distributor_name").alias("x")).distinct()
    names = named.join(close.select("ctext").distinct(), "ctext", "left_semi").select("rep_email", "x").distinct().groupBy("rep_email").agg(F.array_sort(F.collect_list("x")).alias("distributors"))
    heads = heads.join(names, "rep_email", "left").select("rep_email", "f.*", "n_items", "n_first", F.coalesce("distributors", F.array().cast("array<string>")).alias("distributors"))
    return heads, per.select("text", "rep_email").join(items, "text").select("rep_email", "item")


def quote_deadline(due: Column, as_of: Column) -> Column:
    """Five days before due, not before three days from now; without a date ASAP."""
    at = F.greatest(F.date_sub(due, 5), F.date_add(as_of, 3))
    return F.when(due.isNull(), "ASAP").otherwise(F.date_format(at, "yyyy-MM-dd"))


def outbox(requests: DataFrame, subject: str = "Quote request") -> DataFrame:
    """Mails as rows (to, subject, body); nothing is ever sent [W10]."""
    lines = F.array_join(F.transform("items", lambda i: F.concat(F.lit("- item "), i.cast("string"))), "\n")
    return requests.select(F.col("rep_email").alias("to"), F.lit(subject).alias("subject"), F.concat(F.lit("Dear "), "rep_name", F.lit(",\n"), lines, F.lit("\n")).alias("body"))


def alert(rfqs: DataFrame, as_of: date) -> DataFrame:
    """One row ``text`` for new opportunities, or HEARTBEAT_OK [Q8, W7]. rfqs: cr_number, title, agency, due_date, relevance_score, items."""
    d = F.datediff("due_date", F.lit(as_of))
    due = F.when(F.col("due_date").isNull(), "TBD").otherwise(F.concat(F.col("due_date").cast("string"), F.lit(" ("), d.cast("string"), F.lit("d left)")))
    line = F.concat(F.lit("CR# "), "cr_number", F.lit(" ["), urgency(d), F.lit("]\n  "), F.substring("title", 1, 80), F.lit("\n  Agency: "), "agency", F.lit("\n  Due: "), due, F.when(F.col("items") > 0, F.concat(F.lit(" | "), F.col("items").cast("string"), F.lit(" items"))).otherwise(""), F.lit("\n  Score: "), F.format_number("relevance_score", 2))
    body = rfqs.agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cr_number", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    return body.select(F.when(F.col("n") == 0, "HEARTBEAT_OK").otherwise(F.concat(F.col("n").cast("string"), F.lit(" new\n"), F.col("b"))).alias("text"))
