"""Inbox triage: parse, score, category, priority, digest, state [A13-A16, F4-F8, G17, W8, W9]."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quern import config as C
from quern.functions import rules as R
from quern.functions import text as T
from quern.functions.html import data_of

PART = "struct<filename:string>"
STUB = "id string, threadId string, subject string, from string, date string, snippet string, labels array<string>"


def address(raw: Column) -> Column:
    """(sender, sender_email) of ``Name <mail>`` or of a bare address; without a name the raw text is the sender [A16]."""
    open_, close = F.contains(raw, F.lit("<")), F.contains(raw, F.lit(">"))
    after = F.get(F.split(raw, "<"), 1)
    mail = F.when(open_ & close, F.get(F.split(after, ">"), 0)).otherwise(raw)
    name = F.btrim(F.btrim(F.btrim(F.get(F.split(raw, "<"), 0)), F.lit('"')), F.lit("'"))
    return F.struct(F.when(open_ & (name != ""), name).otherwise(raw).alias("sender"), F.lower(F.btrim(mail)).alias("sender_email"))


def domain(mail: Column) -> Column:
    return F.when(F.contains(mail, F.lit("@")), F.lower(F.element_at(F.split(mail, "@"), -1))).otherwise("")


def _last_wins(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the last counts, whatever the session's policy for them."""
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])))


def _lowered(headers: Column) -> Column:
    return _last_wins(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def parsed(stubs: DataFrame, full: DataFrame) -> DataFrame:
    """Stubs, or in their place their full records where there are any [A13, J6].

    stubs: JSON in ``json`` and ord. full: msg_id, headers (map), body, snippet, labels,
    parts, and payload_headers (map) if headers of two levels are known: the upper ones
    come first, but a reply is told by the lower ones. Stubs without an id are dropped. A
    body is text, or a struct of plain and text; one that begins with a tag is read as
    HTML, its first 10,000 characters.
    """
    s = stubs.select("ord", F.from_json("json", STUB).alias("j")).select("ord", "j.*").where(F.coalesce("id", F.lit("")) != "").withColumnRenamed("id", "msg_id")
    none = F.create_map().cast("map<string,string>")
    upper = F.coalesce(_lowered(F.col("headers")), none)
    lower = F.coalesce(_lowered(F.col("payload_headers")), none) if "payload_headers" in full.columns else upper
    f = full.select(
        "msg_id", upper.alias("upper"), lower.alias("lower"), _body_text(full).alias("body"), F.col("snippet").alias("full_snippet"), _labels(full).alias("full_labels"), "parts", F.lit(True).alias("whole"),
    )
    m = s.join(f, "msg_id", "left")
    head = lambda k: F.coalesce(F.col("upper")[k], F.col("lower")[k], F.lit(""))
    of = lambda k, stub: F.when(F.col("whole"), head(k)).otherwise(F.coalesce(stub, F.lit("")))
    subject = of("subject", "subject")
    who = address(of("from", "from"))
    html = F.startswith(F.ltrim(F.col("body")), F.lit("<"))
    body = F.when(html, data_of(F.when(html, F.substring("body", 1, 10000)))).otherwise(F.coalesce("body", F.lit("")))
    answers = F.coalesce(F.col("lower")["in-reply-to"], F.lit("")) != ""
    return m.select(
        "ord", "msg_id", F.coalesce("threadId", F.lit("")).alias("thread_id"), subject.alias("subject"), who["sender"].alias("sender"), who["sender_email"].alias("sender_email"),
        of("to", F.lit("")).alias("to"), T.parse_timestamp(of("date", F.col("date"))).alias("date"), F.coalesce(F.when(F.col("whole"), F.col("full_snippet")).otherwise(F.col("snippet")), F.lit("")).alias("snippet"),
        F.substring(body, 1, 5000).alias("body_plain"), F.coalesce(F.when(F.col("whole"), F.col("full_labels")).otherwise(F.col("labels")), F.array().cast("array<string>")).alias("labels"),
        F.coalesce(_last_wins(F.concat(F.map_entries("lower"), F.map_entries("upper"))) if "payload_headers" in full.columns else F.col("upper"), none).alias("headers"),
        F.coalesce(F.exists("parts", lambda p: p["filename"] != ""), F.lit(False)).alias("has_attachments"),
        (answers | F.lower(subject).rlike("^(re:|fwd:)")).alias("is_reply"),
    )


def _body_text(full: DataFrame) -> Column:
    """A body that is text, or a struct: plain, and text where plain is missing [A15]."""
    kind = full.schema["body"].dataType
    if not isinstance(kind, StructType):
        return F.col("body")
    return F.coalesce(*[F.col(f"body.{f}") for f in ("plain", "text") if f in kind.names], F.lit(""))


def _labels(full: DataFrame) -> Column:
    """Labels as a list; one string is a list of one [A15]."""
    return F.col("labels") if isinstance(full.schema["labels"].dataType, ArrayType) else F.when(F.col("labels").isNotNull(), F.array("labels"))


def searched(messages: DataFrame, query: str = "", most: int = 25) -> DataFrame:
    """Unread messages of the inbox that hold the query's words, the first ``most`` by ord [A13]."""
    text = F.lower(F.concat_ws(" ", "subject", "snippet", "sender_email"))
    held = F.lit(True)
    for word in query.lower().split():
        held = held & F.contains(text, F.lit(word))
    low = F.transform("labels", F.lower)
    unread = F.array_contains(low, "unread") & F.array_contains(low, "inbox")
    return messages.where(unread & held).orderBy("ord").limit(most)


def unseen(messages: DataFrame, processed: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Messages in neither set [F4, J5]."""
    return messages.join(processed.select("msg_id"), "msg_id", "left_anti").join(dismissed.select("msg_id"), "msg_id", "left_anti")


def signals(m: DataFrame, account: str = "", lists: dict | None = None) -> DataFrame:
    """The signals that scores and categories read, as columns. ``lists`` overrides vocabularies."""
    v = {"sales": C.SALES, "newsletter": C.NEWSLETTER, "response": C.RESPONSE, "urgent": C.URGENT, "bulk": C.BULK_DOMAINS, "noreply": C.NOREPLY} | (lists or {})
    text = F.lower(F.concat(F.col("subject"), F.lit(" "), F.substring("body_plain", 1, 2000), F.lit(" "), F.col("snippet")))
    local = F.when(F.contains(F.col("sender_email"), F.lit("@")), F.lower(F.split("sender_email", "@")[0])).otherwise("")
    size = F.length("body_plain")
    urgent = F.lower(F.concat(F.col("subject"), F.lit(" "), F.substring("body_plain", 1, 1000)))
    return m.withColumns(
        {
            "local_part": local,
            "bulk": domain(F.col("sender_email")).isin(*v["bulk"]),
            "noreply": R.any_keyword(local, v["noreply"]),
            "unsubscribe": F.array_contains(F.map_keys("headers"), "list-unsubscribe"),
            "sales_hits": R.keyword_hits(text, v["sales"]),
            "newsletter_hits": R.keyword_hits(text, v["newsletter"]),
            "response_hits": R.keyword_hits(text, v["response"]),
            "short": (size > 0) & (size < 2000),
            "direct": F.contains(F.lower("to"), F.lit(account.lower())) if account else F.lit(False),
            "urgent": R.any_keyword(urgent, v["urgent"]),
        }
    )


def score() -> Column:
    """Doubles in this order [F5, T4]."""
    w = C.MAIL_WEIGHTS
    flag = lambda c, k: F.when(c, F.lit(w[k])).otherwise(0.0)
    return R.weighted_sum(
        [
            flag(F.col("bulk"), "bulk"), flag(F.col("noreply"), "noreply"), flag(F.col("unsubscribe"), "unsubscribe"),
            F.least("sales_hits", F.lit(4)) * F.lit(w["sales"]), flag(F.col("newsletter_hits") > 0, "newsletter"), F.least("response_hits", F.lit(5)) * F.lit(w["response"]),
            flag(F.col("is_reply"), "reply"), flag(F.col("short"), "short"), flag(F.col("direct"), "direct"),
        ]
    )


def category() -> Column:
    """Of ``score`` and the signals [F6]. A local part that names a newsletter counts [T6]."""
    news = (F.col("newsletter_hits") > 0) | (F.col("noreply") & F.contains(F.col("local_part"), F.lit("newsletter")))
    news = news | (F.col("bulk") & F.contains(domain(F.col("sender_email")), F.lit("newsletter")))
    sales = F.col("sales_hits") > 0
    return R.first_match(
        [(F.col("score") >= C.MAIL_THRESHOLD, "needs_response"), (news & ~sales, "newsletter"), (sales, "sales"), (F.col("noreply") | F.col("bulk"), "automated")],
        "informational",
    )


def priority() -> Column:
    """Urgency words, then the score [F7]."""
    return R.first_match([(F.col("urgent"), "HIGH"), (F.col("score") >= C.MAIL_HIGH, "HIGH"), (F.col("score") >= C.MAIL_MEDIUM, "MEDIUM")], "LOW")


def classified(messages: DataFrame, account: str = "", lists: dict | None = None) -> DataFrame:
    s = signals(messages, account, lists).withColumn("score", score())
    return s.withColumns({"category": category(), "priority": priority(), "summary": T.summary_of_mail(F.col("body_plain"), F.col("snippet"))})


def projected(c: DataFrame) -> DataFrame:
    """Classified messages as other programs read them [Q11]."""
    return c.select("msg_id", "subject", F.col("sender_email").alias("sender"), "category", F.round("score", 2).alias("score"), "date")


def counts(c: DataFrame) -> DataFrame:
    """Messages to answer, skipped, and skipped by kind [G17, F8]."""
    n = lambda x: F.count_if(F.col("category") == x)
    return c.agg(n("needs_response").alias("needs_response"), F.count_if(F.col("category") != "needs_response").alias("skipped"), n("sales").alias("sales"), n("newsletter").alias("newsletter"), n("automated").alias("automated"))


def sender_display(name: Column, mail: Column) -> Column:
    """[S21]"""
    return F.when((name != "") & (mail != ""), F.concat(name, F.lit(" <"), mail, F.lit(">"))).otherwise(F.coalesce(F.nullif(mail, F.lit("")), F.nullif(name, F.lit("")), F.lit("(unknown)")))


def priority_rank(p: Column) -> Column:
    """[K6]"""
    return F.when(p == "HIGH", 0).when(p == "MEDIUM", 1).when(p == "LOW", 2).otherwise(3)


def digest(c: DataFrame, as_of: datetime) -> DataFrame:
    """One row ``text``; no rows, no text [W7, T22]."""
    line = F.concat(F.lit("["), "priority", F.lit("] "), "subject", F.lit("\n   From: "), sender_display(F.col("sender"), F.col("sender_email")), F.lit("  ("), T.age_of_mail(F.col("date"), F.lit(as_of)), F.lit(")"), F.when(F.col("summary") != "", F.concat(F.lit("\n   Summary: "), "summary")).otherwise(""))
    need = F.col("category") == "needs_response"
    all_ = c.agg(
        F.count("*").alias("n"), F.count_if(need).alias("a"), F.count_if(~need).alias("s"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(need, F.struct(priority_rank(F.col("priority")).alias("r"), F.col("ord"), line.alias("l"))))), lambda x: x["l"]), "\n\n").alias("body"),
    )
    return all_.where("n > 0").select(F.concat(F.format_string("# Inbox\nNEEDS RESPONSE (%d)\n\n", "a"), "body", F.format_string("\n\nSKIPPED (%d)\n", "s")).alias("text"))


def marked(processed: DataFrame, new: DataFrame, as_of: datetime) -> DataFrame:
    """Processed rows after a run: the last write of an id wins [W8]."""
    add = new.select("msg_id", "category", "subject", F.lit(as_of).cast("timestamp").alias("processed_at"))
    both = processed.select("msg_id", "category", "subject", "processed_at").withColumn("_o", F.lit(0)).unionByName(add.withColumn("_o", F.lit(1)))
    last = both.groupBy("msg_id").agg(F.max_by(F.struct("category", "subject", "processed_at"), F.struct("_o", F.coalesce("processed_at", F.lit(datetime(1, 1, 2))))).alias("r"))
    return last.select("msg_id", "r.*")


def pruned(processed: DataFrame, as_of: datetime, days: int = C.STATE_DAYS) -> DataFrame:
    """Rows younger than the limit; a row without a time is oldest [W8]."""
    return processed.where(F.col("processed_at") > F.lit(as_of) - F.make_dt_interval(F.lit(days)))


def checked(messages: DataFrame, processed: DataFrame, dismissed: DataFrame, as_of: datetime, account: str = "") -> dict[str, DataFrame]:
    """One run: what is new, classified; the digest; the state afterwards [Q11, Q12].

    State is pruned only by runs with new messages [T20].
    """
    new = classified(unseen(messages, processed, dismissed), account)
    after = marked(processed, new, as_of)
    any_new = new.agg((F.count("*") > 0).alias("any"))
    state = after.crossJoin(F.broadcast(any_new)).where(~F.col("any") | (F.col("processed_at") > F.lit(as_of) - F.make_dt_interval(F.lit(C.STATE_DAYS)))).drop("any")
    return {"new": new, "digest": digest(new, as_of), "processed": state}


def state_counts(processed: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row: processed ids, drafts, and the last time that anything was processed [G20, Q12]."""
    return processed.agg(F.count("*").alias("processed_count"), F.max("processed_at").alias("last_check")).join(drafts.agg(F.count("*").alias("draft_count"))).select("processed_count", "draft_count", "last_check")


def dismissed_with(dismissed: DataFrame, msg_id: str) -> DataFrame:
    """The dismissed ids and one more, once [Q12]."""
    one = dismissed.sparkSession.createDataFrame([(msg_id,)], "msg_id string")
    return dismissed.select("msg_id").union(one).distinct()


def shown(messages: DataFrame, msg_id: str) -> DataFrame:
    """One message's ``text``: its heads and up to 3,000 characters of its body [Q12]."""
    line = lambda label, x: F.concat(F.lit(f"{label}: "), F.coalesce(x, F.lit("")))
    who = F.concat("sender", F.lit(" <"), "sender_email", F.lit(">"))
    text = F.concat_ws("\n", line("From", who), line("To", F.col("to")), line("Subject", F.col("subject")), line("Date", F.col("date").cast("string")), F.when(F.col("has_attachments"), "Attachments: Yes"), F.lit(""), F.substring("body_plain", 1, 3000))
    return messages.where(F.col("msg_id") == msg_id).select("msg_id", text.alias("text"))


def draft_shown(drafts: DataFrame, draft_id: str) -> DataFrame:
    """One draft's ``text`` [A17, Q12]. drafts: draft_id, headers (map), data (base64url), snippet."""
    h = lambda k, empty: F.coalesce(F.col("headers")[k], F.lit(empty))
    heads = _lowered(F.col("headers"))
    body = F.coalesce(F.nullif(T.decoded_base64url(F.col("data")), F.lit("")), F.nullif(F.col("snippet"), F.lit("")), F.lit("(empty body)"))
    rows = drafts.where(F.col("draft_id") == draft_id).withColumns({"headers": heads, "body": F.substring(T.rendered_html(body), 1, 3000)})
    text = F.concat_ws("\n", F.concat(F.lit("From: "), h("from", "(unknown)")), F.concat(F.lit("To: "), h("to", "(unknown)")), F.concat(F.lit("Subject: "), h("subject", "(no subject)")), F.concat(F.lit("Date: "), h("date", "(not set)")), F.lit(""), "body")
    return rows.select("draft_id", text.alias("text"))


def prompt(messages: DataFrame) -> DataFrame:
    """(ord, prompt): what a language model would be asked about each classified message [S23]; nothing is asked."""
    lines = F.format_string("From: %s\nTo: %s\nSubject: %s\nIs Reply: %s\n\n%s\n\nRules say: %s (%.2f)", sender_display(F.col("sender"), F.col("sender_email")), "to", "subject", F.col("is_reply").cast("string"), F.substring("body_plain", 1, 1500), "category", "score")
    return messages.select("ord", F.concat(F.lit("Classify this mail as needs_response, informational, newsletter, sales or automated, and sum it up in a line. Answer in JSON.\n\n"), lines).alias("prompt"))


def with_draft(drafts: DataFrame, msg_id: str, body: str | None) -> DataFrame:
    """Drafts with one put, or removed if ``body`` is None [W9]."""
    rest = drafts.where(F.col("msg_id") != msg_id)
    return rest if body is None else rest.unionByName(drafts.sparkSession.createDataFrame([(msg_id, body)], "msg_id string, body string"))
