"""Golden cases of the functions and rule tables; survey IDs in names or comments."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern import config as C
from quern.functions import fuzzy
from quern.functions import rules as R
from quern.functions import text as T
from quern.operators import inbox, news, procure


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()[0]


def many(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_s1_canonical_url(spark):
    cases = {
        "https://www.wgrz.com/article?id=123&utm_source=twitter&utm_medium=social": "https://www.wgrz.com/article?id=123",
        "https://example.com/path/": "https://example.com/path",
        "https://WWW.WGRZ.COM/article": "https://www.wgrz.com/article",
        "https://example.com/page#section2": "https://example.com/page",
        "https://example.com/search?q=buffalo+bills&page=2": "https://example.com/search?q=buffalo+bills&page=2",
        "https://www.wkbw.com/news/local?utm_campaign=fb&fbclid=abc123": "https://www.wkbw.com/news/local",
        "https://x.com?a=1&b=2&a=3&c=": "https://x.com/?a=1&a=3&b=2",
        "": "/",  # T24: missing links share a canonical form
    }
    got = many(spark, list(cases), "string", T.canonical_url)
    assert got == list(cases.values())
    assert many(spark, got, "string", T.canonical_url) == got


def test_s2_story_id(spark):
    f = lambda s, u: one(spark, T.story_id(F.lit(s), F.lit(u)))
    assert f("wgrz", "https://www.wgrz.com/article/123") == "wgrz-70ed89dc9f93"
    assert f("wgrz", "https://example.com/article") == "wgrz-02160c4e36e8"
    assert f("wkbw", "https://example.com/article") == "wkbw-66c2a2bc711f"


def test_text_s3_to_s6_s25_s27(spark):
    assert one(spark, T.clean_text(F.lit("hello   world\n\tfoo"))) == "hello world foo"
    assert one(spark, T.clean_text(F.lit("  pad ded  "))) == "pad ded"
    assert one(spark, T.first_sentences(F.lit("First sentence. Second sentence. Third sentence."), 2)) == "First sentence. Second sentence."
    assert one(spark, T.first_sentences(F.lit("Only one."), 3)) == "Only one."
    assert one(spark, T.truncate(F.lit("aa bb cc dd"), 7)) == "aa bb…"
    assert "<" not in one(spark, T.strip_html(F.lit("<p>hello <b>world</b></p>")))
    assert one(spark, T.absolute_url(F.lit("/a"), "https://h")) == "https://h/a"
    assert one(spark, T.first_number(F.lit("about 1,234 results"))) == 1234
    assert one(spark, T.escape_html(F.lit("a<b\n&"))) == "a&lt;b<br>&amp;"


def test_s13_safe_float_t16(spark):
    assert many(spark, ["$1,234.50", "-5", "1.2.3", "", "n/a", None], "string", T.safe_float) == [1234.5, 5.0, None, None, None, None]


def test_s8_dates(spark):
    assert [str(d) if d else None for d in many(spark, ["3/4/2026", "03/04/26", "March 4, 2026", "2026-03-04"], "string", T.parse_date)] == ["2026-03-04"] * 3 + [None]
    got = many(spark, ["2026-03-03T12:00:00Z", "Tue, 03 Mar 2026 12:00:00 +0000", "Tue, 03 Mar 2026 12:00:00 GMT", "no"], "string", T.parse_timestamp)
    assert got == [datetime(2026, 3, 3, 12)] * 3 + [None]


def test_s20_mail_summary(spark):
    assert one(spark, T.summary_of_mail(F.lit("See https://x.y now. " + "b" * 190 + ". Tail."), F.lit(""))).startswith("See now.")
    assert one(spark, T.summary_of_mail(F.lit(""), F.lit("Snippet only."))) == "Snippet only."


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("Buffalo Bills defeat Miami Dolphins 24-17", "Bills defeat Dolphins 24-17 in Buffalo", 93.671),
        ("Bills Win", "Bills Win!", 94.737),
        ("Mayor announces new park", "Mayor announces new park in Buffalo", 81.356),
        ("Snow storm hits Western New York", "Bills trade for new quarterback", 41.270),
        ("aaaaaa", "aaaaaaaaaa", 75.0),
        ("aaaaa", "aaaaaaaaaa", 66.667),
    ],
)
def test_c3_title_ratio(a, b, want):
    assert fuzzy.token_sort(a.lower(), b.lower()) == pytest.approx(want, abs=1e-3)


def test_c4_token_set():
    assert fuzzy.token_set("Dell laptop", "dell") == 100 and fuzzy.token_set("", "x") == 0


def test_lcs_against_table():
    import random

    r = random.Random(4)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.lcs(a, b) == t[-1][-1]


def test_f9_f10_types(spark):
    want = [("MWBE and SDVOB Discretionary", "mwbe_sdvob_discretionary", True), ("SDVOB Set-Aside", "sdvob_set_aside", True), ("SDVOB Discretionary", "sdvob_discretionary", True), ("MWBE Discretionary", "mwbe_discretionary", True), ("Discretionary", "discretionary", False), ("Continuous Recruitment", "continuous", False), ("", "general", False)]
    got = many(spark, [w[0] for w in want], "string", procure.procurement_type)
    assert [(g["procurement_type"], g["flagged"]) for g in got] == [w[1:] for w in want]
    assert many(spark, ["Contractor Ads", "General", None], "string", procure.competitive) == [False, True, True]


def test_f11_f12_relevance(spark):
    words = ["", "software", "software cloud", "software cloud saas", "software cloud saas azure"]
    got = many(spark, words, "string", procure.relevance)
    assert got == pytest.approx([0, 0.2667, 0.5333, 0.8, 1.0], abs=1e-4)
    assert one(spark, procure.boosted(F.lit(0.8), F.lit(True)) >= C.RELEVANT) and not one(spark, procure.boosted(F.lit(0.8), F.lit(False)) >= C.RELEVANT)


def test_f13_urgency(spark):
    assert many(spark, [-1, 0, 3, 4, 7, 8, 14, 15, None], "int", procure.urgency) == ["expired", "critical", "critical", "urgent", "urgent", "normal", "normal", "low", "unknown"]


def test_quote_deadline(spark):
    from datetime import date

    got = many(spark, [date(2026, 3, 20), date(2026, 3, 9), None], "date", lambda d: procure.quote_deadline(d, F.lit(date(2026, 3, 3))))
    assert got == ["2026-03-15", "2026-03-06", "ASAP"]


def test_recency_and_steps(spark):
    now = datetime(2026, 3, 3, 12)
    at = [datetime(2026, 3, 2, 12), datetime(2026, 3, 1, 12), datetime(2026, 2, 28, 12), datetime(2026, 3, 4), None]
    assert many(spark, at, "timestamp", lambda c: news.recency(c, F.lit(now))) == pytest.approx([0.5134, 0.2636, 0, 1, 0.5], abs=1e-4)
    assert many(spark, [1, 2, 3], "int", news.cross_source) == [0, 0.5, 1]
    assert many(spark, [datetime(2026, 3, 3, 11, 30), datetime(2026, 3, 3, 12, 1), None], "timestamp", lambda c: T.age_of_story(c, F.lit(now))) == ["30m ago", "-1m ago", "unknown"]
    assert many(spark, [datetime(2026, 3, 3, 12), datetime(2026, 3, 1, 12), None], "timestamp", lambda c: T.age_of_mail(c, F.lit(now))) == ["just now", "2d ago", "unknown time"]


def test_g13_g14_costs(spark):
    item = "array<struct<unit_price:double,quantity:double>>"
    assert many(spark, [[(10.0, 0.0)], [(None, 5.0)], [(10.0, None), (2.0, 3.0)]], item, procure.cost) == [10.0, 0.0, 16.0]
    f = procure.fallback(F.lit(100.0))
    assert [one(spark, f[k]) for k in ("low", "mid", "high")] == [108, 115, 125]


def test_t4_t5_t6_mail_scores(spark):
    base = {"ord": 0, "msg_id": "m", "subject": "", "sender": "", "sender_email": "a@b.c", "to": "", "snippet": "", "body_plain": "", "headers": {}, "is_reply": False, "date": None}
    rows = [
        base,
        base | {"sender_email": "x@sendgrid.net", "subject": "please call"},
        base | {"headers": {"list-unsubscribe": "1"}, "subject": "please", "is_reply": True, "to": "me@x.y"},
        base | {"subject": "coupon discount webinar limited time act now"},
        base | {"sender_email": "newsletter-noreply@b.c"},
        base | {"subject": "urgent"},
    ]
    schema = "ord int, msg_id string, subject string, sender string, sender_email string, to string, snippet string, body_plain string, headers map<string,string>, is_reply boolean, date timestamp"
    df = spark.createDataFrame([tuple((r | {"ord": i})[c.split()[0]] for c in schema.split(", ")) for i, r in enumerate(rows)], schema)
    got = {r.ord: r for r in inbox.classified(df, "me@x.y").collect()}
    assert got[0].category == "needs_response" and got[0].priority == "LOW"
    assert got[1].category == "automated" and got[1].score == pytest.approx(-0.4)
    assert got[2].category == "informational" and -1e-15 < got[2].score < 0
    assert got[3].category == "sales" and got[3].score == pytest.approx(-0.6)
    assert got[4].category == "newsletter"
    assert got[5].priority == "HIGH"


def test_first_match_and_hits(spark):
    assert one(spark, R.keyword_hits(F.lit("a b a"), ["a", "b", "c"])) == 2
    assert one(spark, R.first_match([(F.lit(False), "x"), (F.lit(True), "y")], "z")) == "y"
