"""Clustering against a sequential fold, state, keyed tables, matching, readers."""

import json
import random
import zipfile
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import fuzzy
from quern.operators import cluster, graph, inbox, news, procure, reports, stages
from quern.sources import files, sinks

NOW = datetime(2026, 3, 3, 12)
STORY = "ord long, source string, source_priority double, title string, url string, canonical_url string, published_at timestamp"


def story(ord_, title, url, at=NOW, source="wgrz", priority=0.8):
    return (ord_, source, priority, title, url, url, at)


def fold(rows):
    """First-fit in input order, straight from the definition."""
    clusters = []

    def match(a, b):
        if a[5] and a[5] == b[5]:
            return True
        if fuzzy.token_sort(a[3].lower(), b[3].lower()) < 75:
            return False
        return a[6] is None or b[6] is None or abs(a[6] - b[6]) <= timedelta(hours=24)

    for r in sorted(rows):
        for c in clusters:
            if any(match(r, x) for x in c):
                c.append(r)
                break
        else:
            clusters.append([r])
    return {r[0]: c[0][0] for c in clusters for r in c}


def seeds(spark, rows):
    return {r.ord: r.seed for r in cluster.clustered(spark.createDataFrame(rows, STORY)).select("ord", "seed").collect()}


def test_c1_bridge_isn_t_merged(spark):
    rows = [story(0, "Council approves downtown parking plan", "u1"), story(1, "Snow emergency declared overnight", "u2"), story(2, "Council approves new downtown parking plan", "u2")]
    assert seeds(spark, rows) == {0: 0, 1: 1, 2: 0} == fold(rows)


def test_c1_random_rows_equal_the_fold(spark):
    r = random.Random(1)
    words = "snow bills mayor park storm council road win".split()
    rows = [story(i, " ".join(r.choice(words) for _ in range(r.randint(1, 5))), f"u{r.randint(0, 25)}", None if r.random() < 0.1 else NOW + timedelta(hours=r.randint(-60, 60))) for i in range(60)]
    assert seeds(spark, rows) == fold(rows)


def test_c1_repeated_titles_and_spans(spark):
    """Many stories of few titles, over days, some without a time."""
    r = random.Random(5)
    titles = ["Snow storm closes the thruway", "Snow storm closes thruway", "storm closes the Thruway Snow", "Bills win", "Bills win big", "", "Mayor speaks at city hall"]
    rows = [story(i, r.choice(titles), f"u{r.randint(0, 60)}" if r.random() < 0.8 else "", None if r.random() < 0.05 else NOW + timedelta(minutes=r.randint(-9000, 9000))) for i in range(120)]
    assert seeds(spark, rows) == fold(rows)
    by_url = {}
    for o, _, _, _, _, u, _ in sorted(rows):
        by_url.setdefault(u, o)
    got = {x.ord: x.seed for x in cluster.clustered(spark.createDataFrame(rows, STORY), fuzzy=False).collect()}
    assert got == {o: by_url[u] if u else o for o, _, _, _, _, u, _ in rows}


def test_c1_partly_close_spans(spark):
    """Many stories of like titles whose spans match in part: time, order and title decide together."""
    for seed in (11, 12):
        r = random.Random(seed)
        titles = ["Snow storm closes the thruway", "Snow storm closes thruway", "Snow storm closed the thruway now", "Bills win"]
        pick = lambda: r.choices(titles, (6, 3, 1, 2))[0]
        times = [r.randint(-4000, 4000) for _ in range(40)]
        rows = [story(i, pick(), "" if r.random() < 0.9 else f"u{r.randint(0, 9)}", None if r.random() < 0.03 else NOW + timedelta(minutes=r.choice(times))) for i in range(220)]
        assert seeds(spark, rows) == fold(rows)


def test_c1_rounds_on_random_graphs(spark):
    """Least ord over descending edges is first-fit without merging; plain components aren't."""
    r = random.Random(3)
    edges, want, offset = [], {}, 0
    for _ in range(300):
        n = r.randint(2, 14)
        own = {(i, j) for i in range(n) for j in range(i) if r.random() < 0.2}
        clusters = []
        for i in range(n):
            for c in clusters:
                if any((i, j) in own for j in c):
                    c.append(i)
                    break
            else:
                clusters.append([i])
        want |= {offset + i: offset + c[0] for c in clusters for i in c if i != c[0]}
        edges += [(offset + i, offset + j) for i, j in own]
        offset += n
    got = cluster.first_reached(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {x.ord: x.seed for x in got} == want
    chain = spark.range(1, 300).selectExpr("id AS src", "id - 1 AS dst")
    assert {x.seed for x in cluster.first_reached(chain).collect()} == {0}


def test_c1_edges_of_a_hot_title_are_few(spark):
    """One title for all rows, over days: edges grow in proportion, and no task gets them all."""
    df = spark.range(4000).selectExpr("id AS ord", "'wgrz' AS source", "0.8D AS source_priority", "'Snow storm' AS title", "'u' AS url", "concat('u', id) AS canonical_url", "timestamp_seconds(1700000000 + pmod(id * 7919, 400000)) AS published_at")
    rows = graph.durable(cluster.titled(df))
    edges = graph.durable(cluster.matches(rows, cluster.similar_titles(rows)))
    assert edges.count() < 4000 * 40
    assert {x.seed for x in cluster.clustered(df).select("seed").distinct().collect()} == {0}


def test_j1_bands_lose_nothing():
    r = random.Random(8)
    for _ in range(60):
        letters = r.choice(["ab", "abcdefgh ", "aé𝄞x"])
        a = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 62, 63, 64, 130, 300]))) for _ in range(40)]
        b = []
        for x in a:
            y = list(x)
            for _ in range(r.randint(0, 1 + len(x) // 2)):
                if y and r.random() < 0.5:
                    y.pop(r.randrange(len(y)))
                else:
                    y.insert(r.randint(0, len(y)), r.choice(letters))
            b.append("".join(y if r.random() < 0.8 else r.choices(letters, k=r.randint(0, 200))))
        for least in (55.5, 75, 100):
            assert fuzzy.alike(a, b, least).tolist() == [fuzzy.ratio(x, y) >= least for x, y in zip(a, b)]


def test_c1_blocks_move_once_and_lose_nothing(spark, monkeypatch):
    """One block is compared with itself without a second copy; blocks and lots of any size give the pairs of a plain comparison."""
    r = random.Random(4)
    words = "snow bills mayor park storm council road win thruway".split()
    titles = sorted({" ".join(sorted(r.choice(words) for _ in range(r.randint(2, 7)))) for _ in range(90)})
    want = {frozenset((i, j)) for i, x in enumerate(titles) for j, y in enumerate(titles[:i]) if fuzzy.ratio(x, y) >= 75}
    assert want
    kind = pa.list_(pa.struct([("t", pa.int64()), ("words", pa.string())]))
    block = pa.array([[{"t": i, "words": x} for i, x in enumerate(titles)]], kind)
    for most in (7, cluster.PAIRS):
        monkeypatch.setattr(cluster, "PAIRS", most)
        out = [p for b in cluster._compared(75.0)(iter([pa.RecordBatch.from_arrays([block, pa.nulls(1, kind)], names=["left", "right"])])) for p in zip(*[c.to_pylist() for c in b.columns])]
        assert len(out) == len(want) and set(map(frozenset, out)) == want
    rows = graph.durable(cluster.titled(spark.createDataFrame([story(i, x, "u") for i, x in enumerate(titles)], STORY)))
    name = {row.t: row.ord for row in rows.collect()}
    for size in (400, cluster.BLOCK):
        monkeypatch.setattr(cluster, "BLOCK", size)
        found = cluster.similar_titles(rows).collect()
        assert {frozenset((name[p.a], name[p.b])) for p in found} == want and len(found) == 2 * len(want)


def test_c1_empty_and_time_bounds(spark):
    assert seeds(spark, [story(0, "Only", "u")]) == {0: 0}
    apart = [story(0, "Mayor announces new park", "a"), story(1, "Mayor announces new park now", "b", NOW + timedelta(hours=24)), story(2, "Mayor announces new park now!", "c", NOW - timedelta(hours=48))]
    assert seeds(spark, apart) == fold(apart) == {0: 0, 1: 0, 2: 2}


def test_c2_canonical_is_first_of_the_best(spark):
    rows = [story(0, "Bills Win", "u", source="a", priority=0.5), story(1, "Bills Win!", "v", source="b", priority=0.9), story(2, "Bills Win", "w", source="c", priority=0.9)]
    out = cluster.summarised(cluster.clustered(spark.createDataFrame(rows, STORY))).collect()
    assert len(out) == 1 and out[0].ord == 1 and out[0].cross_source_count == 3 and [s.source for s in out[0].all_sources] == ["a", "b", "c"]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7)], "a long, b long")
    assert {r.id: r.comp for r in graph.components(e).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


def test_news_run(spark):
    raw = "ord long, source string, adapter string, title string, url string, published_at timestamp, author string, section string, snippet string, content string, tags array<string>"
    rows = [
        (0, "wgrz", "x", "Buffalo Bills win", "https://a.b/1?utm_source=x", NOW, None, None, "s", "One. Two. Three. Four.", []),
        (1, "wivb", "x", "Buffalo Bills win!", "https://a.b/2", NOW, None, None, "s", None, []),
        (2, "city_of_buffalo", "x", "Notice", "https://a.b/3", NOW - timedelta(hours=5), None, None, None, None, ["official"]),
        (3, "wgrz", "x", "Old", "https://a.b/4", NOW - timedelta(hours=25), None, None, None, None, []),
    ]
    out = news.run(spark.createDataFrame(rows, raw), NOW)
    best = out["stories"].collect()
    assert [(s.ord, s.topic, s.cross_source_count) for s in best] == [(2, "civic", 1), (0, "sports", 2)] or [(s.ord) for s in best] == [0, 2]
    assert {s.ord: s.summary_input_text for s in best}[0] == "One. Two. Three."
    text = out["digest"].head().text
    assert "## Sports" in text and "`[OFFICIAL]`" in text and "(2 sources)" in text
    assert out["headline"].head().text.startswith("Top stories: ")
    report = out["report"].head()
    assert {r.source: r.raw_count for r in report.source_details}["wgrz"] == 2 and (report.raw_count, report.normalized_count, report.deduped_count, report.final_count) == (4, 3, 2, 2)


def test_w8_state(spark):
    at = [NOW - timedelta(days=7, seconds=1), NOW - timedelta(days=7), NOW - timedelta(days=6, hours=23), None]
    p = spark.createDataFrame([(str(i), "sales", "s", t) for i, t in enumerate(at)], "msg_id string, category string, subject string, processed_at timestamp")
    assert [r.msg_id for r in inbox.pruned(p, NOW).collect()] == ["2"]
    new = spark.createDataFrame([("2", "automated", "t")], "msg_id string, category string, subject string")
    again = inbox.marked(p, new, NOW).where("msg_id = '2'").head()
    assert again.category == "automated" and again.processed_at == NOW


def test_a15_parse_and_run(spark):
    stubs = spark.createDataFrame([(0, '{"id":"a","subject":"Hi","from":"Ann <Ann@X.y>"}'), (1, '{"subject":"no id"}'), (2, '{"id":"b","subject":"RE: q"}')], "ord int, json string")
    full = spark.createDataFrame([("a", {"Subject": "Hello", "From": "Ann <Ann@X.y>", "List-Unsubscribe": "u"}, "<p>Hi <b>you</b></p>", None, None, [("f.pdf",)])], "msg_id string, headers map<string,string>, body string, snippet string, labels array<string>, parts array<struct<filename:string>>")
    m = {r.msg_id: r for r in inbox.parsed(stubs, full).collect()}
    assert set(m) == {"a", "b"} and m["a"].subject == "Hello" and m["a"].sender_email == "ann@x.y" and m["a"].body_plain == "Hi  you" and m["a"].has_attachments
    assert "list-unsubscribe" in m["a"].headers and m["b"].is_reply and not m["a"].is_reply
    empty = spark.createDataFrame([], "msg_id string, category string, subject string, processed_at timestamp")
    out = inbox.checked(inbox.parsed(stubs, full), empty, spark.createDataFrame([("b",)], "msg_id string"), NOW)
    assert [r.msg_id for r in out["processed"].collect()] == ["a"] and "SKIPPED" in out["digest"].head().text


def test_f14_w1_dispositions_and_upsert(spark):
    cols = "cr_number string, title string, agency string, category string, ad_type string, raw_text string, note string, due_date date"
    far = date(2026, 6, 1)
    new = spark.createDataFrame(
        [("1", "software cloud saas azure", "x", "y", "General", "", "", far), ("2", "t", "x", "y", "Contractor Ads", "", "", far), ("3", "software cloud saas azure", "x", "y", "General", "", "", date(2026, 3, 9)), ("4", "t", "x", "y", "General", None, None, None), ("5", "t", "", "", "", "", "", far)], cols
    )
    stored = spark.createDataFrame([("5", "new")], "cr_number string, status string")
    got = {r.cr_number: r.disposition for r in procure.disposed(new, stored, date(2026, 3, 3)).collect()}
    assert got == {"1": "kept", "2": "not_competitive", "3": "due_too_soon", "4": "not_relevant"}
    scores = {r.cr_number: r.relevance_score for r in procure.disposed(new, stored, date(2026, 3, 3)).collect()}
    assert scores["1"] > 0.9 and scores["2"] == scores["3"] == 0.0
    batch = spark.createDataFrame([("5", "quoted"), ("6", "new")], "cr_number string, status string")
    once = procure.upserted(stored, batch)
    assert sorted(map(tuple, procure.upserted(once, batch).collect())) == sorted(map(tuple, once.collect())) == [("5", "quoted"), ("6", "new")]
    wide = once.withColumn("title", F.lit("t"))
    assert {tuple(r) for r in procure.upserted(wide, batch).collect()} == {("5", "quoted", "t"), ("6", "new", "t")}  # a column the batch lacks stays
    moves = spark.createDataFrame([("5", "analyzed"), ("5", "processed"), ("6", "odd")], "cr_number string, status string")
    assert {r.cr_number: r.status for r in procure.with_status(once, moves).collect()} == {"5": "analyzed", "6": "new"}


def test_j8_refresh(spark):
    s = spark.createDataFrame([("1", 5.0), ("2", 7.0), ("3", None)], "cr_number string, mbe_goal double")
    p = spark.createDataFrame([("1", 6.0), ("2", None)], "cr_number string, mbe_goal double")
    assert {r.cr_number: (r.mbe_goal, r.changed) for r in procure.refreshed(s, p, ["mbe_goal"]).collect()} == {"1": (6.0, True), "2": (7.0, False), "3": (None, False)}


def test_g10_bids(spark):
    ask = "Microsoft enterprise license renewal Information Technology Office of Example"
    asks = spark.createDataFrame([("a", ask, 0.0), ("b", ask, 4000.0), ("c", "zzz", 100.0)], "cr_number string, text string, cost double")
    deals = spark.createDataFrame(
        [("d1", "Microsoft license renewal enterprise agreement", 10000.0, 0), ("d2", "Adobe license renewal", 5000.0, 1), ("d3", "Microsoft enterprise support information technology", 20000.0, 2), ("d4", "Road salt delivery", 9000.0, 3), ("d5", "Microsoft license", 0.0, 4)],
        "deal string, text string, revenue double, ord int",
    )
    got = {r.cr_number: r for r in procure.bids(asks, deals).collect()}
    assert (got["a"].n, got["a"].low, got["a"].mid, got["a"].high, got["a"].confidence) == (3, 5375.0, pytest.approx(13416.67), 24500.0, "medium")
    assert got["b"].mid == pytest.approx(9008.33) and (got["c"].low, got["c"].mid, got["c"].high, got["c"].confidence) == (108, 115, 125, "low")
    assert [d.deal for d in got["a"].comparable_deals] == ["d1", "d3", "d2"]


def test_j2_g15_quotes(spark):
    items = spark.createDataFrame([(1, "dell latitude laptop"), (2, "cisco switch")], "item int, text string")
    reps = spark.createDataFrame([(0, "dell laptop", "r@x", "R", "D1"), (1, "cisco", "r@x", "Other", "D2"), (2, "", "z@x", "Z", "D3")], "ord int, text string, rep_email string, rep_name string, distributor_name string")
    q = procure.quote_requests(procure.matches(items, reps))
    row = q.collect()
    assert len(row) == 1 and row[0].items == [1, 2] and row[0].rep_name == "R" and row[0].distributors == ["D1", "D2"]
    assert "- item 1" in procure.outbox(q).head().body


def test_f14_a_key_twice_is_stored_once(spark):
    cols = "cr_number string, title string, category string, agency string, raw_text string, note string, ad_type string, due_date date, ord int"
    row = lambda k, title, i: (k, title, "", "", "", "", "General", None, i)
    new = spark.createDataFrame([row("a", "second", 1), row("a", "first", 0), row("b", "stored", 2), row("c", "only", 3)], cols)
    got = procure.disposed(new, spark.createDataFrame([("b",)], "cr_number string"), date(2026, 3, 3)).collect()
    assert {(x.cr_number, x.title) for x in got} == {("a", "first"), ("c", "only")} and len(got) == 2


def test_f14_texts_of_single_keys_are_not_moved(spark):
    cols = "cr_number string, title string, category string, agency string, raw_text string, note string, ad_type string, due_date date"
    row = lambda k, text: (k, "t", "", "", text, "", "General", None)
    stored = spark.createDataFrame([("z",)], "cr_number string")
    one = procure.disposed(spark.createDataFrame([row("a", "software cloud SaaS azure"), row("b", None), row("z", "")], cols), stored, date(2026, 3, 3)).select("cr_number", "disposition")
    assert "Window" not in one._jdf.queryExecution().executedPlan().toString()
    assert dict(map(tuple, one.collect())) == {"a": "kept", "b": "not_relevant"}
    twice = spark.createDataFrame([row("a", "y"), row("a", "x"), row(None, "q"), row(None, "p"), row("b", "w")], cols)
    got = procure.disposed(twice, stored, date(2026, 3, 3)).collect()
    assert sorted((str(r.cr_number), r.raw_text) for r in got) == [("None", "p"), ("a", "x"), ("b", "w")]


def test_g15_contacts_are_grouped_before_they_meet_texts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(procure, "durable", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or graph.durable(df))
    contacts = spark.range(3000).selectExpr("id AS ord", "'dell switch' AS text", "concat('r', id % 2) AS rep_email", "concat('R', id) AS rep_name", "concat('D', id % 50) AS distributor_name")
    items = spark.range(400).selectExpr("id AS item", "concat('dell switch ', id) AS text")
    heads, lines = procure.reps(items, contacts)
    got = {r.rep_email: r for r in heads.collect()}
    assert any("Aggregate [ctext" in p and "Join" in p for p in plans)
    assert [(got[e].rep_name, got[e].n_items, got[e].n_first, len(got[e].distributors)) for e in ("r0", "r1")] == [("R0", 400, 400, 25), ("R1", 400, 0, 25)] and lines.count() == 800


def test_g15_reps_of_a_table(spark):
    """Counts and names by texts equal those of all pairs."""
    r = random.Random(16)
    word = lambda: r.choice(["cisco", "dell", "switch", "lap top", "licence", "ab", "zz9", "renewal"])
    items = [(i, " ".join(word() for _ in range(r.randint(0, 3)))) for i in range(80)]
    contacts = [(i, " ".join(word() for _ in range(r.randint(0, 3))), f"r{i % 5}@x", f"R{i}", f"D{i % 3}") for i in range(25)]
    heads, lines = procure.reps(spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(contacts, "ord int, text string, rep_email string, rep_name string, distributor_name string"))
    pairs = [(i, -fuzzy.token_set(t, c), o, e, n, d) for i, t in items for o, c, e, n, d in contacts if t.strip() and c.strip() and fuzzy.token_set(t, c) >= 55]
    first = {i: min(p[1:] for p in pairs if p[0] == i)[2] for i in {p[0] for p in pairs}}
    want = {}
    for e in {p[3] for p in pairs}:
        own = sorted(p for p in pairs if p[3] == e)
        want[e] = (own[0][4], own[0][5], len({p[0] for p in own}), sum(v == e for v in first.values()), sorted({p[5] for p in own}))
    assert {x.rep_email: (x.rep_name, x.distributor_name, x.n_items, x.n_first, x.distributors) for x in heads.collect()} == want
    assert sorted((x.rep_email, x.item) for x in lines.collect()) == sorted({(p[3], p[0]) for p in pairs})


def test_j2_pruning_loses_nothing(spark):
    r = random.Random(6)
    word = lambda: r.choice(["cisco", "dell", "switch", "lap top", "licence", "ab", "zz9", "Ünïcode", "renewal", "x"])
    items = [(i, " ".join(word() for _ in range(r.randint(0, 5)))) for i in range(60)]
    reps = [(i, " ".join(word() for _ in range(r.randint(0, 4))) + r.choice(["", "e", " swich"]), f"r{i % 7}@x", "R", "D") for i in range(40)]
    got = procure.ranked(procure.matches(spark.createDataFrame(items, "item int, text string"), spark.createDataFrame(reps, "ord int, text string, rep_email string, rep_name string, distributor_name string"))).collect()
    want = {(i, o): fuzzy.token_set(t, c) for i, t in items for o, c, *_ in reps if t.strip() and c.strip() and fuzzy.token_set(t, c) >= 55}
    assert {(g.item, g.ord): g.ratio for g in got} == want
    for i in {g.item for g in got}:
        assert [(g.ord) for g in sorted((g for g in got if g.item == i), key=lambda g: g.rank)] == [o for _, o in sorted((-v, o) for (x, o), v in want.items() if x == i)]


def test_j3_comparables_against_all_pairs(spark):
    r = random.Random(7)
    words = "alpha beta gamma delta omega the new license cloud road salt".split()
    asks = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6))), 0.0) for i in range(50)]
    deals = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 6))), float(r.randint(0, 3)), r.randint(0, 9)) for i in range(200)]
    got = procure.comparables(spark.createDataFrame(asks, "cr_number int, text string, cost double"), spark.createDataFrame(deals, "deal int, text string, revenue double, ord int")).collect()
    kept = lambda t: {w for w in t.split() if len(w) > 2 and w not in ("the", "new")}
    for i, t, _ in asks:
        all_ = [(-len(kept(t) & kept(d)) / len(kept(t) | kept(d)), o, k) for k, d, v, o in deals if v > 0 and kept(t) & kept(d)]
        want = [k for s, _, k in sorted(all_) if -s > 0.1][:10]
        assert [g.deal for g in sorted((g for g in got if g.cr_number == i), key=lambda g: g.rank)] == want


def test_j3_frequent_words_lose_nothing(spark):
    """Every word counts as frequent: keys of several words, the smallest sets of each."""
    r = random.Random(9)
    words = [f"word{c}" for c in "abcdefgh"]
    make = lambda n: sorted({" ".join(sorted(r.sample(words, r.randint(1, 7)))) for _ in range(n)})
    left, right = make(60), make(150)
    rank = {d: i for i, d in enumerate(r.sample(right, len(right)))}
    sets = spark.createDataFrame([(d, rank[d]) for d in right], "d string, first int")
    jac = lambda a, d: len(set(a.split()) & set(d.split())) / len(set(a.split()) | set(d.split()))
    for few, levels in ((0, 4), (3, 2), (10, 3)):
        got = {}
        for x in procure._sharing(spark.createDataFrame([(a,) for a in left], "a string"), sets, 5, few, levels).collect():
            got.setdefault(x.a, set()).add(x.d)
        for a in left:
            best = sorted((-jac(a, d), rank[d], d) for d in right if jac(a, d) > 0)[:5]
            assert {d for _, _, d in best} <= got[a]


def test_j3_a_word_that_all_have(spark):
    n = 100_000
    asks = spark.range(n).selectExpr("id AS cr_number", "concat('common own', translate(CAST(id AS STRING), '0123456789', 'abcdefghij')) AS text", "0D AS cost")
    deals = asks.selectExpr("cr_number AS deal", "text", "1D AS revenue", "cr_number AS ord")
    got = procure.comparables(asks, deals).groupBy("cr_number").agg(F.count("*").alias("n"), F.max_by("deal", F.struct(-F.col("rank"))).alias("best"), F.max("deal").alias("last")).agg(F.count("*"), F.min("n"), F.max("n"), F.count_if(F.col("best") == F.col("cr_number")), F.count_if(F.col("last") > F.greatest(F.lit(9), F.col("cr_number")))).head()
    assert tuple(got) == (n, 10, 10, n, 0)


def test_q1_to_q6_bounds(spark):
    as_of = date(2026, 3, 3)
    due = [as_of - timedelta(1), as_of, as_of + timedelta(7), as_of + timedelta(8), None]
    df = spark.createDataFrame([(i, "t", "a", d, 0.9, False, "new") for i, d in enumerate(due)], "cr_number int, title string, agency string, due_date date, relevance_score double, is_mwbe_sdvob boolean, status string")
    keys = lambda name, n=10: [r.cr_number for r in reports.report(spark, name, df, as_of, n).collect()]
    assert sorted(keys("due", 7)) == [1, 2] and keys("top") == [4, 1, 2, 3] and keys("open") == [1, 2, 3] and keys("detail", 2) == [2]
    assert [r.status for r in procure.reset(df.withColumn("cr_number", F.col("cr_number").cast("string")), ["2"], "quoted").orderBy("cr_number").collect()] == ["new", "new", "quoted", "new", "new"]
    with pytest.raises(ValueError):
        procure.reset(df, ["2"], "proposed")
    with pytest.raises(ValueError):
        procure.with_field(df, "2", "title", "x")
    text = procure.alert(df.withColumn("items", F.lit(0)).withColumn("cr_number", F.col("cr_number").cast("string")), as_of).head().text
    assert "TBD" in text and procure.alert(df.withColumn("items", F.lit(0)).limit(0), as_of).head().text == "HEARTBEAT_OK"


def test_readers(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/a.xml").write_text('<rss><channel><item><title>One</title><link>https://a/1</link><pubDate>Tue, 03 Mar 2026 12:00:00 +0000</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description><category>c</category></item><item><title> </title></item></channel></rss>')
    (tmp_path / "feed/b.xml").write_text("not xml")
    rss = files.feed(spark, str(tmp_path / "feed"), "city", tags=("official",))
    row = rss.collect()
    assert sorted(r.error is None for r in row) == [False, True]
    row = files.sound(rss).collect()
    assert len(row) == 1 and row[0].title == "One" and row[0].snippet == "x" and row[0].tags == ["c", "official"] and row[0].published_at == NOW
    (tmp_path / "html").mkdir()
    (tmp_path / "html/l.html").write_text('<div class="card"><a href="/x"><h3>Head</h3></a><p>note</p><time datetime="2026-03-03T12:00:00Z"></time></div><div class="card">no link</div>')
    cards = files.listing(spark, str(tmp_path / "html"), "wkbw", "https://h", "div.card", "sports", ("sports",))
    got = cards.head()
    assert (got.title, got.url, got.snippet, got.section, got.published_at) == ("Head", "https://h/x", "note", "sports", NOW)
    assert files.sound(files.with_fallback(rss, cards)).count() == 1 and files.with_fallback(rss.limit(0), cards).count() == 1
    every = files.fan_in([cards, rss, cards])
    got = [(r.source, r.file.rpartition("/")[2]) for r in every.orderBy("ord").collect()]
    assert got == [("wkbw", "l.html"), ("city", "a.xml"), ("city", "b.xml"), ("wkbw", "l.html")] and every.select("ord").distinct().count() == 4
    report = {r.source: (r.status, r.raw_count, r.error is None) for r in files.source_report(every, ["city", "wkbw", "ub"]).collect()}
    assert report == {"city": ("ok", 1, False), "wkbw": ("ok", 2, True), "ub": ("ok", 0, True)}
    broken = files.feed(spark, str(tmp_path / "feed/b.xml"), "city")
    assert files.source_report(broken, ["city"]).head().status == "error"
    (tmp_path / "opp").mkdir()
    (tmp_path / "opp/p.html").write_text('<div class="opp-list-item" data-ad-id="7"><div class="bg-primary text-light" title="Full Title: Big  job">Big</div><div class="w-exact-8">Agency:</div><div>Parks</div><div class="w-exact-8">Due Date:</div><div>3/4/2026</div><a class="ad-action-link" href="/Account/Login">x</a></div>')
    r = files.rfq_cards(spark, str(tmp_path / "opp"), "https://h").head()
    assert (r.cr_number, r.title, r.agency, r.due_date, r.detail_url) == ("7", "Big job", "Parks", date(2026, 3, 4), "https://h/Ads/View?ID=7")
    (tmp_path / "det").mkdir()
    (tmp_path / "det/detail_7.html").write_text('<strong>MBE Goal:</strong> 15.5% <a href="/Step6Download?id=1" download="q.pdf">a</a><a href="/Step6Download?id=1">b</a><a href="/x/GeneratePdf?id=2">c</a><a href="/other">d</a>')
    r = files.rfq_details(spark, str(tmp_path / "det"), host="https://h").head()
    assert r.cr_number == "7" and r.mbe_goal == 15.5 and r.wbe_goal is None
    assert [tuple(a) for a in r.attachments] == [("https://h/Step6Download?id=1", "q.pdf"), ("https://h/x/GeneratePdf?id=2", "GeneratePdf")]
    assert files.rfq_cards(spark, str(tmp_path / "opp"), "https://h", max_pages=1).count() == 1


def test_a25_sheets_and_contacts(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.csv").write_bytes("﻿Quote\nItem Description,Qty,Unit Price\nLicenses,3,$10.50\n,1,2\n".encode())
    with zipfile.ZipFile(tmp_path / "s/b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Description</t></si><si><t>Price</t></si><si><t>Thing</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>4</v></c></row></sheetData></worksheet>')
    got = sorted((r.description, r.quantity, r.unit_price) for r in files.line_items(files.sheets(spark, str(tmp_path / "s"))).collect())
    assert got == [("Licenses", 3.0, 10.5), ("Thing", None, 4.0)]
    (tmp_path / "c.csv").write_text("distributor_name,rep_name,rep_email,vendor,product_line,notes\n D , R ,r@x,V,,\n")
    assert files.contacts(spark, str(tmp_path / "c.csv")).head().distributor_name == "D"


def test_w6_snapshots(spark, tmp_path):
    root = str(tmp_path / "t")
    sinks.save_snapshot(spark.createDataFrame([(1, "a")], "k int, v string"), root)
    sinks.save_snapshot(sinks.load_snapshot(spark, root).withColumn("w", F.lit(1)), root)
    assert sinks.load_snapshot(spark, root).head().w == 1
    assert spark.read.json(f"{root}/pointers").count() == 2  # pointers are added, never replaced


def test_a16_senders_and_two_levels_of_headers(spark):
    raw = ["Ann <Ann@X.y>", " ann@x.y ", '"Ann B" <a@b>', "<a@b>", "'Q' <q@r> x", "odd < no end", ""]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(inbox.address(F.col("r")).alias("a")).select("a.*").collect()
    assert [tuple(g) for g in got] == [("Ann", "ann@x.y"), (" ann@x.y ", "ann@x.y"), ("Ann B", "a@b"), ("<a@b>", "a@b"), ("Q", "q@r"), ("odd", "odd < no end"), ("", "")]
    stubs = spark.createDataFrame([(0, '{"id":"a","subject":"stub"}'), (1, '{"id":"b"}')], "ord int, json string")
    kind = "msg_id string, headers map<string,string>, payload_headers map<string,string>, body struct<plain:string,text:string>, snippet string, labels string, parts array<struct<filename:string>>"
    full = spark.createDataFrame([("a", {"In-Reply-To": "x"}, {"FROM": "ann@x.y"}, ("", "unread"), "s", "INBOX", None), ("b", {"Subject": "top"}, {"subject": "low", "in-reply-to": "y"}, (None, " <i>a &lt; b</i> &amp; c"), "s", None, None)], kind)
    m = {r.msg_id: r for r in inbox.parsed(stubs, full).collect()}
    assert (m["a"].subject, m["a"].sender, m["a"].is_reply, m["a"].body_plain) == ("", "ann@x.y", False, "")
    assert (m["b"].subject, m["b"].is_reply, m["b"].body_plain) == ("top", True, "  a < b  & c")


def test_a13_equal_header_names_under_any_policy(spark):
    stubs = spark.createDataFrame([(0, '{"id":"a"}'), (1, '{"id":"b"}')], "ord int, json string")
    rest = "'' AS body, '' AS snippet, '' AS labels, CAST(NULL AS ARRAY<STRUCT<filename: STRING>>) AS parts"
    full = spark.sql(f"SELECT 'a' AS msg_id, map('FROM', 'x@y', 'From', 'ann@x.y', 'Subject', 'up') AS headers, map('subject', 'low', 'To', 'me') AS payload_headers, {rest} UNION ALL SELECT 'b', NULL, NULL, {rest}")
    drafts = spark.sql("SELECT 'd' AS draft_id, map('To', 'a', 'TO', 'b') AS headers, CAST(NULL AS STRING) AS data, 's' AS snippet")
    policy = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        m = {r.msg_id: r for r in inbox.parsed(stubs, full).collect()}
        text = inbox.draft_shown(drafts, "d").first().text
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
    assert (m["a"].sender_email, m["a"].subject, m["a"].headers) == ("ann@x.y", "up", {"from": "ann@x.y", "subject": "up", "to": "me"})
    assert (m["b"].sender_email, m["b"].headers) == ("", {}) and "To: b" in text


def test_w1_buckets_and_two_writers(spark, tmp_path):
    root = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "cr_number string, status string")
    assert sinks.upsert(frame([(str(i), "new") for i in range(200)]), root, buckets=16) == 1
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert sinks.upsert(frame([("7", "quoted"), ("new", "new")]), root, buckets=16) == 2
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    assert before.items() <= after.items() and {p.parent.name for p in after.keys() - before.keys()} <= {p.parent.name for p in before} and len(after) - len(before) <= 2
    got = dict(map(tuple, sinks.load_table(spark, root).collect()))
    assert len(got) == 201 and got["7"] == "quoted" and got["8"] == "new"
    with ThreadPoolExecutor(2) as pool:
        numbers = list(pool.map(lambda k: sinks.upsert(frame([(k, "both"), (f"{k}x", "added")]), root, buckets=16), ("7", "9")))
    got = dict(map(tuple, sinks.load_table(spark, root).collect()))
    assert sorted(numbers) == [3, 4] and len(got) == 203 and got["7"] == got["9"] == "both"
    wide = spark.createDataFrame([("9", "g")], "cr_number string, grade string")
    sinks.upsert(wide, root, buckets=16)
    assert sinks.load_table(spark, root).where("cr_number = '9'").select("cr_number", "status", "grade").head() == ("9", "both", "g")
    n = sinks.save_snapshot(frame([("1", "a")]), str(tmp_path / "s"))
    sinks.save_snapshot(frame([("1", "b")]), str(tmp_path / "s"), after=n)
    with pytest.raises(sinks.Conflict):
        sinks.save_snapshot(frame([("1", "c")]), str(tmp_path / "s"), after=n)
    assert sinks.load_snapshot(spark, str(tmp_path / "s")).head().status == "b"


def test_w6_files_and_the_last_report(spark, tmp_path):
    root = tmp_path / "out"
    root.mkdir()
    assert "No previous run" in sinks.last_report(spark, str(root)).head().text
    rows = [(0, "wgrz", "Bills win", "https://a/1", NOW, None, None, "s", "One.", []), (1, "odd", "Other", "https://a/2", None, None, None, None, None, [])]
    out = news.run(spark.createDataFrame(rows, "ord long, source string, title string, url string, published_at timestamp, author string, section string, snippet string, content string, tags array<string>"), NOW)
    for _ in range(2):  # a second run replaces the files
        sinks.write_run(out, str(root))
    assert {p.name for p in root.iterdir() if not p.name.startswith(".")} == {"top_stories.json", "digest.md", "run_report.json"} and all(p.is_file() for p in root.iterdir())
    assert len(json.loads((root / "top_stories.json").read_text())) == 2 and (root / "digest.md").read_text().startswith("# News Digest")
    report = json.loads((root / "run_report.json").read_text())[0]
    assert (report["raw_count"], report["final_count"], report["source_details"][0]["source"]) == (2, 2, "wgrz")
    assert "1/1 OK" in sinks.last_report(spark, str(root)).head().text and "2 raw → 2 final" in sinks.last_report(spark, str(root)).head().text


def test_g18_sources_are_read_once(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.xml").write_text("<rss><channel><item><title>One</title></item><item><title>Two</title></item></channel></rss>")
    (tmp_path / "f/b.xml").write_text("broken")
    reads = spark.sparkContext.accumulator(0)

    def counted(s):
        def touch(batches):
            for b in batches:
                reads.add(b.num_rows)
                yield b

        df = files.feed(s, str(tmp_path / "f"), "wgrz")
        return df.mapInArrow(touch, df.schema)

    out = files.fetched(spark, [files.Scan("wgrz", counted), files.Scan("wivb", lambda s: files.feed(s, str(tmp_path / "f/b.xml"), "wivb"))])
    assert {r.source: (r.status, r.raw_count) for r in out["report"].collect()} == {"wgrz": ("ok", 2), "wivb": ("error", 0)}
    rows = out["rows"].withColumn("adapter", F.lit("x"))
    got = news.run(rows, NOW, sources=out["report"])["report"].head()
    assert (got.raw_count, got.normalized_count, got.sources_failed) == (2, 2, 1) and reads.value == 3


def test_a20_pages_end_without_next(spark, tmp_path):
    card = '<div class="opp-list-item" data-ad-id="%s"><div class="bg-primary text-light" title="t">t</div></div>'
    button = {1: '<button class="Next">n</button>', 2: '<button class="btn Next">n</button>', 10: '<button class="Next" disabled>n</button>', 11: '<button class="Next">n</button>'}
    for n, b in button.items():
        (tmp_path / f"page_{n}.html").write_text(card % n + b)
    keys = lambda **k: sorted(r.cr_number for r in files.rfq_cards(spark, str(tmp_path), **k).collect())
    assert keys() == ["1", "10", "2"] and keys(max_pages=2) == ["1", "2"] and keys(max_pages=9) == ["1", "10", "2"]


def test_a3_large_feeds_are_split(spark, tmp_path):
    """Spark's XML reader, by record, gives what the parser of whole files gives."""
    item = "<item><title>Title %d</title>\n<link>https://a/%d</link><dc:date>2026-03-03T12:00:00Z</dc:date><description>&lt;p&gt;x %d&lt;/p&gt;</description><category>c</category><category> d </category></item>"
    entry = '<entry><title type="html">Entry %d</title><link href="https://b/%d"/><updated>2026-03-03T11:00:00Z</updated><author><name>Ann</name></author><category term="t"/><summary>s</summary></entry>'
    (tmp_path / "a.xml").write_text('<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel>' + "\n".join(item % (i, i, i) for i in range(300)) + "<item><title> </title></item></channel></rss>")
    (tmp_path / "b.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(entry % (i, i) for i in range(20)) + "</feed>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        name = lambda df: df.withColumn("file", F.regexp_extract("file", "([^/]*)$", 1)).select("file", "title", "url", "published_at", "author", "snippet", "content", "tags", "error", "item_ord")
        split = name(files.feed(spark, str(tmp_path), "s", whole=100))
        whole = name(files.feed(spark, str(tmp_path), "s"))
        key = lambda r: (r.file, r.item_ord)
        assert sorted(split.collect(), key=key) == sorted(whole.where("file = 'b.xml' OR title <> ''").collect(), key=key) and split.count() == 320
        assert files._split_feed(spark, [str(tmp_path / "a.xml")]).select("title").distinct().count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a15_bodies_labels_and_search(spark):
    stubs = spark.createDataFrame([(0, '{"id":"a"}'), (1, '{"id":"b"}')], "ord int, json string")
    full = spark.createDataFrame([("a", {"Subject": "Invoice"}, ("plain text", "<p>html</p>"), "s", "INBOX", None), ("b", {}, (None, "<p>only <b>html</b></p>"), "s", None, None)], "msg_id string, headers map<string,string>, body struct<plain:string,html:string>, snippet string, labels string, parts array<struct<filename:string>>")
    m = {r.msg_id: r for r in inbox.parsed(stubs, full).collect()}
    assert (m["a"].body_plain, m["b"].body_plain) == ("plain text", "") and m["a"].labels == ["INBOX"]
    mails = inbox.parsed(stubs, full).withColumn("labels", F.array(F.lit("INBOX"), F.lit("UNREAD")))
    assert [r.msg_id for r in inbox.searched(mails, "invoice").collect()] == ["a"] and inbox.searched(mails, "", most=1).count() == 1
    assert "Subject: Invoice" in inbox.shown(mails, "a").head().text and inbox.shown(mails, "zz").count() == 0
    assert inbox.prompt(inbox.classified(mails)).count() == 2
    drafts = spark.createDataFrame([("d", {"To": "x@y"}, "PHA-SGk8L3A-", "snip"), ("e", {}, "", "")], "draft_id string, headers map<string,string>, data string, snippet string")
    assert inbox.draft_shown(drafts, "d").head().text.endswith("To: x@y\nSubject: (no subject)\nDate: (not set)\n\nHi") and "(empty body)" in inbox.draft_shown(drafts, "e").head().text
    ids = spark.createDataFrame([("a",)], "msg_id string")
    assert inbox.dismissed_with(inbox.dismissed_with(ids, "b"), "a").count() == 2


def _requests(spark):
    cards = spark.createDataFrame(
        [
            ("p1", 0, "1", "Software license renewal", "Parks", "", None, date(2026, 6, 1), None, "", "software cloud", "SDVOB Set-Aside", "", "u1"),
            ("p1", 1, "1", "Later card", "Parks", "", None, date(2026, 6, 1), None, "", "", "General", "", "u1"),
            ("p1", 2, "2", "Road salt", "Roads", "", None, date(2026, 6, 2), None, "", "", "General", "", "u2"),
            ("p2", 0, "3", "Ads", "Parks", "", None, None, None, "", "", "Contractor Ads", "", "u3"),
        ],
        "file string, item_ord long, cr_number string, title string, agency string, division string, issue_date date, due_date date, ad_end_date date, location string, category string, ad_type string, note string, detail_url string",
    )
    details = spark.createDataFrame([("detail_1.html", "1", "page text", [("a/x.pdf", "x.pdf"), ("a/y.csv", "y.csv")], 6.0, None, None), ("detail_9.html", "9", "no card", [], None, None, None)], f"file string, cr_number string, raw_text string, attachments {files.ATTACHMENTS}, sdvob_goal double, mbe_goal double, wbe_goal double")
    pages = spark.createDataFrame([("x.pdf", 2, "second"), ("x.pdf", 1, "saas azure microsoft")], "filename string, page int, text string")
    tables = spark.createDataFrame([("x.pdf", 0, 0, ["Item Description", "Qty"]), ("x.pdf", 0, 1, ["cisco switch", "2"]), ("x.pdf", 1, 0, ["no", "header"])], "filename string, table_idx int, row_idx int, cells array<string>")
    sheets = spark.createDataFrame([("/d/y.csv", 0, ["Description", "Unit Price"]), ("/d/y.csv", 1, ["dell laptop", "$5"])], "file string, row_idx int, cells array<string>")
    return cards, details, pages, tables, sheets


def test_stages_from_scan_to_proposal(spark):
    cards, details, pages, tables, sheets = _requests(spark)
    as_of = date(2026, 3, 3)
    new = files.assembled(cards, details, NOW)
    got = {r.cr_number: r for r in new.collect()}
    assert set(got) == {"1", "2", "3"} and got["1"].title == "Software license renewal" and got["1"].sdvob_goal == 6.0 and got["2"].raw_text == ""
    empty = spark.createDataFrame([], stages.TABLE)
    out = stages.scan(new, empty, as_of, pages, tables, sheets)
    assert {r.cr_number: r.disposition for r in out["dispositions"].collect()} == {"1": "kept", "2": "not_relevant", "3": "not_competitive"}
    table = out["table"].localCheckpoint()
    one = stages.decoded(table).where("cr_number = '1'").head()
    assert one.raw_text == "page text\n\n--- ATTACHMENTS ---\n\nsaas azure microsoft\n\nsecond" and one.attachment_paths == ["x.pdf", "y.csv"]
    assert [(i.description, i.quantity, i.unit_price) for i in one.line_items] == [("cisco switch", 2.0, None), ("dell laptop", None, 5.0)]
    assert stages.scan(new, table, as_of, pages, tables, sheets)["dispositions"].count() == 0
    contacts = spark.createDataFrame([(0, "cisco", "r@x", "R", "D1"), (1, "dell laptop", "r@x", "Q", "D2"), (2, "dell", "s@x", "S", "D2")], "ord int, text string, rep_email string, rep_name string, distributor_name string")
    deals = spark.createDataFrame([("d1", "software license renewal parks", 1000.0, 0)], "deal string, text string, revenue double, ord int")
    crm = spark.createDataFrame([(5, "[2] Road salt")], "id long, name string")
    end = stages.run_all(table, contacts, deals, as_of, crm)
    rows = {r.cr_number: r for r in end["table"].collect()}
    # A request without items isn't quoted, but analyzed all the same.
    assert {k: r.status for k, r in rows.items()} == {"1": "proposed", "2": "proposed", "3": "proposed"} and rows["2"].odoo_lead_id == 5
    assert {r.cr_number for r in end["leads"].collect()} == {"1", "3"} and end["folders"].where("cr_number = '1'").count() == 4
    mails = {r.to: r for r in end["mails"].collect()}
    assert set(mails) == {"r@x", "s@x"} and mails["r@x"].n_items == 2 and "cisco switch" in mails["r@x"].body and "June 01, 2026" in mails["r@x"].subject
    p = {r.cr_number: r for r in end["proposals"].collect()}
    assert [s.heading for s in p["1"].sections][7:] == ["MWBE / SDVOB Compliance", "Past Performance", "Contact Information"] and "Sdvob Set Aside" in p["1"].sections[7].text and len(p["2"].sections) == 9
    assert "Recommended bid: $" in p["1"].sections[4].text and end["bids"].count() == 3
    again = stages.deep_dive(end["table"], ["1", "99"], contacts, deals, as_of, details.withColumn("sdvob_goal", F.lit(None).cast("double")), pages, tables, sheets)
    one = again["table"].where("cr_number = '1'").head()
    assert one.status == "proposed" and one.sdvob_goal is None and again["leads"].count() == 1 and len(stages.decoded(again["table"]).where("cr_number = '1'").head().line_items) == 2


def test_listing_detail_and_backfill(spark):
    cards, details, pages, tables, sheets = _requests(spark)
    as_of = date(2026, 3, 3)
    table = stages.scan(files.assembled(cards, details, NOW), spark.createDataFrame([], stages.TABLE), as_of, pages, tables, sheets)["table"].localCheckpoint()
    lines = [r.line for r in stages.status_listing(table, as_of).orderBy("section", "rank").collect()]
    assert lines[0] == "CR# 3 | Ads | Due: TBD" and lines[1] == "CR# 1 | Software license renewal | Due: 2026-06-01 [MWBE/SDVOB] | SDVOB=6.0% | 2 items"
    text = stages.detail(table, "1").head().text
    assert text.startswith("CR# 1: Software license renewal [MWBE/SDVOB]\n====") and "Line Items (2):\n  1. cisco switch | Qty: 2.0" in text and "SDVOB Goal:  6.0%" in text
    many = table.withColumn("line_items_json", F.to_json(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(F.concat(F.lit("d"), i.cast("string")).alias("description")))))
    assert "  ... and 5 more items" in stages.detail(many, "1").head().text and stages.detail(table, "nope").count() == 0
    broken = stages.decoded(table.withColumn("line_items_json", F.lit("{not json"))).head()
    assert broken.line_items == []
    pages_ = spark.createDataFrame([("2", None, 3.0, None), ("1", 6.0, None, None)], "cr_number string, sdvob_goal double, mbe_goal double, wbe_goal double")
    out = stages.backfilled(table.withColumn("procurement_type", F.when(F.col("cr_number") == "3", "odd").otherwise(F.col("procurement_type"))), pages_)
    assert {r.cr_number for r in out["changed"].collect()} == {"2", "3"} and out["table"].where("cr_number = '2'").head().mbe_goal == 3.0
    deals = spark.createDataFrame([(2, "[7] b"), (1, "x [7]"), (3, "7")], "id int, name string")
    assert files.deal_of(deals, "7").head().id == 1 and files.deal_of(deals, "8").count() == 0


def test_a1_registry(spark, tmp_path):
    feed = '<rss><channel><item><title>Buffalo Bills %s</title><link>https://a/%s</link><pubDate>bad date</pubDate><updated>2026-03-03T11:00:00Z</updated></item></channel></rss>'
    card = '<div data-testid="content-card"><a href="/g">Game</a><p>note</p></div><article><a href="/w"><h2>Head</h2></a></article>'
    for n in files.SOURCES:
        (tmp_path / n).mkdir()
        if n in ("wkbw", "wgr550"):
            (tmp_path / n / "p.html").write_text(card)
        elif n != "wivb":
            (tmp_path / n / "f.xml").write_text(feed % (n, n) if n != "ub" else "broken")
    (tmp_path / "wivb/empty.xml").write_text("<rss><channel/></rss>")
    (tmp_path / "wivb_html").mkdir()
    (tmp_path / "wivb_html/p.html").write_text('<article><a href="/n"><h3>News</h3></a></article>')
    out = files.fetched(spark, files.registry(str(tmp_path)))
    rows = out["rows"].orderBy("ord").collect()
    assert [r.source for r in rows] == ["wgrz", "spectrum_buffalo", "city_of_buffalo", "wkbw", "wgr550", "wgr550", "wivb"]
    assert rows[0].published_at == NOW - timedelta(hours=1) and rows[2].tags == ["official"]  # the first date can't be parsed
    assert {(r.title, r.section) for r in rows if r.source == "wgr550"} == {("Game", "sports"), ("Head", "sports")}
    run = news.run(out["rows"], NOW, sources=out["report"])
    r = run["report"].head()
    assert (r.sources_attempted, r.sources_succeeded, r.sources_failed, r.raw_count) == (7, 6, 1, 7) and r.final_count == run["compact"].count() > 0
    assert news.listed(run["stories"], NOW).count() == r.final_count and "1. [" in news.prompt(run["stories"], NOW).head().prompt
    sinks.write_run({k: run[k] for k in ("stories", "digest", "report")}, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/run_report.json")).count() == 1


def test_texts_alert_and_projections(spark):
    cards, details, pages, tables, sheets = _requests(spark)
    as_of = date(2026, 3, 3)
    out = stages.alerted(files.assembled(cards, details, NOW), spark.createDataFrame([], stages.TABLE), as_of, pages, tables, sheets)
    table = out["table"].localCheckpoint()
    assert "CR# 1 [low]" in out["alert"].head().text and "2 items" in out["alert"].head().text
    assert stages.alerted(files.assembled(cards, details, NOW), table, as_of, pages, tables, sheets)["alert"].head().text == "HEARTBEAT_OK"
    say = lambda name, n=10: reports.text(spark, name, table, as_of, n).head().text
    assert say("top").startswith("Top 1 RFQs to focus on:\n\n 1. CR# 1 | Score: 1.00 [MWBE/SDVOB]\n    Software license renewal\n    Agency: Parks | Due: 2026-06-01 | Status: new")
    assert "sdvob_set_aside" in say("flagged") and "SDVOB=6.0%" in say("flagged") and say("due", 7) == "No RFQs due in the next 7 days."
    assert say("open").count("\n") == 1 and "Total RFQs tracked:     3" in reports.summary_text(spark, table, as_of).head().text
    assert [r.source for r in files.source_list(spark).orderBy("ord").collect()] == list(files.SOURCES)
    mails = spark.createDataFrame([("m", "Hi", "a@b", "sales", 0.126, None)], "msg_id string, subject string, sender_email string, category string, score double, date timestamp")
    assert inbox.projected(mails).head().score == 0.13
