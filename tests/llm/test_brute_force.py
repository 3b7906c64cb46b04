"""Each operator of the package against a plain version, on small and awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import _arrow as A
from quern.llm import fingerprints, langid, linededup, mixing, neardup, packing, resample, rules, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def rows(seed=0, n=60):
    """Nulls, empties, ties, copies, near copies, repeated rows, one long text."""
    r = random.Random(seed)
    words = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu".split()
    make = lambda k: " ".join(r.choice(words) + r.choice(["", "", "#", "!", "\n", "1"]) for _ in range(k))
    out = [(i, make(r.randint(0, 60)), r.choice(["en", "fr", None]), r.choice(["a", "b", None]), 0, "x") for i in range(n)]
    base = make(80)
    for i in range(n, n + 12):
        w = base.split(" ")
        for _ in range(i - n):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
        out.append((i, " ".join(w), "en", "a", 0, "x"))
    out += [(n + 20, None, None, None, None, None), (n + 21, "", "en", "a", 0, ""), (n + 22, " \t\n", "en", "a", 3, ""), (None, make(30), "en", "b", 0, ""), (n + 23, make(6000), "fr", "b", 0, "x")]
    return out + [out[3], out[n]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC).repartition(3)


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def hashes_of(text, width):
    """The 64-bit hashes of a text's shingles, alone in a batch."""
    h, first = A.word_hashes(*A.joined([text.encode()]))
    return A.shingles(h, first, width)[0].tolist()


def estimate(a, b, k=fingerprints.K):
    """Of the k smallest of both, the share that both have."""
    a, b = set(a.tolist()), set(b.tolist())
    low = sorted(a | b)[:k]
    return sum(x in a and x in b for x in low) / len(low) if a and b else float(not a and not b)


def test_op1_hot_ids_and_many_ranges(spark):
    """Rows of one id, or of none, are spread over ranges; each still finds its successor."""
    r = random.Random(3)
    data = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "".join(r.choice("abcd ") for _ in range(40)) + str(i)) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        parts = fingerprints._ordered(df).where("ghost = 0").groupBy("part").count().collect()
        got = fingerprints.with_successor(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert max(p["count"] for p in parts) < 120 and sum(p["count"] for p in parts) == 400
    signed = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64(t.encode(), seed=42).intdigest())
    order = sorted(data, key=lambda x: (-(2**63) if x[0] is None else x[0], signed(x[1])), reverse=True)
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest() for (_, t), (_, n) in zip(order, order[1:] + order[:1]))
    assert sorted(g.edited_sha256 for g in got) == want


def test_op1(spark, docs):
    got = fingerprints.with_successor(docs).collect()
    order = sorted(((d, t or "") for d, t, *_ in rows()), key=lambda x: -(2**63) if x[0] is None else x[0], reverse=True)
    assert len(got) == len(order)
    edits = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        edits.setdefault(d, set()).add(hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest())
    by_text = {}
    for g in got:
        assert g.edited_sha256 in edits[g.doc_id] and 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
    texts = dict(order)
    for g in got:
        by_text.setdefault(texts[g.doc_id], set()).add(g.fingerprint)
        if len(shingles(texts[g.doc_id], 5)) < fingerprints.K:
            assert g.distinct_shingles == len(shingles(texts[g.doc_id], 5))
    assert all(len(v) == 1 for v in by_text.values())
    plain = lambda t: np.array(sorted({h >> 16 for h in hashes_of(t, 5)})[: fingerprints.K], np.uint64)
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        e = t[: len(t) - m] + n[:m]
        mine = [g for g in got if g.doc_id == d and g.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()]
        assert mine and all(fingerprints.decode(g.fingerprint).tolist() == plain(t).tolist() for g in mine)
        assert all(fingerprints.decode(g.edited_fingerprint).tolist() == plain(e).tolist() for g in mine)
        a, b, c = (shingles(x, 5) for x in (t, e, n))
        for g in mine:
            assert g.near_edited == pytest.approx(estimate(plain(t), plain(e))) and g.near_next == pytest.approx(estimate(plain(t), plain(n)))
            # Sets that both fit whole have their exact likeness; others are near it.
            for x, y, got_near in ((a, b, g.near_edited), (a, c, g.near_next)):
                exact = len(x & y) / len(x | y) if x | y else 1.0
                assert got_near == pytest.approx(exact) if len(x | y) <= fingerprints.K else abs(got_near - exact) < 0.2
            if len(a | b) < fingerprints.K:
                assert g.edited_contained == pytest.approx(len(a & b) / len(b) if b else 1.0)
    assert fingerprints.with_successor(docs.limit(0)).count() == 0
    alone = fingerprints.with_successor(docs.where("doc_id = 5")).head()
    assert alone.near_next == 1.0
    merged = fingerprints.merged(spark.createDataFrame([(1, g.fingerprint) for g in got], "g int, fingerprint string"), ["g"]).head()
    every = sorted(set(np.concatenate([fingerprints.decode(g.fingerprint) for g in got]).tolist()))[: fingerprints.K]
    assert fingerprints.decode(merged.fingerprint).tolist() == every


def spans(words):
    """(bytes, starts, ends) of words laid end to end."""
    raw, at = A.joined([w.encode() for w in words])
    return raw, at[:-1], at[1:]


def test_op2(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = resample.resampled(docs, labels, share=0.5).collect()
    assert len(got) == len(rows())
    keys = sorted((g.key for g in got), reverse=True)
    least = keys[-(-len(keys) // 2) - 1]
    assert all(g.kept == (g.key >= least) for g in got)
    # Counts, log ratios and noise, from the definition.
    kinds = lambda t: re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+|[^0-9A-Za-z_\u0080-\U0010ffff\x20\x09-\x0D]+", t or "")
    buckets = {}
    for _, t, *_ in rows():
        words = [int(x) for x in A.span_hashes(*spans(kinds(t)), resample._BYTES)] if kinds(t) else []
        pairs = [int(A.mix(np.array([a], np.uint64) * A.U64(3) + np.uint64(b))[0]) for a, b in zip(words, words[1:])]
        buckets[t] = [x >> 50 for x in words + pairs]
    good = {i for i in range(50) if i % 2 == 0}
    raw, target = np.zeros(resample.BUCKETS), np.zeros(resample.BUCKETS)
    for d, t, *_ in rows():
        np.add.at(raw, buckets[t], 1)
        if d in good:
            np.add.at(target, buckets[t], 1)
    lean = 50 * resample.BUCKETS / 1000
    p_raw = (raw + 0.5) / (raw.sum() + 0.5 * resample.BUCKETS)
    w = np.log((target + lean * p_raw) / (target.sum() + lean)) - np.log(p_raw)
    assert resample.weights(docs, labels) == pytest.approx(w)
    for g in got:
        fits = [x for d, t, *_ in rows() if d == g.doc_id for x in [np.sum(w[buckets[t]]) if buckets[t] else resample.LAST]]
        assert any(g.log_weight == pytest.approx(x) for x in fits)
    noise = {r.doc_id: r.u for r in docs.select("doc_id", ((F.shiftrightunsigned(F.xxhash64(F.lit(resample.SEED), "doc_id"), 11) + 0.5) / float(2**53)).alias("u")).collect()}
    assert all(g.key == pytest.approx(g.log_weight - np.log(-np.log(noise[g.doc_id]))) for g in got)
    table = spark.createDataFrame([(float(random.Random(i).randrange(40)),) for i in range(3000)], "v double")
    values = sorted((r.v for r in table.collect()), reverse=True)
    assert [resample.kth_largest(table, "v", k, bins=8) for k in (1, 700, 3000)] == [values[0], values[699], values[2999]]
    assert resample.resampled(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("block", ["4k", "1g"])
def test_op3(spark, block):
    fake = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nHELLO\r\n\r\n"
    pages = [(1, fake), (2, "WARC/1.1\r\n"), (3, ""), (4, None), (5, fake + "é" + fake), (6, fake), (7, "a\r"), (8, "\r\n\r\nWARC/1.1")]
    pages += [(i, "WARC/1.1\r\nWARC-Type: x\r\nContent-Length: %d\r\n\r\n" % i * (i % 3) + "z" * (i % 90)) for i in range(9, 300)]
    df = spark.createDataFrame([(i, f"http://x/ {i}", h, 1) for i, h in pages], "page_id long, url string, html string, digest int").coalesce(2)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(map(tuple, warc.round_trip(df).collect()))
        assert warc.round_trip(df.limit(0)).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    last = {}
    for i, h in pages:
        last[h or ""] = max(i, last.get(h or "", i))
    want = []
    for i, h in pages:
        b, m = (h or "").encode(), last[h or ""]
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == m else "revisit", None if i == m else m))
    assert got == sorted(want)


def test_op3_odd_rows(spark):
    """Null ids and addresses, repeated rows, ties for the largest id, a long payload, clashing columns."""
    pages = [(None, "http://x", "same"), (5, None, "same"), (5, "http://y", "same"), (4, "", "same"), (9, "http://z", "WARC/1.1\r\n" * 20_000), (10, "u", "long " * 300_000), (10, "u", "long " * 300_000)]
    df = spark.createDataFrame([(i, u, h, "mine") for i, u, h in pages], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(df).collect()
    assert sorted((str(g.page_id), g.payload_bytes) for g in got) == sorted((str(i), len(h)) for i, _, h in pages)
    sha = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    assert sorted(g.payload_digest for g in got) == sorted(sha(h) for _, _, h in pages)
    by = {(g.page_id, g.record_type, g.refers_to) for g in got}
    assert (4, "revisit", 5) in by and (9, "response", None) in by and any(i == 5 and k == "response" for i, k, _ in by) and any(i == 10 and k == "response" for i, k, _ in by)


def test_op3_hashes_a_payload_once(spark):
    """In each pass over the pages; a lambda or a repeated expression would hash it again for each group of digits."""
    texts = ["", "a", "é" * 50, *("x%d" % i * i for i in range(200))]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u"))
    for made in (warc.records(df), warc.hashed(df).groupBy("digest").agg(F.max("page_id"))):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("sha1(cast") == 1 and "lambda" not in plan
    got = {r.page_id: (r.n, r.digest) for r in warc.hashed(df).collect()}
    assert got == {i: (len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()) for i, t in enumerate(texts)}


def goals_of(sizes):
    """Each source's target, by filling up again and again."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    goal, rest = {}, set(names)
    while rest:
        left = sum(sizes.values()) - sum(goal.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = [s for s in rest if share[s] > 3 * sizes[s]]
        goal |= {s: 3.0 * sizes[s] for s in full} if full else share
        rest -= set(full) if full else rest
    return goal


def test_op4(spark):
    given = rows()
    docs = spark.createDataFrame(given, DOC).repartition(3)
    got = mixing.copies(docs).collect()
    sizes, shortest = {}, {}
    for _, t, _, s, *_ in given:
        n = len(WORD.findall(t or ""))
        sizes[s] = sizes.get(s, 0) + n
        shortest[s] = min(shortest.get(s, n) or n, n or shortest.get(s, n))
    goal = goals_of(sizes)
    assert len(got) == len(given)
    taken = {}
    for g in got:
        s = g.doc.source
        assert g.source_size == sizes[s] and g.target == pytest.approx(goal[s]) and 0 <= g.taken <= 3 * g["size"]
        assert g["size"] > 0 or g.copies == 1
        taken[s] = taken.get(s, 0) + g.taken
    longest = {s: max(len(WORD.findall(t or "")) for _, t, _, x, *_ in given if x == s) for s in sizes}
    for s in sizes:
        # Two rows are equal, and move together. One source's text alone exceeds its target.
        assert abs(taken[s] - goal[s]) <= (longest[s] if longest[s] > goal[s] else max(60, shortest[s])), s
    assert sum(longest[s] > goal[s] for s in sizes) == 1
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(mixing.copies(docs).collect(), key=key)
    assert mixing.copies(docs.limit(0)).count() == mixing.mixed(docs.limit(0)).count() == 0


def test_op4_document_beyond_its_target(spark):
    """It is taken once or not at all, whichever is nearer."""
    given = [(1, "x " * 900, "en", "a", 0, ""), (2, "y " * 100, "en", "b", 0, ""), (3, "z " * 10, "en", "c", 0, ""), (4, "w " * 800, "en", "d", 0, ""), (5, "v " * 800, "en", "e", 0, "")]
    got = {g.doc.source: g for g in mixing.copies(spark.createDataFrame(given, DOC)).collect()}
    assert got["a"].target < 900 and got["d"].target < 800 and got["b"].taken == 300
    assert all(g.copies == int(g.target / g["size"] + 0.5) for g in got.values())


def test_op4_many_sources(spark):
    """Weights and level over several ranges of sources."""
    r = random.Random(4)
    given = [(i, "w " * r.randint(1, 40), "en", "s%03d" % r.randrange(150) if i % 50 else None, 0, "") for i in range(3000)]
    sizes, taken, goal = {}, {}, {}
    for _, t, _, s, *_ in given:
        sizes[s] = sizes.get(s, 0) + len(t) // 2
    for g in mixing.copies(spark.createDataFrame(given, DOC).repartition(5)).collect():
        taken[g.doc.source], goal[g.doc.source] = taken.get(g.doc.source, 0) + g.taken, g.target
    assert goal == pytest.approx(goals_of(sizes))
    assert all(abs(taken[s] - goal[s]) <= 40 for s in goal) and sum(abs(taken[s] - goal[s]) <= 2 for s in goal) > 0.8 * len(goal)


CLASHES = ("size", "rate", "copies", "taken", "source_size", "target", "n_words", "kept", "failed", "n_lines", "n_dropped", "is_copy", "body", "bad", "doc", "_kept", "kept_id", "n", "h", "_s", "_z", "_f", "rank", "component_id", "doc.size")


def test_columns_of_any_name_stay(spark, docs):
    """Operators and stages that return the input's rows leave its other columns alone."""
    import corpus_pipeline

    wide = docs.withColumns({c: F.lit(f"mine {c}") for c in CLASHES}).drop("extra")
    quoted = [F.col(f"`{c}`") for c in CLASHES]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, "/nowhere")
        if name == "packing":
            assert out.count() > 0
            continue
        assert out.columns == wide.columns
        assert all(list(r) == [f"mine {c}" for c in CLASHES] for r in out.select(*quoted).collect())
        assert stage(spark, wide.limit(0), "/nowhere").count() == 0
    assert mixing.copies(wide).count() == rules.ledger(wide).count() == fingerprints.with_successor(wide).count() == neardup.near_duplicates(wide).count() == docs.count()


def test_op5(spark):
    r = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    data, labels = [], []
    for i in range(500):
        w = [r.choice(words) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for k in r.sample(range(60), 3):
                w[k] = r.choice(["idiotic", "moronic", "scummy"])
        data.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(bad)))
    data += [(900, None, None), (901, "", "en"), (None, "w1 w2", "xx")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    l_ = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {g.doc_id: g for g in toxicity.scored(d, l_).collect()}
    assert len(got) == len(data)
    out = [i for i in range(500) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(out)) for i in range(500))
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in out]) > 0.9
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.7) for g in got.values())
    # Tables of sums score as the network does.
    learned, _ = toxicity.trained(d, l_)
    raw, at = A.joined([t.encode() for _, t, _ in data[:20]] + [b"", b"one", b"a b"])
    ids, first = toxicity.word_ids(raw, at)
    assert toxicity.scores(learned, learned.tables(), raw, at) == pytest.approx(learned.calibrated(learned.forward(ids, first)[0]), abs=1e-4)
    assert toxicity.scored(d.limit(0), l_).count() == 0


def test_op5_gradients():
    """Against finite differences, in every part of the network."""
    net = toxicity.Net()
    r = np.random.default_rng(1)
    net.p = {k: r.normal(0, 0.3, x.shape).astype(np.float64) for k, x in net.p.items()}
    net.p["E"][toxicity.BUCKETS] = 0
    data, at = A.joined([b"one two three four five", b"longerword two", b"", b"six"])
    ids, first = toxicity.word_ids(data, at)
    y, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([2.0, 1.0, 2.0, 1.0])

    def loss():
        z = net.forward(ids, first)[0]
        return float(np.mean(weight * (np.logaddexp(0, z) - y * z)))

    g = net.gradients(ids, first, y, weight)
    rows_of, dense = g["E"]
    spots = {k: [tuple(r.integers(0, n) for n in x.shape) for _ in range(12)] for k, x in net.p.items() if k != "E"}
    spots["E"] = [(int(row), int(r.integers(0, toxicity.DIMS))) for row in rows_of if row != toxicity.BUCKETS][:40]
    for k, places in spots.items():
        for p in places:
            old = net.p[k][p]
            net.p[k][p] = old + 1e-3
            up = loss()
            net.p[k][p] = old - 1e-3
            down = loss()
            net.p[k][p] = old
            mine = dense[np.flatnonzero(rows_of == p[0])[0], p[1]] if k == "E" else g[k][p]
            assert mine == pytest.approx((up - down) / 2e-3, rel=0.02, abs=5e-4), (k, p)


def test_op5_thresholds():
    r = np.random.default_rng(2)
    for _ in range(50):
        s, y = r.random(40), r.integers(0, 2, 40)
        if y.any() and not y.all():
            f1 = lambda t: 2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + y.sum())  # noqa: E731, B023
            assert f1(toxicity.best_threshold(s, y)) == pytest.approx(max(f1(t) for t in s))


def test_op5_long_text_in_parts():
    r = random.Random(4)
    net = toxicity.Net()
    tables = net.tables()
    texts = [" ".join(r.choice(("one", "two", "abcdefghij", "é")) + r.choice("  ,.!") for _ in range(r.randint(0, 400))).encode() for _ in range(30)] + [b"x" * 150, b"  " * 900]
    raw, at = A.joined(texts)
    assert toxicity.scores(net, tables, raw, at, 200) == pytest.approx(toxicity.scores(net, tables, raw, at), abs=1e-6)


def test_op5_distinct_words(monkeypatch):
    """A word's prefixes are hashed, and its table rows summed, once a batch; scores and training are as word by word."""
    r = random.Random(8)
    vocab = ["one", "One", "abcdefghij", "abcdefgh", "abcdéfghij", "é", "x" * 300, "sixsix", "fives"]
    texts = [" ".join(r.choice(vocab) for _ in range(r.choice((0, 1, 2, 3, 400)))).encode() for _ in range(70)]
    raw, at = A.joined(texts)
    ids, code, first = toxicity.vocabulary(raw, at)
    assert len(ids) == len(vocab) - 1 and len(code) == first[-1] == sum(len(t.split()) for t in texts)
    for k, w in enumerate(x for t in texts for x in t.split()):
        h = [int(A.span_hashes(d, np.array([0]), np.array([len(d)]), A.LETTERS)[0]) for n in (len(w), *toxicity.PREFIXES) for d in [np.frombuffer(w[:n], np.uint8)]]
        h[1:] = [int(A.mix(np.array([x], np.uint64) + np.uint64(n))[0]) for x, n in zip(h[1:], toxicity.PREFIXES)]
        some = [True, *[len(w) > n for n in toxicity.PREFIXES]]
        assert ids[code[k]].tolist() == [y for x, own in zip(h, some) for y in ([x >> 47, x & (toxicity.BUCKETS - 1)] if own else [toxicity.BUCKETS] * 2)]
    y = np.array([float(b"six" in t) for t in texts])
    net, plain = toxicity.Net(), toxicity.Net()
    net.train(ids, code, first, y, epochs=2)
    plain.train(ids[code], np.arange(len(code)), first, y, epochs=2)
    assert all((net.p[k] == plain.p[k]).all() for k in net.p)
    hashed, real = [], A.span_hashes
    monkeypatch.setattr(A, "span_hashes", lambda data, starts, *rest: hashed.append(len(starts)) or real(data, starts, *rest))
    tables = net.tables()
    z = toxicity.logits(net, tables, raw, at)
    assert sum(hashed) <= len(code) + len(toxicity.PREFIXES) * len(ids)
    assert z == pytest.approx(net.forward(*toxicity.word_ids(raw, at))[0], abs=1e-4)
    # Not even the last bit depends on the texts beside.
    assert z.tolist() == [toxicity.logits(net, tables, *A.joined([t]))[0] for t in texts]


def test_op5_moves_labelled_texts_only(spark):
    """Texts without a label meet no exchange; those that are learned from are what a plain join finds."""
    docs = spark.range(4000).selectExpr("CAST(id AS INT) AS doc_id", "concat('t', id) AS text", "'en' AS lang")
    labels = spark.range(0, 4000, 40).selectExpr("id AS doc_id", "1 AS quality", "CAST(id % 80 = 0 AS INT) AS toxic")
    made = toxicity._examples(docs, labels)
    assert {(r.doc_id, r.text, r.toxic) for r in made.collect()} == {(i, f"t{i}", int(i % 80 == 0)) for i in range(0, 4000, 40) if zlib.crc32(str(i).encode()) % 3 != 1}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = toxicity._examples(docs, labels)
        made.collect()
        plan, written = [made._jdf.queryExecution().executedPlan().executedPlan()], []
        while plan:
            node = plan.pop()
            plan += [node.children().apply(k) for k in range(node.children().size())]
            if "QueryStage" in node.nodeName():
                plan.append(node.plan())
            if node.metrics().contains("shuffleRecordsWritten"):
                written.append(node.metrics().apply("shuffleRecordsWritten").value())
        assert written and max(written) < 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_op5_odd_rows(spark):
    """A doc_id with both labels is no example; repeated rows and a very long text have scores."""
    data = [(i, ("vile " if i % 2 else "kind ") * 30 + f"w{i}", "en") for i in range(300)] + [(400, "kind " * 300_000, "en"), (400, "kind " * 300_000, "en")]
    labels = [(i, 1, i % 2) for i in range(300)] + [(i, 1, 1 - i % 2) for i in range(100)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = toxicity.scored(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(data) and np.mean([g.predicted == g.doc_id % 2 for g in got if g.doc_id < 300]) > 0.95
    assert len({g.score for g in got if g.doc_id == 400}) == 1


def components(data, width, percent):
    sets = {i: shingles(t, width) for i, t, *_ in data if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_op6(spark, docs, width, percent, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)  # several blocks per hub
    r = random.Random(7)
    base = ["v%d" % r.randrange(500) for _ in range(90)]
    data = rows()
    for i in range(200, 260):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(90)] = "e%d" % r.randrange(10**6)
        data.append((i, " ".join(w), "en", "a", 0, "x"))
    got = neardup.near_duplicates(spark.createDataFrame(data, DOC).repartition(3), width, percent).collect()
    want = components(data, width, percent)
    assert len(got) == len(data)
    for g in got:
        if g.doc_id is None:
            assert g.component_id is None and g.kept
        else:
            assert (g.n_shingles, g.component_id, g.kept) == want[g.doc_id]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_op6_template_pages_below_the_similarity(spark):
    """A large group of pages of one template, none of them similar enough, makes no blocks; those that are, are found."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    head = " ".join(word() for _ in range(66))
    pages = [(i, head + " " + " ".join(word() for _ in range(30)), "en", "a", 0, "x") for i in range(1200)]
    pages += [(2000 + i, pages[i][1] + " more", "en", "a", 0, "x") for i in range(5)]
    dealt = []
    old = neardup._across

    def seen(rows, *a):
        dealt.append(rows.count())
        return old(rows, *a)

    neardup._across = seen
    try:
        got = {g.doc_id: g.component_id for g in neardup.near_duplicates(spark.createDataFrame(pages, DOC).repartition(3)).collect()}
    finally:
        neardup._across = old
    assert got == {i: i - 2000 if i >= 2000 else i for i, *_ in pages}
    assert sum(dealt) <= 20


def test_op6_shape():
    assert neardup.shape(0.85) == 9 and neardup.shape(0.8) > 9


def test_op7(spark, docs):
    got = rules.apply_policy(rules.ledger(docs))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    run = con.execute(rules.ORACLE)
    names = [c[0] for c in run.description]
    want = sorted(str(r) for r in run.fetchall())
    assert sorted(str(tuple(r[c] for c in names)) for r in got.select(*names).collect()) == want
    ab = {r.rule: r for r in rules.ablations(got).collect()}
    failed = [r.failed for r in got.collect()]
    assert all(ab[n].n_failed == sum(bool(f & b) for f in failed) and ab[n].n_only == sum(f == b for f in failed) for n, b in rules.BITS.items())
    assert rules.union_of_failures(got.withColumn("g", F.lit(1)), "g").head().n == len(failed)


def test_op7_odd_rows(spark, docs):
    assert rules.ledger(docs.limit(0)).count() == rules.ablations(rules.ledger(docs.limit(0))).where("n_failed > 0").count() == 0
    long = spark.createDataFrame([(1, "word " * 500_000), (1, "word " * 500_000)], "doc_id long, text string")
    got = rules.apply_policy(rules.ledger(long)).collect()
    assert len(got) == 2 and all(g.n_words == g.n_repeat_words == 500_000 and g.base_failed for g in got)


def templates(text):
    """The templates of each line, from the definition."""
    out = []
    for line in (text or "").split("\n"):
        t = ["<*>" if re.search(r"[0-9]", w) else w for w in WORD.findall(line)]
        n, keys = len(t), set()
        if n >= linededup.LEAST:
            keys.add((n, tuple(t)))
            if n >= linededup.OPEN:
                for q in range(4):
                    a, b = n * q // 4, n * (q + 1) // 4
                    keys.add((n, *t[: linededup.DEPTH], q, tuple(t[:a]), tuple(t[b:])))
        out.append((line, n, keys))
    return out


def test_op8(spark, docs):
    shared = ["user 12 logged in from the home page today ok", "user 99 logged in from the work page today ok", "user 7 logged in from the home page today ok"]
    data = rows() + [(300 + i, f"{s}\nown words {i}a {i}b and more of them here and there {i} q{i} r s t u", "en", "a", 0, "x") for i, s in enumerate(shared)]
    got = {(g.doc.doc_id, g.doc.text): g for g in linededup.deduplicated(spark.createDataFrame(data, DOC).repartition(3)).collect()}
    found = [templates(t) for _, t, *_ in data]
    count = {}
    for f in found:
        for k in set().union(*[k for _, _, k in f]):
            count[k] = count.get(k, 0) + 1
    want = set()
    for (d, t, *_), f in zip(data, found):
        bad = [any(count[k] >= linededup.DOCUMENTS for k in keys) for _, _, keys in f]
        want.add((d, t if not any(bad) else "\n".join(x for (x, _, _), b in zip(f, bad) if not b)))
    assert set(got) == want and any(g.n_dropped for g in got.values())
    assert linededup.deduplicated(docs.limit(0)).count() == linededup.deduplicated(docs.limit(0), copy=0.6).count() == 0


def test_op8_long_text(spark):
    """A text of very many lines, most of them recurring, and one of a very long line."""
    line = "line %s speaks of %s and of nothing else but %s"
    names = ["".join(chr(97 + int(c)) for c in str(i)) for i in range(20_000)]
    text = "\n".join(line % (n, n, n) for n in names)
    data = [(i, text + f"\nown {i}", "en", "a", None, "") for i in range(3)] + [(9, "word " * 200_000, "en", "a", None, "")]
    got = {g.doc.doc_id: g for g in linededup.deduplicated(spark.createDataFrame(data, DOC)).collect()}
    assert [got[i].doc.text for i in range(3)] == [f"own {i}" for i in range(3)] and got[9].n_dropped == 0


def test_op9(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(1000, None, "en", None, 0), (1001, "12 ##", "en", None, 0), (None, "the and of the", None, None, 0)], table.schema)
    got = {g.doc_id: g for g in langid.identified(table.unionByName(more)).collect()}
    lang = {r.doc_id: r.lang for r in table.collect()}
    out = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i in out) and np.mean([got[i].lang_pred == lang[i] for i in out]) > 0.9
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and all(0 <= g.score <= 1 for g in got.values())
    assert langid.identified(table.limit(0)).count() == 0


def test_op9_against_plain_kernels():
    """Features, landmarks and ridge regression, with dense matrices and sets."""
    r = random.Random(9)
    words = {"a": "the of and to in".split(), "b": "le la les et des".split(), "c": "der die und das ein".split()}
    texts = [(v, " ".join(r.choice(words[v]) for _ in range(r.randint(5, 60))).encode()) for v in "abc" * 12]

    def grams(x):
        fold = bytes(langid._FOLD[list(x)].tolist())
        out = set()
        for k in range(4):
            for i in range(len(fold) - k):
                code = int.from_bytes(fold[i : i + k + 1], "little")
                out.add(((code * 0x9E3779B1 & 0xFFFFFFFF ^ (k * 0x632BE59B & 0xFFFFFFFF)) * 0x85EBCA77 & 0xFFFFFFFF) >> 20)
        return out

    sets = [grams(t) for _, t in texts]
    kernel = lambda p, q: len(p & q) / np.sqrt(len(p) * len(q))
    k = np.array([[kernel(p, q) for q in sets] for p in sets])
    data, at = A.joined([t for _, t in texts])
    x, doc = langid.blocks(data, at)
    assert doc.tolist() == list(range(36)) and x @ x.T == pytest.approx(k, abs=1e-5)
    y = np.array(["abc".index(v) for v, _ in texts])
    marks = np.concatenate([np.flatnonzero(y == c)[np.unique(np.linspace(0, 11, 3).astype(int))] for c in range(3)])
    values, vectors = np.linalg.eigh(k[np.ix_(marks, marks)])
    keep = values > 1e-6 * values.max()
    z = np.column_stack([k[:, marks] @ vectors[:, keep] / np.sqrt(values[keep]), np.ones(36)])
    t = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    penalty = langid.RIDGE * 36 / z.shape[1] * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-9
    want = z @ np.linalg.solve(z.T @ z + penalty, z.T @ t)
    model = langid.fit([t for _, t in texts], [v for v, _ in texts], landmarks=9)
    assert model.languages == ["a", "b", "c"] and model.scores(data, at) == pytest.approx(want, abs=2e-3)


def test_op9_odd_rows(spark):
    """Repeated rows agree, a doc_id with two languages and a very long text are fine, a hot language is cut to its share."""
    data = [(i, "the and of to in that is" if i % 4 else "le la les des et est", "en" if i % 4 else "fr", "s", 0) for i in range(900)]
    data += [(5, "le la les", "fr", "s", 0), (5, "le la les", "fr", "s", 0), (1000, "the of and " * 200_000, "en", "s", 0)]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    got = langid.identified(d).collect()
    assert len(got) == len(data) and np.mean([g.lang_pred == ("en" if g.doc_id % 4 else "fr") for g in got if g.doc_id != 5]) > 0.99
    assert len({(g.lang_pred, g.score) for g in got if g.doc_id == 5}) == 2


def test_op10(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.packed(docs).collect()
    want = sorted(zlib.crc32(np.asarray(ids[s : s + n], "<u4").tobytes()) for ids in (whole.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in rows()) for s, n in cuts(len(ids)))
    assert sorted(g.ids_crc32 for g in got) == want
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(g.length for g in got) // 1024) + 2
    assert packing.packed(docs.limit(0)).count() == 0


def cuts(n, capacity=1024):
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def test_op10_encoder_is_exact():
    from tokenizers import Tokenizer

    whole, quick = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    assert quick.quick is not None
    r = random.Random(5)
    parts = list("ab zé \n\t  '.!1 <|>　") + ["'s", " the", "<|endoftext|>", "ß", "日本", "😀", "\r\n", "\x1c", "\x85", "\xa0", "à"]
    for _ in range(300):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 20))) for _ in range(r.randint(0, 5))]
        raw, at = A.joined([t.encode() for t in texts])
        for t, ids in zip(texts, quick.encode(raw, at)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_op10_equal_hashes_go_to_the_tokenizer(monkeypatch):
    """If parts have equal hashes, the ids that spell another part are found out."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    real = packing.span_hashes
    monkeypatch.setattr(packing, "span_hashes", lambda *a: real(*a) % np.uint64(5))
    quick = packing.Encoder(packing.default_tokenizer())
    texts = ["one two three four five six seven", "eight nine ten", "", "aa bb cc dd ee ff gg hh"]
    raw, at = A.joined([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in quick.encode(raw, at)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_op10_plan_wastes_nothing_it_needn_t():
    r = random.Random(6)
    for _ in range(50):
        counts = {r.randint(1, 64): r.randint(1, 300) for _ in range(r.randint(1, 30))}
        seen, fill = {}, {}
        for n, rank, count, first, offset, per in packing.plan(counts, 64):
            for k in range(count):
                seen.setdefault(n, set()).add(rank + k)
                fill.setdefault(first + k // per, []).append((offset + k % per * n, n))
        assert {n: len(s) for n, s in seen.items()} == counts
        assert all(sum(n for _, n in s) <= 64 and sorted(s)[0][0] == 0 for s in fill.values())
        assert len(fill) <= 1.25 * -(-sum(n * c for n, c in counts.items()) // 64) + 20 or max(counts) > 32


def test_words_agree_with_the_pattern():
    texts = [t or "" for _, t, *_ in rows()]
    raw, at = A.joined([t.encode() for t in texts])
    h, first = A.word_hashes(raw, at)
    assert np.diff(first).tolist() == [len(WORD.findall(t)) for t in texts]
    values, begin = A.unique_sets(*A.shingles(h, first, 3))
    assert np.diff(begin).tolist() == [len(shingles(t, 3)) for t in texts]


def test_op5_learns_from_all_labelled_rows(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', IF(id = 2, 50000, 2)) AS text", "'en' AS lang")
    rows = toxicity._examples(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).select("doc_id", "part")
    want = {r.doc_id for r in docs.where(~toxicity.held_out()).select("doc_id").collect()}
    got = rows.collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want) + (2 in want)
