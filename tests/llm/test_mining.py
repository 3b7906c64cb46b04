"""Operators 11 to 13 against plain versions, on small and awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import centroids, phrases, sanitise

LOWER = {c: c + 32 for c in range(65, 91)}
DOC = "doc_id long, text string, lang string, `w` int, n long, p string"


# --- phrases ---------------------------------------------------------------------------


def text_rows():
    """Nulls, empties, repeats, breaks, case, a hot word, a common passage, one very long piece."""
    r = random.Random(5)
    words = "the the the The alpha Beta gamma épsilon zeta x η a\x00b 1".split(" ")
    make = lambda k: "".join(r.choice(words) + r.choice([" ", "  ", "\t", ". ", "\n", "! ", " "]) for _ in range(k))
    out = [(i, make(r.randint(0, 60)), r.choice(["en", "fr", None, "und"]), 1, 2, "x") for i in range(60)]
    out += [(i, "start of a passage that all of them share " + make(3), "en", 1, 2, "x") for i in range(60, 90)]
    out += [(90, None, "en", None, None, None), (91, "", None, None, None, None), (92, " .,;\n", "fr", None, None, None), (93, "the " * 20000, "de", 1, 1, "")]
    return out + [out[0], out[0], out[61]]


def plain_phrases(rows, least, longest, top):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        rows_ = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and inside(p, q) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("least", "longest", "top"), [(3, 5, 2000), (2, 3, 7), (40, 4, 5)])
def test_op11(spark, least, longest, top):
    rows = text_rows()
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = phrases.mined(docs, least, longest, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, least, longest, top)
    assert phrases.mined(docs.limit(0)).count() == 0


def test_op11_grows_across_batches():
    """Prefixes cut by a batch's end are reported by both sides; their counts add up."""
    r = random.Random(2)
    rows = sorted({tuple(r.choice((1, 1, 2, 3)) for _ in range(r.randint(2, 5))) for _ in range(400)})
    n = [r.randint(1, 3) for _ in rows]
    want = Counter()
    for p, c in zip(rows, n):
        want.update({p[:k]: c for k in range(2, len(p) + 1)})
    for step in (1, 7, 50, 1000):
        got = Counter()
        for s in range(0, len(rows), step):
            some = rows[s : s + step]
            p = np.array([[*x, *[0] * (5 - len(x))] for x in some])
            for i, k, c in phrases._grow(np.zeros(len(some)), p, np.array([len(x) for x in some]), np.array(n[s : s + step]), 20):
                got[some[i][:k]] += c
        assert {p: c for p, c in got.items() if c >= 20} == {p: c for p, c in want.items() if c >= 20}


def test_op11_exact_arithmetic(spark):
    """Products beyond 64 bits."""
    a, n, f = 4_000_000_000_007, 900_000_000_000_011, 5_000_000_000_021
    found = spark.createDataFrame([("en", [1, 2], a)], "lang string, p array<long>, a long")
    frequent = spark.createDataFrame([("en", 1, "x", f), ("en", 2, "y", f + 2)], "lang string, h long, w string, n long")
    total = spark.createDataFrame([("en", n)], "lang string, n long")
    got = phrases.ranked(found, frequent, total).head()
    assert (got.phrase, got.score) == ("x y", 1000 * a * n // (f * (f + 2)))


# --- personal data ---------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    return sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_found(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == 0 or kind == 1 and all(int(x) <= 255 for x in m[0].split(".")) or kind == 2 and 16 <= len(d) <= 19 and luhn(d) or kind == 3 and 8 <= len(d) <= 15:
                out.append((kind, *m.span(), m[0].lower() if kind == 0 else m[0] if kind == 1 else d))
    return out


def test_op12_patterns():
    r = random.Random(1)
    for i in range(6000):
        letters = r.choice(["a@.b-", "1.2", "12 -+(.", "a1@. +-3", "0123456789 ", "é1.@a", "+1( )"])
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 60)))
        assert sanitise.found(text) == plain_found(text), text
    card = "4111 1111-1111 1111"
    text = f"é {card} x@y.z 1.2.3.4 +1 (212) 555-0153"
    assert [x[0] for x in sanitise.found(text)] == [0, 1, 2, 3] and sanitise.found(text) == plain_found(text)


def test_op12_long_runs():
    """Megabytes of one character take time in proportion."""
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1" + "(" * 1_000_000, "a@" * 500_000, "." * 999_999 + "@b.c"):
        sanitise.found(text)


def pii_rows():
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = [(i, make(r.randint(0, 40)), "en", 1, 2, "x") for i in range(400)]
    # Three entities whose neighbours are telling, one of them only in copies; and one in many documents.
    rows += [(1000 + i, f"{make(12)} bob smythe bob@acme.org dentist {make(12)}", "en", 1, 2, "x") for i in range(6)]
    rows += [(1100 + i, f"{make(5)} Émile call +1 (212) 555-0153 {make(12)} {i}", None, 1, 2, "x") for i in range(5)]
    rows += [(1200 + i, "only in copies hidden 10.0.0.1 word", "en", 1, 2, "x") for i in range(9)]
    rows += [(1300 + i, f"{make(8)} office@firm.example {make(8)} office", "en", 1, 2, "x") for i in range(120)]
    rows += [(2000, None, None, None, None, None), (2001, "", "en", 1, 2, ""), (None, "smythe a@b.c", "en", 1, 2, ""), (2002, "smythe without", "en", 1, 2, ""), (2003, make(60000) + " x@y.zz", "en", 1, 2, "")]
    return rows + [rows[401], rows[401]]


def plain_sanitised(rows, window, support, generalised, removed):
    texts = [t or "" for _, t, *_ in rows]
    df, seen, words_of = Counter(), defaultdict(set), []
    for t in texts:
        base = plain_found(t)
        words = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer("[0-9A-Za-z\x80-\U0010ffff]+", t)]
        df.update({w for _, _, w in words})
        free = [(a, b, w) for a, b, w in words if not any(s < b and a < e for _, s, e, _ in base)]
        words_of.append((base, free))
        by = defaultdict(list)
        for kind, s, e, value in base:
            before = [w for a, _, w in free if a < s][-window:]
            by[kind, value].append(before + [w for a, _, w in free if a >= e][:window])
        for c, parts in by.items():
            where = min(map(tuple, parts))  # any rule that looks at the surroundings alone
            seen[c].add(where)
            for w in {w for p in parts for w in p}:
                seen[c, w].add(where)
    n, level = len(texts), {}
    for c in [c for c in seen if isinstance(c[0], int)]:
        ne = len(seen[c])
        for key in [k for k in seen if k[0] == c]:
            net = len(seen[key])
            if net >= support and n > ne:
                share = math.log2(net * n / (ne * df[key[1]])) / math.log2(n / ne)
                assert min(abs(share - generalised), abs(share - removed)) > 1e-9
                if share >= generalised:
                    level[key] = int(share >= removed)
    out = []
    for (doc_id, *_), (base, free) in zip(rows, words_of):
        spans = [f"{sanitise.KINDS[k]}:{s}:{e}" for k, s, e, _ in base]
        sha = hashlib.sha256(",".join(spans).encode()).hexdigest()
        most = {}
        for k, _, _, v in base:
            for a, b, w in free:
                if ((k, v), w) in level:
                    most[a, b] = max(most.get((a, b), 0), level[(k, v), w])
        spans += [f"{sanitise.LEVELS[x]}:{a}:{b}" for x, a, b in sorted((x, a, b) for (a, b), x in most.items())]
        out.append(str((doc_id, *[sum(s[0] == k for s in base) for k in range(4)], sha, ",".join(spans))))
    return sorted(out)


@pytest.mark.parametrize(("window", "support", "generalised", "removed"), [(10, 3, 0.7512, 0.9012), (3, 2, 0.3012, 0.9912)])
def test_op12(spark, window, support, generalised, removed):
    rows = pii_rows()
    docs = spark.createDataFrame(rows, DOC).repartition(5)
    got = sanitise.findings(docs, window, support, generalised, removed).drop("text_sha256")
    got = sorted(str(tuple(x)) for x in got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect())
    want = plain_sanitised(rows, window, support, generalised, removed)
    assert got == want
    assert any("removed" in x for x in want) and any("generalised" in x for x in want)
    assert sanitise.findings(docs.limit(0)).count() == 0


def test_op12_texts(spark):
    docs = spark.createDataFrame(pii_rows(), DOC)
    got = {x.doc.doc_id: x for x in sanitise.sanitised(docs).collect()}
    assert got[2000].sanitised == "" and got[2002].sanitised == "smythe without"
    assert "acme" not in got[1000].sanitised and "smythe" not in got[1000].sanitised and "[email]" in got[1000].sanitised
    assert got[1200].sanitised == "only in copies hidden [ip] word"  # copies prove nothing
    assert sanitise.sanitised(docs).count() == docs.count()


# --- centroids -------------------------------------------------------------------------


def vectors(r, n=300, dim=8):
    rows = [(i, [r.gauss(0, 0.3) for _ in range(dim)], 1, "x") for i in range(n)]
    same = [r.gauss(0, 0.3) for _ in range(dim)]
    rows += [(n + i, same, 1, "x") for i in range(150)]  # a large group of copies
    rows += [(n + 150 + i, [0.5 * (i % 2), *[0.0] * (dim - 1)], 1, "x") for i in range(40)]  # ties
    bad = [None, [], [1.0] * (dim - 1), [1.0] * (dim + 1), [None, *[0.0] * (dim - 1)], [math.nan, *[0.0] * (dim - 1)], [math.inf, *[0.0] * (dim - 1)]]
    rows += [(9000 + i, v, 1, "x") for i, v in enumerate(bad)]
    return rows + [rows[0], rows[0], (None, same, None, None)]


def plain_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    c = [q for _, q in sorted(kept, key=lambda x: (sha(x[0]), x[1]))[:k]]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(c)), key=lambda j: (d(q, c[j]), j))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, q in kept:
            by[near(q)].append(q)
        c = [[sum(x) // len(by[j]) for x in zip(*by[j])] if j in by else q for j, q in enumerate(c)]
    out = [(i, near(q), d(q, c[near(q)])) for i, q in kept]
    total = Counter()
    for _, j, x in out:
        total[j] += x
    return sorted(str((i, j, x, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())) for i, j, x in out)


@pytest.mark.parametrize(("k", "scale"), [(12, 1.0), (40, 1.0), (7, 30000.0)])
def test_op13(spark, k, scale):
    rows = [(i, v and [x if x is None else x * scale for x in v], *more) for i, v, *more in vectors(random.Random(3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, ids string").repartition(3)
    got = centroids.clustered(df, k=k, dim=8).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert sorted(str(tuple(x)) for x in got.collect()) == plain_clusters(rows, k, 5, 8)


def test_op13_odd_tables(spark):
    df = spark.createDataFrame(vectors(random.Random(1)), "vec_id long, embedding array<double>, cluster int, ids string")
    assert centroids.clustered(df.limit(0), dim=8).count() == 0
    assert centroids.clustered(df.where("vec_id >= 9000"), dim=8).count() == 0
    few = centroids.clustered(df.where("vec_id < 3"), dim=8).collect()  # vector 0 is there three times
    assert len(few) == 5 and {x.distance for x in few} == {0}
    huge = df.where("vec_id < 3").withColumn("embedding", F.transform("embedding", lambda x: x * 1e300))
    assert centroids.clustered(huge, dim=8).count() == 5


def test_op13_balls_go_whole():
    """Balls far from all but one centroid aren't opened, and what is opened is exact."""
    r = np.random.default_rng(0)
    places = np.array([[0] * 8, [10**6] * 8, [-(10**6)] * 8])
    points = np.concatenate([p + r.integers(-99, 99, (500, 8)) for p in places])
    tree = centroids.Tree.build(r.permutation(points))
    balls, rest, cluster = tree.nearest(places)
    assert len(balls) < 16 and sum(tree.hi[i] - tree.lo[i] for i, _ in balls) > 1400
    assert sum(tree.hi[i] - tree.lo[i] for i, _ in balls) + len(rest) == 1500
    close = r.integers(-300, 300, (30, 8))
    balls, rest, cluster = tree.nearest(close)
    got = np.empty(1500, int)
    for i, j in balls:
        got[tree.lo[i] : tree.hi[i]] = j
    got[rest] = cluster
    assert (got == centroids.squares(tree.points, close).argmin(axis=1)).all()


# --- training rows of earlier operators ------------------------------------------------------


def test_op5_op9_an_id_that_repeats(spark):
    """An id with very many rows is one example; the model is that of the rows without repeats."""
    from quern.llm import langid, toxicity

    words = {"en": "the of and to a in is it that", "fr": "le la et les des en un du que"}
    r = random.Random(1)
    make = lambda lang: " ".join(r.choice(words[lang].split()) for _ in range(30))
    rows = [(i, make(lang), lang) for i in range(200) for lang in [("en", "fr")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = docs.unionByName(spark.range(100_000).selectExpr("0L AS doc_id", f"'{rows[0][1]}' AS text", "'en' AS lang"))
    a, b = langid.trained(docs), langid.trained(many)
    assert a.languages == b.languages and np.array_equal(a.matrix, b.matrix)
    labels = spark.createDataFrame([(i, int(lang == "fr")) for i, _, lang in rows], "doc_id long, toxic int")
    a, b = toxicity.scored(docs, labels), toxicity.scored(many.dropDuplicates(), labels)
    assert sorted(a.collect()) == sorted(b.collect())
    net, _ = toxicity.trained(many, labels)
    assert sorted(map(str, toxicity.trained(docs, labels)[0].tables())) == sorted(map(str, net.tables()))
