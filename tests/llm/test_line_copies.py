"""Line dedup: which lines of copies stay, against a plain version that compares all pairs."""

import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F
from test_brute_force import DOC, rows, templates

from quern.llm import linededup


def plain(data):
    """(doc_id, text after) of each row, from the definition, over every pair of body and hub."""
    bodies = Counter(t or "" for _, t, *_ in data)
    found = {t: templates(t) for t in bodies}
    carried = {t: set().union(*[ks for _, _, ks in f]) for t, f in found.items()}
    count = Counter()
    for t, n in bodies.items():
        count.update({k: n for k in carried[t]})
    recurs = {k for k, n in count.items() if n >= linededup.DOCUMENTS}
    size = lambda t, only: sum(n for _, n, ks in found[t] if only(ks))
    able = [t for t in bodies if size(t, lambda ks: ks & recurs) > linededup.COPY * size(t, lambda ks: True)]
    order = {t: (sum(count[k] for _, _, ks in found[t] for k in ks & recurs), signed(t)) for t in able}
    others = {k: count[k] - sum(bodies[t] for t in able if k in carried[t]) for k in recurs}
    open_ = {k for k in recurs if others[k] < linededup.DOCUMENTS or 2 * others[k] < count[k]}
    hub = {k: max((t for t in able if k in carried[t]), key=order.get) for k in open_ if any(k in carried[t] for t in able)}
    up = {}
    for t in able:
        best = []
        for h in {hub[k] for k in carried[t] & set(hub)} - {t}:
            w = size(t, lambda ks: any(hub.get(k) == h for k in ks))
            if w > linededup.COPY * (size(t, bool) + size(h, bool) - w):
                best.append((w, signed(h), h))
        if best:
            up[t] = max(best)[2]

    def end(t):
        return end(up[t]) if t in up else t

    cls = {t: end(t) for t in up}
    cls |= {h: h for h in cls.values()} | {t: t for t in able if bodies[t] > 1 and t not in cls and t not in cls.values()}
    out = []
    for d, t, *_ in data:
        x, bad = t or "", set(carried[t or ""] & recurs)
        if x in cls:
            for k in set(bad) & open_:
                holders = {h: cls.get(h, h) for h in able if k in carried[h]}
                own = sum(bodies[h] for h, c in holders.items() if c == cls[x])
                if 2 * own > count[k] or others[k] + len(set(holders.values())) - 1 < linededup.DOCUMENTS:
                    bad.discard(k)
        f = found[x]
        out.append((d, t if not any(ks & bad for _, _, ks in f) else "\n".join(line for line, _, ks in f if not ks & bad)))
    return out


def signed(t):
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64(t.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_boilerplate_leaves_short_texts_and_copies(spark):
    notice = "all rights reserved by the owners of this site and others too"
    body = "\n".join(f"line {w} of the long body speaks about {w} and nothing else {w}" for w in "red blue green pink grey black white brown".split())
    data = rows(1, 20)
    data += [(100 + i, f"{notice}\n{w} {w}x {w}y {w}z {w}q", "en", "a", 0, "x") for i, w in enumerate("alpha bravo carol delta eagle".split())]  # mostly boilerplate, no copies
    data += [(200 + i, f"{notice}\n" + " ".join(f"{w}{c}" for c in "abcdefghijklmnopqrstu"), "en", "a", 0, "x") for i, w in enumerate("oak elm fir yew".split())]
    data += [(300 + i, f"{body}\n{notice}" + ("\nlast words of this one" if i == 2 else ""), "en", "a", 0, "x") for i in range(5)]  # copies that carry it
    got = linededup.deduplicated(spark.createDataFrame(data, DOC).repartition(3), copy=linededup.COPY)
    kept = got.select("doc.doc_id", "doc.text", "is_copy").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(plain(data))
    text = {r.doc_id: r for r in kept}
    assert all(notice not in (r.text or "") for r in kept)
    assert all(not text[100 + i].is_copy for i in range(5)) and all(text[300 + i].is_copy and body in text[300 + i].text for i in range(5))
    assert got.where(F.col("doc.text").isNull()).count() == 1


def test_random_groups_against_the_definition(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    pool = [" ".join(word() for _ in range(r.randint(2, 14))) for _ in range(14)]
    data = []
    for g in range(25):
        base = [" ".join(word() for _ in range(r.randint(3, 20))) for _ in range(r.randint(1, 8))] + r.sample(pool, r.randint(0, 3))
        for _ in range(r.randint(1, 6)):
            lines = [x if r.random() < 0.85 else x + " " + word() for x in base]
            data.append((len(data), "\n".join(lines), "en", "a", 0, "x"))
    got = linededup.deduplicated(spark.createDataFrame(data, DOC).repartition(3), copy=linededup.COPY)
    want, have = Counter(plain(data)), Counter((r.doc.doc_id, r.doc.text) for r in got.collect())
    assert have == want
    assert got.where("is_copy").count() > 20 and got.where("n_dropped > 0").count() > 20
