"""A text of more than a megabyte among short ones: whole, not cut."""

import random

import pytest
from test_brute_force import DOC, WORD, shingles

from quern.llm import fingerprints, mixing, neardup, packing, phrases, resample, sanitise


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    long = " ".join(r.choice("alpha beta gamma épsilon delta zeta eta\n".split(" ")) + str(r.randrange(999)) for _ in range(140_000)) + " end x@y.zz"
    edited = long[:-20] + " other end x@y.zz"
    return {0: "a short text of some words", 1: long, 2: edited, 3: "", 4: "another short one"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t), "x") for i, t in texts.items()], DOC)


def test_whole_texts(spark, docs, texts):
    assert len(texts[1].encode()) > 1_000_000
    prints = {r.doc_id: r for r in fingerprints.with_successor(docs).collect()}
    assert all(prints[i].n_chars == len(t) for i, t in texts.items()) and prints[2].near_next > 0.95
    near = {r.doc_id: r for r in neardup.near_duplicates(docs, width=3, percent=85).collect()}
    assert near[1].n_shingles == len(shingles(texts[1], 3)) and near[2].component_id == 1 and not near[2].kept
    sizes = {r.doc.doc_id: r["size"] for r in mixing.copies(docs).collect()}
    assert sizes == {i: len(WORD.findall(t)) for i, t in texts.items()}
    pieces = packing.packed(docs.where("doc_id IN (0, 1)")).collect()
    ids = sorted((p.piece, p.start, p.length) for p in pieces if p.doc_id == 1)
    assert all(a[1] + a[2] == b[1] for a, b in zip(ids, ids[1:])) and len(ids) > 200 and max(p.length for p in pieces) <= 1024
    labels = spark.createDataFrame([(0, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in resample.resampled(docs, labels).collect()} <= set(texts)
    spans = {r.doc_id: r.spans for r in sanitise.findings(docs).collect()}
    assert spans[1] == f"email:{len(texts[1]) - 6}:{len(texts[1])}" and spans[0] == ""
    n = {r.phrase: r.n for r in phrases.mined(docs, least=100).collect()}
    assert set(n.values()) <= {sum(len(p.split()) for t in texts.values() for p in t.replace("\n", ".").split("."))}
