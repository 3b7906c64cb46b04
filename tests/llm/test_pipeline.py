"""The pipeline's stages: what each keeps, and the whole against a plain version."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
from test_brute_force import DOC, WORD, components, cuts, goals_of, rows
from test_line_copies import plain as plain_lines

import corpus_pipeline
from quern.llm import neardup, packing, rules


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = docs
        docs = stage(spark, docs, sf).localCheckpoint()  # a test's own; the pipeline writes tables
        assert docs.columns == columns
        if name == "near-dedup":
            assert neardup.near_duplicates(docs).where("NOT kept").count() == 0
        if name == "line dedup":
            assert docs.count() == given.count()
        if name == "quality rules":
            assert 0.5 * before < docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def corpus():
    """Odd rows, boilerplate, exact and near copies, and rows that the rules reject."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8)))
    line = lambda: " ".join(word() for _ in range(r.randint(6, 14)))
    notice = "all rights reserved by the owners of this site and others too"
    out = [r_ for r_ in rows(2, 20) if len(r_[1] or "") < 5000]
    for i in range(300, 360):
        text = "\n".join(line() for _ in range(r.randint(3, 7))) + (f"\n{notice}" if i % 3 == 0 else "")
        out.append((i, text, "en", "abc"[i % 3], 0, "x"))
        if i % 6 == 0:
            out.append((i + 100, text, "en", "a", 0, "y"))
        if i % 10 == 0:
            out.append((i + 200, text + " " + word(), "en", "b", 0, "y"))
    out.append((700, "###\n" * 40, "en", "a", 0, "x"))
    return [*out, out[25], out[25]]


def test_pipeline_against_plain_stages(spark, tmp_path):
    data = corpus()
    df = spark.createDataFrame(data, DOC)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    con = duckdb.connect()
    con.register("documents", df.toArrow())
    run = con.execute(rules.ORACLE)
    names = [c[0] for c in run.description]
    verdicts = Counter((v["doc_id"], v["kept"], v["n_words"]) for v in (dict(zip(names, x)) for x in run.fetchall()))
    kept = [x for x in data if verdicts[x[0], True, len(WORD.findall(x[1] or ""))]]
    lines = [(x[0], t, *x[2:4], len(t), *x[5:]) for x, (_, t) in zip(kept, plain_lines(kept))]
    of = components(lines, 5, 80)
    unique = {x for x in lines if x[0] is None or of[x[0]][2]}
    assert 0 < len(unique) < len(lines) < len(data) and any(x[1] != y[1] for x, y in zip(kept, lines))

    copies = Counter(g.doc_id for g in got if g.piece == 0)
    assert set(copies) <= {x[0] for x in unique} and max(copies.values()) <= 3
    sizes, taken = Counter(), Counter()
    for d, t, _, s, *_ in unique:
        sizes[s] += len(WORD.findall(t))
        taken[s] += copies[d] * len(WORD.findall(t))
    goal = goals_of(dict(sizes))
    assert all(abs(taken[s] - goal[s]) <= 30 for s in sizes), (taken, goal)

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for d, t, *_ in unique:
        ids = whole.encode(t, add_special_tokens=False).ids + [2]
        for k, (s, n) in enumerate(cuts(len(ids))):
            want[d, k, s, n, zlib.crc32(np.asarray(ids[s : s + n], "<u4").tobytes())] += copies[d]
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == +want
    fill = {}
    for g in got:
        fill.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for s in fill.values():
        assert all(o == sum(n for p, n in s if p < o) for o, _ in s) and sum(n for _, n in s) <= 1024


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOC).write.parquet(str(tmp_path / "a/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    spark.createDataFrame([(1, None, None, None, None, None), (None, "", "en", "a", 0, "")], DOC).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0  # the rules keep neither
