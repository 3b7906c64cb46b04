"""Operator 12: personal data by fixed patterns, and terms that disclose it.

The patterns find e-mail and IP addresses, card and phone numbers: the protected
entities. The corpus says how strongly a term that stands near an entity reveals it: with
probabilities over documents, the pointwise mutual information of entity c and term t,
log2(p(c, t) / (p(c) p(t))), as a share of what there is to know, -log2 p(c). In documents
that name the entity, terms above one share are generalised, and those above a larger one
are removed; documents without an entity are left alone. A document's evidence for an
entity counts once for all documents that have the entity in the same surroundings, so
copies of a text prove nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _arrow as A
from ._spark import bits, durable, nested

KINDS = ("email", "ip", "card", "phone")
#: What the method adds, weakest first.
LEVELS = ("generalised", "removed")
#: Words on each side of an entity that are evidence.
WINDOW = 10
#: Documents with different surroundings that must agree.
SUPPORT = 3
#: Shares of the entity's information from which a term is generalised or removed.
GENERALISED, REMOVED = 0.75, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def found(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, stop, value) by kind and start.

    Leftmost matches of ``KINDS``' patterns, in time linear in the text: an address is
    found by its at sign and the run before it, and runs of digits are entered at their
    start alone.
    """
    out = []
    floor = 0
    if "@" in text:
        for m in _HOST.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end(), text[start : m.end()].lower()))
                floor = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.groups()):
            out.append((1, *m.span(), m[0]))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(48 <= c <= 57 for c in m[0].encode())
            if 8 <= n <= 15:
                out.append((3, *m.span(), re.sub("[^0-9]", "", m[0])))
    return out


def _entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Terms:
    """The words of a text outside its findings: their hashes and places, in code points."""

    def __init__(self, text: str, spans: list[tuple[int, int, int, str]]):
        data, at = A.joined([text.encode("utf-8", "surrogatepass")])
        starts, ends, _ = A.words(data, at, A.LETTERS)
        begun = np.cumsum((data & 0xC0) != 0x80)
        start, stop = begun[starts] - 1, begun[ends - 1]
        bounds = sorted((a, b) for _, a, b, _ in spans)
        cover = np.zeros(len(text) + 1, np.int32)
        for a, b in bounds:
            cover[a] += 1
            cover[b] -= 1
        inside = np.concatenate([[0], np.cumsum(np.cumsum(cover) > 0)])
        free = inside[stop] == inside[start]
        self.hashes = A.span_hashes(data, starts, ends, A.LETTERS)[free]
        self.start, self.stop = start[free], stop[free]

    def around(self, a: int, b: int, window: int = WINDOW) -> np.ndarray:
        i, j = np.searchsorted(self.start, [a, b])
        return np.concatenate([self.hashes[max(0, i - window) : i], self.hashes[j : j + window]])


def _evidence(text: str, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(entity, surroundings, terms) of each different entity of a text."""
    spans = found(text)
    if not spans:
        return
    terms, by = _Terms(text, spans), {}
    for kind, a, b, value in spans:
        by.setdefault(_entity(kind, value), []).append(terms.around(a, b, window))
    for e, parts in by.items():
        where = min(hashlib.blake2b(p.tobytes(), digest_size=8).digest() for p in parts)
        yield e, int.from_bytes(where, "little"), A.unique(np.concatenate(parts))


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    for x in batch.column(column):
        yield x.as_py() or ""


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def evidence(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(e, s, t, d): entity, its surroundings, a term in them and the text, each once; t is null once for each (e, s, d)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in _texts(b, "text"):
                d = None
                for e, s, terms in _evidence(text, window):
                    d = d or int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                    n = len(terms)
                    mask = np.arange(n + 1) == n
                    t = pa.array(np.append(terms, np.uint64(0)).view(np.int64), mask=mask)
                    yield pa.RecordBatch.from_arrays([_signed([e] * (n + 1)), _signed([s] * (n + 1)), t, _signed([d] * (n + 1))], names=["e", "s", "t", "d"])

    return docs.select("text").mapInArrow(run, "e long, s long, t long, d long").distinct()


def document_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n): in how many documents each of the terms is; a few others may be counted, too."""
    among = docs.sparkSession.sparkContext.broadcast(bits(terms, "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = A.utf8(b.column("text"))
            for i, j in A.chunks(at):
                h, first = A.word_hashes(data[at[i] : at[j]], at[i : j + 1] - at[i], A.LETTERS)
                keep = among.value.has(h)
                doc = np.repeat(np.arange(j - i), np.diff(first))[keep]
                pairs = np.unique(np.stack([h[keep], doc.astype(np.uint64)], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
                t, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["t", "n"])

    return docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalised: float = GENERALISED, removed: float = REMOVED) -> DataFrame:
    """(e, t, share, level): terms that reveal an entity, by all documents; durable."""
    seen = durable(evidence(docs, window))
    contexts = seen.select("e", "s", "t").distinct()
    alone = contexts.where("t IS NULL").groupBy("e").agg(F.count("*").alias("ne"))
    both = contexts.where("t IS NOT NULL").groupBy("e", "t").agg(F.count("*").alias("net")).where(F.col("net") >= support)
    # A term is in no fewer documents than there are texts with it near some entity: most terms are ruled out by that.
    low = seen.where("t IS NOT NULL").select("t", "d").distinct().groupBy("t").agg(F.count("*").alias("nt"))
    n = F.lit(float(docs.count()))
    share = (F.log2(F.col("net") * n / (F.col("ne") * F.col("nt"))) / F.log2(n / F.col("ne"))).alias("share")
    enough = lambda rows: rows.where(n > F.col("ne")).withColumn("share", share).where(F.col("share") >= generalised)
    both = durable(enough(both.join(alone, "e").join(low, "t")).drop("nt", "share"))
    if both.isEmpty():
        return both.select("e", "t", F.lit(0.0).alias("share"), F.lit(0).alias("level"))
    rows = enough(both.join(document_frequency(docs, durable(both.select("t").distinct())).withColumnRenamed("n", "nt"), "t"))
    return durable(rows.select("e", "t", "share", F.when(F.col("share") >= removed, 1).otherwise(0).alias("level")))


def _pair(e: int, terms: np.ndarray) -> np.ndarray:
    return A.mix(terms * np.uint64(0x9FB21C651E98DF25) + np.uint64(e))


def _marked(pairs: DataFrame, spark) -> A.Bits | None:
    """A set that has every pair's hash and every entity's; None without pairs."""
    if pairs.isEmpty():
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, t = (b.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("e", "t"))
            h = np.concatenate([A.mix(t * np.uint64(0x9FB21C651E98DF25) + e), e])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return bits(durable(pairs.select("e", "t").mapInArrow(run, "h long").distinct()), "h")


_ROWS = "doc_id long, text_sha256 string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near array<struct<e:long,t:long,start:long,stop:long>>"


def _documents(docs: DataFrame, marked: A.Bits | None) -> DataFrame:
    """One row per document: the base findings, and places of terms that may disclose one of them."""
    known = docs.sparkSession.sparkContext.broadcast(marked)

    def near(text: str, spans: list) -> list[dict]:
        entities = np.array(sorted({_entity(k, v) for k, _, _, v in spans}), np.uint64)
        entities = entities[known.value.has(entities)] if known.value is not None else entities[:0]
        if not len(entities):
            return []
        terms, out = _Terms(text, spans), []
        for e in entities.tolist():
            for i in np.flatnonzero(known.value.has(_pair(e, terms.hashes))).tolist():
                out.append({"e": int(np.uint64(e).view(np.int64)), "t": int(terms.hashes[i].view(np.int64)), "start": int(terms.start[i]), "stop": int(terms.stop[i])})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for b in batches:
            counts, bases, texts, places = [[], [], [], []], [], [], []
            for text in _texts(b, "text"):
                spans = found(text)
                for k, n in enumerate(counts):
                    n.append(sum(s[0] == k for s in spans))
                bases.append(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, _ in spans))
                texts.append(sha(text))
                places.append(near(text, spans) if spans else [])
            place = pa.struct([(c, pa.int64()) for c in ("e", "t", "start", "stop")])
            cols = [b.column("doc_id").cast(pa.int64()), pa.array(texts), *(pa.array(n, pa.int64()) for n in counts), pa.array([sha(x) for x in bases]), pa.array(bases), pa.array(places, pa.list_(place))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_sha256", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "near"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, _ROWS)


def findings(docs: DataFrame, window: int = WINDOW, support: int = SUPPORT, generalised: float = GENERALISED, removed: float = REMOVED) -> DataFrame:
    """Per document: doc_id, text_sha256, counts by kind, base_sha256, and ``spans``: kind:start:stop of all findings, by kind, then start.

    Input: doc_id and text; other columns are ignored. A null text is empty and, like any
    text without personal data, has no span. Repeated rows give a row each; equal texts
    have equal spans. A very long text is one row's work, in time linear in it. No rows
    give no rows. A term that discloses two entities has the stronger level; shares equal
    to a threshold are above it.
    """
    pairs = disclosing(docs, window, support, generalised, removed)
    rows = durable(_documents(docs, _marked(pairs, docs.sparkSession)).withColumn("row", F.monotonically_increasing_id()))
    placed = rows.select("row", F.explode("near").alias("p")).select("row", "p.*").join(pairs.select("e", "t", "level"), ["e", "t"])
    spans = placed.groupBy("row", "start", "stop").agg(F.max("level").alias("level"))
    kind = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("level") + 1)
    text = F.concat_ws(":", kind, F.col("start").cast("string"), F.col("stop").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("level", "start", text.alias("span"))))  # one document's
    added = spans.groupBy("row").agg(F.array_join(F.transform(listed, lambda x: x["span"]), ",").alias("added"))
    spans_: Column = F.concat_ws(",", F.nullif("base", F.lit("")), "added").alias("spans")
    return rows.join(added, "row", "left").select("doc_id", "text_sha256", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans_)


def rewritten(text: str, spans: str) -> str:
    """The text with findings as their kind in brackets, generalised terms as [word] or [number], and without removed ones; where spans overlap the first counts."""
    out, done = [], 0
    for start, stop, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start < done:
            done = max(done, stop)
            continue
        said = {"removed": "", "generalised": "[number]" if text[start:stop].isdigit() else "[word]"}.get(kind, f"[{kind}]")
        out += [text[done:start], said]
        done = stop
    return "".join(out) + text[done:]


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """(doc, spans, sanitised): every row of ``docs`` whole, with its text rewritten; parameters as ``findings``."""
    per_text = findings(docs, **how).groupBy("text_sha256").agg(F.min("spans").alias("spans"))  # equal texts, equal spans
    rows = nested(docs).withColumn("text_sha256", F.sha2(F.coalesce("doc.text", F.lit("")), 256))

    @F.pandas_udf("string")
    def apply(text, spans):
        return text.combine(spans, rewritten)

    return rows.join(per_text, "text_sha256").select("doc", "spans", apply(F.coalesce("doc.text", F.lit("")), F.col("spans")).alias("sanitised"))
