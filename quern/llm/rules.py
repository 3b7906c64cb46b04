"""Operator 7: quality rules as a ledger of failure bits.

Every rule is evaluated once per document into one bit of ``failed``, with the
measurements it read beside it. A policy is a version name and a mask; applying
one, or asking what a rule alone costs, is bit arithmetic over the ledger and
reads no text. All of it is row-local: the ledger needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import SPACE_RUN, SPACES, nested

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

#: In order of their bits: name and the condition under which a document fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "shouting": "5 * n_exclaims > n_words",
    "letters": "2 * n_letters < word_chars",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: A policy's documents fail by any rule in its mask.
POLICIES = {"base-1": BASE, "web-1": (1 << len(RULES)) - 1, "web-2": ((1 << len(RULES)) - 1) & ~BITS["repeated_lines"]}
DEFAULT = "web-1"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaims", "n_letters")

#: From an array w of words: its size, its length when joined, and the words in windows
#: found twice or more. Hashes of 1, 2, 4 and 8 words are made of each other by pairing an
#: array with itself shifted. If any 8-word hash repeats, its places are gathered, and
#: counted as the length of the union of [place, place + 8).
_ZIP = "zip_with({0}, slice({0}, {1}, size({0})), (a, b) -> xxhash64(a, b))"
_OF_WORDS = f"""
transform(_split, w -> named_struct('n', size(w), 'chars', length(array_join(w, '')), 'repeated',
  CASE WHEN size(w) <= {WINDOW} THEN 0L ELSE
    transform(array(slice(
      transform(array(transform(array({_ZIP.format("w", 2)}), h -> {_ZIP.format("h", 3)})[0]), h -> {_ZIP.format("h", 5)})[0],
      1, size(w) - {WINDOW - 1})),
      hashes -> CASE WHEN size(array_distinct(hashes)) = size(hashes) THEN 0L ELSE
        aggregate(
          transform(array(sort_array(transform(hashes, (h, i) -> struct(h AS h, i AS i)))),
            s -> sort_array(transform(
              filter(s, (x, j) -> x.h = get(s, j - 1).h OR x.h = get(s, j + 1).h), x -> x.i)))[0],
          named_struct('n', 0L, 'upto', 0),
          (a, p) -> named_struct('n', a.n + p + {WINDOW} - greatest(p, a.upto), 'upto', p + {WINDOW}),
          a -> a.n) END)[0] END))[0]
"""


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's rows as ``doc``, and MEASURES; a null text has no words and no lines.

    Words are ``[^\\x20\\x09-\\x0D]+``; a line is a ``\\n``-split part with a word.
    Windows are compared by 64-bit hash. A very long text is measured whole, in one row.
    Columns of the input may have any names; repeated rows are measured alike; no rows
    give no rows.
    """
    t = F.coalesce(F.col("doc")[text], F.lit(""))
    bare = F.btrim(t, F.lit(SPACES))
    split = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = nested(docs).withColumn("_split", F.array(split)).withColumns(
        {
            "_w": F.expr(_OF_WORDS),
            "_l": F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))[0],
        }
    )

    def without(pattern: str) -> Column:
        return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))

    found = {
        "n_words": F.col("_w.n"),
        "word_chars": F.col("_w.chars"),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.col("_l.dup"),
        "n_repeat_words": F.col("_w.repeated"),
        "n_lines": F.col("_l.n"),
        "n_exclaims": F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))),
        "n_letters": without("\\p{L}+"),
    }
    return counted.select("doc", *[v.cast("long").alias(k) for k, v in found.items()])


def failed(rules: dict[str, str] = RULES) -> Column:
    """The bits of the rules that a row of measures fails."""
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, cond in enumerate(rules.values())]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def judged(docs: DataFrame) -> DataFrame:
    """``measures`` and the bits of the rules that each document fails."""
    return measures(docs).withColumn("failed", failed())


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measures and ``failed``: what every policy and report works on.

    Null doc_ids and repeated rows are rows like any other; extra columns are left out;
    no rows make an empty ledger.
    """
    return judged(docs.select("doc_id", "text")).select("doc.doc_id", *MEASURES, "failed")


def apply_policy(rows: DataFrame, policy: str | int = DEFAULT) -> DataFrame:
    """``rows`` of a ledger with ``base_failed`` and ``kept`` under a policy or mask."""
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("failed").bitwiseAND(F.lit(mask)) == 0))


def ablations(rows: DataFrame, policy: str | int = DEFAULT) -> DataFrame:
    """Per rule of a policy: rule, n_failed, n_only (that it alone rejects), in one pass.

    One aggregate of conditional sums, unpivoted: a rule's failures, and those whose
    failed bits under the mask are that rule's alone, which dropping it would keep.
    """
    mask = POLICIES[policy] if isinstance(policy, str) else policy
    hit = F.col("failed").bitwiseAND(F.lit(mask))
    names = [n for n, b in BITS.items() if b & mask]
    sums = [F.array(F.count_if(hit.bitwiseAND(F.lit(BITS[n])) != 0), F.count_if(hit == BITS[n])).alias(n) for n in names]
    wide = rows.agg(*sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n)[0].alias("n_failed"), F.col(n)[1].alias("n_only")) for n in names]))
    return wide.select(pairs.alias("x")).select("x.*")


def union_of_failures(rows: DataFrame, by: str) -> DataFrame:
    """Per group the rules that any, and that all, of its documents fail, as bits."""
    return rows.groupBy(by).agg(F.bit_or("failed").alias("any_failed"), F.bit_and("failed").alias("all_failed"), F.count("*").alias("n"))


#: DuckDB's form of the query: windows by their words rather than by hash.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
dup AS (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM dup GROUP BY r),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(l)::BIGINT AS n_lines, length(t) - length(replace(t, '!', '')) AS n_exclaims,
    length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS n_letters
  FROM d LEFT JOIN rep ON d.r = rep.r),
f AS (
  SELECT *, ({" | ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(RULES.values()))})::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & {BASE}) <> 0 AS base_failed,
  (failed & {BASE}) = 0 AND (failed & {POLICIES[DEFAULT]}) = 0 AS kept, failed
FROM f
"""
