"""Three generic rule operators: keyword hits, first match, weighted sum."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyword_hits(text: Column, keywords: Iterable[str]) -> Column:
    """How many of the keywords are substrings; each counts once [T8: never tokenised]."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(k)), 1).otherwise(0) for k in keywords])


def any_keyword(text: Column, keywords: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(k)) for k in keywords])


def first_match(rules: Sequence[tuple[Column, Column | str]], otherwise: Column | str | None) -> Column:
    """The value of the first rule that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(rules[0][0], lit(rules[0][1]))
    for cond, value in rules[1:]:
        out = out.when(cond, lit(value))
    return out.otherwise(lit(otherwise))


def weighted_sum(terms: Sequence[Column]) -> Column:
    """Doubles added from left to right, which decides ties at thresholds [T4]."""
    return reduce(lambda a, b: a + b, [t.cast("double") for t in terms])


def lookup(key: Column, table: dict, default: float) -> Column:
    """A small dictionary as an expression [J7]."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))
