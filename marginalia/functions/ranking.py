"""Scores and weights of ranked search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The indexed fields with their boosts. Tags are stored, and indexed only on demand.
BOOSTS = {"basename": 3.0, "aliases": 3.0, "folder": 2.0, "headings": 1.27, "content": 1.0}
TAG_BOOST = 1.15
#: The parameters of BM25+.
K, B, D = 1.2, 0.7, 0.5
#: Weights of derived terms, the share of typos and the most of them, the least prefix.
PREFIX_WEIGHT, FUZZY_WEIGHT, FUZZY_SHARE, MOST_TYPOS, LEAST_PREFIX = 0.375, 0.45, 0.2, 6, 2


def typos(term: str) -> int:
    """Edits allowed to a query term: none up to three characters, else a fifth of them, six at most."""
    return 0 if len(term) <= 3 else min(MOST_TYPOS, int(FUZZY_SHARE * len(term) + 0.5))


def match_kind(term: Column, query: str, prefix: bool, fuzzy: bool) -> Column:
    """How a term of the index matches a query term: exact, prefix, fuzzy, or null; the first that holds."""
    kind = F.when(term == query, "exact")
    if prefix and len(query) >= LEAST_PREFIX:
        kind = kind.when(term.startswith(query), "prefix")
    k = typos(query)
    if fuzzy and k:
        near = F.abs(F.length(term) - len(query)) <= k
        kind = kind.when(near & F.levenshtein(term, F.lit(query), k).between(1, k), "fuzzy")
    return kind


def match_weight(term: Column, query: str, kind: Column) -> Column:
    """The weight of a derived term: one for an exact match, less the longer or farther it is."""
    n = F.length(term).cast("double")
    ahead = F.lit(PREFIX_WEIGHT) * n / (n + F.lit(0.3) * (n - len(query)))
    near = F.lit(FUZZY_WEIGHT) * n / (n + F.levenshtein(term, F.lit(query)))
    return F.when(kind == "exact", F.lit(1.0)).when(kind == "prefix", ahead).when(kind == "fuzzy", near)


def bm25_plus(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    """The BM25+ score of a term in a field."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (D + tf * (K + 1) / (tf + K * (1 - B + B * length / average)))


def boost(field: Column, boosts: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, value in boosts.items():
        out = F.when(field == name, F.lit(value)).otherwise(out)
    return out
