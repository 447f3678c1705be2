"""The inverted index as tables: postings, field lengths and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.ranking import BOOSTS
from marginalia.functions.text import DEFAULT, Analysis, occurrences, tokens


def bucket_of(term: Column) -> Column:
    """The part of the saved index that holds a term: a hash of its first two characters, so that a
    prefix search of two characters and more reads one part."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(64))


def fields(docs: DataFrame, names: list[str] | None = None, key: str = "note_id", analysis: Analysis = DEFAULT) -> DataFrame:
    """``(key, field, tokens)`` of each document and indexed field; null fields have no tokens."""
    parts = [F.struct(F.lit(n).alias("field"), tokens(F.col(n), analysis).alias("tokens")) for n in names or BOOSTS]
    return docs.select(key, F.explode(F.array(*parts)).alias("f")).select(key, "f.field", "f.tokens")


def counted(terms: Column) -> Column:
    """The distinct values of an array as ``(term, tf)``, by one sort.

    Each part is bound as the variable of a lambda, so that it's worked out once.
    """
    empty = F.array().cast("array<struct<term: string, tf: bigint>>")

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (F.get(s, j) != F.get(s, j - 1)))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda j, i: F.struct(F.get(s, j).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(s)) - j).cast("bigint").alias("tf"))))[0]

    return F.when(F.size(terms) > 0, F.transform(F.array(F.array_sort(terms)), runs)[0]).otherwise(empty)


def posted_fields(docs: DataFrame, names: list[str] | None = None, key: str = "note_id", analysis: Analysis = DEFAULT) -> DataFrame:
    """``(key, field, length, terms)``: of each field its length and its terms as ``(term, tf)``.

    All of a field is in one row, so its terms are counted there and nothing is shuffled.
    """
    own = fields(docs, names, key, analysis)
    return own.select(key, "field", F.size("tokens").cast("bigint").alias("length"), counted(F.transform("tokens", analysis.term)).alias("terms"))


def postings(docs: DataFrame, names: list[str] | None = None, key: str = "note_id", count_all: bool = False, analysis: Analysis = DEFAULT) -> DataFrame:
    """``(key, field, term, tf)``: tf is the number of case variants of the term in the field.

    Tokens of a field are distinct before they become terms, so tf doesn't count occurrences,
    unless ``count_all`` asks for it.
    """
    if count_all:
        parts = [F.struct(F.lit(n).alias("field"), occurrences(F.col(n), analysis).alias("tokens")) for n in names or BOOSTS]
        own = docs.select(key, F.inline(F.array(*parts)))
    else:
        own = fields(docs, names, key, analysis)
    rows = own.select(key, "field", F.explode("tokens").alias("token"))
    return rows.groupBy(key, "field", analysis.term(F.col("token")).alias("term")).agg(F.count(F.lit(1)).alias("tf"))


def field_lengths(docs: DataFrame, names: list[str] | None = None, key: str = "note_id", analysis: Analysis = DEFAULT) -> DataFrame:
    """``(key, field, length)``: distinct tokens of each field, zero for an empty one."""
    return fields(docs, names, key, analysis).select(key, "field", F.size("tokens").cast("bigint").alias("length"))


def field_stats(docs: DataFrame, names: list[str] | None = None, key: str = "note_id", analysis: Analysis = DEFAULT) -> DataFrame:
    """``(field, documents, average)`` of the field lengths."""
    return field_lengths(docs, names, key, analysis).groupBy("field").agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("average"))


def document_frequency(docs: DataFrame, names: list[str] | None = None, key: str = "note_id", analysis: Analysis = DEFAULT) -> DataFrame:
    """``(term, field, df)``: in how many documents a field has the term.

    Terms are made distinct inside each row, so counts are pre-aggregated before the shuffle and a
    common term sends one row per task.
    """
    rows = fields(docs, names, key, analysis).select("field", F.explode(F.array_distinct(F.transform("tokens", analysis.term))).alias("term"))
    return rows.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
