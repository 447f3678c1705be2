"""Ranked multi-field search with exact, prefix and typo-tolerant terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions import query as Q
from marginalia.functions.ranking import BOOSTS, LEAST_PREFIX, bm25_plus, boost, match_kind, match_weight, typos
from marginalia.functions.text import DEFAULT, Analysis
from marginalia.operators.index import bucket_of, fields
from marginalia.sources.tables import materialize

#: The most results that a caller may ask for, and how many come by default.
MOST_RESULTS, RESULTS = 300, 30

SCHEMA = "note_id bigint, path string, rank int, score double, query_terms string, matched_terms string"


def limit_of(n: int) -> int:
    """A result limit, which must be between 1 and 300."""
    if not 1 <= n <= MOST_RESULTS:
        raise ValueError(f"a result limit is between 1 and {MOST_RESULTS}")
    return n


def _weights(term: Column, wanted: list[str], options: Q.Options) -> Column:
    """``(term, query_term, weight)`` of each of the query's few terms that a term matches; written into
    the expression, so without a join."""
    own = [F.struct(term.alias("term"), F.lit(q).alias("query_term"), match_weight(term, q, match_kind(term, q, options.prefix, options.fuzzy)).alias("weight")) for q in wanted]
    return F.filter(F.array(*own), lambda k: k["weight"].isNotNull())


def expansion(terms: DataFrame, raw: str, options: Q.Options = Q.Options(), analysis: Analysis = DEFAULT) -> DataFrame:
    """``(term, query_term, kind, weight)`` of the vocabulary's terms that a query's terms match.

    Each term of the vocabulary has one kind for a query term: exact before prefix before fuzzy. The
    query's few terms are written into the condition, so the vocabulary is read once, without a join.
    """
    parsed = Q.parse(raw, options)
    wanted = Q.terms(parsed.text, analysis)
    if not wanted:
        return terms.sparkSession.createDataFrame([], "term string, query_term string, kind string, weight double")
    kinds = [F.struct(F.lit(q).alias("query_term"), (kind := match_kind(F.col("term"), q, parsed.options.prefix, parsed.options.fuzzy)).alias("kind"), match_weight(F.col("term"), q, kind).alias("weight")) for q in wanted]
    return terms.select("term").distinct().select("term", F.inline(F.filter(F.array(*kinds), lambda k: k["kind"].isNotNull())))


def search(docs: DataFrame, raw: str, limit: int = RESULTS, options: Q.Options = Q.Options(), boosts: dict[str, float] | None = None, every_term: bool = True, analysis: Analysis = DEFAULT) -> DataFrame:
    """``(note_id, path, rank, score, query_terms, matched_terms)`` of the best documents for a query.

    The query's commands are parsed and its terms expanded against each document's own tokens, so
    that only matching terms leave the scan, which counts documents and field lengths on the way;
    document frequencies and scores are worked out of those few rows. With ``every_term`` a document
    must match all query terms, else any. Ties go to the smaller note_id. An empty query, or one of
    stop words alone, has no results.
    """
    parsed = Q.parse(raw, options)
    wanted = Q.terms(parsed.text, analysis)
    boosts = boosts or BOOSTS
    spark = docs.sparkSession
    if not wanted:
        return spark.createDataFrame([], SCHEMA)

    def matches(token: Column) -> Column:
        return _weights(analysis.term(token), wanted, parsed.options)

    names = list(boosts)
    rows = fields(docs, names, analysis=analysis).select("note_id", "field", F.size("tokens").alias("length"), F.flatten(F.transform("tokens", matches)).alias("hits"))
    seen = Observation()
    lengths = [F.avg(F.when(F.col("field") == f, F.col("length"))).alias(f"average_{k}") for k, f in enumerate(names)]
    watched = rows.observe(seen, F.count(F.when(F.col("field") == names[0], 1)).alias("n"), *lengths)
    found = materialize(watched.where(F.size("hits") > 0).select("note_id", "field", "length", F.inline("hits")))
    n, average = seen.get["n"], {f: seen.get[f"average_{k}"] or 1.0 for k, f in enumerate(names)}
    hits = found.groupBy("note_id", "field", "length", "term", "query_term", "weight").agg(F.count(F.lit(1)).alias("tf"))
    frequency = hits.groupBy("field", "term").agg(F.count_distinct("note_id").alias("df"))
    top = best(hits.join(frequency, ["field", "term"]), n, average, boosts, len(wanted) if every_term else 1, limit)
    return ranked(top.join(docs.select("note_id", "path"), "note_id"))


def best(hits: DataFrame, n: int, average: dict[str, float], boosts: dict[str, float], least: int, limit: int) -> DataFrame:
    """``(note_id, score, query_terms, matched_terms)`` of the best documents by their hits, which have
    ``field``, ``term``, ``query_term``, ``weight``, ``tf``, ``length`` and ``df``."""
    part = F.col("weight") * boost(F.col("field"), boosts) * bm25_plus(F.col("tf"), F.col("df"), F.lit(n), F.col("length"), boost(F.col("field"), average))
    total = hits.groupBy("note_id").agg(F.sum(part).alias("sum"), F.sort_array(F.collect_set("query_term")).alias("q"), F.sort_array(F.collect_set("term")).alias("m")).where(F.size("q") >= least)
    return total.select("note_id", F.round(F.col("sum") * F.size("q"), 6).alias("score"), F.array_join("q", " ").alias("query_terms"), F.array_join("m", " ").alias("matched_terms")).orderBy(F.desc("score"), "note_id").limit(limit_of(limit))


def ranked(top: DataFrame) -> DataFrame:
    """A bounded number of results with their rank by score, then note_id."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "note_id")
    return top.withColumn("rank", F.row_number().over(order)).select("note_id", "path", "rank", "score", "query_terms", "matched_terms")


#: How many terms of the vocabulary a query's terms may match to be looked up by name.
MOST_TERMS = 10_000


def matched_vocabulary(vocabulary: DataFrame, wanted: list[str], options: Q.Options) -> DataFrame:
    """``(bucket, field, term, query_term, weight, df)`` of the saved vocabulary's terms that a query matches.

    Exact terms and prefixes ask for their bucket alone; typos may stand anywhere, so they read the
    vocabulary, but no postings.
    """
    term = F.col("term")
    near = F.lit(False)
    for q in wanted:
        same = (term == q) | term.startswith(q) if options.prefix and len(q) >= LEAST_PREFIX else term == q
        near = near | ((F.col("bucket") == bucket_of(F.lit(q))) & same)
        if options.fuzzy and typos(q):
            near = near | F.length(term).between(len(q) - typos(q), len(q) + typos(q))
    rows = vocabulary.where(near).groupBy("bucket", "field", "term").agg(F.sum("df").alias("df"))
    return rows.select("bucket", "field", "df", F.inline(_weights(term, wanted, options)))


def search_index(
    postings: DataFrame, vocabulary: DataFrame, totals: DataFrame, raw: str, limit: int = RESULTS, options: Q.Options = Q.Options(), every_term: bool = True,
    alive: Callable[[DataFrame], DataFrame] | None = None, analysis: Analysis = DEFAULT, most_terms: int = MOST_TERMS,
) -> DataFrame:
    """``(note_id, score, query_terms, matched_terms)``: the same ranking on saved index tables.

    The query's terms are looked up in the vocabulary first. If at most ``most_terms`` match (they
    are counted), the postings are read by their buckets and terms alone, which prunes partitions
    and row groups; beyond, they are joined. With ``alive``, which takes dead rows out, frequencies
    are counted in the matched postings, else they are the vocabulary's.
    """
    parsed = Q.parse(raw, options)
    wanted = Q.terms(parsed.text, analysis)
    spark = postings.sparkSession
    empty = spark.createDataFrame([], "note_id bigint, score double, query_terms string, matched_terms string")
    sums = {r["field"]: r for r in totals.groupBy("field").agg(F.sum("documents").alias("documents"), F.sum("length").alias("length")).collect()}
    n = max((r["documents"] for r in sums.values()), default=0)
    if not wanted or n <= 0:
        return empty
    average = {f: (r["length"] / r["documents"] if r["documents"] else 0) or 1.0 for f, r in sums.items()}
    terms = matched_vocabulary(vocabulary, wanted, parsed.options)
    few = terms.limit(most_terms + 1).collect()
    if not few:
        return empty
    if len(few) <= most_terms:
        asked = F.broadcast(spark.createDataFrame(few, terms.schema))
        own = postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few})))
    else:
        asked, own = materialize(terms), postings
    hits = own.join(asked.drop("bucket"), ["field", "term"])
    if alive:
        hits = materialize(alive(hits).drop("df"))
        hits = hits.join(hits.groupBy("field", "term").agg(F.count_distinct("note_id").alias("df")), ["field", "term"])
    return materialize(best(hits, n, average, BOOSTS, len(wanted) if every_term else 1, limit))
