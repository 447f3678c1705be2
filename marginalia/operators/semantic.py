"""Nearest neighbours of vectors by cosine."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.text import terms

#: Numbers of a vector made by hashing.
DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(key, similarity)`` of the ``k`` vectors nearest to one by cosine; ties go to the smaller key.

    Null vectors and such of another length or of zeros have no similarity and no row.
    """
    norm = math.sqrt(sum(x * x for x in query))
    v = F.col(vector)
    own = F.sqrt(dot(v, v))
    usable = vectors.where((F.size(v) == len(query)) & (own > 0)) if norm else vectors.limit(0)
    similarity = dot(v, F.array(*(F.lit(float(x)) for x in query))) / (own * norm)
    return usable.select(key, F.round(similarity, 6).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = 1000) -> DataFrame:
    """``(query_id, key, similarity)`` of the ``k`` vectors nearest to each query, as ``top_k`` gives them for one.

    The queries are a stated set, sent to the tasks in blocks of about ``block``; each partition keeps its
    ``k`` best of a query before anything is shuffled.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    own = vectors.select(key, F.col(vector).alias("__own"), norm.alias("__norm")).where("__norm > 0")
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("__query"), norm.alias("__query_norm")).where("__query_norm > 0")
    blocks = max(1, -(-asked.count() // block))
    similarity = F.round(dot(F.col("__own"), F.col("__query")) / (F.col("__norm") * F.col("__query_norm")), 6)
    first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    out = None
    for n in range(blocks):
        some = F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n))
        pairs = own.join(some, F.size("__own") == F.size("__query")).select("query_id", key, similarity.alias("similarity"))
        part = pairs.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= k).drop("__rank")
        out = part if out is None else out.unionByName(part)
    return out


def semantic_documents(df: DataFrame) -> DataFrame:
    """``(path, view_type, content)`` for a semantic index, each path and text once."""
    return df.select("path", "view_type", "content").distinct()


def hashed_terms(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A vector of a text without a model: each distinct term adds one or takes one, by its hash, in one place.

    Texts that share terms are near; a text without terms has no vector.
    """
    hashes = F.transform(terms(text), lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 6), 16, 10).cast("int"))

    def total(own: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(own, lambda h: F.pmod(h, F.lit(dimensions)) == d), F.lit(0), lambda a, h: a + F.when(F.pmod(F.floor(h / dimensions), F.lit(2)) == 0, 1).otherwise(-1).cast("int")).cast("float"))

    return F.when(F.size(hashes) > 0, F.transform(F.array(hashes), total)[0])


def passages(docs: DataFrame) -> DataFrame:
    """``(path, chunk_no, text)``: the paragraphs of documents, cut at blank lines; blank ones are left out."""
    parts = F.filter(F.transform(F.split("content", r"\n[^\S\n]*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    return docs.select("path", F.posexplode(parts).alias("chunk_no", "text"))


def embedded(parts: DataFrame, embed: Callable[[Column], Column] = hashed_terms) -> DataFrame:
    """Passages with their ``embedding``; such without one are left out."""
    return parts.withColumn("embedding", embed(F.col("text"))).where("embedding is not null")


def search_passages(parts: DataFrame, text: str, embed: Callable[[Column], Column] = hashed_terms, k: int = 30) -> DataFrame:
    """``(path, rank, similarity, items)`` of the ``k`` passages nearest to a text, by document.

    ``items`` has a document's passages as ``(chunk_no, similarity, text)``, nearest first; a
    document ranks by its nearest. White space around the text doesn't count; a blank text has no
    results. Ties go to the smaller path and number.
    """
    schema = "path string, rank int, similarity double, items array<struct<chunk_no: int, similarity: double, text: string>>"
    spark = parts.sparkSession
    vector = spark.range(1).select(embed(F.lit(text.strip())).alias("v")).first()["v"] if text.strip() else None
    if vector is None:
        return spark.createDataFrame([], schema)
    found = top_k(parts.withColumn("__key", F.struct("path", "chunk_no", "text")), [float(x) for x in vector], k, key="__key")
    rows = found.select("__key.*", "similarity").groupBy("path").agg(F.max("similarity").alias("similarity"), F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "chunk_no", "text"))).alias("near"))
    items = F.transform("near", lambda x: F.struct(x["chunk_no"].alias("chunk_no"), (-x["far"]).alias("similarity"), x["text"].alias("text")))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), "path")
    return rows.select("path", F.row_number().over(order).alias("rank"), "similarity", items.alias("items"))
