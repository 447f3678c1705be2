"""The searchable documents, their lines, and statistics of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import paths
from marginalia.sources.tables import drop_repeats

COLUMNS = ("note_id", "vault", "path", "basename", "folder", "aliases", "tags", "headings", "content")


def notes_once(notes: DataFrame) -> DataFrame:
    """Each note once, by note_id; of repeated rows the one indexed first."""
    return drop_repeats(notes, "note_id", [F.col("indexed_at")])


def documents(notes: DataFrame, extensions: tuple[str, ...] = ("md",), excluded: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """The indexable notes, with nulls where the content of a file can't be indexed.

    A null path isn't indexable; missing metadata becomes empty text.
    """
    keep = notes_once(notes).where(paths.is_indexable(F.col("path"), extensions, excluded, ignored))
    readable = paths.view_type(F.col("path")) == "markdown"
    meta = [F.when(readable, F.coalesce(c, F.lit(""))).alias(c) for c in ("aliases", "tags", "headings")]
    return keep.select("note_id", "vault", "path", F.coalesce("basename", paths.basename(F.col("path"))).alias("basename"), "folder", *meta, F.when(readable, F.col("content")).alias("content"))


def with_metadata(files: DataFrame, metadata: DataFrame, key: str = "path") -> DataFrame:
    """Files with the metadata parsed of them; empty text where there is none.

    Where both have a column, the metadata's is taken. Null keys have no metadata.
    """
    columns = [c for c in metadata.columns if c != key]
    kept = [c for c in files.columns if c not in columns]
    return files.select(*kept).join(metadata, key, "left").select(*kept, *(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def split_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, row_no, text)``: the lines at line feeds; a CR and a last empty line stay, nulls give none."""
    return df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("row_no", "text"))


def count_extensions(df: DataFrame, path: str = "path") -> DataFrame:
    """Number of files by extension, ``no_extension`` where a path has none."""
    ext = paths.extension(F.col(path))
    return df.groupBy(F.when(F.coalesce(ext, F.lit("")) == "", "no_extension").otherwise(ext).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def corpus_size(df: DataFrame, text: str, warn_kb: int = 2000) -> DataFrame:
    """``(files, bytes, kb, mb, large)`` of all texts; zeros for an empty table."""
    size = F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))
    sums = df.agg(F.count(F.lit(1)).alias("files"), size.alias("bytes"))
    kb = F.col("bytes") / 1024
    return sums.select("files", "bytes", F.round(kb, 2).alias("kb"), F.round(kb / 1024, 2).alias("mb"), (kb > warn_kb).alias("large"))


def not_indexed(docs: DataFrame, indexed: DataFrame, key: str = "path") -> DataFrame:
    """The documents whose key isn't in the index yet."""
    return docs.join(indexed.select(key).distinct(), key, "left_anti")


def indexed_only(docs: DataFrame, indexed: DataFrame, key: str = "path") -> DataFrame:
    """The documents whose key is in the index."""
    return docs.join(indexed.select(key).distinct(), key, "left_semi")


def new_exclusions(candidates: DataFrame, present: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """Exclusions that may be added: not empty, not there already, and of a path that exists."""
    wanted = candidates.where(F.length(key) > 0).select(key).distinct()
    return wanted.join(present.select(key).distinct(), key, "left_anti").join(existing.select(key).distinct(), key, "left_semi")
