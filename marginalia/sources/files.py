"""Folders of text files as tables, and other small sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import paths
from marginalia.functions.text import html_to_text


def list_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md",), excluded: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """``(path, size, update_time)`` of the indexable files below a folder; contents aren't read."""
    root = folder.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.substring_index(F.col("path"), root + "/", -1)
    return files.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("update_time")).where(paths.is_indexable(F.col("path"), extensions, excluded, ignored))


def read_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md",)) -> DataFrame:
    """``(path, content)``: the files' whole texts; HTML comes as plain text, unsupported kinds are left out."""
    root = folder.rstrip("/")
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("__file"))
    path = F.substring_index(F.col("__file"), root + "/", -1)
    readable = raw.withColumn("path", F.url_decode(path)).where(paths.extension(F.col("path")).isin(*extensions) & (paths.view_type(F.col("path")) == "markdown"))
    return readable.select("path", F.when(paths.extension(F.col("path")) == "html", html_to_text(F.col("value"))).otherwise(F.col("value")).alias("content"))


def stop_words(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """A list of stop words, one a line, for ``Settings.analysis``.

    A list of more than ``most`` is refused, as it would be part of every expression; for such a one
    there is ``without_words``.
    """
    words = [r[0] for r in spark.read.text(path).where(F.length("value") > 0).distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} stop words: join them with without_words")
    return sorted(words)


def without_words(tokens: DataFrame, words: DataFrame, column: str = "token") -> DataFrame:
    """Rows of tokens that aren't in a table of words of any size (its first column); nulls stay."""
    return tokens.join(words.select(F.col(words.columns[0]).alias(column)).distinct(), column, "left_anti").select(tokens.columns)
