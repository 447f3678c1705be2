"""p4: how often every term and tag occurs, in how many notes, and which are too rare or common."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import terms as T
from marginalia.operators.corpus import notes_once


def _partial_counts(letters: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.sliced(batches, "content", "tags"):
            yield from T.counted("content", *T.words(part.column("content"), 3, letters))
            yield from T.counted("tags", *T.tags(part.column("tags")))

    return run


def term_frequency(notes: DataFrame, rare_notes: int = 1, common_share: float = 0.2, letters: str = T.LETTERS) -> DataFrame:
    """``(field_name, term, occurrences, notes, mark)`` of every term of content and every tag.

    ``mark`` is ``rare`` for a term in at most ``rare_notes`` notes, ``common`` for one in at least
    ``common_share`` of the notes (with content, for content; of all notes, for tags), else null; a
    term that is both is rare. Counts come from last-seen counters inside each batch and are summed
    after a shuffle of one row per distinct term and batch, so a term that fills a third of all
    tokens sends no more rows than any other.

    ``letters`` is the character class that words of content are made of, ``\\p{L}`` for any script.

    Null and empty texts give no terms; notes without an id each count as a note of their own; an
    empty table gives no rows.
    """
    once = notes_once(notes.select("note_id", "indexed_at", "content", "tags"))
    totals = once.agg(F.count(F.lit(1)).alias("tags"), F.count("content").alias("content")).first()
    counts = (
        once.select("content", "tags").mapInArrow(_partial_counts(letters), T.COUNT_SCHEMA)
        .groupBy("field_name", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("notes").alias("notes"))
    )
    n = F.when(F.col("field_name") == "content", F.lit(totals["content"])).otherwise(F.lit(totals["tags"]))
    mark = F.when(F.col("notes") <= rare_notes, "rare").when(F.col("notes") >= F.lit(common_share) * n, "common")
    return counts.withColumn("mark", mark)


def found(notes: DataFrame) -> DataFrame:
    """p4_found: the marked terms."""
    return term_frequency(notes).where("mark is not null").select("field_name", "term", "mark")
