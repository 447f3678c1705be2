"""p6: how distinctive each term of a note is, by graph-of-words degree and rarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import terms as T
from marginalia.operators.corpus import notes_once
from marginalia.sources.tables import materialize

FIELDS = ("content", "headings", "tags")


def _stream(batch: pa.RecordBatch, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of all fields with their row and their segment (row and field), in text order."""
    parts = [T.words(batch.column(f), least) for f in FIELDS]
    rows = np.concatenate([r for _, r in parts])
    segments = np.concatenate([r * len(FIELDS) + k for k, (_, r) in enumerate(parts)])
    return pa.chunked_array([t for t, _ in parts], pa.string()), rows, segments


def graph_of_words(codes: np.ndarray, rows: np.ndarray, segments: np.ndarray, window: int, min_tf: int) -> tuple[np.ndarray, ...]:
    """Row, term code, occurrences and degree of each term that occurs ``min_tf`` times in its row.

    The degree is the number of distinct other terms within ``window`` terms on either side, inside
    one segment.
    """
    width = int(codes.max()) + 1
    keys, at, tf = np.unique(rows * width + codes, return_inverse=True, return_counts=True)
    take = tf >= min_tf
    wanted = take[at]
    edges = []
    for k in range(1, window):
        near = (segments[k:] == segments[:-k]) & (codes[k:] != codes[:-k])
        for a, b in ((slice(None, -k), slice(k, None)), (slice(k, None), slice(None, -k))):
            use = near & wanted[a]
            edges.append(at[a][use] * width + codes[b][use])
    distinct = np.unique(np.concatenate(edges)) if edges else np.zeros(0, np.int64)
    degree = np.bincount(distinct // width, minlength=len(keys))
    return keys[take] // width, keys[take] % width, tf[take], degree[take]


def _one_pass(least: int, window: int, min_tf: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of both kinds from one reading: of each slice the records of its terms (``occurrences`` is
    null), and of each record its terms with occurrences and degree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.sliced(batches, *FIELDS):
            terms, rows, segments = _stream(batch, least)
            codes, distinct = T.encode(terms)
            if not len(codes):
                continue
            _, records = T.last_seen_counts(codes, rows, len(distinct))
            nothing = pa.nulls(len(distinct), pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, distinct, nothing, nothing, pa.array(records, pa.int64())], NAMES)
            order = np.argsort(segments, kind="stable")
            row, code, tf, degree = graph_of_words(codes[order], rows[order], segments[order], window, min_tf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("note_id").take(pa.array(row)), distinct.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(degree, pa.int64()), pa.nulls(len(row), pa.int64())], NAMES
            )

    return run


NAMES = ["note_id", "term", "occurrences", "degree", "records"]


def term_weights(notes: DataFrame, least: int = 5, window: int = 4, min_tf: int = 1, max_notes: int | None = None, broadcast_terms: int = 10_000) -> DataFrame:
    """``(note_id, term, occurrences, degree, notes, score)`` of every term of every note.

    ``degree`` is the number of distinct terms within ``window`` of the term in the note's graph of
    words; ``score`` is degree * ln((N + 1) / notes), with N the number of all notes and ``notes``
    those that have this term. ``min_tf`` and ``max_notes`` keep only terms that occur so often in
    the note, and in so few notes.

    The texts are read and cut into terms once; that pass, which gives the terms of each note and,
    summed up slice by slice, the notes of each term, is written and read again for the join. The
    ``broadcast_terms`` commonest terms are joined by broadcast, so their number has a bound; of the
    others none can be in more than one row of ``broadcast_terms``, so no key is hot in the shuffle.
    Null and empty fields give no term; a table without terms gives no rows.
    """
    once = notes_once(notes.select("note_id", "indexed_at", *FIELDS)).select("note_id", *FIELDS)
    total = once.count()
    rows = materialize(once.mapInArrow(_one_pass(least, window, min_tf), "note_id bigint, term string, occurrences bigint, degree bigint, records bigint"))
    counts = rows.where("occurrences is null").groupBy("term").agg(F.sum("records").alias("notes"))
    weights = rows.where("occurrences is not null").drop("records")
    if max_notes is not None:
        joined = weights.join(counts.where(F.col("notes") <= max_notes), "term")
    else:
        counts = materialize(counts)
        hot = F.broadcast(counts.orderBy(F.desc("notes"), "term").limit(broadcast_terms).select("term", F.col("notes").alias("__hot")))
        told = weights.join(hot, "term", "left")
        cold = told.where("__hot is null").drop("__hot").join(counts, "term")
        joined = told.where("__hot is not null").withColumnRenamed("__hot", "notes").unionByName(cold)
    score = F.col("degree") * F.log((F.lit(total) + 1) / F.col("notes"))
    return joined.select("note_id", "term", "occurrences", "degree", "notes", score.alias("score"))


def found(notes: DataFrame) -> DataFrame:
    """p6_found: terms that occur at least 5 times in their note and in at most 3 notes."""
    return term_weights(notes, min_tf=5, max_notes=3).select("note_id", "term")
