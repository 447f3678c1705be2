"""Term streams over Arrow batches: the tokenisation that p4 and p6 share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the letters of a term, as a character class without its brackets.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


#: Texts are worked on in slices of so many bytes, whatever the size of a batch; a longer text is a slice of its own.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows whose texts have about ``SLICE`` bytes, so that memory has a bound."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // SLICE
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def sliced(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """All batches in such slices."""
    for batch in batches:
        yield from slices(batch, columns)


def words(texts: pa.Array, least: int, letters: str = LETTERS) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of at least ``least`` letters, lower-cased, with the row each comes from.

    Null and empty texts give no term. Works on whole texts, whatever their length.
    """
    spaced = pc.replace_substring_regex(texts, f"[^{letters}]+", " ")
    return _flat(pc.split_pattern(spaced, " "), least)


def tags(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Values between white space without leading ``#``, lower-cased, with their row."""
    terms, rows = _flat(pc.utf8_split_whitespace(texts), 1)
    terms = pc.utf8_ltrim(terms, characters="#")
    keep = pc.greater(pc.binary_length(terms), 0)
    return terms.filter(keep), rows[keep.to_numpy(zero_copy_only=False)]


def _flat(lists: pa.Array, least: int) -> tuple[pa.Array, np.ndarray]:
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = pc.list_flatten(lists)
    keep = pc.fill_null(pc.greater_equal(pc.utf8_length(terms), least), False)
    return pc.utf8_lower(terms.filter(keep)), rows[keep.to_numpy(zero_copy_only=False)]


def encode(terms: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of the terms and the distinct terms that they stand for."""
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.combine_chunks()
    coded = terms.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def last_seen_counts(codes: np.ndarray, rows: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and records of each term by last-seen counters.

    The tokens of a term are walked in record order; a token counts as a new record where its
    record differs from the one last seen. No set of records is kept for any term.
    """
    order = np.lexsort((rows, codes))
    c, r = codes[order], rows[order]
    fresh = np.ones(len(c), dtype=bool)
    fresh[1:] = (c[1:] != c[:-1]) | (r[1:] != r[:-1])
    return np.bincount(codes, minlength=n_terms), np.bincount(c[fresh], minlength=n_terms)


def counted(field: str, terms: pa.Array, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The partial counts of one batch, one row per distinct term."""
    codes, distinct = encode(terms)
    if len(distinct):
        occurrences, records = last_seen_counts(codes, rows, len(distinct))
        yield pa.RecordBatch.from_arrays(
            [pa.array([field] * len(distinct)), distinct, pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())],
            ["field_name", "term", "occurrences", "notes"],
        )


COUNT_SCHEMA = "field_name string, term string, occurrences bigint, notes bigint"


def tag_array(tags: Column) -> Column:
    """The distinct tags of a joined string in code point order, as a Column; null gives none."""
    parts = F.transform(F.split(F.coalesce(tags, F.lit("")), r"(?U)\s+"), lambda t: F.lower(F.regexp_replace(t, "^#+", "")))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda t: t != "")))
