"""Lines of documents: which match, how well, and fuzzy search inside one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.text import term_pattern

#: How many lines of a document come out.
LINES = 30


def line_score(text: Column, terms: list[str], prefix: bool = True, case_sensitive: bool = False) -> Column:
    """The score of a line: for each distinct matched form its length, for each repeat 0.01."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit("(" + term_pattern(t, prefix, case_sensitive) + ")"), 1) for t in terms))
    forms = F.array_distinct(found)
    lengths = F.aggregate(forms, F.lit(0), lambda a, f: a + F.length(f))
    return F.round(lengths + F.lit(0.01) * (F.size(found) - F.size(forms)), 4)


def matching_lines(lines: DataFrame, terms: list[str], prefix: bool = True, case_sensitive: bool = False) -> DataFrame:
    """The lines that match one of the terms whatever its case, with their ``score``.

    The cheap test goes before the score; lines of score zero are left out. No terms, no lines.
    """
    if not terms:
        return lines.withColumn("score", F.lit(0.0)).limit(0)
    admitted = lines.where(F.col("text").rlike("|".join(f"(?:{term_pattern(t)})" for t in terms)))
    scored = admitted.withColumn("score", line_score(F.col("text"), terms, prefix, case_sensitive))
    return scored if prefix and not case_sensitive else scored.where("score > 0")


def top_lines(lines: DataFrame, terms: list[str], key: str = "note_id", k: int = LINES, prefix: bool = True, tie: tuple[str, ...] = ("text",)) -> DataFrame:
    """The ``k`` best lines of each document, the earlier of equal ones, then by ``tie``; ``rank`` from 1."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "row_no", *tie)
    return matching_lines(lines, terms, prefix).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Characters of text times characters of the query that fuzzy matching works on at a time, whatever the lengths of the lines.
AT_ONCE = 1 << 20
#: Kinds of characters, and what sets the lines that are worked on together apart.
ALNUM, LOWER, UPPER, DIGIT, APART = 1, 2, 4, 8, 1 << 40


def fuzzy_matches(texts: list[str], query: str) -> list[tuple[int, list[int]] | None]:
    """The best alignment of a query as a subsequence of each text: its score and the columns.

    Sixteen for each character, more at the start of a word, after a separator or at a capital; one
    that follows the one before at once gets at least what the first of its run got; less for gaps.
    Case counts only if the query has capitals. None if the query is no subsequence.

    Texts are worked on end to end, a vector step for each character of the query over the places
    that have it; the penalties of gaps are settled by a running maximum. A long text is worked on
    in stretches. So memory depends neither on the longest text nor on how lengths are mixed.
    """
    if not query:
        return [(0, []) for _ in texts]
    out: list[tuple[int, list[int]] | None] = [None] * len(texts)
    most = max(AT_ONCE // len(query), 1 << 10)
    part, size = [], 0
    for k, text in enumerate(texts):
        if text and len(text) > most:
            out[k] = _aligned_long(text, query, most)
        elif text:
            if size + len(text) > most:
                _align([texts[i] for i in part], query, part, out)
                part, size = [], 0
            part.append(k)
            size += len(text)
    if part:
        _align([texts[i] for i in part], query, part, out)
    return out


def _align(texts: list[str], query: str, ids: list[int], out: list[tuple[int, list[int]] | None]) -> None:
    """Puts the alignments of some texts into ``out`` at ``ids``."""
    steps = _steps("".join(texts), np.cumsum([len(t) for t in texts]), query, [[] for _ in query])
    _, row, score, _, _ = steps[-1]
    if not len(row):
        return
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    best = np.maximum.reduceat(score, begins)
    tops = np.flatnonzero(score == np.repeat(best, np.diff(np.append(begins, len(row)))))
    ends = tops[np.concatenate([[True], row[tops][1:] != row[tops][:-1]])]
    columns, at = np.empty((len(ends), len(query)), np.int64), ends
    for q in range(len(query) - 1, -1, -1):
        columns[:, q], at = steps[q][0][at], steps[q][4][at]
    columns -= np.cumsum([0, *(len(t) for t in texts)])[row[ends]][:, None]
    for k, x, c in zip(row[ends].tolist(), best.tolist(), columns.tolist(), strict=True):
        out[ids[k]] = (x, c)


def _aligned_long(text: str, query: str, size: int) -> tuple[int, list[int]] | None:
    """The alignment of one text, in stretches of ``size``.

    Of each stretch go on, for each character of the query, the alignment that any gap would start
    from and that in the last column, which a run may follow.
    """
    held: list[list[tuple[int, int, int, list[int]]]] = [[] for _ in query]
    found: tuple[int, list[int]] | None = None
    for at in range(0, len(text), size):
        own = text[at : at + size]
        steps = _steps(own, np.array([len(own)]), query, held, at, text[at - 1 : at])

        def trail(q: int, k: int, steps: list = steps, held: list = held) -> list[int]:
            back = []
            while q >= 0 and k >= len(held[q]):
                back.append(int(steps[q][0][k]))
                q, k = q - 1, int(steps[q][4][k])
            return (held[q][k][3] if q >= 0 else []) + back[::-1]

        score = steps[-1][2]
        if len(score) and (found is None or score.max() > found[0]):
            found = int(score.max()), trail(len(query) - 1, int(score.argmax()))
        kept = []
        for q, (place, _, score, chunk, _) in enumerate(steps[:-1]):
            ks = sorted({int((score + place).argmax()), *np.flatnonzero(place == at + len(own) - 1).tolist()}) if len(place) else []
            kept.append([(int(place[k]), int(score[k]), int(chunk[k]), trail(q, k)) for k in ks])
        held = [*kept, []]
    return found


def _steps(text: str, ends: np.ndarray, query: str, held: list[list[tuple[int, int, int, list[int]]]], at: int = 0, before: str = "") -> list[tuple[np.ndarray, ...]]:
    """For each character of the query ``(place, row, score, chunk, link)`` of the best alignments that
    end with it, by place, those of ``held`` first; ``link`` is where the one before is in its step.

    ``text`` is several texts end to end, of which ``ends`` has the ends, or the stretch of a text
    from place ``at`` on, which follows the character ``before``.
    """
    codes = np.frombuffer(((before or " ") + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    signs = np.flatnonzero(seen)
    chars, fold = [chr(c) for c in signs.tolist()], query == query.lower()
    number = {c: k for k, c in enumerate(dict.fromkeys(query), 1)}
    wanted, kinds = np.zeros(len(seen), np.int32), np.zeros(len(seen), np.uint8)
    wanted[signs] = [number.get(c.lower() if fold else c, 0) for c in chars]
    kinds[signs] = [ALNUM * c.isalnum() + LOWER * c.islower() + UPPER * c.isupper() + DIGIT * c.isdigit() for c in chars]
    which = wanted[codes[1:]]
    spots = np.flatnonzero(which)
    rows, which = np.searchsorted(ends, spots, side="right"), which[spots]
    kind, last = kinds[codes[spots + 1]], kinds[codes[spots]]
    last[(rows > 0) & (spots == ends[rows - 1])] = 0
    word = (kind & ALNUM > 0) & (last & ALNUM == 0)
    turn = (last & LOWER > 0) & (kind & UPPER > 0) | (kind & DIGIT > 0) & (last & DIGIT == 0)
    bonuses = np.where(word, 8, np.where(turn, 7, 0))
    spots += at
    of = {c: np.flatnonzero(which == k) for c, k in number.items()}
    steps: list[tuple[np.ndarray, ...]] = []
    for q, want in enumerate(query):
        place, row, bonus = spots[of[want]], rows[of[want]], bonuses[of[want]]
        if q == 0:
            step = place, row, 16 + 2 * bonus, bonus, np.full(len(place), -1)
        elif not len(steps[-1][0]):
            step = tuple(np.zeros(0, np.int64) for _ in range(5))
        else:
            there, its, score, chunk, _ = steps[-1]
            top = np.maximum.accumulate(score + there + its * APART)
            source = np.maximum.accumulate(np.where(np.concatenate([[True], top[1:] > top[:-1]]), np.arange(len(top)), 0))
            n = np.searchsorted(there, place)
            by = np.maximum(n - 1, 0)
            touch = (n > 0) & (there[by] == place - 1)
            far = source[np.maximum(n - touch - 1, 0)]
            gaps, touch = (n > touch) & (its[far] == row), touch & (its[by] == row)
            run = np.maximum(bonus, chunk[by])
            direct, gapped = score[by] + 16 + np.maximum(run, 4), score[far] + there[far] - place + 15 + bonus
            near = touch & (~gaps | (direct >= gapped))
            step = tuple(x[near | gaps] for x in (place, row, np.where(near, direct, gapped), np.where(near, run, bonus), np.where(near, by, far)))
        if held[q]:
            step = tuple(np.concatenate([np.array(x, np.int64), y]) for x, y in zip(([h[0] for h in held[q]], [0] * len(held[q]), [h[1] for h in held[q]], [h[2] for h in held[q]], [-1] * len(held[q])), step, strict=True))
        steps.append(step)
    return steps


def fuzzy_match(text: str, query: str) -> tuple[int, list[int]] | None:
    """The same for one text."""
    return fuzzy_matches([text], query)[0]


def subsequence_pattern(query: str) -> str:
    """The pattern that a line must match to hold the query's characters in order.

    Each step runs to the next wanted character and never back, so a line is read once.
    """
    signs = ("\\" + c if not c.isalnum() else c for c in query)
    return ("(?ius)^" if query == query.lower() else "(?s)^") + "".join(f"[^{c}]*+{c}" for c in signs)


def scored_lines(lines: DataFrame, query: str, keys: tuple[str, ...] = ("note_id", "row_no")) -> DataFrame:
    """``(*keys, text, score, positions)`` of all lines that hold a query as a subsequence.

    White space in the query doesn't count; an empty query has no results. A pattern keeps lines
    that can't match from Python.
    """
    query = "".join(query.split())
    types = dict(lines.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", text string, score int, positions array<int>"
    if not query:
        return lines.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = fuzzy_matches(rows["text"].tolist(), query)
            out = rows[[f is not None for f in found]].copy()
            out["score"] = [f[0] for f in found if f]
            out["positions"] = [f[1] for f in found if f]
            yield out[[*keys, "text", "score", "positions"]]

    return lines.select(*keys, "text").where(F.col("text").rlike(subsequence_pattern(query))).mapInPandas(run, schema)


def fuzzy_lines(lines: DataFrame, query: str, limit: int = LINES, keys: tuple[str, ...] = ("note_id", "row_no")) -> DataFrame:
    """``(*keys, text, score, positions)`` of the lines that match a query best as a subsequence; ties
    go to the earlier keys."""
    return scored_lines(lines, query, keys).orderBy(F.desc("score"), *keys).limit(limit)


def fuzzy_lines_each(lines: DataFrame, query: str, k: int = LINES) -> DataFrame:
    """The same inside every note: ``(note_id, row_no, text, score, positions, rank)`` of its ``k`` best lines."""
    order = Window.partitionBy("note_id").orderBy(F.desc("score"), "row_no", "text")
    return scored_lines(lines, query).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_lines(lines: DataFrame, raw: str, limit: int = LINES) -> DataFrame:
    """``(note_id, row_no, rank, score, query_terms, matched_terms)``: lines ranked as documents of their own.

    The former search inside a file: any term will do, prefixes and typos count.
    """
    from marginalia.operators.search import search

    own = lines.select(F.struct("note_id", "row_no").alias("note_id"), F.lit("").alias("path"), "text")
    found = search(own, raw, limit, boosts={"text": 1.0}, every_term=False)
    return found.select("note_id.note_id", "note_id.row_no", "rank", "score", "query_terms", "matched_terms")


def min_in_set(numbers: Column) -> Column:
    """The least of an array of numbers; the largest double for an empty or missing one."""
    return F.coalesce(F.array_min(numbers).cast("double"), F.lit(1.7976931348623157e308))


def match_columns(text: Column, terms: list[str]) -> Column:
    """All columns that the terms cover in a line, whatever their case, in order."""
    low = F.lower(text)
    sizes = {len(t): [x.lower() for x in terms if len(x) == len(t)] for t in terms if t}
    if not sizes:
        return F.array().cast("array<int>")

    def of(line: Column) -> Column:
        at = F.when(F.length(line) > 0, F.sequence(F.lit(0), F.length(line) - 1)).otherwise(F.array().cast("array<int>"))

        def spots(n: int, own: list[str]) -> Column:
            begins = F.filter(at, lambda i: F.substr(line, i + 1, F.lit(n)).isin(*own))
            return F.flatten(F.transform(begins, lambda i: F.sequence(i, i + (n - 1))))

        return F.array_sort(F.array_distinct(F.flatten(F.array(*(spots(n, own) for n, own in sizes.items())))))

    return F.transform(F.array(low), of)[0]
