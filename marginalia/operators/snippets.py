"""Snippets: the columns to mark, the context around a hit, and its markup."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.functions.text import HAN
from marginalia.operators.lines import fuzzy_lines, min_in_set, top_lines


@dataclass(frozen=True)
class Limits:
    """How much context comes before and behind a hit."""

    lines_before: int
    lines_after: int
    chars_before: int
    chars_after: int
    least: int = 4


#: Limits by kind of snippet, and by whether the query has wide characters.
LIMITS = {
    ("line", False): Limits(0, 0, 30, 230), ("line", True): Limits(0, 0, 30, 230),
    ("paragraph", False): Limits(4, 7, 220, 600), ("paragraph", True): Limits(4, 7, 220, 600),
    ("subItem", False): Limits(3, 3, 180, 200), ("subItem", True): Limits(3, 3, 60, 80),
}


def limits_for(kind: str, query: str) -> Limits:
    """The limits of a kind of snippet for a query."""
    return LIMITS[kind, re.search(f"[{HAN}]", query) is not None]


def marked_columns(text: str, terms: list[str], limits: Limits, prefix: bool = True) -> list[int]:
    """The columns to mark in a line.

    The last of the terms that occurs fixes a window around its first occurrence; all terms are
    marked inside the window.
    """
    patterns = [re.compile(re.escape(t) + ("" if prefix else "(?![a-zA-Z])"), re.IGNORECASE) for t in terms if t]
    for pattern, term in zip(reversed(patterns), reversed([t for t in terms if t]), strict=True):
        if m := pattern.search(text):
            a, b = max(0, m.start() - limits.chars_before), min(len(text), m.start() + len(term) + limits.chars_after)
            return sorted({c for p in patterns for x in p.finditer(text[a:b]) for c in range(a + x.start(), a + x.end())})
    return []


def mark(text: str, columns: list[int]) -> str:
    """The text, safe as HTML, with runs of the columns between ``<mark>`` tags."""
    wanted, out, i = set(columns), [], 0
    while i < len(text):
        j = i
        while j < len(text) and (j in wanted) == (i in wanted):
            j += 1
        part = html.escape(text[i:j], quote=False)
        out.append(f"<mark>{part}</mark>" if i in wanted else part)
        i = j
    return "".join(out)


def matched_line(marked: str, background: bool = False) -> str:
    """The hit's own line between its ``<span>`` tags."""
    return f'<span class="matched-line{" highlight-bg" if background else ""}">{marked}</span>'


def context(lines: list[str], row: int, col: int, limits: Limits, check_first: bool = False) -> tuple[list[tuple[int, str]], int]:
    """The lines around a hit as ``(row, text)``, and the column at which the hit's line begins.

    Budgets of characters go first to the hit's line, then to the lines above and below. A line that
    fits is kept; one that fills the budget ends the walk; a longer one is cut. An outermost line
    shorter than the least is dropped; ``check_first`` looks at the first line below instead of the
    last, as an old behaviour did.
    """
    text = lines[row]
    last = min(len(text) - 1, col + limits.chars_after)
    start = 0 if col < limits.chars_before else col - limits.chars_before
    above: list[tuple[int, str]] = []
    if col < limits.chars_before:
        above = _walk(lines, range(row - 1, max(-1, row - 1 - limits.lines_before), -1), limits.chars_before - col, True)
        if above and len(above[-1][1]) < limits.least:
            above.pop()
    below = _walk(lines, range(row + 1, min(len(lines), row + 1 + limits.lines_after)), limits.chars_after - (last - col), False)
    if below and len(below[0 if check_first else -1][1]) < limits.least:
        below.pop()
    return [*above[::-1], (row, text[start : last + 1]), *below], start


def _walk(lines: list[str], rows: range, budget: int, upwards: bool) -> list[tuple[int, str]]:
    out, used = [], 0
    for r in rows:
        left = budget - used
        if left <= 0:
            break
        text = lines[r]
        if len(text) < left:
            out.append((r, text))
            used += len(text)
            continue
        out.append((r, text[-left:] if upwards else text[:left]))
        break
    return out


def render(lines: list[str], row: int, columns: list[int], limits: Limits, background: bool = False) -> tuple[str, int]:
    """The snippet of a hit as HTML and its first marked column."""
    col = min(columns, default=0)
    kept, start = context(lines, row, col, limits)
    shift = start if kept and kept[0][0] == row else 0
    parts = [matched_line(mark(t, [c - shift for c in columns if c >= shift]), background) if r == row else html.escape(t, quote=False) for r, t in kept]
    return "\n".join(parts), col


def snippets(docs: DataFrame, lines: DataFrame, terms: list[str], query: str, k: int = 30) -> DataFrame:
    """``(note_id, row_no, col, rank, score, snippet)`` of the best lines of each document.

    Lines are ranked with built-in functions; only documents with hits go to Python, each once with
    its at most ``k`` hits. Documents without a hit have no rows.
    """
    limits = limits_for("subItem", query)
    hits = top_lines(lines, terms, k=k).groupBy("note_id").agg(F.sort_array(F.collect_list(F.struct("rank", "row_no", "score"))).alias("hits"))
    joined = hits.join(docs.select("note_id", "content"), "note_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for note_id, content, own_hits in zip(rows["note_id"], rows["content"], rows["hits"], strict=True):
                own = content.split("\n")
                for x in own_hits:
                    text, col = render(own, x["row_no"], marked_columns(own[x["row_no"]], terms, limits), limits)
                    out.append((note_id, x["row_no"], col, x["rank"], x["score"], text))
            yield pd.DataFrame(out, columns=["note_id", "row_no", "col", "rank", "score", "snippet"])

    return joined.mapInPandas(run, "note_id bigint, row_no int, col int, rank int, score double, snippet string")


def line_snippets(hits: DataFrame, terms: list[str], query: str, background: bool = False) -> DataFrame:
    """``(note_id, row_no, col, snippet)`` of hits' own lines alone, cut around the first marked column."""
    limits = limits_for("line", query)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [render([t], 0, marked_columns(t, terms, limits), limits, background) for t in rows["text"]]
            yield pd.DataFrame({"note_id": rows["note_id"], "row_no": rows["row_no"], "col": [c for _, c in made], "snippet": [x for x, _ in made]})

    return hits.select("note_id", "row_no", "text").mapInPandas(run, "note_id bigint, row_no int, col int, snippet string")


def search_in_file(docs: DataFrame, note_id: int, query: str, limit: int = 30) -> DataFrame:
    """``(row_no, score, line, paragraph)``: the best lines of one document with both contexts."""
    from marginalia.operators.corpus import split_lines

    one = docs.where(F.col("note_id") == note_id)
    hits = fuzzy_lines(split_lines(one, "note_id", "content"), query, limit).join(one.select("note_id", "content"), "note_id")
    wide, around = LIMITS["line", False], LIMITS["paragraph", False]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            split = {c: c.split("\n") for c in rows["content"].unique()}
            for x in rows.itertuples():
                own, columns = split[x.content], list(x.positions)
                out.append((x.row_no, x.score, render(own, x.row_no, columns, wide)[0], render(own, x.row_no, columns, around, True)[0]))
            yield pd.DataFrame(out, columns=["row_no", "score", "line", "paragraph"])

    return hits.mapInPandas(run, "row_no int, score int, line string, paragraph string")


def neighbours(hits: DataFrame, lines: DataFrame, before: int, after: int) -> DataFrame:
    """``(note_id, hit_row, row_no, text)``: lines within some rows of a hit, by equality on note and row.

    Each hit asks for its few neighbour rows, so the band becomes an equi-join.
    """
    wanted = hits.select("note_id", F.col("row_no").alias("hit_row"), F.explode(F.sequence(F.col("row_no") - before, F.col("row_no") + after)).alias("row_no"))
    return wanted.join(lines.select("note_id", "row_no", "text"), ["note_id", "row_no"]).select("note_id", "hit_row", "row_no", "text")


def context_budget(hits: DataFrame, lines: DataFrame, rows: int, budget: int, upwards: bool) -> DataFrame:
    """``(note_id, hit_row, row_no, text)`` above or below hits, cut to a budget of characters."""
    near = neighbours(hits, lines, rows if upwards else 0, 0 if upwards else rows).where("row_no <> hit_row")
    order = Window.partitionBy("note_id", "hit_row").orderBy(F.desc("row_no") if upwards else F.asc("row_no"))
    used = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("__used")
    size = F.length("text")
    cut = F.substring(F.col("text"), F.when(F.lit(upwards), F.greatest(size - left, F.lit(0)) + 1).otherwise(F.lit(1)), left)
    return near.withColumn("__used", used).where(left > 0).select("note_id", "hit_row", "row_no", F.when(size < left, F.col("text")).otherwise(cut).alias("text"))


def old_snippet(text: str, col: int, before: int = 30, after: int = 200) -> str:
    """A fixed cut around a column, as the former in-file search gave."""
    return text[max(0, col - before) : col + after]


def old_search_in_file(docs: DataFrame, note_id: int, query: str, limit: int = 30) -> DataFrame:
    """``(row_no, col, snippet)``: the former in-file search, with a fixed cut around the first column."""
    from marginalia.operators.corpus import split_lines

    one = docs.where(F.col("note_id") == note_id)
    hits = fuzzy_lines(split_lines(one, "note_id", "content"), query, limit)
    col = min_in_set(F.col("positions")).cast("int")
    start = F.greatest(col - 30, F.lit(0))
    return hits.select("row_no", col.alias("col"), F.substr(F.col("text"), start + 1, col + 200 - start).alias("snippet"))
