"""Queries: commands, options and tokens, worked out on the driver, where a query is one string."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import DEFAULT, HAN, Analysis


@dataclass(frozen=True)
class Options:
    """How terms of a query match."""

    prefix: bool = True
    fuzzy: bool = True


@dataclass(frozen=True)
class Query:
    """The text to search for and the options that its commands set."""

    text: str
    options: Options


def parse(raw: str, defaults: Options = Options()) -> Query:
    """Takes ``/ap /np /af /nf`` commands off the ends of a query.

    Only the first and the last part between spaces can hold commands, joined by slashes. Later
    commands win; an unknown one restores the defaults and ends; the parts are dropped all the same.
    """
    parts, commands = raw.split(" "), []
    for at in (0, -1):
        if parts and parts[at].startswith("/"):
            commands += parts.pop(at).split("/")
    options = defaults
    for command in commands:
        if command in ("ap", "np"):
            options = replace(options, prefix=command == "ap")
        elif command in ("af", "nf"):
            options = replace(options, fuzzy=command == "af")
        elif command:
            options = defaults
            break
    return Query(" ".join(parts), options)


def parsed(raw: Column) -> Column:
    """The same for a column of queries: a struct of text, prefix and fuzzy."""
    parts = F.split(raw, " ")
    first = F.element_at(parts, 1)
    head = first.startswith("/")
    rest = F.when(head, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    last = F.when(F.size(rest) > 0, F.try_element_at(rest, F.lit(-1))).otherwise("")
    tail = last.startswith("/")
    text = F.array_join(F.when(tail, F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest), " ")
    joined = F.concat(F.when(head, first).otherwise(""), F.when(tail, last).otherwise(""))
    commands = F.filter(F.split(joined, "/"), lambda c: c != "")
    known = F.forall(commands, lambda c: c.isin("ap", "np", "af", "nf"))

    def setting(on: str, off: str) -> Column:
        own = F.filter(commands, lambda c: c.isin(on, off))
        return F.when(known & (F.size(own) > 0), F.element_at(own, -1) == on).otherwise(F.lit(True))

    return F.struct(text.alias("text"), setting("ap", "np").alias("prefix"), setting("af", "nf").alias("fuzzy"))


def _separator(c: str) -> bool:
    return c.isspace() or c == "﻿" or c in "^=`[]{}()<>" or unicodedata.category(c)[0] in "ZP" and c not in "!\"&'-_\\"


def tokens(text: str, analysis: Analysis = DEFAULT) -> list[str]:
    """The tokens of a query, the same as the Column expression gives, in order."""
    blank = "".join(" " if _separator(c) else c for c in re.sub(f"[{HAN}]+", " ", text))
    found = [w for w in blank.split(" ") if len(w) >= 2 and w not in analysis.stop_words_en]
    parts = [p for w in found if len(w) > 3 for p in re.sub("([a-z])(?=[A-Z])", r"\1 ", re.sub("[-_]", " ", w)).split(" ") if len(p) > 1]
    runs = re.findall(f"[{HAN}]+", text)
    pairs = [p for r in runs for p in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)]) if p not in analysis.stop_words_zh]
    return [t for t in dict.fromkeys(found + parts + pairs) if len(t) < 30]


def terms(text: str, analysis: Analysis = DEFAULT) -> list[str]:
    """The distinct tokens of a query, in lower case unless case counts."""
    return list(dict.fromkeys(t if analysis.case_sensitive else t.lower() for t in tokens(text, analysis)))


def maximal_terms(query: list[str], matched: list[str]) -> list[str]:
    """The terms to look for in lines: query terms that matched and aren't part of a longer query
    term, and matched terms unrelated to all others; without such query terms the maximal matched."""

    def inside(a: str, b: str) -> bool:
        return len(a) < len(b) and a in b

    kept = [q for q in query if q in matched and not any(inside(q, o) for o in query)]
    if not kept:
        return [m for m in matched if not any(inside(m, o) for o in matched)]
    return kept + [m for m in matched if m not in kept and not any(inside(m, o) or inside(o, m) for o in matched)]


def maximal(query: Column, matched: Column) -> Column:
    """The same as ``maximal_terms`` for columns of arrays."""

    def inside(a: Column, b: Column) -> Column:
        return (F.length(a) < F.length(b)) & F.contains(b, a)

    kept = F.array_distinct(F.filter(query, lambda q: F.array_contains(matched, q) & ~F.exists(query, lambda o: inside(q, o))))
    alone = F.filter(matched, lambda m: ~F.exists(matched, lambda o: inside(m, o)))
    others = F.filter(matched, lambda m: ~F.array_contains(kept, m) & ~F.exists(matched, lambda o: inside(m, o) | inside(o, m)))
    return F.when(F.size(kept) == 0, alone).otherwise(F.concat(kept, others))


def move_cursor(at: int, step: int, n: int) -> int:
    """A place in a list of ``n`` results, moved and held inside it."""
    return max(0, min(n - 1, at + step))


def cursor(at: Column, step: int, n: Column) -> Column:
    """The same for columns."""
    return F.greatest(F.lit(0), F.least(n - 1, at + step))
