"""Tokenisation and other text functions as Column expressions."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words, matched as written, so that ``The`` stays and ``the`` goes.
STOP_WORDS_EN = """a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down
during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only
or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under until up very was we
were what when where which while who whom why will with would you your yours""".split()
#: Chinese function words.
STOP_WORDS_ZH = "的 了 和 是 在 也 有 就 不 都 而 及 与 或 我们 你们 他们 因为 所以 但是 而且 如果 以及 这个 那个 没有 一个 已经 可以 以前 以后".split()
#: Fixed value: the Han characters that make a text Chinese.
HAN = "一-龥"
#: Separators: white space, brackets, ``^ = ` ``, and all punctuation but ``! " & ' - _ \``; Han characters, which are cut apart.
SEPARATORS = rf"[\s\p{{Z}}\p{{P}}\x{{FEFF}}^=\x60<>{HAN}&&[^!\"&'\-_\\]]+"
#: What a word with parts has: a hyphen, an underscore, or a capital behind a small letter.
PARTED = "[-_]|[a-z][A-Z]"


@dataclass(frozen=True)
class Analysis:
    """How texts become terms: whether case counts, and which stop words go; the same for index and query."""

    case_sensitive: bool = False
    stop_words_en: tuple[str, ...] = tuple(STOP_WORDS_EN)
    stop_words_zh: tuple[str, ...] = tuple(STOP_WORDS_ZH)

    def term(self, token: Column | str) -> Column:
        """A token as the term that it is indexed by."""
        return F.col(token) if self.case_sensitive and isinstance(token, str) else token if self.case_sensitive else F.lower(token)

    def key(self) -> str:
        """A name that differs wherever the terms may."""
        return f"{'exact' if self.case_sensitive else 'folded'}-{zlib.crc32(repr((sorted(self.stop_words_en), sorted(self.stop_words_zh))).encode()):08x}"


DEFAULT = Analysis()


def wide_runs(text: Column) -> Column:
    """The maximal runs of Han characters."""
    return F.regexp_extract_all(text, F.lit(f"([{HAN}]+)"), 1)


def bigrams(text: Column, stop_words: list[str] | tuple[str, ...] = STOP_WORDS_ZH) -> Column:
    """Overlapping pairs of the Han runs, a lone character by itself: segmentation without a dictionary."""
    pairs = F.transform(wide_runs(text), lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    return F.filter(F.flatten(pairs), lambda t: ~t.isin(*stop_words)) if stop_words else F.flatten(pairs)


def words(text: Column, stop_words: list[str] | tuple[str, ...] | None = None) -> Column:
    """Words of two and more characters between separators, without stop words (case counts)."""
    stop = STOP_WORDS_EN if stop_words is None else stop_words
    return F.filter(F.split(text, SEPARATORS), lambda w: (F.length(w) >= 2) & ~w.isin(*stop) if stop else F.length(w) >= 2)


def subwords(word: Column) -> Column:
    """Parts of a word at hyphens, underscores and from lower to upper case, of two and more characters."""
    spaced = F.regexp_replace(F.regexp_replace(word, "[-_]", " "), "([a-z])(?=[A-Z])", "$1 ")
    return F.filter(F.split(spaced, " "), lambda p: F.length(p) > 1)


def occurrences(text: Column, analysis: Analysis = DEFAULT) -> Column:
    """All tokens of a text as often as they stand in it: words, parts of words that have some, Han pairs."""
    text = F.coalesce(text, F.lit(""))
    found = words(text, analysis.stop_words_en)
    parts = F.flatten(F.transform(F.filter(found, lambda w: (F.length(w) > 3) & w.rlike(PARTED)), subwords))
    return F.filter(F.concat(found, parts, bigrams(text, analysis.stop_words_zh)), lambda t: F.length(t) < 30)


def tokens(text: Column, analysis: Analysis = DEFAULT) -> Column:
    """Distinct tokens of a text as it is indexed and queried; null and empty texts have none.

    Words, the parts of words over three characters, and Han pairs, all under 30 characters. Parts
    aren't checked against the stop words.
    """
    text = F.coalesce(text, F.lit(""))
    found = F.array_distinct(words(text, analysis.stop_words_en))
    parts = F.flatten(F.transform(F.filter(found, lambda w: (F.length(w) > 3) & w.rlike(PARTED)), subwords))
    return F.filter(F.array_distinct(F.concat(found, parts, bigrams(text, analysis.stop_words_zh))), lambda t: F.length(t) < 30)


def terms(text: Column, analysis: Analysis = DEFAULT) -> Column:
    """The tokens as terms, in lower case unless case counts: as many as there are case variants."""
    return F.transform(tokens(text, analysis), analysis.term)


def wide_count(text: Column) -> Column:
    """Number of Han characters."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{HAN}]", ""))


def is_large_charset(text: Column) -> Column:
    """Whether at least 35 % of the characters, rounded up, are Han."""
    return wide_count(text) >= F.ceil(F.lit(0.35) * F.length(text))


def strip_spaces(text: Column) -> Column:
    """A query without any white space, as the fuzzy line search takes it."""
    return F.regexp_replace(text, r"(?U)\s", "")


def markdown_clean(text: Column) -> Column:
    """Link labels without their targets, text without double asterisks and backticks."""
    text = F.regexp_replace(text, r"\[([^\[\]]+)\]\([^()]*\)", "$1")
    text = F.regexp_replace(text, r"\*\*(.*?)\*\*", "$1")
    return F.regexp_replace(text, "`(.*?)`", "$1")


def html_to_text(html: Column) -> Column:
    """Plain text of HTML: tags go, block ends become line ends, basic entities are resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|table|ul|ol)\s*>", "\n")
    text = F.regexp_replace(text, r"</?[A-Za-z][^<>]*>", "")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return markdown_clean(text)


def headings(text: Column) -> Column:
    """The headings of a Markdown text, joined by spaces."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.*?)[ \t#]*\r?$"), 1), " ")


def escape_html(text: Column) -> Column:
    """Text safe to stand between tags."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def term_pattern(term: str, prefix: bool = True, case_sensitive: bool = False) -> str:
    """The Java pattern that finds a term in a line; without ``prefix`` no letter may follow."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", term)
    return ("" if case_sensitive else "(?iu)") + quoted + ("" if prefix else "(?![a-zA-Z])")


def mark_literal(text: Column, query: str) -> Column:
    """The text, safe as HTML, with each occurrence of the query between ``<mark>`` tags, whatever its case."""
    if not query:
        return escape_html(text)
    quoted = term_pattern(query.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    return F.regexp_replace(escape_html(text), f"({quoted})", "<mark>$1</mark>")


def joined_tags(tags: Column) -> Column:
    """An array of tags as one string, each without a leading ``#``; null for null."""
    return F.array_join(F.transform(tags, lambda t: F.regexp_replace(t, "^#", "")), " ")


def front_matter(text: Column, key: str) -> Column:
    """The values of a key of a note's front matter, written in brackets, as a list or as one value."""
    block = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---(?:\r?\n|\z)", 1)
    inline = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\[([^\]\n]*)\]", 1)
    listed = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*-[ \t]+[^\n]*(?:\n|\z))+)", 1)
    single = F.regexp_extract(block, rf"(?m)^{key}:[ \t]*([^\[\s][^\n\r]*)", 1)
    parts = F.when(inline != "", F.split(inline, ",")).when(listed != "", F.split(F.regexp_replace(listed, r"(?m)^[ \t]*-[ \t]+", ""), r"\r?\n")).otherwise(F.array(single))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "^[\"']|[\"']$", "")), lambda p: p != "")
