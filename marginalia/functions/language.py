"""A text's language as far as the index cares: English, Chinese or other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.formatting import percent
from marginalia.functions.text import wide_count

ORDER = ("en", "zh", "other")


def language(text: Column) -> Column:
    """``other`` under ten characters or without letters, ``zh`` with more Han than Latin letters, else ``en``."""
    latin = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    wide = wide_count(text)
    return F.when((F.length(text) < 10) | (latin + wide == 0), "other").when(wide > latin, "zh").otherwise("en")


def proportions(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, main, en, zh, other)``: each group's shares by length, as percent, and its main language.

    Ties go to the earlier of en, zh, other; a group without any text has null shares and ``other``.
    """
    sizes = [F.coalesce(F.sum(F.when(language(F.col(text)) == c, F.length(text))), F.lit(0)).alias(f"n_{c}") for c in ORDER]
    sums = df.groupBy(key).agg(*sizes)
    total = sum((F.col(f"n_{c}") for c in ORDER), F.lit(0))
    best = F.greatest(*(F.col(f"n_{c}") for c in ORDER))
    main = F.when(best == 0, "other").when(F.col("n_en") == best, "en").when(F.col("n_zh") == best, "zh").otherwise("other")
    return sums.select(key, main.alias("main"), *(percent(F.when(total > 0, F.col(f"n_{c}") / total)).alias(c) for c in ORDER))
