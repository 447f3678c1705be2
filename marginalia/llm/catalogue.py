"""The pN_ queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import distinctive, frequency, garbling, language, leakage, lookalikes, markup, mixing, sql, splitting, together
from marginalia.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(run: Callable[..., DataFrame], *names: str) -> Query:
    """The query that applies an operator to whole tables."""
    return lambda spark, folder: run(*(table(spark, folder, n) for n in names))


def _classes(notes: DataFrame) -> DataFrame:
    """The classes of look-alike values, with the least note of each class and form instead of digests."""
    own = lookalikes.classes(notes)
    first = {"first_of_class": ("field_name", "class_id"), "first_of_form": ("field_name", "class_id", "form_id")}
    for name, key in first.items():
        own = own.join(own.groupBy(*key).agg(F.min("note_id").alias(name)), list(key))
    return own.select("field_name", "note_id", "n_forms", "n_notes", *first)


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(markup.found, "indexed_documents"),
        "p1_clean": _over(markup.cleaned, "indexed_documents"),
        "p1_clean_lines": _over(markup.cleaned_lines, "note_lines"),
        "p2_found": _over(lookalikes.same_looking, "indexed_documents"),
        "p2_classes": _over(_classes, "indexed_documents"),
        "p2_normalized": _over(lookalikes.normalized, "indexed_documents"),
        "p3_found": _over(language.found, "indexed_documents"),
        "p3_languages": _over(language.languages, "indexed_documents"),
        "p4_found": _over(frequency.found, "indexed_documents"),
        "p4_term_frequency": _over(frequency.term_frequency, "indexed_documents"),
        "p5_found": _over(together.found, "indexed_documents"),
        "p5_tag_pairs": _over(together.tag_pairs, "indexed_documents"),
        "p6_found": _over(distinctive.found, "indexed_documents"),
        "p6_term_weights": _over(distinctive.term_weights, "indexed_documents"),
        "p7_found": _over(splitting.found, "indexed_documents", "semantic_documents"),
        "p7_pieces": _over(splitting.all_pieces, "indexed_documents", "semantic_documents"),
        "p7_rebuilt": _over(splitting.rebuilt, "indexed_documents", "semantic_documents"),
        "p8_found": _over(leakage.found, "documents", "eval_items"),
        "p8_leaks": _over(leakage.leaks, "documents", "eval_items"),
        "p9_found": _over(mixing.found, "documents", "mix_targets"),
        "p9_mix": _over(lambda d, t: mixing.mix(d, t)[0], "documents", "mix_targets"),
        "p9_report": _over(lambda d, t: mixing.mix(d, t)[1], "documents", "mix_targets"),
        "p9_report_shares": _over(lambda d, t: mixing.mix(d, t, meet_shares=True)[1], "documents", "mix_targets"),
        "p10_found": _over(garbling.found, "documents"),
        "p10_repaired": _over(garbling.garbled, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return sql.SQL
