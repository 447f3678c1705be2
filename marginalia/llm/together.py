"""p5: which tags occur together, and how much more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.terms import tag_array
from marginalia.operators.corpus import notes_once
from marginalia.sources.tables import materialize

#: Into how many parts the rows of one tag are spread where counts are joined by shuffle.
SALTS = 32


def tag_pairs(notes: DataFrame, min_notes: int = 1, min_share: float = 0.0, broadcast_tags: int = 200_000) -> DataFrame:
    """``(tag_a, tag_b, notes_a, notes_b, notes_ab, n_notes, lift, conviction)`` of all pairs of tags.

    Identical deduplicated tag arrays are collapsed into one basket with a weight; pairs are made
    once per distinct basket and the weights are summed. ``min_notes`` and ``min_share`` ask only for
    pairs in so many notes and such a share of all notes. A tag below that support is in no such
    pair, so baskets are cut to the frequent tags and collapsed again before any pair is made.

    The counts of tags are joined to the finished pairs: broadcast up to ``broadcast_tags`` (checked
    by a count), beyond by a shuffle with each tag spread over ``SALTS`` parts.

    lift is n_ab * n / (n_a * n_b); conviction of a => b is P(a) * P(not b) / P(a and not b), null
    where b always comes with a. Null and empty tags give no pair; case, ``#`` and repeats inside a
    note don't count; ``tag_a`` < ``tag_b`` by code point.
    """
    once = notes_once(notes.select("note_id", "indexed_at", "tags")).select(tag_array(F.col("tags")).alias("basket"))
    baskets = materialize(once.groupBy("basket").agg(F.count(F.lit(1)).alias("weight")).withColumn("basket_id", F.monotonically_increasing_id()))
    n = baskets.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    support = max(min_notes, min_share * n)
    tags = baskets.select("basket_id", "weight", F.explode("basket").alias("tag"))
    counts = materialize(tags.groupBy("tag").agg(F.sum("weight").alias("notes")).where(F.col("notes") >= support))
    few = counts.limit(broadcast_tags + 1).count() <= broadcast_tags
    if support > 1:
        kept = tags.join(F.broadcast(counts) if few else counts, "tag", "left_semi")
        cut = kept.groupBy("basket_id", "weight").agg(F.sort_array(F.collect_list("tag")).alias("basket"))
        baskets = cut.groupBy("basket").agg(F.sum("weight").alias("weight"))
    firsts = baskets.where(F.size("basket") > 1).select("weight", "basket", F.posexplode("basket").alias("at", "tag_a"))
    rows = firsts.select("weight", "tag_a", F.explode(F.slice("basket", F.col("at") + 2, F.size("basket"))).alias("tag_b"))
    pairs = rows.groupBy("tag_a", "tag_b").agg(F.sum("weight").alias("notes_ab")).where(F.col("notes_ab") >= support)
    for side, other in (("a", "b"), ("b", "a")):
        own = counts.select(F.col("tag").alias(f"tag_{side}"), F.col("notes").alias(f"notes_{side}"))
        if few:
            pairs = pairs.join(F.broadcast(own), f"tag_{side}")
        else:
            spread = own.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            pairs = pairs.withColumn("__salt", F.pmod(F.xxhash64(f"tag_{other}"), F.lit(SALTS)).cast("int")).join(spread, [f"tag_{side}", "__salt"]).drop("__salt")
    a, b, ab, total = F.col("notes_a"), F.col("notes_b"), F.col("notes_ab"), F.lit(n)
    return pairs.select(
        "tag_a", "tag_b", "notes_a", "notes_b", "notes_ab", total.alias("n_notes"),
        (ab * total / (a * b)).alias("lift"),
        F.when(a > ab, (a / total) * (1 - b / total) / ((a - ab) / total)).alias("conviction"),
    )


def found(notes: DataFrame) -> DataFrame:
    """p5_found: pairs in at least five notes, a thousandth of the notes, and four times as many as chance gives."""
    return (
        tag_pairs(notes, min_notes=5, min_share=0.001)
        .where("notes_ab >= 5 and 1000 * notes_ab >= n_notes and notes_ab * n_notes >= 4 * notes_a * notes_b")
        .select("tag_a", "tag_b")
    )
