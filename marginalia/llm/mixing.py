"""p9: sources mixed to target shares of tokens, by fitting each source's budget exactly."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.terms import sliced
from marginalia.sources.tables import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: how a byte-level BPE vocabulary of this kind cuts text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
WINDOW = 16_384
#: Documents of one length to a bucket of the seeded order, the most buckets, and the lengths that are broadcast.
PER_BUCKET, MOST_BUCKETS, BROADCAST_LENGTHS = 256, 1 << 20, 200_000
#: Into how many parts the documents of one length are spread where there are more lengths than that.
SALTS = 32


def source_name(source: Column) -> Column:
    """A source's name without outer spaces and case, ``_`` as ``-``."""
    return F.lower(F.regexp_replace(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""), "_", "-"))


def _count(folder: str, vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokenizer = tiktoken.Encoding("corpus", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        for batch in sliced(batches, "text"):
            sizes = [len(tokenizer.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_sizes(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)`` with normalised sources; null texts have no tokens and no row."""
    return documents.where("text is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text").mapInArrow(_count(folder, vocabulary), "doc_id bigint, source string, tokens bigint")


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length to take so that their sum is the largest within ``budget``.

    Bounded knapsack over sums: for each length the fewest items of it that reach a sum are carried
    along, so that one vector step per length settles all multiplicities.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return take
    by = np.full(budget + 1, -1, np.int64)  # which length reached the sum first
    by[0] = len(lengths)
    used_of = np.zeros(budget + 1, np.int64)
    for k, (size, most) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
        if size <= 0 or size > budget or most <= 0:
            continue
        reached = by >= 0
        rows = -(-(budget + 1) // size)
        grid = np.zeros(rows * size, bool)
        grid[: budget + 1] = reached
        grid = grid.reshape(rows, size)
        step = np.where(grid, np.arange(rows)[:, None], -(10**9))
        used = np.arange(rows)[:, None] - np.maximum.accumulate(step, axis=0)
        new = (~grid & (used > 0) & (used <= most)).ravel()[: budget + 1]
        by[new] = k
        used_of[new] = used.ravel()[: budget + 1][new]
        if by[budget] >= 0:
            break
    total = int(np.flatnonzero(by >= 0).max())
    while total:
        k = int(by[total])
        take[k] += used_of[total]
        total -= int(used_of[total]) * int(lengths[k])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Numbers to take of each length for a sum as near below ``budget`` as can be had.

    Most of the budget is filled in proportion to the lengths' counts, the rest, down to a window
    of ``WINDOW`` tokens or twice the longest text, from the commonest lengths, and the window
    exactly by the bounded knapsack.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    have = int((lengths * counts).sum())
    if budget >= have:
        return counts.copy()
    window = max(WINDOW, 2 * int(lengths.max()))
    share = max(0, budget - window) / have
    take = np.floor(counts * share).astype(np.int64)
    rest = budget - int((take * lengths).sum())
    for k in np.argsort(-(counts - take) * lengths, kind="stable").tolist():
        if rest <= window:
            break
        if lengths[k] > 0:
            n = min(int(counts[k] - take[k]), (rest - window) // int(lengths[k]) + 1)
            take[k] += n
            rest -= n * int(lengths[k])
    left = counts - take
    return take + knapsack(lengths, np.minimum(left, rest // np.maximum(lengths, 1)), min(rest, budget))


def budgets(sizes: DataFrame, targets: DataFrame, meet_shares: bool = False) -> DataFrame:
    """``(source, target_share, max_repeats, have, budget, copies, rest, short, total)`` of each target.

    ``budget`` is the target's share of ``total``, the tokens of all documents. A source that can't
    reach it with ``max_repeats`` copies of everything is ``short`` and gives those copies; else it
    gives ``copies`` whole ones and ``rest`` tokens more. With ``meet_shares`` the total is cut to
    what the scarcest source that has documents allows, so that none is short and all these sources
    come in the proportions of their targets.
    """
    per_source = sizes.groupBy("source").agg(F.sum("tokens").alias("have"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    named = targets.where("source is not null").select(F.col("source").alias("target_name"), source_name(F.col("source")).alias("source"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    joined = named.join(per_source, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    if meet_shares:
        most = joined.where("have > 0 and target_share > 0").agg(F.min(F.col("have") * F.col("max_repeats") / F.col("target_share"))).first()[0]
        total = min(total, most) if most is not None else total
    wanted = joined.withColumn("total", F.lit(float(total))).withColumn("budget", F.floor(F.col("target_share") * F.col("total")))
    short = F.col("have") * F.col("max_repeats") < (F.col("budget") if meet_shares else F.col("target_share") * F.col("total"))
    full = wanted.withColumn("short", short)
    copies = F.when(F.col("short"), F.col("max_repeats").cast("bigint")).when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(F.lit(0))
    full = full.withColumn("copies", copies)
    return full.withColumn("rest", F.when(F.col("short"), F.lit(0)).otherwise(F.col("budget") - F.col("copies") * F.col("have")))


def _fit_source(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("tokens", kind="stable")
    take = fit(rows["tokens"].to_numpy(), rows["n"].to_numpy(), int(rows["rest"].iloc[0]))
    return pd.DataFrame({"source": rows["source"], "tokens": rows["tokens"], "n": rows["n"], "extra": take})


def fitted(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``(source, tokens, n, extra)``: how many of a source's ``n`` documents of a length come once more.

    Documents are counted by source and exact token length; each source's counts, as many rows as it
    has lengths, are fitted to its budget.
    """
    wanted = F.broadcast(plan.where("rest > 0").select("source", "rest"))  # a row a target
    counts = sizes.where("tokens > 0").join(wanted, "source").groupBy("source", "tokens", "rest").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.groupBy("source").applyInPandas(_fit_source, "source string, tokens bigint, n bigint, extra bigint"))


def _by_length(rows: DataFrame, lengths: DataFrame, few: bool) -> DataFrame:
    """Documents with what is known of their source's length; no length is hot, as many are spread."""
    if few:
        return rows.join(F.broadcast(lengths), ["source", "tokens"], "left")
    spread = lengths.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod("order", F.lit(SALTS)).cast("int")).join(spread, ["source", "tokens", "__salt"], "left").drop("__salt")


def mix(documents: DataFrame, targets: DataFrame, seed: int = 7, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, meet_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix ``(doc_id, source, tokens, repeats)`` and its report by source.

    Documents are counted by source and exact token length, and each source's counts fitted to its
    budget. The documents of a length are taken in the order of a seeded hash, which is cut into
    buckets of about ``PER_BUCKET`` documents: whole buckets are taken by their number, and only the
    documents of the one bucket in which a length's number ends are ranked. So a length or source
    that holds a third of all rows is no hot task.

    A document without text, source or target is in no mix but counts for the total, if it has
    text. Repeated doc_ids are documents of their own. A null max_repeats counts as one. Without
    ``meet_shares`` the total stays and a short source leaves the others over their shares; with it
    the total shrinks and the shares are met.
    """
    sizes = materialize(token_sizes(documents, folder, vocabulary))
    plan = materialize(budgets(sizes, targets, meet_shares))
    takes = fitted(sizes, plan)
    few = takes.limit(BROADCAST_LENGTHS + 1).count() <= BROADCAST_LENGTHS
    lengths = takes.withColumn("buckets", F.least(F.ceil(F.col("n") / PER_BUCKET), F.lit(MOST_BUCKETS)))
    order = F.xxhash64("doc_id", F.lit(seed))
    bucket = F.floor(F.shiftrightunsigned(F.col("order"), 44) * F.col("buckets") / (1 << 20))
    placed = sizes.join(F.broadcast(plan.select("source", "copies")), "source").withColumn("order", order)
    parts = _by_length(placed, lengths.where("extra > 0 and extra < n"), few).where("extra is not null").withColumn("bucket", bucket)
    of_length = Window.partitionBy("source", "tokens").orderBy("bucket")
    running = parts.groupBy("source", "tokens", "bucket", "extra").agg(F.count(F.lit(1)).alias("k")).withColumn("upto", F.sum("k").over(of_length))
    cuts = materialize(running.where("upto >= extra and upto - k < extra").select("source", "tokens", F.col("bucket").alias("edge"), (F.col("extra") - F.col("upto") + F.col("k")).alias("last")))
    known = _by_length(placed, lengths.join(cuts, ["source", "tokens"], "left"), few).withColumn("bucket", bucket)
    at = Window.partitionBy("source", "tokens").orderBy(F.col("order") < 0, "order", "doc_id")  # as numbers without a sign, as the buckets are
    edge = known.where("bucket = edge").withColumn("__at", F.row_number().over(at)).withColumn("more", (F.col("__at") <= F.col("last")).cast("int")).drop("__at")
    rest = known.where("edge is null or bucket <> edge").withColumn("more", F.coalesce((F.col("extra") == F.col("n")) | (F.col("bucket") < F.col("edge")), F.lit(False)).cast("int"))
    mixed = rest.unionByName(edge).withColumn("repeats", F.col("copies") + F.col("more")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed"), F.max("repeats").alias("most_repeats"), F.count(F.lit(1)).alias("documents"))
    report = plan.join(reached, "source", "left")
    whole = Window.partitionBy(F.lit(1))
    report = report.select(
        F.col("target_name").alias("source"), "target_share", "max_repeats", F.col("have").alias("tokens_available"), F.col("budget").alias("tokens_wanted"), F.coalesce("mixed", F.lit(0)).alias("tokens_mixed"),
        F.coalesce("documents", F.lit(0)).alias("documents_mixed"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "short",
    ).withColumn("share_reached", F.col("tokens_mixed") / F.sum("tokens_mixed").over(whole))
    return mixed, report


def found(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """p9_found: the sources whose fitted numbers stay under their share, checked on their exact sums."""
    sizes = materialize(token_sizes(documents))
    plan = materialize(budgets(sizes, targets))
    filled = fitted(sizes, plan).groupBy("source").agg(F.sum(F.col("tokens") * F.col("extra")).alias("filled"))
    reached = plan.join(filled, "source", "left").withColumn("reached", F.col("copies") * F.col("have") + F.coalesce("filled", F.lit(0)))
    return reached.where("reached < target_share * total").where("short").select(F.col("target_name").alias("source"))
