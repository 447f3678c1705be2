"""p8: evaluation texts inside training documents, by rare seeds, a bound on common pairs of words and local alignment."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.terms import sliced

#: A word is a maximal run of letters or digits; raised, circled and fraction numbers are signs.
WORD = re.compile(r"[^\W_²³¹¼-¾⁰-₉⅐-⅟①-⒛⓪-⓿❶-➓]+")
SEED = 4
MATCH, MISMATCH, GAP = 2, -2, -2
#: Numbers that the bound and the alignments hold at a time.
AT_ONCE = 1 << 21


def words(text: str | None) -> list[str]:
    """Words of a text without case; null and empty texts have none."""
    return WORD.findall((text or "").casefold())


class Items:
    """The evaluation items as word ids, with their seeds.

    Built on the driver from a checked number of items, sent to the tasks once.
    """

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        texts = [words(t) for _, t in rows]
        self.vocabulary = sorted({w for t in texts for w in t})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        self.words = [np.array([number[w] for w in t], dtype=np.int64) for t in texts]
        self.seeds = {n: self._index(n) for n in range(1, SEED + 1)}

    def _index(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct runs of ``n`` words, where the items of each begin, and the items.

        Under ``SEED`` words only items that are so short as a whole are in it.
        """
        own = [(k, grams(t, len(self.vocabulary), n)) for k, t in enumerate(self.words) if (len(t) == n or n == SEED) and len(t) >= n]
        runs = np.concatenate([g for _, g in own]) if own else np.zeros(0, np.int64)
        items = np.concatenate([np.full(len(g), k, np.int64) for k, g in own]) if own else np.zeros(0, np.int64)
        order = np.lexsort((items, runs))
        distinct, begins = np.unique(runs[order], return_index=True)
        return distinct, np.append(begins, len(order)), items[order]

    @property
    def grams(self) -> np.ndarray:
        """The distinct seeds."""
        return self.seeds[SEED][0]

    def holders(self, found: np.ndarray, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """For each run found, by its number, the items that have it: two arrays, place and item."""
        distinct, begins, items = self.seeds[n]
        slot = np.searchsorted(distinct, found)
        sizes = begins[slot + 1] - begins[slot]
        place = np.repeat(np.arange(len(found)), sizes)
        inner = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return place, items[begins[slot][place] + inner]

    def groups(self, share: float) -> list[Shared]:
        """The items that have a seed, by length: of one group, the longest has under four times the words of the shortest."""
        by: dict[int, list[int]] = defaultdict(list)
        for k, t in enumerate(self.words):
            if len(t) >= SEED:
                by[(len(t).bit_length() - 1) // 2].append(k)
        return [Shared(by[c], self.words, share) for c in sorted(by)]


class Shared:
    """Items of like length by their pairs of neighbouring words; the k-th use of a pair in a text is a pair of its own.

    An alignment that reaches ``share`` of an item of n words has M matches and E others with
    2M - 2E >= 2 * share * n. The matches form at most E + 1 runs, so at least M - E - 1 >=
    share * n - 1 pairs are common, and it spans at most M + E <= (2 - share) * n words of the
    document. Of ``width`` words or fewer, any stretch stands whole in one of the pieces of twice
    that width that begin every ``width`` words.
    """

    def __init__(self, members: list[int], words: list[np.ndarray], share: float):
        self.members = np.array(members, np.int64)
        lengths = np.array([len(words[k]) for k in members], np.int64)
        self.least = np.ceil(share * lengths - 1e-9).astype(np.int64) * MATCH
        self.needed = self.least // MATCH - 1
        self.width = int(np.ceil((2 - share) * lengths.max()))
        flat, item = np.concatenate([words[k] for k in members]), np.repeat(np.arange(len(members)), lengths)
        self.padded = np.full((len(members), int(lengths.max())), -2, np.int32)
        self.padded[item, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        inside = item[:-1] == item[1:]
        first, second, item = flat[:-1][inside], flat[1:][inside], item[:-1][inside]
        self.base = int(flat.max()) + 1
        self.pairs = np.unique(first * self.base + second)
        keys = numbered(np.searchsorted(self.pairs, first * self.base + second), item)
        order = np.argsort(keys, kind="stable")
        self.keys, self.firsts, self.sizes = np.unique(keys[order], return_index=True, return_counts=True)
        self.items = item[order]

    def pairs_of(self, ids: np.ndarray) -> np.ndarray:
        """For each word but the last, the number of the pair with the next word; -1 if no item has it."""
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0) & (ids[1:] < self.base), ids[:-1] * self.base + ids[1:], -1)
        slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[slot] == pair, slot, -1)


def numbered(ids: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """A number for each word or pair that also tells which use in its group it is."""
    order = np.lexsort((ids, groups))
    i, g = ids[order], groups[order]
    begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (g[1:] != g[:-1])])) if len(i) else np.zeros(0, np.int64)
    use = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
    out = np.empty(len(i), np.int64)
    out[order] = use << 32 | i
    return out


def grams(ids: np.ndarray, base: int, n: int = SEED) -> np.ndarray:
    """A number for each run of ``n`` word ids; -1 where a word is in no item."""
    if len(ids) < n:
        return np.zeros(0, np.int64)
    parts = [ids[k : len(ids) - n + 1 + k] for k in range(n)]
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out * np.uint64(base + 1) + p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = (out >> np.uint64(1)).astype(np.int64)
    out[np.minimum.reduce(parts) < 0] = -1
    return out


def coded(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts of a batch (-1: in no item) and the row of each word."""
    tokens = [words(t) for t in texts.to_pylist()]
    rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    flat = pa.array([w for t in tokens for w in t], pa.string())
    ids = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, rows


def hits(ids: np.ndarray, rows: np.ndarray, items: Items, n: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the batch's words where a run of ``n`` words of an item stands, and the runs."""
    g = grams(ids, len(items.vocabulary), n)
    known = items.seeds[n][0]
    if not len(g) or not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot = np.minimum(np.searchsorted(known, g), len(known) - 1)
    at = np.flatnonzero((rows[: len(g)] == rows[n - 1 :]) & (g >= 0) & (known[slot] == g))
    return at, g[at]


def count_seeds(documents: DataFrame, items: Items) -> dict[int, int]:
    """How often each seed of the items stands in the corpus; as many numbers as the items have seeds."""
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        vocabulary, counts = pa.array(own.vocabulary, pa.string()), Counter()
        for batch in sliced(batches, "text"):
            _, seeds = hits(*coded(batch.column("text"), vocabulary), own)
            values, n = np.unique(seeds, return_counts=True)
            counts.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["seed", "n"])

    rows = documents.select("text").mapInArrow(run, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    return {r["seed"]: r["n"] for r in rows}


def rare_seeds(items: Items, counts: dict[int, int], least: int) -> np.ndarray:
    """The seeds to search for: the rarest of every window of ``least`` words, of equal ones the last.

    So every passage of ``least`` words of an item holds one of its chosen seeds. Edited copies may
    hold none, as what an edit made of a window is rarer than the item's own words; see ``edited``.
    """
    chosen: set[int] = set()
    for t in items.words:
        g = grams(t, len(items.vocabulary)).tolist()
        span = max(1, least - SEED + 1)
        for a in range(max(1, len(g) - span + 1)):
            window = g[a : a + span]
            if window:
                chosen.add(min(reversed(window), key=lambda s: counts.get(s, 0)))
    return np.array(sorted(chosen), dtype=np.int64)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: score of the best local alignment, its end in the passage, and
    the longest run of equal consecutive words of the two anywhere.

    Gap costs inside a row are settled by a running maximum, so each item word is one vector step.
    """
    n = len(passage)
    previous, runs = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    slope = -GAP * np.arange(n + 1)
    score, end, longest = 0.0, 0, 0
    for w in item:
        equal = passage == w
        now = np.zeros(n + 1)
        now[1:] = np.maximum(0, np.maximum(previous[:-1] + np.where(equal, MATCH, MISMATCH), previous[1:] + GAP))
        now = np.maximum.accumulate(now + slope) - slope
        fresh = np.zeros(n + 1, np.int64)
        fresh[1:] = np.where(equal, runs[:-1] + 1, 0)
        previous, runs = now, fresh
        longest = max(longest, int(fresh.max()))
        if now.max() > score:
            score, end = float(now.max()), int(now.argmax())
    return int(score), end, longest


def align_all(items: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """The scores of ``align`` for rows of items (filled up with -2) and of passages (with -1)."""
    previous = np.zeros((len(items), passages.shape[1] + 1), np.int32)
    slope = -GAP * np.arange(passages.shape[1] + 1, dtype=np.int32)
    score = np.zeros(len(items), np.int32)
    for w in items.T:
        now = np.zeros_like(previous)
        np.maximum(previous[:, :-1] + np.where(passages == w[:, None], np.int32(MATCH), np.int32(MISMATCH)), previous[:, 1:] + np.int32(GAP), out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now += slope
        np.maximum.accumulate(now, axis=1, out=now)
        now -= slope
        np.maximum(score, now.max(axis=1), out=score)
        previous = now
    return score


def edited(ids: np.ndarray, begins: np.ndarray, group: Shared, share: float) -> set[tuple[int, int]]:
    """``(row, item)`` of all alignments that reach ``share``: pieces that hold enough pairs of words of an item are aligned."""
    lengths = np.diff(begins)
    pieces = np.maximum(1, -(-lengths // group.width) - 1)
    row = np.repeat(np.arange(len(lengths)), pieces)
    start = begins[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * group.width
    size = np.minimum(start + 2 * group.width, begins[row + 1]) - start
    pairs = group.pairs_of(ids)
    spots = np.flatnonzero(pairs >= 0)
    lo = np.searchsorted(spots, start)
    hi = np.maximum(lo, np.searchsorted(spots, start + size - 1))
    piece = np.repeat(np.arange(len(row)), hi - lo)
    at = spots[np.arange(len(piece)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[piece]]
    keys = numbered(pairs[at], piece)
    slot = np.minimum(np.searchsorted(group.keys, keys), len(group.keys) - 1)
    same = group.keys[slot] == keys
    slot, piece = slot[same], piece[same]
    held, n = np.bincount(piece, weights=group.sizes[slot], minlength=len(row)), len(group.members)
    part = (np.cumsum(held + n) // AT_ONCE).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(row)]
    out: set[tuple[int, int]] = set()
    for a, b in zip(cuts, cuts[1:], strict=False):
        lo, hi = np.searchsorted(piece, [a, b])
        sizes = group.sizes[slot[lo:hi]]
        which = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(group.firsts[slot[lo:hi]], sizes)
        shared = np.bincount((np.repeat(piece[lo:hi], sizes) - a) * n + group.items[which], minlength=(b - a) * n).reshape(b - a, n)
        p, k = np.nonzero(shared >= group.needed)
        step = max(1, AT_ONCE // 16 // (2 * group.width + 1))
        for c in range(0, len(p), step):
            q, i = p[c : c + step] + a, k[c : c + step]
            spots = start[q][:, None] + np.arange(size[q].max())
            inside = spots < (start[q] + size[q])[:, None]
            passages = np.where(inside, ids[np.where(inside, spots, 0)], -1)
            good = align_all(group.padded[i], passages) >= group.least[i]
            out.update(zip(row[q[good]].tolist(), group.members[i[good]].tolist(), strict=True))
    return out


def _leaks(shared: object, seeds: np.ndarray, least: int, min_share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        vocabulary = pa.array(items.vocabulary, pa.string())
        groups = items.groups(min_share) if min_share <= 1 else []
        lengths = [n for n in range(1, SEED) if len(items.seeds[n][0])] if min_share <= 1 else []
        for batch in sliced(batches, "text"):
            ids, rows = coded(batch.column("text"), vocabulary)
            begins = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            at, found = hits(ids, rows, items)
            rare = np.isin(found, seeds)
            place, held = items.holders(found[rare])
            pairs = set(zip(rows[at[rare][place]].tolist(), held.tolist(), strict=True))
            for n in lengths:
                spots, found = hits(ids, rows, items, n)
                place, held = items.holders(found, n)
                pairs |= set(zip(rows[spots[place]].tolist(), held.tolist(), strict=True))
            for group in groups:
                pairs |= edited(ids, begins, group, min_share)
            out = []
            for row, k in sorted(pairs):
                item = items.words[k]
                score, _, longest = align(item, ids[begins[row] : begins[row + 1]])
                if longest >= least or score >= min_share * MATCH * len(item) and (longest >= min(SEED, len(item)) or len(item) >= least):
                    out.append((batch.column("doc_id")[row].as_py(), items.ids[k], len(item), score, longest))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                ["doc_id", "item_id", "item_words", "score", "longest_run"],
            )

    return run


def leaks(documents: DataFrame, eval_items: DataFrame, least: int = 12, min_share: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """``(doc_id, item_id, item_words, score, longest_run, share)`` of documents that hold an item.

    A pair comes out if it shares ``least`` consecutive words, or if its best alignment (Smith-
    Waterman) reaches ``min_share`` of the score of the whole item, as edited copies do; an item of
    fewer than ``least`` words must share a seed as well, and one shorter than a seed must stand in
    the document whole. No such pair is missed: for the first, of every window of ``least`` item
    words the n-gram rarest in the corpus is a seed; for the second, every piece of a document that
    holds as many of an item's pairs of words as such an alignment needs is aligned. ``score`` and
    ``longest_run`` are those of the whole document.

    The items are a stated query set, taken in blocks of about ``block_bytes`` of text (and no less
    than one item), each searched in all documents and small enough to send to every task. Nothing
    but counts of a block's seeds and results leaves the documents' partitions. Null and empty texts
    match nothing; repeated rows of a document give one row.
    """
    own = documents.select("doc_id", "text").where(F.length("text") > 0)
    items = eval_items.select("item_id", "text").where("item_id is not null").dropDuplicates(["item_id"])
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["bytes"] // block_bytes)) if size["n"] else 0
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).orderBy("item_id").collect()
        if not rows:
            continue
        held = Items([(r["item_id"], r["text"]) for r in rows])
        seeds = rare_seeds(held, count_seeds(own, held), least)
        shared = own.sparkSession.sparkContext.broadcast(held)
        part = own.mapInArrow(_leaks(shared, seeds, least, min_share), "doc_id bigint, item_id bigint, item_words int, score int, longest_run int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return own.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, item_words int, score int, longest_run int, share double")
    share = F.col("score") / (MATCH * F.col("item_words"))
    return out.withColumn("share", share).where((F.col("longest_run") >= least) | (F.col("share") >= min_share)).groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("item_words", "score", "longest_run", "share")))


def found(documents: DataFrame, eval_items: DataFrame, least: int = 12) -> DataFrame:
    """p8_found: documents with at least 12 consecutive words of an item; no share is asked for, as none is over 1."""
    return leaks(documents, eval_items, least, min_share=2).where(F.col("longest_run") >= least).select("doc_id", "item_id")
