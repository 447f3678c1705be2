"""p7: oversized texts cut into pieces at natural boundaries, with overlap."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.sources.tables import drop_repeats

#: Boundaries from strong to weak; a cut falls behind the match.
BOUNDARY = re.compile(
    r"""(?P<paragraph>\n[^\S\n]*\n\s*)
    | (?P<line>\n)
    | (?P<sentence>[.!?]["'”’)\]]*[^\S\n]+ | [。！？])
    | (?P<clause>[,;:][^\S\n]+ | [、，：；])
    | (?P<space>[^\S\n]+)""",
    re.VERBOSE,
)
STRENGTH = {"paragraph": 5, "line": 4, "sentence": 3, "clause": 2, "space": 1}


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind each natural boundary and their strengths."""
    found = [(m.end(), STRENGTH[m.lastgroup]) for m in BOUNDARY.finditer(text)]
    at = np.array([p for p, _ in found], dtype=np.int64)
    return at, np.array([s for _, s in found], dtype=np.int64)


def _whole(text: str, at: int, low: int) -> int:
    """The cut moved left off a combining mark, joiner or the middle of a CR LF, at least ``low``."""
    cut = at
    while cut > low and (
        unicodedata.category(text[cut]) in ("Mn", "Mc", "Me") or text[cut] in "‍️" or text[cut - 1] == "‍" or text[cut - 1 : cut + 1] == "\r\n"
    ):
        cut -= 1
    return cut if cut > low else at


def split_points(text: str, size: int, marks: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Cuts that leave stretches of at most ``size``: (position, strength), 0 for a hard cut.

    A stretch that is too long is cut at the strongest boundary in its middle half, of equal ones
    at the nearest to the midpoint; else at the strongest in the whole stretch; else in the middle.
    """
    at, strength = marks or boundaries(text)
    cuts, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= size:
            continue
        mid, quarter = (a + b) // 2, (b - a) // 4
        cut, kind = _whole(text, mid, a), 0
        for low, high in ((mid - quarter, mid + quarter), (a + 1, b - 1)):
            i, j = np.searchsorted(at, low, "left"), np.searchsorted(at, high, "right")
            if i < j:
                kind = int(strength[i:j].max())
                near = at[i:j][strength[i:j] == kind]
                cut = int(near[np.abs(near - mid).argmin()])
                break
        cuts.append((cut, kind))
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


def pieces(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """``(start, end, strength of the cut before it)`` of each piece, in code points.

    Every piece is at most ``limit`` long; from the second on it begins up to ``overlap`` before the
    end of the one before, at the first natural boundary in that range, or, if there is none, by
    exactly the overlap. Without the overlaps the pieces are the text.
    """
    if len(text) <= limit:
        return [(0, len(text), 5)]
    marks = boundaries(text)
    cuts, at = split_points(text, limit - overlap, marks), marks[0]
    ends = [c for c, _ in cuts] + [len(text)]
    out, start = [], 0
    for k, end in enumerate(ends):
        first = start
        if k and overlap:
            i, j = np.searchsorted(at, start - overlap, "left"), np.searchsorted(at, start, "left")
            first = int(at[i]) if i < j else _whole(text, max(0, start - overlap), 0)
            first = first if start - first <= overlap else start - overlap
        out.append((first, end, cuts[k - 1][1] if k else 5))
        start = end
    return out


def _unbounded(text: str, limit: int) -> bool:
    return re.search(rf"[^\s.!?。！？]{{{limit + 1}}}", text) is not None


def _cut(limit: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("content"), strict=True):
                text = text.as_py()
                kind = "unbounded" if _unbounded(text, limit) else "bounded"
                cuts = pieces(text, limit, overlap)
                n = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path.as_py()] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([c[0] for c in cuts], pa.int64()), pa.array([c[1] for c in cuts], pa.int64()),
                        pa.array([c[2] for c in cuts], pa.int32()), pa.array([kind] * n, pa.string()), pa.array([text[a:b] for a, b, _ in cuts], pa.string()),
                    ],
                    ["path", "piece_no", "start_at", "end_at", "cut", "kind", "text"],
                )

    return run


def split_long(df: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """The pieces of the contents over ``limit`` characters; shorter ones never reach Python."""
    schema = "path string, piece_no int, start_at bigint, end_at bigint, cut int, kind string, text string"
    return df.select("path", "content").where(F.length("content") > limit).mapInArrow(_cut(limit, overlap), schema)


def split_texts(df: DataFrame, version: list[Column], limit: int = 4000, overlap: int = 200) -> DataFrame:
    """``(path, piece_no, start_at, end_at, cut, kind, text)``: every content as pieces.

    ``cut`` is the strength of the boundary before the piece (5 paragraph, 4 line, 3 sentence,
    2 clause, 1 space, 0 none). A content within the limit is one piece of kind ``bounded``; null
    and empty contents give none. A path that comes again gives its pieces once (first by
    ``version``); rows without a path are all cut.
    """
    once = drop_repeats(df.select("path", "content", *version), "path", [F.col(c) for c in df.select(*version).columns] or [F.length("content")])
    short = once.where(F.length("content").between(1, limit)).select(
        "path", F.lit(0).alias("piece_no"), F.lit(0).cast("bigint").alias("start_at"), F.length("content").cast("bigint").alias("end_at"),
        F.lit(5).alias("cut"), F.lit("bounded").alias("kind"), F.col("content").alias("text"),
    )
    return short.unionByName(split_long(once, limit, overlap))


def all_pieces(notes: DataFrame, semantic: DataFrame) -> DataFrame:
    """The pieces of both tables, with ``table_name``."""
    a = split_texts(notes, [F.col("indexed_at")]).withColumn("table_name", F.lit("indexed_documents"))
    b = split_texts(semantic, []).withColumn("table_name", F.lit("semantic_documents"))
    return a.unionByName(b)


def rebuilt(notes: DataFrame, semantic: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """``(table_name, path, n_chars, several, within, overlapping, text)``: the digest of each content as its
    pieces give it back without their overlaps, and whether they keep limit and overlap."""
    before = F.lag("end_at", 1, 0).over(Window.partitionBy("table_name", "path").orderBy("piece_no"))
    own = all_pieces(notes, semantic).where("path is not null").withColumn("before", before)
    new = F.struct("piece_no", F.substr("text", F.col("before") - F.col("start_at") + 1).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["t"]), "")
    return own.groupBy("table_name", "path").agg(
        F.max("end_at").alias("n_chars"), (F.count(F.lit(1)) > 1).alias("several"), F.min(F.length("text") <= limit).alias("within"),
        F.min((F.col("piece_no") == 0) | (F.col("before") - F.col("start_at")).between(0, overlap)).alias("overlapping"), F.md5(whole.cast("binary")).alias("text"),
    )


def found(notes: DataFrame, semantic: DataFrame) -> DataFrame:
    """p7_found: the paths whose content came out in more than one piece, with their kind."""
    parts = [split_long(df).where("piece_no = 1").select(F.lit(name).alias("table_name"), "path", "kind") for name, df in (("indexed_documents", notes), ("semantic_documents", semantic))]
    return parts[0].unionByName(parts[1]).distinct()
