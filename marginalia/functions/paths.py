"""Functions of file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions by the kind of view that shows them.
VIEW_TYPES = {
    "markdown": ["md", "txt", "html"],
    "pdf": ["pdf"],
    "canvas": ["canvas"],
    "image": ["jpg", "jpeg", "png", "gif", "svg", "webp"],
    "audio": ["mp3", "wav", "flac", "m4a"],
    "video": ["mp4", "webm", "mov"],
}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def basename(path: Column) -> Column:
    """The file's name without its last extension; a name that begins with its only dot stays whole."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension without its dot, empty if there is none."""
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def folder(path: Column) -> Column:
    """The folder with a slash at its end, ``./`` for the root."""
    above = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.when(above.isin("", "/"), "./").otherwise(above)


def view_type(path: Column) -> Column:
    """The kind of view of a file, ``unsupported`` if none has its extension."""
    out = F.lit("unsupported")
    for kind, extensions in VIEW_TYPES.items():
        out = F.when(extension(path).isin(*extensions), kind).otherwise(out)
    return out


def is_excluded(path: Column, excluded: list[str]) -> Column:
    """Whether one of the paths is the path or a folder above it; ``a/b`` doesn't exclude ``a/bc``."""
    if not excluded:
        return F.lit(False)
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.exists(above, lambda p: p.isin(*[e.rstrip("/") for e in excluded]))


def is_indexable(path: Column, extensions: tuple[str, ...] = ("md",), excluded: list[str] | None = None, ignored: list[str] | None = None) -> Column:
    """A file, not a folder (whose path ends in a slash), of an allowed extension (case counts), no drawing,
    not excluded, not ignored by a host pattern."""
    keep = ~path.endswith("/") & extension(path).isin(*extensions) & ~F.contains(path, F.lit("excalidraw.md")) & ~is_excluded(path, excluded or [])
    for pattern in ignored or []:
        keep = keep & ~path.rlike(pattern)
    return keep


def suggests(path: Column, query: str) -> Column:
    """Whether a path holds the query anywhere, whatever its case."""
    return F.contains(F.lower(path), F.lit(query.lower()))


def parse_extensions(text: Column) -> Column:
    """Extensions between white space, each without one leading dot."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda e: F.regexp_replace(e, r"^\.", "")), lambda e: e != "")


def url_domain(url: Column) -> Column:
    """The host of a URL with or without ``https://``; empty for ``http://``."""
    return F.when(url.startswith("http://"), "").otherwise(F.regexp_extract(url, r"^(?:https://)?([^/?#\s]+)", 1))
