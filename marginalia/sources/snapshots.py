"""The index and its references as versioned tables, and the settings."""

from __future__ import annotations

import json
import re
import time
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.query import Options
from marginalia.functions.text import Analysis, tokens
from marginalia.operators.index import bucket_of, posted_fields
from marginalia.operators.search import RESULTS, ranked, search_index
from marginalia.sources.tables import materialize

VERSION = 3


class Store:
    """Tables of one corpus under ``root/corpus/v<version>``.

    A manifest names the current snapshot folder of every table. A save writes new folders and then
    a new manifest, under a name of its own that is renamed when it is whole, so readers see all old
    tables or all new ones and a job that is lost leaves the old. The folders of the last ``retain``
    manifests stay, so that a query planned on the one before can end. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, corpus: str, version: int = VERSION, retain: int = 2):
        self.spark, self.home, self.retain = spark, f"{root.rstrip('/')}/{corpus}", max(1, retain)
        self.root = f"{self.home}/v{version}"
        self.version = version
        jvm = spark.sparkContext._jvm
        self._path, self._text = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        home = self._path(f"{self.root}/manifests")
        if not self._fs.exists(home):
            return []
        return sorted(n for s in self._fs.listStatus(home) if (n := s.getPath().getName()).isdigit())

    def _read(self, manifest: str) -> dict[str, str]:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{manifest}"))
        try:
            return json.loads(self._text.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self) -> dict[str, str]:
        """The folder of each table's current snapshot; empty before the first save."""
        known = self._manifests()
        return self._read(known[-1]) if known else {}

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None, merged: int = -1) -> str:
        """Writes a snapshot that no manifest names yet; its folder.

        ``merged`` is the number of the last delta that it holds; those deltas count no more once the
        snapshot is current, even if their removal is broken off.
        """
        folder = f"{name}-{time.time_ns()}-{merged}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, folders: dict[str, str]) -> None:
        """Makes snapshots the current ones, all at once, and drops those that no kept manifest names."""
        known = self._manifests()
        entries = (self._read(known[-1]) if known else {}) | folders
        target = f"{int(known[-1]) + 1 if known else 0:012d}"
        part = self._path(f"{self.root}/manifests/.{target}-{time.time_ns()}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(entries), "utf-8"))
        out.close()
        place = self._path(f"{self.root}/manifests/{target}")
        if self._fs.exists(place) or not self._fs.rename(part, place):
            self._fs.delete(part, False)
            raise RuntimeError("another writer saved at the same time")
        old, kept = known[: len(known) + 1 - self.retain], known[len(known) + 1 - self.retain :]
        in_use = set(entries.values()).union(*(self._read(m).values() for m in kept))
        for m in old:
            for folder in set(self._read(m).values()) - in_use:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            self._fs.delete(self._path(f"{self.root}/manifests/{m}"), False)

    def save(self, name: str, df: DataFrame, partition_by: list[str] | None = None, merged: int = -1) -> None:
        """Writes a table as a new snapshot and makes it the current one."""
        self.commit({name: self.write(name, df, partition_by, merged)})

    def current(self, name: str) -> str | None:
        """The folder of the current snapshot, if there is one."""
        return self.manifest().get(name)

    def load(self, name: str) -> DataFrame | None:
        """The current snapshot of a table; None if it is absent, so that the caller rebuilds."""
        folder = self.current(name)
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def add_delta(self, name: str, df: DataFrame, number: int) -> None:
        """Writes rows beside a table; the same number again replaces them, so a replay changes nothing."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}-deltas/{number:012d}")

    def deltas(self, name: str) -> list[str]:
        """The folders of a table's finished deltas that its snapshot doesn't hold, oldest first."""
        folder = self.current(name)
        merged = int(re.search(r"-(-?\d+)$", folder).group(1)) if folder else -1
        home = self._path(f"{self.root}/{name}-deltas")
        if not self._fs.exists(home):
            return []
        folders = [s.getPath() for s in self._fs.listStatus(home)]
        return sorted(f.toString() for f in folders if int(f.getName()) > merged and self._fs.exists(self._path(f, "_SUCCESS")))

    def load_with_deltas(self, name: str) -> DataFrame | None:
        """The current snapshot and the deltas written since, unmerged; None if there is neither."""
        base, parts = self.load(name), self.deltas(name)
        if not parts:
            return base
        new = self.spark.read.parquet(*parts)
        return new if base is None else base.unionByName(new)

    def drop_deltas(self, folders: list[str]) -> None:
        for f in folders:
            self._fs.delete(self._path(f), True)

    def drop_stale_versions(self) -> list[str]:
        """Deletes the tables of other versions of this corpus; their names."""
        path = self._path(self.home)
        if not self._fs.exists(path):
            return []
        stale = [s.getPath() for s in self._fs.listStatus(path) if s.getPath().getName() != f"v{self.version}"]
        names = [p.getName() for p in stale]
        for p in stale:
            self._fs.delete(p, True)
        return sorted(names)


#: The tables of an index. ``postings`` hold the field's length with each term, so that a query needs
#: no other large table; ``vocabulary`` has each term's document frequencies, ``totals`` the sums of
#: documents and lengths by field, both as amounts that deltas add to; ``gone`` has the notes that a
#: refresh took out, with its number.
TABLES = {"postings": ["bucket"], "vocabulary": ["bucket"], "lengths": None, "documents": None, "totals": None}


def index_rows(docs: DataFrame, number: int, analysis: Analysis = Analysis()) -> dict[str, DataFrame]:
    """The rows of all index tables of some documents, made by the refresh of that number."""
    own = materialize(posted_fields(docs, analysis=analysis))
    found = own.select("note_id", "field", "length", F.explode("terms").alias("t")).select("note_id", "field", "t.term", "t.tf", "length")
    lengths = own.select("note_id", "field", "length")
    rows = {
        "postings": found.withColumn("bucket", bucket_of(F.col("term"))),
        "vocabulary": found.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df")).withColumn("bucket", bucket_of(F.col("term"))),
        "lengths": lengths, "documents": docs.select("note_id", "vault", "path", "tags"), "totals": totals_of(lengths),
    }
    return {name: df.withColumn("made", F.lit(number)) for name, df in rows.items()}


def totals_of(lengths: DataFrame, sign: int = 1) -> DataFrame:
    """``(field, documents, length)``: how many documents and tokens come in, or go out."""
    return lengths.groupBy("field").agg((sign * F.count(F.lit(1))).alias("documents"), (sign * F.coalesce(F.sum("length"), F.lit(0))).alias("length"))


def _ordered(name: str, rows: DataFrame) -> DataFrame:
    """A table as it is best read: postings and vocabulary by bucket and term, so that a term's rows
    lie together and small buckets are one file each; the others by note."""
    if TABLES[name]:
        return rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    return rows.sort("note_id") if name == "documents" else rows


def save_index(store: Store, docs: DataFrame, refs: DataFrame, analysis: Analysis = Analysis()) -> None:
    """Builds all index tables of the documents anew, with the references that they stand for.

    They become current together, with the analysis that the terms were made by.
    """
    last = last_delta(store)
    parts = [d for name in [*TABLES, "gone"] for d in store.deltas(name)]
    folders = {name: store.write(name, _ordered(name, df), TABLES[name], last) for name, df in index_rows(docs, last, analysis).items()}
    folders["gone"] = store.write("gone", docs.sparkSession.createDataFrame([], "note_id bigint, made int"), merged=last)
    folders["refs_lexical"] = store.write("refs_lexical", _refs_rows(refs, last), merged=last)
    parts += store.deltas("refs_lexical")
    store.commit(folders | {"analysis": analysis.key()})
    store.drop_deltas(parts)


def last_delta(store: Store) -> int:
    """The number of the last refresh, 0 if there was none."""
    folder = store.current("gone")
    merged = int(re.search(r"-(-?\d+)$", folder).group(1)) if folder else 0
    return max([merged, 0, *(int(d.rstrip("/").rpartition("/")[2]) for d in store.deltas("gone"))])


def refresh_index(store: Store, gone: DataFrame, new: DataFrame, compact_every: int = 20, analysis: Analysis = Analysis()) -> None:
    """Takes notes out of the index and puts new ones in.

    The new rows are written as deltas and the notes taken out beside them; rows of such a note made
    before are dead. Of the old tables only the narrow one of field lengths is read, for the totals.
    Every so many refreshes all is merged into new snapshots. The list of notes taken out is written
    last: a refresh broken off before changes nothing and is made anew under the same number.
    """
    number = last_delta(store) + 1
    rows = index_rows(new, number, analysis)
    out = totals_of(live(store, "lengths").join(gone.select("note_id").distinct(), "note_id", "left_semi"), -1)
    rows["totals"] = rows["totals"].unionByName(out.withColumn("made", F.lit(number)))
    for name, df in rows.items():
        store.add_delta(name, df, number)
    store.add_delta("gone", gone.select("note_id", F.lit(number).alias("made")), number)
    if number % compact_every == 0:
        compact_index(store)


def compact_index(store: Store) -> None:
    """Merges all deltas into new snapshots without the dead rows."""
    number = last_delta(store)
    parts = [d for name in [*TABLES, "gone"] for d in store.deltas(name)]
    kept = {name: live(store, name) for name in ("postings", "lengths", "documents")}
    made = F.lit(number).alias("made")
    kept["vocabulary"] = kept["postings"].groupBy("term", "field", "bucket").agg(F.count(F.lit(1)).alias("df")).select("term", "field", "df", "bucket", made)
    kept["totals"] = totals_of(kept["lengths"]).withColumn("made", F.lit(number))
    folders = {name: store.write(name, _ordered(name, kept[name]), partition_by, number) for name, partition_by in TABLES.items()}
    folders["gone"] = store.write("gone", store.load_with_deltas("gone").limit(0), merged=number)
    store.commit(folders)
    store.drop_deltas(parts)


def _refs_rows(refs: DataFrame, number: int) -> DataFrame:
    """References as they are stored: a later row of a path replaces an earlier, ``removed`` ones end it."""
    time_of = F.col("update_time") if "update_time" in refs.columns else F.lit(None)
    removed = F.col("removed") if "removed" in refs.columns else F.lit(False)
    return refs.select("path", time_of.cast("timestamp").alias("update_time"), removed.alias("removed"), F.lit(number).alias("made"))


def save_refs(store: Store, engine: str, refs: DataFrame) -> None:
    """Replaces all references of an engine, ``lexical`` or ``semantic``."""
    name, number = f"refs_{engine}", last_refs(store, engine)
    parts = store.deltas(name)
    store.save(name, _refs_rows(refs, number), merged=number)
    store.drop_deltas(parts)


def last_refs(store: Store, engine: str) -> int:
    """The number of the last change of an engine's references."""
    folder, parts = store.current(f"refs_{engine}"), store.deltas(f"refs_{engine}")
    return max([0, *(int(d.rstrip("/").rpartition("/")[2]) for d in parts), *([int(re.search(r"-(-?\d+)$", folder).group(1))] if folder else [])])


def change_refs(store: Store, engine: str, refs: DataFrame, compact_every: int = 20) -> None:
    """Adds, replaces and (``removed``) ends references of the paths given, at the cost of these alone."""
    number = last_refs(store, engine) + 1
    store.add_delta(f"refs_{engine}", _refs_rows(refs, number), number)
    if number % compact_every == 0:
        save_refs(store, engine, load_refs(store, engine))


def load_refs(store: Store, engine: str) -> DataFrame | None:
    """``(path, update_time)``: the references of an engine as they stand; None if none were saved."""
    rows = store.load_with_deltas(f"refs_{engine}")
    if rows is None:
        return None
    last = rows.groupBy("path").agg(F.max(F.struct("made", "update_time", "removed")).alias("last"))
    return last.where("not last.removed").select("path", "last.update_time")


def any_gone(store: Store) -> bool:
    """Whether notes were taken out since the last snapshots, so that frequencies must be counted anew."""
    return bool(store.load_with_deltas("gone").head(1))


def alive(store: Store, rows: DataFrame) -> DataFrame:
    """The rows of notes that weren't taken out after they were made, and of no unfinished refresh."""
    out = store.load_with_deltas("gone").groupBy("note_id").agg(F.max("made").alias("__out"))
    kept = rows.where(F.col("made") <= last_delta(store)).join(out, "note_id", "left")
    return kept.where(F.col("__out").isNull() | (F.col("made") >= F.col("__out"))).drop("__out")


def live(store: Store, name: str) -> DataFrame:
    """A table of notes of the index as it stands."""
    return alive(store, store.load_with_deltas(name))


def finished(store: Store, name: str) -> DataFrame:
    """A table of amounts without those of an unfinished refresh."""
    return store.load_with_deltas(name).where(F.col("made") <= last_delta(store))


def search_saved(store: Store, raw: str, limit: int = RESULTS, options: Options = Options(), every_term: bool = True, analysis: Analysis = Analysis()) -> DataFrame:
    """``(note_id, path, rank, score, query_terms, matched_terms)``: ranked search on the saved tables.

    A term is found through the vocabulary, then its postings alone are read, by bucket and term.
    While no note was taken out since the snapshots, its frequencies come from the vocabulary too.
    """
    gone = any_gone(store)
    top = search_index(
        finished(store, "postings"), finished(store, "vocabulary"), finished(store, "totals"), raw, limit, options, every_term,
        alive=(lambda rows: alive(store, rows)) if gone else None, analysis=analysis,
    )
    ids = [r["note_id"] for r in top.select("note_id").collect()]  # at most the limit
    paths = live(store, "documents").where(F.col("note_id").isin(ids)).select("note_id", "path")
    return ranked(top.join(F.broadcast(paths), "note_id"))


def token_count(df: DataFrame, text: str = "content") -> DataFrame:
    """``(documents, tokens)`` of a column of texts."""
    return df.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(F.size(tokens(F.col(text)))), F.lit(0)).alias("tokens"))


@dataclass
class SearchSettings:
    prefix: bool = True
    fuzzy: bool = True
    case_sensitive: bool = False
    extensions: list[str] = field(default_factory=lambda: ["md"])
    excluded: list[str] = field(default_factory=list)


@dataclass
class Settings:
    """What a user may set; unknown keys of a file are ignored."""

    search: SearchSettings = field(default_factory=SearchSettings)
    results: int = 30
    stop_words_en: bool = True
    stop_words_zh: bool = True
    semantic: bool = False

    def analysis(self, en: list[str] | None = None, zh: list[str] | None = None) -> Analysis:
        """How texts become terms under these settings; with other lists of stop words, if given."""
        default = Analysis()
        return Analysis(
            self.search.case_sensitive,
            tuple(default.stop_words_en if en is None else en) if self.stop_words_en else (),
            tuple(default.stop_words_zh if zh is None else zh) if self.stop_words_zh else (),
        )


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """A nested record with another laid over it; arrays are replaced."""
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def _build(kind: type, values: dict[str, Any]) -> Any:
    known = {f.name: f for f in fields(kind)}
    default = kind()
    return kind(**{k: _build(type(getattr(default, k)), v) if is_dataclass(getattr(default, k)) else v for k, v in values.items() if k in known})


def load_settings(path: str | None) -> Settings:
    """The defaults with a JSON file laid over them; a missing file leaves the defaults."""
    stored: dict[str, Any] = {}
    if path:
        try:
            with open(path, encoding="utf-8") as f:
                stored = json.load(f)
        except FileNotFoundError:
            pass
    return _build(Settings, merge(asdict(Settings()), stored))


def save_settings(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, ensure_ascii=False, indent=1)
