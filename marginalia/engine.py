"""The query API over one corpus: what a user of a note search calls."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.functions import paths
from marginalia.functions import query as Q
from marginalia.functions.text import Analysis
from marginalia.operators import corpus, maintain, search, semantic
from marginalia.operators import snippets as hit_snippets
from marginalia.sources import snapshots
from marginalia.sources.service import Collection
from marginalia.sources.snapshots import Settings, Store, save_index
from marginalia.sources.tables import materialize
from marginalia.streaming import changes


class NoteSearch:
    """Search over a table of notes, with a saved index that follows changes.

    ``store`` holds the index tables; without one every query works on the notes themselves.
    ``stop_words`` and ``stop_words_zh`` replace the built-in lists; ``ignored`` are the host's
    patterns of paths to leave out; ``embed`` turns a column of texts into vectors.
    """

    def __init__(
        self, spark: SparkSession, notes: DataFrame, settings: Settings | None = None, store: Store | None = None, ignored: list[str] | None = None,
        stop_words: list[str] | None = None, stop_words_zh: list[str] | None = None, embed: Callable[[Column], Column] = semantic.hashed_terms,
    ):
        self.spark, self.notes, self.store, self.ignored, self.embed = spark, notes, store, ignored, embed
        self.settings = settings or Settings()
        self.analysis: Analysis = self.settings.analysis(stop_words, stop_words_zh)
        own = self.settings.search
        self.documents = corpus.documents(notes, tuple(own.extensions), own.excluded, ignored)
        self.options = Q.Options(own.prefix, own.fuzzy)
        self.stream: StreamingQuery | None = None

    def _store(self) -> Store:
        if self.store is None:
            raise ValueError("no store was given")
        return self.store

    def sync(self) -> None:
        """Waits until the stream that was started has applied all changes that have arrived."""
        if self.stream is not None and self.stream.isActive:
            self.stream.processAllAvailable()

    def search(self, raw: str) -> DataFrame:
        """The best notes for a query, with rank, score, query terms and matched terms.

        The saved index answers if there is one made by the same analysis, after the changes that
        have arrived; else the notes themselves are searched.
        """
        if self.store is not None and self.store.manifest().get("analysis") == self.analysis.key():
            return self.search_saved(raw)
        return search.search(self.documents, raw, self.settings.results, self.options, analysis=self.analysis)

    def search_saved(self, raw: str) -> DataFrame:
        """The same by the saved index, which is built if it is absent or made by another analysis."""
        store = self._store()
        if store.manifest().get("analysis") != self.analysis.key():
            self.reindex()
        self.sync()
        return snapshots.search_saved(store, raw, self.settings.results, self.options, analysis=self.analysis)

    def hits_in(self, note_id: int, raw: str, matched: list[str], k: int = 30) -> DataFrame:
        """The best snippets of one note that a query found, for the terms worth looking for."""
        text = Q.parse(raw, self.options).text
        terms = Q.maximal_terms(Q.terms(text, self.analysis), matched)
        one = self.documents.where(F.col("note_id") == note_id)
        return hit_snippets.snippets(one, corpus.split_lines(one, "note_id", "content"), terms, text, k)

    def search_in_file(self, note_id: int, text: str) -> DataFrame:
        """The lines of one note that match a query as a subsequence, with their contexts."""
        return hit_snippets.search_in_file(self.documents, note_id, text, self.settings.results)

    def nearest(self, vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
        """The vectors nearest to that of a query."""
        return semantic.top_k(vectors, query, k)

    def search_semantic(self, text: str, k: int | None = None) -> DataFrame:
        """``(path, rank, similarity, items)``: the notes with the passages nearest to a text, best first.

        ``items`` are a note's passages among the results. A blank text has no results. The vectors
        are made if they are absent.
        """
        own = Collection(self._store())
        if not own.exists():
            self.reindex_semantic()
        return semantic.search_passages(own.rows(), text, self.embed, search.limit_of(k or self.settings.results))

    def reindex(self) -> None:
        """Builds the saved index and its references anew, and the vectors if the settings ask for them."""
        save_index(self._store(), self.documents, self.current_files(), self.analysis)
        if self.settings.semantic:
            self.reindex_semantic()

    def passages(self, documents: DataFrame | None = None) -> DataFrame:
        """``(path, chunk_no, text, embedding)`` of notes, by paragraphs."""
        return semantic.embedded(semantic.passages(self.documents if documents is None else documents), self.embed)

    def reindex_semantic(self) -> None:
        """Makes all vectors anew, with the references that they stand for."""
        Collection(self._store()).reindex(self.passages())
        snapshots.save_refs(self._store(), "semantic", self.current_files())

    def current_files(self) -> DataFrame:
        """``(path, update_time)`` of the indexable notes as they are."""
        own = self.settings.search
        keep = paths.is_indexable(F.col("path"), tuple(own.extensions), own.excluded, self.ignored)
        return self.notes.where(keep).groupBy("path").agg(F.max("indexed_at").alias("update_time"))

    def pending_changes(self, engine: str = "lexical") -> DataFrame:
        """``(path, op)`` that would bring what is saved up to the notes; everything if there is nothing."""
        refs = snapshots.load_refs(self.store, engine) if self.store else None
        return maintain.diff(self.current_files(), refs if refs is not None else self.current_files().limit(0))

    def refresh(self) -> int:
        """Applies pending changes to the saved index, at the cost of the changed notes.

        The references are saved last, so a refresh that was broken off is made again; they then are
        those of the notes as they are. Gives the number of changed paths.
        """
        store = self._store()
        if store.manifest().get("analysis") != self.analysis.key():
            self.reindex()
            return self.documents.count()
        ops = materialize(self.pending_changes())
        changed = ops.select("path").distinct()
        n = changed.count()
        if n:
            gone = snapshots.live(store, "documents").join(changed, "path", "left_semi").select("note_id").distinct()
            new = self.documents.join(ops.where("op = 'add'").select("path").distinct(), "path", "left_semi")
            snapshots.refresh_index(store, materialize(gone), new, analysis=self.analysis)
        self._follow_refs("lexical")
        return n

    def _follow_refs(self, engine: str, only: DataFrame | None = None) -> None:
        """Replaces the references that aren't those of the notes as they are, of all paths or of some."""
        then = snapshots.load_refs(self._store(), engine)
        then = (self.current_files().limit(0) if then is None else then).select("path", F.col("update_time").alias("__then"), F.lit(True).alias("__was"))
        both = self.current_files().withColumn("__is", F.lit(True)).join(then, "path", "full_outer")
        other = both.where("__is is null or __was is null or not (update_time <=> __then)").select("path", "update_time", F.col("__is").isNull().alias("removed"))
        other = materialize(other if only is None else other.join(only, "path", "left_semi"))
        if other.head(1):
            snapshots.change_refs(self._store(), engine, other)

    def refresh_semantic(self) -> int:
        """The same for the vectors: those of changed and gone notes go, those of changed and new ones come."""
        store = self._store()
        own = Collection(store)
        if not own.exists():
            self.reindex_semantic()
            return own.count()
        ops = materialize(self.pending_changes("semantic"))
        changed = ops.select("path").distinct()
        n = changed.count()
        if n:
            own.delete(ops.where("op = 'delete'").select("path").distinct())
            new = self.documents.join(ops.where("op = 'add'").select("path").distinct(), "path", "left_semi")
            own.add(self.passages(new))
        self._follow_refs("semantic")
        return n

    def apply(self, ops: DataFrame) -> None:
        """Applies what a batch of changes does, ``(vault, path, op, replace)``, to the saved index.

        Added notes come with the content that they have now. An add of a note that is there and wasn't
        deleted changes nothing, so a batch may be applied twice.
        """
        store = self._store()
        if store.load("postings") is None:
            self.reindex()
            return
        keys = ["vault", "path"]
        present = materialize(snapshots.live(store, "documents").select("note_id", *keys).join(ops, keys))
        gone = present.where("op = 'delete' or replace").select("note_id").distinct()
        wanted = ops.where("op = 'add'").join(present.where("not replace").select(*keys).distinct(), keys, "left_anti")
        new = self.documents.join(wanted.select(*keys), keys, "left_semi")
        snapshots.refresh_index(store, gone, new, analysis=self.analysis)
        self._follow_refs("lexical", ops.select("path").distinct())

    def follow(self, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Starts the stream that applies a feed of changes to the index; a running one is stopped first."""
        self.stream = changes.start(changes.source(self.spark, folder), self._store(), checkpoint, once=once, then=self.apply)
        return self.stream
