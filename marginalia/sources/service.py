"""Semantic search by a remote service, and the same operations on tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators import semantic
from marginalia.sources.snapshots import Store


class ServiceError(RuntimeError):
    """An answer that is neither data nor absent."""


class Service:
    """A client of a semantic server: JSON over HTTP with the corpus' name in a header.

    Documents are sent from the executors, a batch of rows at a time; sending one again is harmless
    to a server that keys them by path, so lost tasks may be run again.
    """

    def __init__(self, url: str, corpus: str, header: str = "vaultId", timeout: float = 30):
        self.url, self.headers, self.timeout = url.rstrip("/"), {header: corpus, "Content-Type": "application/json"}, timeout

    def call(self, method: str, path: str, parameters: dict[str, Any] | None = None, body: Any = None) -> Any:
        """An answer's data; None for the codes -1 and -2; an error for any other code or status."""
        query = "?" + urlencode({k: v if isinstance(v, str) else json.dumps(v) for k, v in parameters.items()}) if parameters else ""
        data = None if body is None else json.dumps(body).encode()
        try:
            with urlopen(Request(f"{self.url}/{path}{query}", data, self.headers, method=method), timeout=self.timeout) as answer:
                got = json.load(answer)
        except (HTTPError, URLError) as e:
            raise ServiceError(str(e)) from e
        if got.get("code") == 0:
            return got.get("data")
        if got.get("code") in (-1, -2):
            return None
        raise ServiceError(got.get("message") or "the service refused")

    def reachable(self) -> bool:
        try:
            return self.call("GET", "testConnection") is not None
        except ServiceError:
            return False

    def exists(self) -> bool:
        return bool(self.call("GET", "doesCollectionExist"))

    def count(self) -> int:
        return int(self.call("GET", "docsCount") or 0)

    def search(self, text: str, view_type: str = "markdown") -> list[dict[str, Any]]:
        """The server's results for a query; an empty one isn't sent."""
        text = text.strip()
        return (self.call("GET", "search", {"queryText": text, "viewType": view_type}) or []) if text else []

    def reindex(self, documents: DataFrame) -> int:
        """Replaces the collection by the documents."""
        self.call("POST", "reindexAll", body=[])
        return self.add(documents)

    def add(self, documents: DataFrame, rows: int = 100) -> int:
        return self._send(semantic.semantic_documents(documents), "addDocuments", rows)

    def delete(self, paths: DataFrame, rows: int = 1000) -> int:
        return self._send(paths.select("path").distinct(), "deleteDocuments", rows)

    def _send(self, df: DataFrame, path: str, rows: int) -> int:
        def run(batches: Iterator[Any]) -> Iterator[Any]:
            import pandas as pd

            for batch in batches:
                for at in range(0, len(batch), rows):
                    part = batch.iloc[at : at + rows]
                    self.call("POST", path, body=part["path"].tolist() if len(batch.columns) == 1 else part.to_dict("records"))
                yield pd.DataFrame({"n": [len(batch)]})

        return df.mapInPandas(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Collection:
    """Vectors of documents as a stored table, with the service's operations.

    A document may have several passages. A change is written as a numbered delta, so it costs what
    it changes; the rows of a path's last number count, and every so many changes all is merged.
    """

    COLUMNS = ("path", "chunk_no", "text", "embedding")

    def __init__(self, store: Store, name: str = "vectors", compact_every: int = 20):
        self.store, self.name, self.compact_every = store, name, compact_every

    def exists(self) -> bool:
        return self.store.current(self.name) is not None

    def rows(self) -> DataFrame:
        """``(path, chunk_no, text, embedding)`` as they stand."""
        all_rows = self.store.load_with_deltas(self.name)
        last = all_rows.groupBy(F.col("path").alias("__path")).agg(F.max("made").alias("__made"))
        kept = all_rows.join(last, (F.col("path") == F.col("__path")) & (F.col("made") == F.col("__made"))) if self.store.deltas(self.name) else all_rows
        return kept.where("not removed").select(*self.COLUMNS)

    def count(self) -> int:
        """How many documents have vectors."""
        return self.rows().select("path").distinct().count() if self.exists() else 0

    def _stored(self, vectors: DataFrame, number: int) -> DataFrame:
        number_of = F.col("chunk_no") if "chunk_no" in vectors.columns else F.lit(0)
        text = F.col("text") if "text" in vectors.columns else F.lit(None)
        vector = F.col("embedding") if "embedding" in vectors.columns else F.lit(None)
        own = vectors.select("path", number_of.cast("int").alias("chunk_no"), text.cast("string").alias("text"), vector.cast("array<float>").alias("embedding"))
        return own.where("path is not null").dropDuplicates(["path", "chunk_no"]).withColumns({"removed": F.lit("embedding" not in vectors.columns), "made": F.lit(number)})

    def reindex(self, vectors: DataFrame) -> None:
        """Replaces the table by rows of ``path`` and ``embedding``, with ``chunk_no`` and ``text`` if a path has several."""
        number, parts = self._last(), self.store.deltas(self.name)
        self.store.save(self.name, self._stored(vectors, number), merged=number)
        self.store.drop_deltas(parts)

    def _last(self) -> int:
        folder = self.store.current(self.name)
        return max([0, *(int(x.rstrip("/").rpartition("/")[2]) for x in self.store.deltas(self.name)), *([int(folder.rpartition("-")[2])] if folder else [])])

    def _change(self, vectors: DataFrame) -> None:
        number = self._last() + 1
        self.store.add_delta(self.name, self._stored(vectors, number), number)
        if number % self.compact_every == 0:
            self.reindex(self.rows())

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors of paths that aren't there yet."""
        if not self.exists():
            return self.reindex(vectors)
        self._change(vectors.join(self.rows().select("path").distinct(), "path", "left_anti"))

    def delete(self, paths: DataFrame) -> None:
        if self.exists():
            self._change(paths.select("path"))

    def search(self, vector: list[float], k: int = 10) -> DataFrame:
        """``(path, similarity)`` of the nearest passages' documents."""
        return semantic.top_k(self.rows(), vector, k, key="path")
