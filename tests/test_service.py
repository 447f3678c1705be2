import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from marginalia.functions import query, text
from marginalia.operators import snippets
from marginalia.sources.service import Collection, Service, ServiceError
from marginalia.sources.snapshots import Store


class Handler(BaseHTTPRequestHandler):
    held: dict = {}

    def _answer(self, data, code=0):
        body = json.dumps({"data": data, "message": "no", "code": code}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def do_GET(self):
        name = self.path.split("?")[0].strip("/")
        if name == "testConnection":
            self._answer(self.headers["vaultId"])
        elif name == "doesCollectionExist":
            self._answer(bool(self.held))
        elif name == "docsCount":
            self._answer(len(self.held))
        elif name == "search":
            self._answer(None, -1) if "none" in self.path else self._answer([{"path": self.path}])
        else:
            self._answer(None, 7)

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if "reindex" in self.path:
            self.held.clear()
        elif "add" in self.path:
            self.held.update({d["path"]: d for d in body})
        else:
            for p in body:
                self.held.pop(p, None)
        self._answer(True)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield Service(f"http://127.0.0.1:{server.server_port}", "v1")
    server.shutdown()


def test_service(spark, service):
    docs = spark.createDataFrame([("a", "markdown", "x"), ("a", "markdown", "x"), ("b", "pdf", None)], "path string, view_type string, content string")
    assert service.reachable() and service.reindex(docs) == 2 and service.count() == 2 and service.exists()
    assert service.delete(docs.where("path = 'a'")) == 1 and service.count() == 1
    assert service.search("  ") == [] and service.search("none") == []
    assert "queryText=a+%26b" in service.search(" a &b ")[0]["path"]
    with pytest.raises(ServiceError):
        service.call("GET", "what")
    assert not Service("http://127.0.0.1:9", "v", timeout=1).reachable()


def test_collection(spark, tmp_path):
    own = Collection(Store(spark, str(tmp_path), "c"))
    rows = lambda *r: spark.createDataFrame(list(r), "path string, embedding array<float>")
    assert not own.exists() and own.count() == 0
    own.add(rows(("a", [1.0, 0.0]), ("b", [0.0, 1.0])))
    own.add(rows(("b", [1.0, 1.0]), ("c", [1.0, 0.1])))
    assert own.count() == 3
    assert [r["path"] for r in own.search([1.0, 0.0], 2).collect()] == ["a", "c"]
    own.delete(rows(("a", [0.0])))
    assert own.count() == 2


def test_more_text_functions(spark):
    df = spark.createDataFrame([("---\naliases: [One, 'Two x']\ntags:\n  - \"#a\"\n  - b\ntitle: T\n---\nbody", "Glass & <glass>", ["#a", "b"])], "t string, l string, g array<string>")
    got = df.select(text.front_matter(F.col("t"), "aliases").alias("a"), text.front_matter(F.col("t"), "tags").alias("b"), text.front_matter(F.col("t"), "title").alias("c"), text.front_matter(F.col("l"), "tags").alias("d"), text.mark_literal(F.col("l"), "glass").alias("m"), text.joined_tags(F.col("g")).alias("j")).first()
    assert got["a"] == ["One", "Two x"] and got["b"] == ["#a", "b"] and got["c"] == ["T"] and got["d"] == []
    assert got["m"] == "<mark>Glass</mark> &amp; &lt;<mark>glass</mark>&gt;" and got["j"] == "a b"
    assert [query.move_cursor(0, -1, 3), query.move_cursor(1, 1, 3), query.move_cursor(2, 1, 3)] == [0, 2, 2]


def test_maximal_columns_agree(spark):
    cases = [("foo foobar", "foo bar foobar"), ("ab abc", "abc xab abcd"), ("x y", "p pq q"), ("a b", "a b ab")]
    df = spark.createDataFrame([(q.split(), m.split()) for q, m in cases], "q array<string>, m array<string>")
    for r in df.select("q", "m", query.maximal(F.col("q"), F.col("m")).alias("t")).collect():
        assert r["t"] == query.maximal_terms(r["q"], r["m"])


def test_old_snippets(spark, make_notes):
    df = make_notes({"note_id": 1, "content": "x" * 50 + " glass furnace\nno"})
    got = snippets.old_search_in_file(df, 1, "glass").collect()
    assert [(r["row_no"], r["col"]) for r in got] == [(0, 51)] and got[0]["snippet"] == snippets.old_snippet("x" * 50 + " glass furnace", 51)
