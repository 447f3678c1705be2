"""Nulls, empty tables, repeats and clashing column names in every general operator."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import ranking
from marginalia.operators import corpus, index, lines, maintain, search, semantic, snippets

EXTRA = ["1 as term", "2 as tf", "3 as rank", "'s' as score", "4 as field", "5 as tokens", "6 as length", "'x' as op", "7 as n", "8 as row_no"]


@pytest.fixture(scope="module")
def wide(make_notes):
    rows = [{"note_id": 1, "content": "glass furnace", "tags": "a #b"}, {"note_id": 1, "content": "glass furnace", "tags": "a #b"}, {"note_id": None, "content": "glass"}, {"note_id": 2, "path": None, "content": "glass"}, {"note_id": 3, "content": None}, {"note_id": 4, "content": ""}, {"note_id": 5, "content": "glass " * 40_000}]
    return make_notes(*rows, extra=EXTRA)


def test_documents_and_index(wide):
    docs = corpus.documents(wide)
    assert sorted(r[0] or 0 for r in docs.select("note_id").collect()) == [0, 1, 3, 4, 5]
    assert index.postings(docs).where("note_id = 5 and field = 'content'").first()["tf"] == 1
    assert index.postings(docs, ["content"], count_all=True).where("note_id = 5").first()["tf"] == 40_000
    for run in (index.postings, index.field_lengths, index.field_stats, index.document_frequency):
        assert run(docs).count() > 0 and run(docs.limit(0)).count() == 0


def test_search_and_lines(wide):
    docs = corpus.documents(wide)
    assert {r["note_id"] for r in search.search(docs, "glass").collect()} == {1, 5}
    with_tags = search.search(docs, "b /np/nf", boosts=ranking.BOOSTS | {"tags": ranking.TAG_BOOST})
    assert with_tags.count() == 0
    own = corpus.split_lines(docs, "note_id", "content").selectExpr("*", "1 as score", "2 as rank", "3 as positions")
    assert lines.top_lines(own, ["glass"]).count() == 3
    assert lines.fuzzy_lines(own, "glsf").count() == 1 and lines.fuzzy_lines(own, "gls").count() == 3
    assert lines.top_lines(own.limit(0), ["glass"]).count() == 0
    assert snippets.snippets(docs, own, ["furnace"], "furnace").count() == 1
    hit = own.where("note_id = 1").select("note_id", "row_no")
    assert snippets.context_budget(hit, own, 2, 50, True).count() == 0


def test_ties_go_to_the_smaller_id(make_notes):
    docs = corpus.documents(make_notes(*({"note_id": k, "path": f"a/x{k}.md", "basename": "same", "content": "glass"} for k in (3, 1, 2))))
    assert [r["note_id"] for r in search.search(docs, "glass", limit=2).orderBy("rank").collect()] == [1, 2]


def test_maintenance(spark, wide):
    files = wide.select("path", F.col("indexed_at").alias("update_time"), "op", "n")
    refs = files.limit(0)
    assert maintain.diff(files, refs).count() == 5
    assert maintain.diff(refs, files).where("op = 'delete'").count() == 5
    assert corpus.not_indexed(files, refs).count() == files.count() and corpus.indexed_only(files, refs).count() == 0
    meta = wide.select("path", "tags").where("path is not null").distinct()
    joined = corpus.with_metadata(wide.select("path", F.lit("mine").alias("tags")), meta)
    assert joined.columns == ["path", "tags"] and joined.where("path is null").first()["tags"] == ""
    assert corpus.new_exclusions(files, refs, files).count() == 5
    engines = files.withColumn("engine", F.lit("lexical"))
    assert maintain.stale_refs(engines, files).where("state = 'current'").count() == 5
    assert semantic.semantic_documents(spark.createDataFrame([("a", "b", None)] * 2, "path string, view_type string, content string")).count() == 1
