from datetime import datetime

import pytest

from marginalia.engine import NoteSearch
from marginalia.operators import corpus
from marginalia.sources import snapshots
from marginalia.sources.snapshots import Store


@pytest.fixture
def before(make_notes):
    return make_notes({"note_id": 1, "basename": "Glass", "content": "the glass furnace is hot\nglass again"}, {"note_id": 2, "content": "kiln rules"}, {"note_id": 3, "content": "glass kiln"})


def test_queries(spark, before):
    engine = NoteSearch(spark, before)
    top = engine.search("glass kiln").collect()
    assert [r["note_id"] for r in top] == [3]
    hits = engine.hits_in(1, "glas furnace", ["glass", "furnace"]).collect()
    assert [r["row_no"] for r in sorted(hits, key=lambda r: r["rank"])] == [0, 1]
    assert engine.search_in_file(1, "glsfur").count() == 1
    with pytest.raises(ValueError):
        engine.reindex()


def test_refresh_equals_rebuild(spark, before, make_notes, tmp_path):
    store = Store(spark, str(tmp_path), "c")
    engine = NoteSearch(spark, before, store=store)
    assert [r["note_id"] for r in engine.search_saved("glass").collect()][0] in (1, 3)
    assert engine.pending_changes().count() == 0
    after = make_notes({"note_id": 1, "basename": "Glass", "content": "only a kiln now", "indexed_at": datetime(2024, 5, 5)}, {"note_id": 3, "content": "glass kiln"}, {"note_id": 4, "content": "glass glass"})
    later = NoteSearch(spark, after, store=store)
    assert sorted(map(tuple, later.pending_changes().collect())) == [("a/n1.md", "add"), ("a/n1.md", "delete"), ("a/n2.md", "delete"), ("a/n4.md", "add")]
    assert later.refresh() == 3
    key = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    fresh = NoteSearch(spark, after, store=Store(spark, str(tmp_path), "d"))
    fresh.reindex()

    def same():
        for name, columns in (("postings", ("note_id", "field", "term", "tf")), ("lengths", ("note_id", "field", "length")), ("documents", ("note_id", "path", "tags"))):
            assert key(snapshots.live(store, name), *columns) == key(snapshots.live(fresh.store, name), *columns)
        assert key(later.search_saved("glass"), "note_id", "score") == key(later.search("glass"), "note_id", "score")
        assert later.pending_changes().count() == 0 and later.refresh() == 0

    same()
    broken = snapshots.last_delta(store) + 1
    store.add_delta("postings", snapshots.index_rows(before_documents(before), broken)["postings"], broken)
    same()
    snapshots.compact_index(store)
    assert not store.deltas("gone")
    same()
    NoteSearch(spark, before, store=store).refresh()
    assert later.refresh() == 3
    same()


def before_documents(notes):
    return corpus.documents(notes)


CHANGES = "op_id bigint, vault string, path string, op string, op_time timestamp, arrived_at timestamp"


def test_changes_reach_the_index_before_a_query(spark, make_notes, tmp_path):
    first = make_notes({"note_id": 1, "content": "glass one"}, {"note_id": 2, "content": "kiln two"})
    store = Store(spark, str(tmp_path / "s"), "c")
    NoteSearch(spark, first, store=store).reindex()
    later = make_notes({"note_id": 1, "content": "glass changed"}, {"note_id": 3, "content": "glass three"}, {"note_id": 2, "content": "kiln glass"})
    vault = later.first()["vault"]
    feed = tmp_path / "in"

    def arrive(*rows):
        data = [(i, vault, f"a/n{n}.md", op, datetime(2024, 1, day), datetime(2024, 1, 9)) for i, n, op, day in rows]
        spark.createDataFrame(data, CHANGES).coalesce(1).write.mode("append").parquet(str(feed / "change_ops.parquet"))

    arrive((1, 1, "delete", 2), (2, 1, "add", 3), (3, 3, "ADD", 3), (4, 2, "add", 2))
    engine = NoteSearch(spark, later, store=store)
    running = engine.follow(str(feed), str(tmp_path / "cp"))
    try:
        ids = lambda q: sorted(r["note_id"] for r in engine.search(q).collect())
        assert ids("glass") == [1, 3] and ids("changed") == [1] and ids("one") == [] and ids("two") == [2]
        arrive((5, 3, "delete", 5), (6, 1, "delete", 1))
        assert ids("glass") == [1]
        assert {r["path"] for r in snapshots.load_refs(store, "lexical").collect()} == {"a/n1.md", "a/n2.md", "a/n3.md"}
        again = engine.follow(str(feed), str(tmp_path / "cp"))
        assert not running.isActive and again.isActive and len([q for q in spark.streams.active if q.name == again.name]) == 1
    finally:
        engine.stream.stop()
    assert ids("glass") == [1]


def test_settings_change_the_terms(spark, make_notes, tmp_path):
    notes = make_notes({"note_id": 1, "content": "Glass the kiln"}, {"note_id": 2, "content": "glass"})
    exact = snapshots.Settings()
    exact.search.case_sensitive = True
    for store in (None, Store(spark, str(tmp_path), "c")):
        ids = lambda q, **o: sorted(r["note_id"] for r in NoteSearch(spark, notes, store=store, **o).search(q + " /np/nf").collect())  # noqa: E731, B023
        if store:
            NoteSearch(spark, notes, store=store).reindex()
        assert ids("Glass") == [1, 2] and ids("Glass", settings=exact) == [1] and ids("glass", settings=exact) == [2]
        assert ids("the") == [] and ids("the", settings=snapshots.Settings(stop_words_en=False)) == [1]
        assert ids("glass", stop_words=["glass"]) == [] and ids("the", stop_words=["glass"]) == [1] and ids("Glass kiln", stop_words=["kiln"]) == [1, 2]
    engine = NoteSearch(spark, notes, exact, store)
    assert sorted(r["note_id"] for r in engine.search_saved("glass /np/nf").collect()) == [2]
    assert store.manifest()["analysis"] == exact.analysis().key()


def test_semantic_search_follows_the_notes(spark, make_notes, tmp_path):
    store = Store(spark, str(tmp_path), "c")
    first = make_notes({"note_id": 1, "content": "glass furnace heat\n\nlunch menu soup"}, {"note_id": 2, "content": "harbour ferry"}, {"note_id": 3, "content": None}, {"note_id": 4, "content": "\n \n"})
    engine = NoteSearch(spark, first, snapshots.Settings(semantic=True), store)
    engine.reindex()
    top = engine.search_semantic(" glass furnace ", 2).orderBy("rank").collect()
    assert top[0]["path"] == "a/n1.md" and top[0]["items"][0]["text"] == "glass furnace heat" and top[0]["similarity"] > 0.8
    assert engine.search_semantic("  ").count() == 0 and engine.pending_changes("semantic").count() == 0
    after = make_notes({"note_id": 1, "content": "only soup", "indexed_at": datetime(2024, 5, 5)}, {"note_id": 5, "content": "glass furnace"})
    later = NoteSearch(spark, after, snapshots.Settings(semantic=True), store)
    assert later.refresh_semantic() == 5 and later.refresh_semantic() == 0
    assert [r["path"] for r in later.search_semantic("glass furnace", 1).collect()] == ["a/n5.md"]


def test_a_save_is_seen_whole_and_the_one_before_stays_readable(spark, tmp_path):
    store = Store(spark, str(tmp_path), "c")
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    store.commit({"a": store.write("a", one(1)), "b": store.write("b", one(1))})
    read = store.load("a")
    store.write("a", one(9))
    assert [r["n"] for r in store.load("a").collect()] == [1]
    store.commit({"a": store.write("a", one(2)), "b": store.write("b", one(2))})
    assert [r["n"] for r in read.collect()] == [1] and [r["n"] for r in store.load("b").collect()] == [2]
    before = store.manifest()["a"]
    store.save("a", one(3))
    store.save("a", one(4))
    assert not (tmp_path / "c" / f"v{store.version}" / before).exists() and [r["n"] for r in store.load("b").collect()] == [2]
