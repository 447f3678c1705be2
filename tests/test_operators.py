import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from marginalia.functions.query import Options
from marginalia.operators import corpus, index, lines, maintain, search, semantic, snippets
from marginalia.sources.snapshots import Settings, Store, load_settings, merge, save_index, save_settings, search_saved
from marginalia.sources.tables import drop_repeats


def day(n):
    return datetime(2024, 1, n)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def notes(make_notes):
    return make_notes(
        {"note_id": 1, "basename": "Glass furnace", "content": "the glass furnace\nis hot", "tags": "todo", "aliases": None},
        {"note_id": 2, "basename": "Kiln", "content": "Glass glass GLASS and glasses", "headings": "Furnace rules"},
        {"note_id": 3, "basename": None, "content": None},
        {"note_id": 4, "path": "a/b.pdf", "content": "glass furnace"},
        {"note_id": 5, "content": ""},
        {"note_id": 1, "basename": "Glass furnace", "content": "the glass furnace\nis hot", "tags": "todo", "indexed_at": day(9)},
    )


@pytest.fixture(scope="module")
def docs(make_notes):
    return corpus.documents(notes(make_notes))


def test_documents(docs):
    got = {r["note_id"]: r for r in docs.collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert got[3]["basename"] == "n3" and got[3]["content"] is None and got[1]["aliases"] == ""


def test_drop_repeats_paths_agree(spark):
    data = [(k % 7 if k % 5 else None, k) for k in range(40)]
    df = spark.createDataFrame(data, "k int, v int")
    small, large = (drop_repeats(df, "k", [F.col("v")], broadcast_rows=n) for n in (100, 2))
    assert rows(small.where("k is not null")) == rows(large.where("k is not null"))
    assert small.where("k is null").count() == large.where("k is null").count() == 8
    assert drop_repeats(df.limit(0), "k", [F.col("v")]).count() == 0


def test_drop_repeats_has_a_total_order(spark):
    data = [(1, 5, "a"), (1, 5, "b"), (1, 5, "b"), (1, 6, "c"), (2, None, "d"), (2, 1, "e"), (2, 2, "f"), (3, None, "g"), (4, 7, "h"), (4, 7, "h"), (None, 1, "i"), (None, 1, "i"), (5, 1, "j"), (5, 2, "k"), (5, 2, "l")]
    df = spark.createDataFrame(data, "k int, v int, t string")
    for some in (df, df.where("k is null or k > 1"), df.where("k = 5"), df.where("k = 3"), df.where("k in (1, 4)")):
        ways = [drop_repeats(part, "k", [F.col("v")], broadcast_rows=n).collect() for n in (100, 1) for part in (some, some.repartition(7, "t"), some.repartition(3))]
        assert all(sorted(map(str, w)) == sorted(map(str, ways[0])) for w in ways)
    got = {r["k"]: r["t"] for r in drop_repeats(df, "k", [F.col("v")]).where("k is not null").collect()}
    assert got[2] == "e" and got[3] == "g" and got[4] == "h" and got[5] == "j" and got[1] in "ab"


def test_postings_count_case_variants(docs):
    got = {(r["note_id"], r["field"], r["term"]): r["tf"] for r in index.postings(docs).collect()}
    assert got[2, "content", "glass"] == 3 and got[2, "content", "glasses"] == 1 and got[1, "basename", "furnace"] == 1
    lengths = {(r["note_id"], r["field"]): r["length"] for r in index.field_lengths(docs).collect()}
    assert lengths[3, "content"] == 0 and lengths[2, "content"] == 4
    df = {(r["term"], r["field"]): r["df"] for r in index.document_frequency(docs).collect()}
    assert df["glass", "content"] == 2


def test_search(docs):
    exact = search.search(docs, "glass furnace /np/nf")
    assert [r["note_id"] for r in exact.orderBy("rank").collect()] == [1, 2]
    typo = search.search(docs, "glas furnase")
    assert {r["note_id"] for r in typo.collect()} == {1, 2}
    assert search.search(docs, "glas furnase /nf/np").count() == 0
    assert search.search(docs, "the").count() == 0 and search.search(docs, "").count() == 0
    with pytest.raises(ValueError):
        search.search(docs, "glass", limit=301)
    assert search.search(docs.limit(0), "glass").count() == 0


def test_search_is_monotone(docs):
    ids = lambda q, **o: {r["note_id"] for r in search.search(docs, q, **o).collect()}
    assert ids("glass /np/nf") <= ids("glass /ap/nf") <= ids("glass /ap/af")
    assert ids("glass furnace") <= ids("glass furnace", every_term=False)
    assert ids("glass hot") <= ids("glass")


def test_saved_index_ranks_alike(spark, docs, tmp_path):
    store = Store(spark, str(tmp_path), "c")
    assert store.load("postings") is None
    save_index(store, docs, docs.select("path"))
    for raw in ("glas furn", "glass furnace /np/nf", "fu /nf", "nothing", ""):
        assert rows(search_saved(store, raw)) == rows(search.search(docs, raw))
    store.save("lengths", index.field_lengths(docs))
    assert store.load("lengths").count() == 20
    other = Store(spark, str(tmp_path), "c", version=1)
    other.save("x", docs.select("path"))
    assert store.drop_stale_versions() == ["v1"]


def test_line_scores(spark):
    df = spark.createDataFrame([(1, 0, "foo Foo foo"), (1, 1, "nothing"), (1, 2, None), (2, 0, "foo"), (2, 1, "foo"), (2, 2, "c++ foo")], "note_id bigint, row_no int, text string")
    got = {(r["note_id"], r["row_no"]): r["score"] for r in lines.matching_lines(df, ["foo"]).collect()}
    assert got == {(1, 0): 6.01, (2, 0): 3.0, (2, 1): 3.0, (2, 2): 3.0}
    assert rows(lines.top_lines(df, ["foo", "c++"], k=2).where("note_id = 2").select("row_no", "rank")) == [(0, 2), (2, 1)]
    assert lines.matching_lines(df, []).count() == 0
    whole = lines.matching_lines(df, ["fo"], prefix=False)
    assert whole.count() == 0


def test_fuzzy_match_is_a_subsequence():
    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice("abcAB -_") for _ in range(random.randint(0, 14)))
        q = "".join(random.choice("abcA") for _ in range(random.randint(1, 4)))
        got = lines.fuzzy_match(text, q)
        it = iter(text.lower() if q == q.lower() else text)
        assert (got is not None) == all(c in it for c in q)
        if got:
            columns = got[1]
            assert columns == sorted(set(columns)) and "".join(text[i] for i in columns).lower() == q.lower()
    assert lines.fuzzy_match("fooBar", "fb")[1] == [0, 3]
    assert lines.fuzzy_match("abc", "") == (0, [])


def test_fuzzy_match_finds_the_best(spark):
    """Against all ways to place the query, by the same rules."""
    from itertools import combinations

    def score(text, columns):
        def bonus(i):
            p = text[i - 1] if i else " "
            return 8 if text[i].isalnum() and not p.isalnum() else 7 if p.islower() and text[i].isupper() or text[i].isdigit() and not p.isdigit() else 0

        total, first = 0, 0
        for k, c in enumerate(columns):
            if k and c == columns[k - 1] + 1:
                first = max(bonus(c), first)
                total += 16 + max(first, 4)
            else:
                first = bonus(c)
                total += 16 + bonus(c) * (2 if k == 0 else 1) - (3 + c - columns[k - 1] - 2 if k else 0)
        return total

    random.seed(5)
    for _ in range(150):
        text = "".join(random.choice("abB -1") for _ in range(random.randint(0, 9)))
        q = "".join(random.choice("ab1") for _ in range(random.randint(1, 3)))
        ways = [c for c in combinations(range(len(text)), len(q)) if "".join(text[i] for i in c).lower() == q]
        got = lines.fuzzy_match(text, q)
        assert (got is None) == (not ways)
        if got:
            assert got[0] == score(text, got[1]) and got[0] >= max(score(text, c) for c in ways) - 8


def test_fuzzy_matches_hold_little_whatever_the_lengths(monkeypatch):
    """A long line among short ones: what is held follows their sum, not the longest times their number."""
    import tracemalloc

    short, long = ["Glass-furnace 1st"] * 2000, "x glass " * 250
    tracemalloc.start()
    try:
        got = lines.fuzzy_matches([*short, long], "glsfr")
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0] == lines.fuzzy_match(short[0], "glsfr") and got[:2000] == got[:1] * 2000 and got[2000] is None
    assert held < 64 << 20

    random.seed(7)
    texts = ["".join(random.choice("abB -1") for _ in range(3000)) for _ in range(4)]
    whole = lines.fuzzy_matches(texts, "ab1ab")
    monkeypatch.setattr(lines, "AT_ONCE", 1)  # each is cut into stretches
    assert lines.fuzzy_matches(texts, "ab1ab") == whole and all(whole)


def test_best_lines_of_each_note_beside_a_long_line(spark, monkeypatch):
    """What ``fuzzy_lines_each`` runs on a batch holds little, and all lines of all notes come out."""
    import tracemalloc

    import pandas as pd

    own = [(k // 50, k % 50, "Glass-furnace 1st") for k in range(2000)] + [(7, 50, "glass fr " * 250), (90, 0, "x" * 2500 + " glsfr")]
    df = spark.createDataFrame(own, "note_id bigint, row_no int, text string")
    ran = []
    kept = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: ran.append(run) or kept(self, run, schema))
    got = {(r["note_id"], r["row_no"]): r["rank"] for r in lines.fuzzy_lines_each(df, "glsfr", 3).collect()}
    assert len(got) == 40 * 3 + 1 and got[90, 0] == 1 and got[7, 50] <= 3
    assert all(got[k, 0] == 1 and got[k, 1] == 2 and got[k, 2] == 3 for k in range(40) if k != 7)
    tracemalloc.start()
    try:
        assert sum(map(len, ran[0](iter([pd.DataFrame(own, columns=["note_id", "row_no", "text"])])))) == 2002
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert held < 64 << 20


def test_columns_and_ranked_lines(spark):
    df = spark.createDataFrame([(1, 0, "Glass of glasses"), (1, 1, ""), (1, 2, None), (2, 0, "furnace glas"), (2, 1, "kiln")], "note_id bigint, row_no int, text string")
    found = {(r[0], r[1]): r[2] for r in df.select("note_id", "row_no", lines.match_columns(F.col("text"), ["glass", "of"])).collect()}
    assert found[1, 0] == [0, 1, 2, 3, 4, 6, 7, 9, 10, 11, 12, 13] and found[1, 1] == [] and found[2, 1] == []
    assert [r[0] for r in df.where("row_no = 0").orderBy("note_id").select(lines.min_in_set(lines.match_columns(F.col("text"), ["glass"]))).collect()] == [0.0, 1.7976931348623157e308]
    got = lines.ranked_lines(df, "glass furnace").orderBy("rank").collect()
    assert [(r["note_id"], r["row_no"]) for r in got] == [(2, 0), (1, 0)]
    each = lines.fuzzy_lines_each(df, "gls", 1)
    assert sorted((r["note_id"], r["row_no"]) for r in each.collect()) == [(1, 0), (2, 0)]


def test_fuzzy_lines(spark):
    df = spark.createDataFrame([(1, 0, "glass furnace"), (1, 1, None), (1, 2, ""), (1, 3, "g-l-a-s"), (1, 4, "furnace")], "note_id bigint, row_no int, text string")
    got = lines.fuzzy_lines(df, "gl as").collect()
    assert [r["row_no"] for r in got] == [0, 3] and got[0]["positions"] == [0, 1, 2, 3]
    assert lines.fuzzy_lines(df, "  ").count() == 0


def test_marks():
    assert snippets.mark("abcdef", [1, 2, 4]) == "a<mark>bc</mark>d<mark>e</mark>f"
    assert snippets.mark("<b>", [1]) == "&lt;<mark>b</mark>&gt;"
    assert snippets.mark("", []) == ""
    near = snippets.Limits(0, 0, 2, 3)
    assert snippets.marked_columns("xx foo and bar foo", ["foo", "bar"], near) == [11, 12, 13]
    assert snippets.marked_columns("nothing", ["foo"], near) == []


def test_context():
    own = ["first line here", "second", "hit is in this line", "after", "ab", "last one is long enough"]
    limits = snippets.Limits(4, 7, 12, 30)
    kept, start = snippets.context(own, 2, 4, limits)
    assert start == 0 and kept[0] == (0, "re") or kept[0][0] == 1
    assert (2, own[2]) in kept
    kept, start = snippets.context(own, 2, 15, limits)
    assert start == 3 and kept[0] == (2, own[2][3:])
    html, col = snippets.render(own, 2, [15, 16], limits)
    assert col == 15 and html.startswith('<span class="matched-line">') and "<mark>li</mark>" in html
    assert snippets.render(["", "x"], 0, [], limits)[1] == 0


def test_context_windows_follow_the_budget(spark):
    own = spark.createDataFrame([(1, i, t) for i, t in enumerate(["aaaa", "bbb", "hit", "cccc", "dd"])], "note_id bigint, row_no int, text string")
    hit = spark.createDataFrame([(1, 2)], "note_id bigint, row_no int")
    assert rows(snippets.context_budget(hit, own, 3, 5, True)) == [(1, 2, 0, "aa"), (1, 2, 1, "bbb")]
    assert rows(snippets.context_budget(hit, own, 3, 5, False)) == [(1, 2, 3, "cccc"), (1, 2, 4, "d")]


def test_snippets(spark, docs):
    own = corpus.split_lines(docs, "note_id", "content")
    got = snippets.snippets(docs, own, ["furnace"], "furnace").collect()
    assert len(got) == 1 and "<mark>furnace</mark>" in got[0]["snippet"] and got[0]["col"] == 10
    inside = snippets.search_in_file(docs, 1, "glsfrn").collect()
    assert len(inside) == 1 and "highlight-bg" in inside[0]["paragraph"]


def test_diff(spark):
    now = spark.createDataFrame([("x", day(2)), ("z", day(5)), ("same", day(1)), (None, day(1)), ("nul", None)], "path string, update_time timestamp")
    then = spark.createDataFrame([("x", day(1)), ("y", day(1)), ("same", day(1)), ("same", day(1)), ("nul", day(1))], "path string, update_time timestamp")
    assert rows(maintain.diff(now, then)) == [("x", "add"), ("x", "delete"), ("y", "delete"), ("z", "add")]
    assert maintain.diff(now.limit(0), then.limit(0)).count() == 0


OPS = "op_id bigint, vault string, path string, op string, op_time timestamp, arrived_at timestamp"


def test_net_change(spark):
    data = [(1, "v", "p", "add", day(1), None), (2, "v", "p", "del", day(2), None), (3, "v", "p", " ADD ", day(3), None), (3, "v", "p", " ADD ", day(3), None), (4, "v", "q", "add", day(5), None), (5, "v", "q", "delete", day(4), None), (6, "v", None, "add", day(1), None), (7, "v", "r", "what", day(1), None), (8, "v", "t", "add", day(1), None), (9, "v", "t", "delete", day(1), None)]
    ops = spark.createDataFrame(data, OPS)
    assert rows(maintain.pending(ops).where("path = 'p'").select("op", "op_id")) == [("add", 3), ("delete", 2)]
    assert rows(maintain.net_change(ops).select("path", "op")) == [("p", "add"), ("q", "add"), ("t", "delete")]
    present = spark.createDataFrame([("v", "t"), ("v", "s"), ("v", "s")], "vault string, path string")
    assert rows(maintain.apply_changes(present, maintain.net_change(ops))) == [("v", "p"), ("v", "q"), ("v", "s")]


def test_expand_events(spark):
    df = spark.createDataFrame([("create", "a", None, day(1)), ("rename", "b", "c", day(2)), ("modify", "d", None, day(3)), ("delete", "e", None, day(4)), ("odd", "f", None, day(5))], "event string, path string, old_path string, op_time timestamp")
    assert rows(maintain.expand_events(df).select("path", "op")) == [("a", "add"), ("b", "add"), ("c", "delete"), ("d", "add"), ("d", "delete"), ("e", "delete")]


def test_latest_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, day(1), 1, "a"), (1, None, 2, "b")], "k int, t timestamp, count int, n string")
    assert rows(maintain.latest(df, ["k"], "t").select("count", "n")) == [(1, "a")]


def test_cosine(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [3.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert rows(semantic.top_k(df, [1.0, 0.0], 3)) == [(1, 1.0), (2, 0.707107), (6, 1.0)]
    assert semantic.top_k(df, [0.0, 0.0]).count() == 0


def test_nearest_of_each_query(spark):
    df = spark.createDataFrame([(n, [float(n % 7 - 3), float(n % 5), 1.0]) for n in range(60)] + [(60, None), (61, [0.0] * 3), (62, [1.0])], "vec_id int, embedding array<float>")
    asked = df.where("vec_id % 10 = 0 or vec_id = 61")
    want = sorted((q["vec_id"], *r) for q in asked.collect() if q["embedding"] for r in semantic.top_k(df, q["embedding"], 4).collect())
    for block in (1000, 2):
        assert sorted(tuple(r) for r in semantic.top_k_each(df, asked, 4, block=block).collect()) == want


def test_files(spark, tmp_path):
    from marginalia.sources.files import list_files, read_files, stop_words, without_words

    (tmp_path / "d").mkdir()
    (tmp_path / "d/a b.md").write_text("x\r\ny\n", encoding="utf-8")
    (tmp_path / "d/c.html").write_text("<p>hi <b>you</b></p>", encoding="utf-8")
    (tmp_path / "d/e.png").write_bytes(b"\x00")
    (tmp_path / "stop.txt").write_text("the\n\na\n")
    assert [r["path"].replace("%20", " ") for r in list_files(spark, f"file:{tmp_path}/d").collect()] == ["a b.md"]
    assert rows(read_files(spark, f"file:{tmp_path}/d", ("md", "html"))) == [("a b.md", "x\r\ny\n"), ("c.html", "hi you\n")]
    assert stop_words(spark, str(tmp_path / "stop.txt")) == ["a", "the"]
    with pytest.raises(ValueError, match="stop words"):
        stop_words(spark, str(tmp_path / "stop.txt"), most=1)
    tokens = spark.createDataFrame([("the", 1), ("kiln", 2), (None, 3)], "token string, n int")
    assert sorted(r["n"] for r in without_words(tokens, spark.read.text(str(tmp_path / "stop.txt"))).collect()) == [2, 3]


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert load_settings(path) == Settings()
    own = Settings(results=9)
    own.search.extensions = ["txt"]
    save_settings(own, path)
    assert load_settings(path) == own
    assert merge({"a": {"b": 1, "c": [1, 2]}, "d": 1}, {"a": {"c": [3]}}) == {"a": {"b": 1, "c": [3]}, "d": 1}


def test_options_default():
    assert Options() == Options(True, True)


def test_statistics(spark):
    df = spark.createDataFrame([("a.md", "x" * 1024), ("b", None), (None, "é")], "path string, t string")
    assert rows(corpus.count_extensions(df)) == [("md", 1), ("no_extension", 2)]
    assert tuple(corpus.corpus_size(df, "t").first()) == (3, 1026, 1.0, 0.0, False)
    assert tuple(corpus.corpus_size(df.limit(0), "t").first()) == (0, 0, 0.0, 0.0, False)
    assert corpus.split_lines(df.where("t is null"), "path", "t").count() == 0
    history = spark.createDataFrame([(2, "b"), (1, "a")], "id int, query string")
    assert maintain.last_query(history).first()[0] == "b" and maintain.last_query(history.limit(0)).first()[0] == ""
