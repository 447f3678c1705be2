"""p4 to p9: operators on terms, pieces, items and mixes."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import distinctive, frequency, leakage, mixing, splitting, together


def rows(df):
    return sorted(tuple(r) for r in df.collect())


WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    vocabulary = ["Glass", "glass", "Été", "kiln", "ab", "harbour", "x1y", "naïveté", "Ferry", "ferrÿ"]
    out = []
    for i in range(40):
        content = rng.choice([None, "", " ".join(rng.choices(vocabulary, k=rng.randrange(60))) + "\r\n"])
        tags = rng.choice([None, "", " ".join(rng.choices(["#Todo", "todo", "a", "b", "#c", "D", "  ", "#"], k=5))])
        out.append({"note_id": i, "content": content, "tags": tags, "headings": rng.choice([None, "Rareword rareword"])})
    return out


@pytest.fixture(scope="module")
def table(make_notes, data):
    return make_notes(*data, *data[:6], extra=["1 as term", "2 as notes", "3 as occurrences", "4 as n"])


def tags_of(x):
    return {t.lstrip("#").lower() for t in (x["tags"] or "").split() if t.lstrip("#")}


def test_frequency_against_brute_force(table, data):
    occurrences, notes = Counter(), defaultdict(set)
    for x in data:
        terms = [("content", w.lower()) for w in WORD.findall(x["content"] or "") if len(w) >= 3]
        terms += [("tags", t.lstrip("#").lower()) for t in (x["tags"] or "").split() if t.lstrip("#")]
        occurrences.update(terms)
        for t in terms:
            notes[t].add(x["note_id"])
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["notes"]) for r in frequency.term_frequency(table).collect()}
    assert got == {t: (n, len(notes[t])) for t, n in occurrences.items()}
    n = {"content": sum(x["content"] is not None for x in data), "tags": len(data)}
    want = sorted((f, t, "rare" if len(s) == 1 else "common") for (f, t), s in notes.items() if len(s) == 1 or 5 * len(s) >= n[f])
    assert rows(frequency.found(table)) == want
    assert frequency.term_frequency(table.limit(0)).count() == 0


def test_pairs_against_brute_force(table, data):
    got = {(r["tag_a"], r["tag_b"]): r for r in together.tag_pairs(table, min_notes=2, min_share=0).collect()}
    one, two = Counter(), Counter()
    for x in data:
        own = sorted(tags_of(x))
        one.update(own)
        two.update((a, b) for k, a in enumerate(own) for b in own[k + 1 :])
    assert {p: (r["notes_a"], r["notes_b"], r["notes_ab"]) for p, r in got.items()} == {p: (one[p[0]], one[p[1]], n) for p, n in two.items() if n >= 2}
    for (a, b), r in got.items():
        assert r["lift"] == pytest.approx(two[a, b] * len(data) / (one[a] * one[b]))
    beyond = together.tag_pairs(table, min_notes=2, min_share=0, broadcast_tags=0)
    assert rows(beyond) == rows(together.tag_pairs(table, min_notes=2, min_share=0))
    assert together.tag_pairs(table.limit(0)).count() == 0


def test_hot_basket_is_collapsed(make_notes):
    df = make_notes(*({"note_id": i, "tags": "b a #A"} for i in range(200)))
    assert [tuple(r)[:5] for r in together.tag_pairs(df).collect()] == [("a", "b", 200, 200, 200)]


def brute_degree(words, window):
    near = defaultdict(set)
    for i, a in enumerate(words):
        for b in words[max(0, i - window + 1) : i + window]:
            if a != b:
                near[a].add(b)
    return near


def test_weights_against_brute_force(table, data):
    tf, near, notes = {}, {}, defaultdict(set)
    for x in data:
        fields = [[w.lower() for w in WORD.findall(x[f] or "") if len(w) >= 5] for f in ("content", "headings", "tags")]
        for t, n in Counter(w for f in fields for w in f).items():
            tf[x["note_id"], t] = n
            near[x["note_id"], t] = len(set().union(*(brute_degree(f, 4)[t] for f in fields)))
            notes[t].add(x["note_id"])
    got = {(r["note_id"], r["term"]): r for r in distinctive.term_weights(table).collect()}
    assert {k: (r["occurrences"], r["degree"], r["notes"]) for k, r in got.items()} == {k: (n, near[k], len(notes[k[1]])) for k, n in tf.items()}
    for (_, t), r in got.items():
        assert r["score"] == pytest.approx(r["degree"] * np.log((len(data) + 1) / len(notes[t])))
    assert distinctive.found(table).count() == sum(n >= 5 and len(notes[t]) <= 3 for (_, t), n in tf.items())
    assert distinctive.term_weights(table.limit(0)).count() == 0


def check_pieces(text, limit, overlap):
    cuts = splitting.pieces(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in cuts)
    for (a, b, _), (c, d, _) in zip(cuts, cuts[1:], strict=False):
        assert a < d and c <= b and b - c <= overlap and b < d
    return cuts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n,é\u0301\u200d😀。", max_size=300), st.integers(8, 60))
def test_pieces_cover_the_text(text, limit):
    check_pieces(text, limit, limit // 4)
    check_pieces(text, limit, 0)


def test_pieces_of_long_texts():
    text = ("A sentence of words. " * 30 + "\n\n") * 40
    cuts = check_pieces(text, 4000, 200)
    assert all(kind == 5 for _, _, kind in cuts)
    assert len(check_pieces("x" * 100_000, 4000, 200)) >= 25
    assert splitting.pieces("x" * 4000) == [(0, 4000, 5)]


def test_pieces_tables(spark, make_notes):
    long, stuck = "word " * 2000, "x" * 4001
    df = make_notes({"note_id": 1, "path": "a", "content": long}, {"note_id": 1, "path": "a", "content": long}, {"note_id": 2, "path": "b", "content": stuck}, {"note_id": 3, "path": "c", "content": "short"}, {"note_id": 4, "path": "d"}, {"note_id": 5, "path": "e", "content": ""}, {"note_id": 6, "path": "f", "content": "x" * 3990 + "\u200b" * 20}, {"note_id": 7, "path": "g", "content": ("x" * 3999 + "\u3000") * 2}, extra=["1 as kind", "2 as piece_no"])
    other = spark.createDataFrame([("p", "pdf", stuck + "."), ("p", "pdf", stuck + "."), (None, "pdf", "y")], "path string, view_type string, content string")
    assert rows(splitting.found(df, other)) == [("indexed_documents", "a", "bounded"), ("indexed_documents", "b", "unbounded"), ("indexed_documents", "f", "unbounded"), ("indexed_documents", "g", "bounded"), ("semantic_documents", "p", "unbounded")]
    parts = splitting.all_pieces(df, other)
    assert parts.groupBy("table_name", "path", "piece_no").count().where("count > 1").count() == 0
    assert parts.where("path = 'c'").first()["text"] == "short" and parts.where("path in ('d', 'e')").count() == 0
    assert splitting.found(df.limit(0), other.limit(0)).count() == 0


def brute_leaks(documents, items, least):
    found = set()
    for i, t in items:
        own = leakage.words(t)
        spans = {tuple(own[k : k + least]) for k in range(len(own) - least + 1)}
        for d, text in documents:
            w = leakage.words(text)
            if any(tuple(w[k : k + least]) in spans for k in range(len(w) - least + 1)):
                found.add((d, i))
    return sorted(found)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    stock = "which of the statements below is best supported by the text".split()
    make = lambda n: ["".join(rng.choices("abcde", k=3)) for _ in range(n)]
    items = [(i, stock + make(40)) for i in range(12)] + [(50, make(11)), (51, []), (52, make(3))]
    documents = []
    for d in range(120):
        words = make(60)
        if d % 3 == 0:
            i, own = items[rng.randrange(12)]
            n, a = rng.choice([11, 12, 13, 30]), rng.randrange(0, 20)
            words[20:20] = [rng.choice([w.upper(), f"**{w}**", w + ",\n"]) for w in own[a : a + n]]
        if d % 10 == 0:
            words[5:5] = stock
        documents.append((d, " ".join(words)))
    i, own = items[3]
    edited = own[:]
    for k in range(7, len(own), 8):
        edited[k] = "zzz"
    documents += [(500, " ".join(edited)), (501, None), (502, "")]
    texts = [(i, " ".join(w)) for i, w in items] + [(53, None)]
    return documents, texts, spark.createDataFrame(documents + documents[:3], "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as item_id"), spark.createDataFrame(texts, "item_id bigint, text string").selectExpr("*", "0 as doc_id")


def test_leaks_against_brute_force(corpus):
    documents, texts, d, i = corpus
    want = brute_leaks([x for x in documents if x[1]], [x for x in texts if x[1]], 12)
    assert rows(leakage.found(d, i)) == want and len(want) > 10
    blocks = leakage.leaks(d, i, block_bytes=100).where("longest_run >= 12").select("doc_id", "item_id")
    assert rows(blocks) == want
    every = rows(leakage.leaks(d, i).select("doc_id", "item_id"))
    assert (500, 3) in every and (500, 3) not in want
    assert leakage.found(d.limit(0), i).count() == 0 and leakage.found(d, i.limit(0)).count() == 0


def brute_smith_waterman(a, b):
    best, h = 0, np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = leakage.MATCH if a[i - 1] == b[j - 1] else leakage.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + leakage.GAP, h[i, j - 1] + leakage.GAP)
            best = max(best, h[i, j])
    return best


def test_leaks_of_edited_copies(spark):
    rng = random.Random(9)
    make = lambda n: ["".join(rng.choices("abcdefgh", k=4)) for _ in range(n)]
    items = [(i, make(40)) for i in range(7)] + [(8, make(18)), (9, make(150)), (10, make(3))]
    documents = [(1000, make(30) + items[0][1] + make(30)), (1001, ["..."]), (1002, make(900))]
    for i, own in items[:-1]:
        for every in range(4, 13):
            edited = [w if (k + 1) % every else rng.choice(["zz", "zz zz", own[0]]) for k, w in enumerate(own)]
            documents.append((i * 20 + every, make(rng.choice([0, 5, 300])) + edited + make(rng.choice([0, 40]))))
    few = ["a", "b", "c", "d", "e", "f"]
    items += [(20 + i, rng.choices(few, k=rng.randrange(12, 30))) for i in range(6)]
    documents += [(2000 + d, rng.choices(few, k=rng.randrange(80))) for d in range(30)]
    want = set()
    for i, own in items:
        for d, text in documents:
            number = {w: k for k, w in enumerate(own)}
            text = [number.get(w, -1) for w in " ".join(text).split()]
            score, _, longest = leakage.align(np.array([number[w] for w in own]), np.array(text, dtype=np.int64))
            if longest >= 12 or score >= len(own) and len(own) >= 12:
                want.add((d, i, score, longest))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in documents], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string")
    got = set(rows(leakage.leaks(d, i).select("doc_id", "item_id", "score", "longest_run")))
    assert got == want
    assert {(n * 20 + every, n) for n in range(7) for every in range(6, 12)} <= {r[:2] for r in got}


def test_alignment_against_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        a, b = (np.array([rng.randrange(4) for _ in range(rng.randrange(1, 15))]) for _ in range(2))
        assert leakage.align(a, b)[0] == brute_smith_waterman(a, b)


def test_knapsack_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        lengths = np.array(rng.sample(range(1, 15), rng.randrange(1, 5)))
        counts = np.array([rng.randrange(0, 4) for _ in lengths])
        budget = rng.randrange(0, 60)
        sums = {0}
        for x, c in zip(lengths, counts, strict=True):
            sums = {s + k * x for s in sums for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_fit_is_exact_on_a_large_source():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(rng.integers(1, 3000, 200_000), return_counts=True)
    for budget in (12_345_678, 777, 0, 10**12):
        take = mixing.fit(lengths, counts, budget)
        total = int((take * lengths).sum())
        assert (take <= counts).all() and total == min(budget, int((lengths * counts).sum()))


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(11)
    data = [(i, "word " * rng.randrange(1, 30), rng.choice(["Big", " big ", "BIG"])) for i in range(300)]
    data += [(1000 + i, "a b c", "small_one") for i in range(5)] + [(2000 + i, "x y", None) for i in range(5)] + [(3000, None, "big"), (3001, "", "big")]
    documents = spark.createDataFrame(data, "doc_id bigint, text string, source string").selectExpr("*", "1 as tokens", "2 as bucket")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small-one", 0.3, 2), ("absent", 0.2, 3)], "source string, target_share double, max_repeats int")
    return data, documents, targets


def test_mix(mixed):
    data, documents, targets = mixed
    sizes = {r["doc_id"]: r["tokens"] for r in mixing.token_sizes(documents).collect()}
    total = sum(sizes.values())
    mix, report = mixing.mix(documents, targets)
    got = {r["doc_id"]: r for r in mix.collect()}
    assert len(got) == mix.count() and all(r["tokens"] == sizes[i] for i, r in got.items())
    by = {r["source"]: r for r in report.collect()}
    assert sum(r["tokens"] * r["repeats"] for r in got.values() if r["source"] == "big") == by["big"]["tokens_mixed"] == int(0.5 * total)
    assert by["small-one"]["short"] and by["small-one"]["most_repeats"] == 2 and by["small-one"]["documents_mixed"] == 5
    assert by["absent"]["short"] and by["absent"]["tokens_mixed"] == 0
    assert sum(r["share_reached"] for r in by.values()) == pytest.approx(1)
    again = {r["doc_id"]: r["repeats"] for r in mixing.mix(documents.repartition(3), targets)[0].collect()}
    assert again == {i: r["repeats"] for i, r in got.items()}
    assert rows(mixing.found(documents, targets)) == [("absent",), ("small-one",)]
    assert rows(mixing.found(documents.limit(0), targets)) == []
    assert mixing.mix(documents.limit(0), targets)[0].count() == 0


def test_one_length_fills_its_budget(spark):
    documents = spark.createDataFrame([(i, "a b c", "s") for i in range(500)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("s", 0.4, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(documents, targets)[0].count() == 200


def mix_tables(spark, n=900):
    rng = random.Random(3)
    docs = [(k, " ".join(["glass", "kiln", "ferry"][k % 3] for _ in range(rng.randrange(1, 9))), ("a", "b", "c")[0 if k % 10 < 8 else 1 + k % 2]) for k in range(n)]
    targets = [("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.1, 1), ("none", 0.1, 3)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def test_shares_are_met_by_a_smaller_mix(spark):
    docs, targets = mix_tables(spark)
    mixed, report = mixing.mix(docs, targets, meet_shares=True)
    got = {r["source"]: r for r in report.collect()}
    assert got["none"]["tokens_mixed"] == 0 and not any(got[s]["short"] for s in "abc")
    for s in "abc":
        assert abs(got[s]["share_reached"] - got[s]["target_share"] / 0.9) < 0.01 and got[s]["most_repeats"] <= got[s]["max_repeats"]
    assert sum(r["tokens"] * r["repeats"] for r in mixed.collect()) == sum(r["tokens_mixed"] for r in got.values())


def test_buckets_and_spreading_don_t_change_the_mix(spark, monkeypatch):
    docs, targets = mix_tables(spark)
    plain = rows(mixing.mix(docs, targets)[0])
    monkeypatch.setattr(mixing, "PER_BUCKET", 7)
    assert rows(mixing.mix(docs, targets)[0]) == plain
    monkeypatch.setattr(mixing, "BROADCAST_LENGTHS", 1)
    assert rows(mixing.mix(docs, targets)[0]) == plain
    assert sorted(r[0] for r in mixing.found(docs, targets).collect()) == ["b", "c", "none"]


def test_all_pairs_come_without_a_threshold(spark, make_notes):
    df = make_notes({"note_id": 1, "tags": "a b"}, {"note_id": 2, "tags": "b c"}, {"note_id": 3, "tags": "#A c b"}, {"note_id": 4, "tags": None})
    assert rows(together.tag_pairs(df).select("tag_a", "tag_b", "notes_ab")) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 2)]
    assert rows(together.tag_pairs(df, broadcast_tags=0)) == rows(together.tag_pairs(df))
    assert rows(together.tag_pairs(df, min_notes=2).select("tag_a", "tag_b")) == [("a", "b"), ("b", "c")]


def test_common_terms_join_alike(make_notes):
    df = make_notes(*({"note_id": k, "content": f"glass kiln harbour number{'abcdefgh'[k]} furnace"} for k in range(8)), {"note_id": 8, "content": "x y"}, {"note_id": 9, "content": None})
    plain = rows(distinctive.term_weights(df))
    assert rows(distinctive.term_weights(df, broadcast_terms=2)) == plain and len(plain) == 8 * 4
    assert rows(distinctive.term_weights(df, broadcast_terms=1).where("term = 'glass'"))[0][4] == 8


def test_short_items_and_recall_of_edits(spark):
    """Items of one to three words are found whole; of copies with every third to eleventh word changed, all that keep the share."""
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice((14, 25, 40, 80))))) for k in range(40)] + [(100, "Zebra"), (101, "blue zebra"), (102, "one blue zebra")]
    docs, true = [], set()
    for k in range(200):
        i, text = items[rng.randrange(40)]
        words = text.split()
        every, begin = rng.choice((3, 4, 5, 6, 8, 11)), rng.randrange(3)
        for at in range(begin, len(words), every):
            if at < len(words):
                words[at : at + 1] = rng.choice(([], ["new"], [words[at], "more"]))
        docs.append((k, " ".join(rng.choices(vocabulary, k=60) + words + rng.choices(vocabulary, k=60))))
        true.add((k, i))
    docs += [(900, "the blue, Zebra runs"), (901, "one blue sky"), (902, None), (903, "")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.leaks(d, i, block_bytes=2000).collect()}
    assert {k for k in got if k[1] >= 100} == {(900, 100), (900, 101)}
    own = dict(docs)
    vocab = {w: n for n, w in enumerate({w for _, t in [*items, *docs] for w in leakage.words(t)})}
    code = lambda t: np.array([vocab[w] for w in leakage.words(t)])
    reach = set()
    for doc, item in true:
        score, _, longest = leakage.align(code(dict(items)[item]), code(own[doc]))
        n = len(code(dict(items)[item]))
        if longest >= 12 or score >= n * leakage.MATCH * 0.5:
            reach.add((doc, item))
    assert reach <= set(got) and len(reach) > 60


def test_terms_of_any_script(make_notes):
    df = make_notes({"note_id": 1, "content": "печь Печь kiln 2x"}, {"note_id": 2, "content": "печь"})
    got = {r["term"]: (r["occurrences"], r["notes"]) for r in frequency.term_frequency(df, letters=r"\p{L}").where("field_name = 'content'").collect()}
    assert got == {"печь": (3, 2), "kiln": (1, 1)}
