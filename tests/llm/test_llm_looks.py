"""p2: the public table of look-alikes, and classes."""

import pytest
from pyspark import SparkContext

from marginalia.llm import lookalikes as L


@pytest.fixture(scope="module")
def table(spark):
    return L.with_more(L.confusables(spark))


@pytest.mark.parametrize("a,b", [("Ꭺpple", "Apple"), ("ꓐook", "Book"), ("ᴄode", "code"), ("Ьank", "bank"), ("раypal", "paypal"), ("ｗｉｄｅ", "wide"), ("ﬁne", "fine"), ("café", "café"), ("a​b", "ab"), ("x y", "x y"), ("𝐛old", "bold")])
def test_same_look(table, a, b):
    assert L.skeleton(a, table) == L.skeleton(b, table)


@pytest.mark.parametrize("a,b", [("Il", "l1"), ("modern", "modem"), ("O2", "02"), ("cafe", "café"), ("Case", "case"), ("a – b", "a - b"), ("٥", "0"), ("x²", "x2"), ("日", "曰"), ("ёлка", "елка")])
def test_what_shows_counts(table, a, b):
    assert L.skeleton(a, table) != L.skeleton(b, table)


def test_skeletons_are_stable(table):
    for c in map(chr, list(range(0x80, 0x3000)) + list(range(0xA000, 0xAC00))):
        once = L.skeleton(c, table)
        assert L.skeleton(once, table) == once, (c, once)


def test_classes(make_notes):
    notes = make_notes({"note_id": 1, "basename": "Ꭺpple"}, {"note_id": 2, "basename": "Apple"}, {"note_id": 3, "basename": "Apple"}, {"note_id": 3, "basename": "Apple"}, {"note_id": 4, "basename": "apple"}, {"note_id": 5, "basename": " "}, {"note_id": None, "basename": "Apple"}, {"note_id": 6, "basename": "kiln"}, {"note_id": 7, "basename": "kiln"}, extra=["1 as key", "2 as stored", "3 as n"])
    own = [r for r in L.classes(notes).collect() if r["field_name"] == "basename"]
    assert sorted((r["note_id"], r["n_forms"], r["n_notes"]) for r in own) == [(1, 2, 3), (2, 2, 3), (3, 2, 3)]
    assert len({r["class_id"] for r in own}) == 1 and len({r["form_id"] for r in own}) == 2
    pairs = sorted(tuple(r) for r in L.same_looking(notes).collect() if r["field_name"] == "basename")
    assert pairs == [("basename", 1, 2), ("basename", 1, 3)]
    assert L.classes(notes.limit(0)).count() == 0


def test_large_classes_are_spread_alike(make_notes, monkeypatch):
    notes = make_notes(*({"note_id": k, "basename": "Apple" if k % 3 else "Ꭺpple"} for k in range(12)))
    plain = sorted(map(tuple, L.same_looking(notes).collect()))
    monkeypatch.setattr(L, "LARGE", 2)
    assert sorted(map(tuple, L.same_looking(notes).collect())) == plain and len(plain) >= 32


class WithoutIcu:
    """A JVM whose packages under com hold no classes."""

    def __init__(self, jvm):
        self.jvm = jvm

    def __getattr__(self, name):
        return getattr(self.jvm.absent if name == "com" else self.jvm, name)


@pytest.mark.parametrize("run", [L.classes, L.same_looking, L.normalized])
def test_a_missing_table_is_an_error(make_notes, monkeypatch, run):
    notes = make_notes({"note_id": 1, "basename": "Ꭺpple"}, {"note_id": 2, "basename": "Apple"}, extra=["1 as key", "2 as stored"])
    monkeypatch.setattr(SparkContext, "_jvm", WithoutIcu(SparkContext._jvm))
    with pytest.raises(RuntimeError, match="SpoofChecker"):
        run(notes).collect()
