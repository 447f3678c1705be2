"""p3: notes without id, without labels, and in none of the languages."""

from pathlib import Path

import pyarrow.parquet as pq
import pytest

from marginalia.llm import language as L

SENTENCES = {
    "en": "The town council decided to postpone its meeting because the mayor was absent, but the library stays open until evening.",
    "de": "Der Gemeinderat hat beschlossen, die Sitzung zu verschieben, weil der Bürgermeister abwesend war, doch die Bücherei bleibt offen.",
    "fr": "Le conseil municipal a décidé de reporter la réunion parce que le maire était absent, mais la bibliothèque reste ouverte.",
    "es": "El ayuntamiento decidió aplazar la reunión porque el alcalde estaba ausente, pero la biblioteca sigue abierta hasta la noche.",
    "ru": "Городской совет решил отложить заседание, потому что мэр отсутствовал, но библиотека открыта до вечера.",
    "zh": "市议会决定推迟会议，因为市长缺席，但图书馆一直开放到晚上。",
}


def table(make_notes, *rows):
    return make_notes(*({"note_id": i, "lang": label, "content": text} for i, label, text in rows))


def test_notes_without_id_stay_apart_and_without_labels_are_told(make_notes):
    notes = table(make_notes, (None, None, SENTENCES["de"]), (None, None, SENTENCES["fr"]), (None, "", SENTENCES["de"] + " Danach gehen wir nach Hause."), (7, None, SENTENCES["en"]), (7, None, SENTENCES["en"]))
    got = sorted((r["note_id"] or 0, r["lang"]) for r in L.languages(notes).where("row_no = -1").collect())
    assert got == [(0, "de"), (0, "de"), (0, "fr"), (7, "en")]
    assert L.languages(notes.limit(0)).count() == 0


@pytest.mark.parametrize("language", SENTENCES)
def test_common_words_tell_the_language(language):
    model = L.Model(L._seeds(list(range(len(L.LANGUAGES)))))
    assert L.judge(SENTENCES[language], model, 3, 3.0)[0][1] == language


def test_a_language_without_labelled_notes_is_found(make_notes):
    notes = table(make_notes, *((k, "en", f"{SENTENCES['en']} Number {k}.") for k in range(4)), (9, "en", SENTENCES["ru"]), (10, None, SENTENCES["de"]))
    got = {r["note_id"]: r["lang"] for r in L.languages(notes).where("row_no = -1").collect()}
    assert got[9] == "ru" and got[10] == "de" and got[0] == "en"


@pytest.fixture(scope="module")
def model(spark):
    path = Path("/root/testdata/sf0.1/indexed_documents.parquet")
    if not path.exists():
        pytest.skip("no tables")
    return L.train(spark.read.parquet(str(path)))


@pytest.mark.parametrize(
    "text",
    [
        "Il consiglio comunale ha deciso di rimandare la riunione perché il sindaco era assente, ma la biblioteca resta aperta fino a sera.",
        "De gemeenteraad heeft besloten de vergadering uit te stellen omdat de burgemeester afwezig was en de bibliotheek blijft open.",
        "Rada miasta postanowiła przełożyć spotkanie, ponieważ burmistrz był nieobecny, ale biblioteka pozostaje otwarta.",
        "Το δημοτικό συμβούλιο αποφάσισε να αναβάλει τη συνεδρίαση", "시의회는 시장이 불참했기 때문에 회의를 연기하기로 결정했다 그래서 도서관은 저녁까지 문을 연다 그리고 모두가 집에 갔다",
    ],
)
def test_other_languages_are_unknown(model, text):
    assert L.judge(text, model, 3, 3.0)[0][1] == L.UNKNOWN


def test_known_languages_are_known_and_sure(model):
    for language, text in SENTENCES.items():
        assert L.judge(text, model, 3, 3.0)[0][1] == language and L.judge(text, model, 3, 3.0)[0][2] > 0.9
    mixed = L.judge(SENTENCES["en"] + "\n" + SENTENCES["de"], model, 3, 3.0)
    assert 0.3 < mixed[0][2] < 0.7 and mixed[1][0] in (0, 1)


def test_held_out_notes(spark, model):
    """Notes that weren't in the sample: the language agrees with the label of all but wrong labels."""
    notes = pq.read_table("/root/testdata/sf0.01/indexed_documents.parquet", columns=["content", "lang"]).to_pylist()
    names = {n: c for c, ns in L.LABELS.items() for n in ns.split()}
    told = [(names[x["lang"].lower()], L.judge(x["content"], model, 3, 3.0)) for x in notes if x["content"] and (x["lang"] or "").lower() in names]
    told = [(label, found[0][1]) for label, found in told if found]
    assert len(told) > 200 and sum(a == b for a, b in told) / len(told) > 0.9
