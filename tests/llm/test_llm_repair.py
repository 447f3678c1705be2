"""p10: round trips in many languages, nested layers, and texts that must stay as they are."""

import pytest

from marginalia.llm.garbling import BYTES, READ_AS, cost, garbled, repair

TEXTS = {
    "pl": "Zażółć gęślą jaźń, proszę państwa. Każdy może przyjść.", "cs": "Příliš žluťoučký kůň úpěl ďábelské ódy.", "tr": "Pijamalı hasta yağız şoföre çabucak güvendi.",
    "el": "Καλημέρα κόσμε, τι κάνετε σήμερα;", "he": "שלום עולם, מה שלומך היום?", "ar": "مرحبا بالعالم، كيف حالك اليوم؟", "ko": "안녕하세요 세계, 오늘은 어떻습니까?",
    "vi": "Xin chào thế giới, hôm nay trời đẹp quá.", "th": "สวัสดีชาวโลก", "hi": "नमस्ते दुनिया, आप कैसे हैं?", "ja": "こんにちは世界、今日はいい天気です。", "zh": "今天天气很好，我们去公园散步。",
    "ru": "Привет, мир! Как дела сегодня?", "uk": "Привіт, світе! Як справи сьогодні, їжак?", "sr": "Љубав и њежност, ђак џеп ћерка", "de": "Grüße aus München, schöne Straße",
    "fr": "Voilà l’été à la plage, où «café»… l'Île", "is": "Það er gott að þú ert hér, Ísland", "ro": "Țara și județul în mâini bune",
}


def read_as(raw: bytes, codec: str) -> str:
    back = {b: c for c, b in BYTES[codec].items()}
    return "".join(chr(b) if b < 128 else back.get(b, chr(b)) for b in raw)


@pytest.mark.parametrize("language", TEXTS)
def test_sound_text_stays(language):
    assert repair(TEXTS[language]) == (TEXTS[language], 0, 0, True)


@pytest.mark.parametrize("language", TEXTS)
@pytest.mark.parametrize("codec", READ_AS)
def test_utf8_read_as_legacy(language, codec):
    text = TEXTS[language]
    new, passages, layers, whole = repair(read_as(text.encode(), codec))
    assert (new, layers, whole) == (text, 1, True) and passages > 0


@pytest.mark.parametrize("layers", [2, 5, 9])
def test_layers_have_no_limit(layers):
    text = TEXTS["de"]
    for _ in range(layers):
        text = read_as(text.encode(), "latin-1")
    assert repair(text)[0] == TEXTS["de"] and repair(text)[2:] == (layers, True)


@pytest.mark.parametrize("language,codec", [("el", "cp1253"), ("he", "cp1255"), ("ar", "cp1256"), ("tr", "cp1254"), ("pl", "cp1250"), ("cs", "cp1250"), ("ko", "euc-kr"), ("th", "cp874")])
def test_what_cannot_be_told_is_left(language, codec):
    text = read_as(TEXTS[language].encode(codec, "ignore"), "cp1252")
    assert repair(text)[0] == text


def test_remainder_is_not_recovered():
    text = "Schöne Straße: MÃ¼nchen, GrÃ¼Ã\x9fe und Ã\x83 \x81"
    new, passages, _, whole = repair(text)
    assert new == text and passages and not whole


def test_signs_beside_letters_are_no_sequences():
    for text in ("Spaß… und Maß»", "CAFÉ… «été»…", "5 °C, Â und Ã allein", "naïve – déjà vu… 10 µm", "é»… ok"):
        assert repair(text)[0] == text


def test_cost_falls_by_the_repair():
    for text in TEXTS.values():
        if not text.isascii():
            assert cost(read_as(text.encode(), "cp1252")) > cost(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, read_as(TEXTS["el"].encode(), "latin-1"), 0), (2, None, 0), (3, "", 0), (4, TEXTS["he"], 0), (None, "GrÃ¼Ã\x9fe", 0)], "doc_id bigint, text string, passages int")
    got = {r["doc_id"]: r["text"] for r in garbled(df).collect()}
    assert got == {1: TEXTS["el"], None: "Grüße"}
    assert garbled(df.limit(0)).count() == 0
