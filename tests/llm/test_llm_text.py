"""p1, p2, p3, p10: operators on characters, markup and languages."""

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import garbling, language, lookalikes, markup


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def marks(text):
    return sorted(set(markup.clean(text)[1]))


@pytest.mark.parametrize(
    "line,family",
    [
        ("a <br> b", "html"), ("a < br >b", "html"), ("</a >x", "html"), ("x <!-- todo --> y", "html"), ("a &amp; b", "html"), ("a &nbsp b", "html"), ("&#xE9;", "html"), ("<o:p>x</o:p>", "html"),
        ("# Title", "markdown"), ("- [ ] task", "markdown"), ("> [!note]", "markdown"), ("a **b** c", "markdown"), ("a ==b== c", "markdown"), ("a %%b%% c", "markdown"), ("x[^3] y", "markdown"), ("[2]: a/b.md", "markdown"),
        ("| a | b |", "markdown"), (r"\*a\* b", "markdown"), ("`x` y", "markdown"), ("![](a.png)", "markdown"), ("[a](<b c.md> \"d\")", "markdown"), ("[gives][7]", "markdown"), ("1) x", "markdown"), ("***", "markdown"),
        ("[[a]]", "wiki"), ("![[a.png]]", "wiki"), ("{{note|x}}", "wiki"), ("{{{x|}}}", "wiki"), ("a ''b'' c", "wiki"), ("== T ==", "wiki"), ("{{cite|a={{date|2020}}|b=x}}", "wiki"),
        (r"\emph{a} b", "latex"), ("a $n^2$ b", "latex"), (r"a \(x\) b", "latex"), (r"\[ a = b \]", "latex"), ("$$x$$", "latex"), (r"40\% x", "latex"), (r"5\,km", "latex"), (r"caf\'e", "latex"), (r"{\bf a}", "latex"), (r"\begin{itemize}", "latex"), (r"a \& co", "latex"),
    ],
)
def test_markup_is_seen(line, family):
    assert marks(line) == [(0, family)]


@pytest.mark.parametrize(
    "line",
    ["a < b, c > d", "10 > 9", "<3", "<- x", "a -> b", "R&D", "50% & more", "$5 - $12", "x == y", "f(x) = {a, b}", "3 | 4", "2 * 3 * 4 = 24", "5'' x 7''", "(see *)", "snake_case_name", "file_name_v2.txt", r"C:\data\new\table", "text [3]", "~40 kg", "text #7", "", "  ", "just words"],
)
def test_prose_is_left_alone(line):
    assert marks(line) == []
    assert markup.clean(line)[0] == line.strip()


def test_code_is_content():
    text = "```python\n<b>**x**</b> $a$ [[b]]\n```\n~~~\n```\n~~~\n<pre><code>\n&amp; \\frac{1}{2}\n</code></pre>\n`$x$ [[y]]` z"
    assert marks(text) == [(0, "markdown"), (2, "markdown"), (3, "markdown"), (5, "markdown"), (6, "html"), (8, "html"), (9, "markdown")]
    assert "<b>**x**</b> $a$ [[b]]" in markup.clean(text)[0]


def test_blocks_over_lines():
    assert marks('{| class="x"\n|-\n| a || b\n|}') == [(k, "wiki") for k in range(4)]
    assert marks("\\begin{equation}\nE = mc\n\\end{equation}") == [(0, "latex"), (2, "latex")]
    assert marks("<!-- a\nb\n-->") == [(0, "html"), (2, "html")]
    assert marks("Title\n=====\n\ntext") == [(1, "markdown")]
    assert marks("{{box\n|a=b\n}}") == [(0, "wiki"), (1, "wiki"), (2, "wiki")]
    assert marks("```\nnever closed\n# x") == [(0, "markdown")]


def test_structure_stays():
    clean = markup.clean("# A\n\n* one\n* **two**\n\n\\section{B}\n$x^2$ is \\emph{it}\n<h2>C</h2>\nsee [l](u)\n* x\n  * y")[0]
    assert clean == "# A\n\n- one\n- two\n\n## B\n\n$x^2$ is it\n\n## C\n\nsee l\n- x\n  - y"


def test_blocks_of_links_go():
    prose = "Long prose, with commas, and more, that scores well. " * 8
    text = f"[a](b) [c](d) [e](f)\n\n{prose}\n\n# H\n\nkept"
    clean = markup.clean(text)[0]
    assert "a c e" not in clean and "kept" in clean and "# H" in clean
    only = markup.clean("[a](b)")[0]
    assert only in ("a", "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n*_`$<>[]{}|=\\&;#~'%-/!()", max_size=80))
def test_markup_never_fails(text):
    clean, found = markup.clean(text)
    assert isinstance(clean, str) and all(0 <= r <= text.count("\n") and f in markup.FAMILIES for r, f in found)


def test_long_lines_stay_fast():
    import time

    began = time.time()
    for sign in ("*a ", "[[", "{{", "`", "_b ", "$a ", "<", "''", "\\x{"):
        markup.clean(sign * 20_000)
    assert time.time() - began < 60


def test_markup_tables(make_notes):
    df = make_notes({"note_id": 1, "content": "a **b**\r\n<br>"}, {"note_id": 1, "content": "a **b**\r\n<br>"}, {"note_id": 2}, {"note_id": 3, "content": ""}, {"note_id": None, "content": "# x"}, extra=["1 as clean", "'q' as family"])
    assert rows(markup.found(df.where("note_id is not null"))) == [(1, 0, "markdown"), (1, 1, "html")]
    assert markup.found(df).count() == 3 and markup.found(df.limit(0)).count() == 0
    assert {r["note_id"]: r["clean"] for r in markup.cleaned(df.where("note_id = 3")).collect()} == {3: ""}


def test_clean_lines(spark):
    df = spark.createDataFrame([(1, 0, "**a**"), (1, 1, None), (1, 0, "**a**"), (2, 0, "")], "note_id bigint, row_no int, text string")
    assert sorted(map(str, (r["clean"] for r in markup.cleaned_lines(df).collect()))) == ["", "None", "a", "a"]


def test_clean_lines_keep_their_notes_state(spark):
    code = "```sh\n# total per folder\ncp <b>a</b> &amp; **x** {{ slot }}\n```\n# Head"
    other = "<pre>\n**kept** &lt;\n</pre>\n<!-- not\n**this**\n--> after\n\\begin{align}\na_1 &= b \\\\\n\\end{align}\n{| class=x\n! a !! b\n|-\n| **c** || d\n|}\nTitle\n=====\n$$\nx*y*z\n$$\n*end*\r"
    notes = {1: code, 2: other, 3: "```\n" + "**a**\n" * 3000 + "```\n**b**", 4: "**c**\n\n---"}
    table = [(n, r, t or None) for n, text in notes.items() for r, t in enumerate(text.split("\n"))]
    random.Random(2).shuffle(table)
    table += table[:50] + [(None, 1, "**d**"), (1, None, "```")]
    df = spark.createDataFrame(table, "note_id bigint, row_no int, text string").repartition(3)
    want = {(n, b.row): (b.text, b.kind) for n, text in notes.items() for b in markup.Reader().read(text)} | {(None, 1): ("d", "paragraph"), (1, None): ("```", "fence")}
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = markup.cleaned_lines(df).collect()
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(str, ((r["note_id"], r["row_no"]) for r in got))) == sorted(map(str, (t[:2] for t in table)))
        null = {t[:2] for t in table if t[2] is None}
        assert all((r["clean"], r["kind"]) == ((None, None) if (r["note_id"], r["row_no"]) in null else want[r["note_id"], r["row_no"]]) for r in got)
    assert want[1, 1] == ("# total per folder", "code") and want[1, 2][0] == "cp <b>a</b> &amp; **x** {{ slot }}" and want[1, 4][1] == "heading"


def test_spans_have_no_bound():
    long = "word " * 3000 + "word"
    for start, end, family in (("%%", "%%", "markdown"), ("$$", "$$", "latex"), ("\\[", "\\]", "latex"), ("`", "`", "markdown"), ("**", "**", "markdown"), ("__", "__", "markdown"), ("~~", "~~", "markdown"), ("==", "==", "markdown"), ("\'\'\'", "\'\'\'", "wiki")):
        text, marks = markup.clean(f"before {start}{long}{end} after\nnext **b**")
        inner = "" if start == "%%" else start + long + end if family == "latex" else long
        assert (text, marks) == (f"before {inner} after\nnext b", sorted({(0, family), (1, "markdown")}))
    text, marks = markup.clean("a <code>**x**</code> " * 50 + "<script>y</script>" * 50 + "`" + "<b>" * 2000 + "`")
    assert text == "a **x** " * 50 + "<b>" * 2000 and marks == [(0, "html"), (0, "markdown")]


def test_lists_of_links_stay():
    prose = "The kiln is hot, the glass is slow, and the ferry waits. " * 8
    index = "- [[Kiln]]\n- [[Glass|the glass]]\n- [Ferry](ferry.md)"
    text, _ = markup.clean(f"# Index\n{prose}\n{index}\n\n## More\n* [[Sand]]\n\n[Home](a.md) [Next](b.md)")
    assert text == f"# Index\n\n{prose.strip()}\n- Kiln\n- the glass\n- Ferry\n\n## More\n\n- Sand"


@pytest.mark.parametrize("sign", ["$$", "\\[", "%%", "<pre", "<!--", "\\begin{"])
def test_signs_without_an_end_are_text(sign):
    lines = language.spoken_lines(f"one {sign} two\nthree\nfour")
    assert lines[0].startswith("one") and lines[1:] == ["three", "four"]
    end = {"$$": "$$", "\\[": "\\]", "%%": "%%", "<pre": "</pre", "<!--": "-->", "\\begin{": "\\end{"}[sign]
    assert language.spoken_lines(f"one {sign} two\nthree\n{end}\nfour\nfive {sign} six\nseven")[1:4] == ["", "", "four"]
    assert language.spoken_lines(f"one {sign} two\nthree\n{end}\nfour\nfive {sign} six\nseven")[5] == "seven"


def disguise(text, rng):
    spaces = "\u00a0\u2007\u2009\u202f"
    twins = {v: k for k, v in lookalikes.PROTOTYPES.items() if v.isalpha()}
    out = []
    for c in unicodedata.normalize("NFD", text) if rng.random() < 0.5 else text:
        r = rng.random()
        if c == " " and r < 0.5:
            c = rng.choice(spaces)
        elif "!" <= c <= "~" and r < 0.3 and c.isalnum():
            c = chr(ord(c) + 0xFEE0)
        elif c in twins and r < 0.6:
            c = twins[c]
        out.append(c + (rng.choice("\u200b\u200d\u00ad\u2060\ufeff") if rng.random() < 0.2 else ""))
    return "".join(out).replace("\n", rng.choice(["\n", "\r\n"]))


def test_disguises_have_one_skeleton():
    rng = random.Random(5)
    for text in ("Glass furnace Étélithal 293", "Mürpanvik\nx CAPE", "岚桥 12", "Ёлка ёж", ""):
        for _ in range(40):
            assert lookalikes.skeleton(disguise(text, rng)) == lookalikes.skeleton(text)


@pytest.mark.parametrize("a,b", [("Foo", "foo"), ("resume", "résumé"), ("O1", "0l"), ("a1", "al"), ("x²", "x2"), ("½", "1/2"), ("a b", "ab"), ("a\nb", "a b"), ("teh", "the"), ("a–b", "a-b")])
def test_visible_differences_stay(a, b):
    assert lookalikes.skeleton(a) != lookalikes.skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_skeletons_are_stable(text):
    once = lookalikes.skeleton(text)
    assert lookalikes.skeleton(once) == once
    assert lookalikes.consistent(lookalikes.consistent(text)) == lookalikes.consistent(text)


def test_same_looking_against_brute_force(make_notes):
    rng = random.Random(9)
    data = []
    for i in range(60):
        text = rng.choice(["Glass furnace", "Chess evening", "Mürvik"])
        data.append({"note_id": i, "basename": disguise(text, rng) if rng.random() < 0.6 else text, "content": rng.choice([None, "", " \u200b", "a\r\nb", "a\nb"])})
    df = make_notes(*data, *data[:5], extra=["0 as key", "'x' as stored"])
    want = set()
    for field in ("basename", "content"):
        for x in data:
            for y in data:
                a, b = x[field], y[field]
                if x["note_id"] < y["note_id"] and a and b and a != b and lookalikes.skeleton(a) == lookalikes.skeleton(b) and lookalikes.skeleton(a).strip():
                    want.add((field, x["note_id"], y["note_id"]))
    got = rows(lookalikes.same_looking(df))
    assert len(got) == len(set(got)) and set(got) == want
    assert lookalikes.same_looking(df.limit(0)).count() == 0
    assert lookalikes.normalized(df).count() == 65


TEXTS = {
    "en": "The harbour fee was written in a hurry because of the rain and the old ferry depends on the older version. ",
    "de": "Die Glashütte wurde in großer Eile geschrieben, und der Haushaltsplan bleibt bis zum Herbst geöffnet. ",
    "fr": "La récolte des roseaux rend le travail plus facile parce que le vieux bac attend toujours une réponse. ",
    "es": "El diario de viaje todavía espera una respuesta pero la colmena del pueblo remite a una página anterior. ",
    "pt": "O registo do tempo torna o trabalho mais fácil mas a velha balsa não será verificada amanhã de manhã. ",
    "ru": "Ночной поезд заменяет старую версию, потому что зимний бюджет всё ещё ждёт ответа до осени. ",
    "zh": "整个春天，夜班火车证实了我们的猜测，而且天气记录仍然在等待答复。",
}


@pytest.fixture(scope="module")
def language_notes(make_notes):
    rng, data = random.Random(2), []
    labels = {"en": "en-US", "de": "German", "fr": "fra", "es": "ES", "pt": "pt_BR", "ru": "rus", "zh": "zh-Hans"}
    for i in range(140):
        lang = list(TEXTS)[i % 7]
        words = TEXTS[lang].split(" ")
        content = "\n".join(" ".join(words) + TEXTS[lang] for _ in range(1 + rng.randrange(3))) * 2
        data.append({"note_id": i, "content": content, "lang": labels[lang] if i % 10 else rng.choice([None, "und", "", "xx"])})
    data.append({"note_id": 200, "content": TEXTS["en"] * 4, "lang": "de"})
    data.append({"note_id": 201, "content": f"{TEXTS['fr'] * 2}\n{TEXTS['de']}\n```\nthe code and the rest of it\n```\n{TEXTS['fr'] * 2}", "lang": "FR"})
    data += [{"note_id": 202, "lang": "en"}, {"note_id": 203, "content": "", "lang": None}, {"note_id": 204, "content": "$x$ 12 --", "lang": None}, {"note_id": 201, "content": data[-1]["content"], "lang": "FR"}]
    return make_notes(*data, extra=["'z' as label", "1 as confidence"])


def test_languages(language_notes):
    got = {(r["note_id"], r["row_no"]): r["lang"] for r in language.found(language_notes).collect()}
    for i in range(0, 140, 10):
        assert got.pop((i, -1)) == list(TEXTS)[i % 7]
    assert got == {(200, -1): "en", (201, 1): "de"}
    every = language.languages(language_notes)
    assert every.groupBy("note_id", "row_no").count().where("count > 1").count() == 0
    assert every.where("confidence < 0 or confidence > 1").count() == 0
    assert language.languages(language_notes.limit(0)).count() == 0


def test_held_out_accuracy(language_notes):
    model = language.train(language_notes, per_language=12)
    right = total = 0
    for k, (lang, text) in enumerate(TEXTS.items()):
        for part in (text[: len(text) // 2], text[len(text) // 2 :]):
            scores = model.scores([part])[0]
            right += language.LANGUAGES[int(scores[0].argmax())] == lang
            total += 1
    assert right == total


def test_spoken_lines_keep_their_number():
    text = "a\n```\ncode\n```\n\\begin{equation}\nx\n\\end{equation}\nb `c` <i>d</i>\n"
    lines = language.spoken_lines(text)
    assert len(lines) == text.count("\n") + 1 and lines[2] == "" and "code" not in " ".join(lines) and "c" not in lines[7].split()


def wrong(text, layers):
    for meant, read in layers:
        text = text.encode(meant).decode(read)
    return text


@pytest.mark.parametrize(
    "text,layers",
    [
        ("Le relevé de la rivière près de Çelborg", [("utf-8", "latin-1")]), ("Die Glashütte führt jedes Werkzeug", [("utf-8", "cp1252")]), ("réunion", [("utf-8", "cp437")]), ("Reunión del consejo", [("utf-8", "mac_roman")]),
        ("Ночной поезд заменяет старую версию", [("cp1251", "latin-1")]), ("Ночной поезд заменяет старую версию", [("koi8-r", "latin-1")]), ("второй черновик относится к той же теме", [("koi8-r", "cp1251")]), ("Собрание совета занимает три раздела", [("utf-8", "cp866")]),
        ("按照新的规定在岚溪的旅行日记", [("gbk", "latin-1")]), ("按照新的规定在岚溪的旅行日记还需要", [("utf-8", "latin-1")]), ("près de la réunion", [("utf-8", "cp1252"), ("utf-8", "cp1252")]), ("l’atelier “ok” 17 °C", [("utf-8", "latin-1")]),
    ],
)
def test_garbling_round_trip(text, layers):
    new, passages, depth, whole = garbling.repair("Plain start. " + wrong(text, layers) + " plain end.")
    assert new == "Plain start. " + text + " plain end." and passages >= 1 and whole and depth >= 1


@pytest.mark.parametrize(
    "text",
    ["MANUTENÇÃO DA ESTAÇÃO: NÃO HÁ DECISÃO", "où faut-il ranger “était” – déjà\u00a0»", "¿Qué caja guarda?", "½ l, 17 °C, © 2020, 3 × 4 m", "Субботний рынок остаётся «В» и “К”", "HŒVVASTEAD Å Ø æ ß", "按照新的规定，在岚溪。", "Москва—город, А-Я", "", "plain"],
)
def test_right_text_is_left_alone(text):
    assert garbling.repair(text) == (text, 0, 0, True)


def test_lost_characters_are_found_but_not_recovered():
    new, passages, _, whole = garbling.repair("near Ibka\ufffdker was")
    assert passages == 1 and not whole


def test_garbled_tables(spark):
    data = [(1, "prÃ¨s de"), (2, None), (3, ""), (4, "fine"), (1, "prÃ¨s de"), (5, "é")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "0 as passages", "'x' as layers")
    assert rows(garbling.found(df)) == [(1,)]
    assert [r["text"] for r in garbling.garbled(df).collect()] == ["près de", "près de"]
    assert garbling.found(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé àÇ½В»»Г—“”—\u00a0Ðñж©ß，的", max_size=25))
def test_repair_never_fails(text):
    new, passages, layers, whole = garbling.repair(text)
    assert isinstance(new, str) and (passages == 0) <= (new == text) and (not whole or (passages == 0) == (new == text))
