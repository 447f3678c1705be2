"""p1: the tree of containers, and spans and nests of any size."""

import pytest

from marginalia.llm import markup as M

PAGE = """<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></nav>
<div class="cookie">We use cookies. <button>Accept</button></div>
<article>
<h1>Glass furnaces</h1>
<p>The furnace, which was built in 1890, holds the heat for days, and the glass, once molten, is drawn by hand, slowly, into long canes.</p>
<p>Later, the canes are cut, sorted, and stored, until the winter market opens in town, when buyers from the coast arrive.</p>
<ul>
<li>sand</li>
<li>soda &amp; lime</li>
</ul>
<pre>code = "a, b"</pre>
<p>Its heat is $Q = mc$.</p>
<aside><a href="/1">Older post</a> <a href="/2">Newer post</a></aside>
</article>
<footer>© 2024 Example | <a href="/t">Terms</a> | <a href="/p">Privacy</a></footer>"""


@pytest.mark.parametrize("page", [PAGE, PAGE.replace("\n", ""), "<body><div>" + PAGE + "</div></body>"])
def test_the_article_stays_and_what_is_around_it_goes(page):
    clean, _ = M.clean(page)
    for word in ("Home", "About", "cookies", "Accept", "Terms", "Privacy", "2024", "Older"):
        assert word not in clean
    for part in ("# Glass furnaces", "The furnace, which", "Later, the canes", "- sand", "- soda & lime", 'code = "a, b"', "$Q = mc$"):
        assert part in clean


def test_a_note_outside_containers_is_kept_whole():
    note = "# Note\nSome text.\n<div>a callout</div>\nmore text, with commas, and so on.\n## Index\n- [[a]]\n- [[b]]\n<div>\nsecond, callout, of some length, with commas\n</div>"
    clean, _ = M.clean(note)
    assert all(x in clean for x in ("# Note", "Some text.", "a callout", "more text", "- a", "- b", "second, callout"))


@pytest.mark.parametrize("note,expected", [("</div>a</article>", "a"), ("<div>a\n\nb", "a\n\nb"), ("<nav>a</div></nav>b", "a\nb"), ("<article></article>", ""), ("<div><div><div>x</div>", "x")])
def test_unpaired_tags_do_no_harm(note, expected):
    assert M.clean(note)[0] == expected


def test_containers_of_any_depth():
    assert M.clean("<div>\n" * 3000 + "deep, text")[0] == "deep, text"
    assert M.clean("<div>" * 3000 + "deep" + "</div>" * 3000)[0] == "deep"
    assert M.clean("## a\n<div>\n## b\n" * 400)[0].count("## b") == 400


def test_prose_beside_the_best_and_behind_stray_tags_stays():
    long = "The kiln, which is old, still burns, and its keeper, who is older, feeds it, night after night, without a word. " * 8
    note = f"<div>A callout that stands by itself and has nothing but some eighty letters of plain prose without any link in it.</div>\n<div>stray\n{long}\n<div>\n{long}\n</div>\nshort end"
    clean, _ = M.clean(note)
    assert "A callout" in clean and "stray" in clean and "short end" in clean and clean.count("The kiln") == 16


def test_scores_pass_to_ancestors():
    root = M.tree(M.Reader().read("<main>\n<div>\none, two, three\n</div>\n</main>"))
    best = M.score(root)
    main = root.children[0]
    assert best.name == "div" and best.score == 3 and main.score == 1.5 and root.score == 3 / 6


@pytest.mark.parametrize("depth", [3, 40, 300])
def test_nests_of_any_depth(depth):
    assert M.clean("\\textbf{" * depth + "deep" + "}" * depth)[0] == "deep"
    assert M.clean("{{t|" * depth + "deep" + "}}" * depth)[0] == "deep"
    assert M.clean("*" * 2 + "_" + "deep" + "_" + "*" * 2)[0] == "deep"


@pytest.mark.parametrize("size", [100, 6300, 200_000])
def test_spans_of_any_length(size):
    assert M.clean("`" + "x <b> " * (size // 6) + "`")[1] == [(0, "markdown")]
    assert M.clean("$$" + "a_1 + " * (size // 6) + "$$ and more")[1] == [(0, "latex")]


def test_private_use_characters_stay():
    for text in ("a \ue0000\ue001 b", "x \ue002div\ue003 `c \ue0000\ue001` <i>y</i>", "\ue004\ue005"):
        own = [c for c in text if "\ue000" <= c <= "\ue005"]
        assert [c for c in M.clean(text)[0] if "\ue000" <= c <= "\ue005"] == own
