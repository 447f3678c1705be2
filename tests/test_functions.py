import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import formatting, language, paths, query, text


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "path,base,ext,folder",
    [
        ("/shelf/loan.txt", "loan", "txt", "/shelf/"), ("/shelf/tide.2024.table.bak.zip", "tide.2024.table.bak", "zip", "/shelf/"), ("/shelf/plain", "plain", "", "/shelf/"),
        ("/shelf/.secret.md", ".secret", "md", "/shelf/"), ("deep/er/leaf.md", "leaf", "md", "deep/er/"), ("/top.md", "top", "md", "./"), ("", "", "", "./"),
    ],
)
def test_paths(spark, path, base, ext, folder):
    assert one(spark, paths.basename, path) == base
    assert one(spark, paths.extension, path) == ext
    assert one(spark, paths.folder, path) == folder


def test_excluded_whole_segments(spark):
    rows = spark.createDataFrame([("a/b/c.md",), ("a/bc.md",), ("a/b",), (None,)], "path string")
    got = [r[0] for r in rows.select(paths.is_excluded(F.col("path"), ["a/b"])).collect()]
    assert got[:3] == [True, False, True]
    assert not got[3]


@pytest.mark.parametrize(
    "given_text,expected",
    [
        ("abc/nef/adg", {"abc", "nef", "adg"}), ("camelCase this-boy", {"camelCase", "camel", "Case", "this-boy", "boy", "this"}), ("The the", {"The"}), ("word! a&b c++", {"word!", "a&b", "c++"}),
        ("潮汐表", {"潮汐", "汐表"}), ("岚", {"岚"}), ("x" * 30 + " " + "y" * 29, {"y" * 29}), ("", set()), (None, set()), ("a ", set()),
    ],
)
def test_tokens(spark, given_text, expected):
    assert set(one(spark, text.tokens, given_text)) == expected
    if given_text is not None:
        assert set(query.tokens(given_text)) == expected


def test_tokens_agree_with_the_drivers(spark):
    rows = ["Fish&chips, (l’été) 砚湾river_bank mixedCase-word ©2024 a–b “quoted” ½ x=y", "Ёлка ёж: пойти/дойти; 1.5.2 a^b `code` é-É", "tab\there\r\nnew　line﻿end"]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select("x", text.tokens(F.col("x")).alias("t"))
    for r in df.collect():
        assert sorted(r["t"]) == sorted(query.tokens(r["x"]))


def test_language_golden_shapes(spark):
    rows = spark.createDataFrame([(1, "a plain english sentence"), (1, "整个春天在沐渡的夜班火车证实"), (2, "short"), (3, None)], "g int, t string")
    got = {r["g"]: r.asDict() for r in language.proportions(rows, "g", "t").collect()}
    assert got[1]["main"] == "en" and got[1]["en"] == "63.16%" and got[1]["zh"] == "36.84%"
    assert got[2]["main"] == "other" and got[2]["other"] == "100.00%"
    assert got[3]["main"] == "other" and got[3]["en"] is None


def test_formatting(spark):
    assert [one(spark, formatting.duration, m, "bigint") for m in (500, 1000, 65000)] == ["500 ms", "1 s 0 ms", "1 min 5 s 0 ms"]
    assert one(spark, formatting.percent, 0.125, "double") == "12.50%"
    assert one(spark, formatting.percent, None, "double") is None
    assert one(spark, lambda c: formatting.query_string("http://h/s", {"q": c}), "a b&c") == "http://h/s?q=a+b%26c"
    assert one(spark, lambda c: formatting.decode_answer(F.lit(200), c), '{"data": "x", "code": 0}') == "x"
    assert one(spark, lambda c: formatting.decode_answer(F.lit(200), c), '{"data": "x", "code": -1}') is None
    with pytest.raises(Exception, match="refused"):
        one(spark, lambda c: formatting.decode_answer(F.lit(200), c), '{"message": "no", "code": 3}')


def test_domains(spark):
    assert one(spark, paths.url_domain, "https://example.org/a") == "example.org"
    assert one(spark, paths.url_domain, "http://example.org/a") == ""


@pytest.mark.parametrize(
    "raw,expected",
    [("/ap/nf something /np", ("something", False, False)), ("/etc/hosts", ("", True, True)), ("a /np", ("a", False, True)), ("/np", ("", False, True)), ("", ("", True, True)), ("a  b", ("a  b", True, True)), ("/np/ap x /zz", ("x", True, True))],
)
def test_commands(spark, raw, expected):
    q = query.parse(raw)
    assert (q.text, q.options.prefix, q.options.fuzzy) == expected
    assert tuple(one(spark, query.parsed, raw)) == expected


def test_maximal_terms():
    assert query.maximal_terms(["foo", "foobar"], ["foo", "bar", "foobar"]) == ["foobar"]
    assert query.maximal_terms(["ab", "abc"], ["abc", "xab", "abcd"]) == ["abc", "xab"]
    assert query.maximal_terms(["x"], ["p", "pq", "q"]) == ["pq"]
    assert query.maximal_terms([], []) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab /npf", max_size=20))
def test_commands_never_fail(raw):
    q = query.parse(raw)
    assert isinstance(q.text, str)


def test_text_cleaning(spark):
    assert one(spark, text.markdown_clean, "[a](b) **c** `d` [x]") == "a c d [x]"
    assert one(spark, text.html_to_text, "<p>a &lt; b</p><script>x</script><b>c</b><br>d") == "a < b\nc\nd"
    assert one(spark, text.headings, "# A b\ntext\n### C ##\r\n#no") == "A b C"
    assert one(spark, text.escape_html, "<a&b>") == "&lt;a&amp;b&gt;"
    assert one(spark, text.is_large_charset, "潮汐ab") is True
    assert one(spark, text.strip_spaces, " a  b\t") == "ab"


def test_folders_are_no_files(spark):
    rows = spark.createDataFrame([("a/b.md/",), ("a/b.md",), ("a/b/",), (None,)], "path string")
    assert [r[0] for r in rows.select(paths.is_indexable(F.col("path"))).collect()] == [False, True, False, None]
