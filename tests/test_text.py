"""Golden cases for the string / path / number scalars (FIXTURES §3)."""

from pyspark.sql import functions as F

from quire.functions import text as T
from tests.conftest import one_col


def test_resolve_path(spark):
    cases = [
        ("../B/Paris", "A/France", "B/Paris"),
        ("Paris", "A/France", "A/Paris"),
        ("/x//y/", "A/F", "x//y/"),
        ("./", "F", "."),
        ("../../x", "A/F", "../x"),
        ("a%20b+c%2", "F", "a b+c%2"),
        ("p?q#r", "A/F", "A/p"),
        ("#top", "F", ""),
        ("a`|b]c", "F", "abc"),
        ("x/", "A/F", "A/x"),
        (" C%C3%A9 ", "", "Cé"),
    ]
    df = spark.createDataFrame([(h, b) for h, b, _ in cases], "h string, b string")
    got = [r[0] for r in df.select(T.resolve_path("h", "b")).collect()]
    assert got == [want for _, _, want in cases]


def test_slug(spark):
    cases = {"Early life": "early-life", "  A -- B  ": "a-b", "C++ & C#": "c-c",
             "cite_note-3": "cite-note-3", "É1": "1", "日本": ""}
    assert one_col(spark, list(cases), T.slug) == list(cases.values())


def test_human_size(spark):
    cases = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1331: "1.3 KB",
             1048575: "1024.0 KB", 1048576: "1.0 MB", 1310720: "1.2 MB", 7155441: "6.8 MB"}
    assert one_col(spark, list(cases), T.human_size, "v long") == list(cases.values())


def test_book_path(spark):
    cases = {"Title_cover.123": "Title.123", "Title_cover.123x": "Title_cover.123x",
             "Title.123": "Title.123"}
    assert one_col(spark, list(cases), T.book_path) == list(cases.values())


def test_cell_span(spark):
    cases = [(None, 1), ("0", 1), ("-3", 1), ("7", 7), ("999", 50), ("x", 1), ("3.7", 1)]
    assert one_col(spark, [c for c, _ in cases], T.cell_span) == [w for _, w in cases]


def test_snippet(spark):
    a = "a" * 41
    cases = [
        ("x" * 150, "x" * 150),
        ("x" * 151, "x" * 150 + "…"),
        ("x" * 70 + "." + "y" * 100, "x" * 70 + "."),
        ("x" * 60 + "." + "y" * 100, ("x" * 60 + "." + "y" * 100)[:150] + "…"),
        ("x" * 61 + "." + "y" * 100, "x" * 61 + "."),
        ("x" * 179 + ".b", "x" * 179 + "."),
        ("x" * 180 + ".", "x" * 150 + "…"),
        (a, a),
    ]
    assert one_col(spark, [c for c, _ in cases], T.snippet) == [w for _, w in cases]


def test_escape_and_guard(spark):
    assert one_col(spark, ["a`b\\c"], T.escape_markup) == ["a\\`b\\\\c"]
    cases = {">x": "\\>x", "-x": "\\-x", "#x": "\\#x", "<x": "\\<x", "x>": "x>", "": ""}
    assert one_col(spark, list(cases), T.guard_line) == list(cases.values())


def test_python_whitespace(spark):
    s = " a  \x1c b　"
    assert one_col(spark, [s], lambda c: T.py_strip(T.norm_space(c))) == [" ".join(s.split())]


def test_unquote_and_citation(spark):
    assert one_col(spark, ["a%20b+c%2", "%E2%82%AC"], T.unquote) == ["a b+c%2", "€"]
    cases = {" [12] ": "12", "[]": "*", "  ": "*", "[ a ]": "a"}
    assert one_col(spark, list(cases), T.citation_number) == list(cases.values())


def test_cache_key_matches_python(spark):
    import hashlib
    df = spark.createDataFrame([("w.zim", "A/B")], "a string, p string")
    got = df.select(T.cache_key("a", "p")).first()[0]
    assert got == hashlib.sha256("w.zim\x00A/B".encode()).hexdigest()


def test_thousands_and_stem(spark):
    assert one_col(spark, [7155441, 0], T.thousands, "v long") == ["7,155,441", "0"]
    assert one_col(spark, ["/x/wiki_en.zim", ".zim", "a.b.zim"], T.stem) == ["wiki_en", ".zim", "a.b"]
    assert one_col(spark, ["<p>hi</p>  "], T.visible_length) == [2]
