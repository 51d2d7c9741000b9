"""Repaired nesting, plain text, rule sets by type, raw export: goldens."""

import pytest
from pyspark.sql import functions as F

from quire.operators import extract as X
from quire.operators import html as H
from quire.operators import requests as RQ

DOC = "doc_id long, archive string, path string, html string"


def docs(spark, *htmls):
    return spark.createDataFrame([(i, "a.zim", "p", h) for i, h in enumerate(htmls)], DOC)


def test_repaired_nesting(spark):
    cases = ["<p><b>x<p>y", "<p>a<div>b</div>c", "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "<dl><dt>a<dd>b<dt>c</dl>",
             "<table><tr><td>a<td>b<tr><td>c<table><tr><td>in</table><td>d</table>", "<p>a<table><tr><td><p>b<p>c</table>d",
             "<p><button><p>a</button>b"]
    d = docs(spark, *cases)
    got = {r.doc_id: r.text for r in X.render_documents(d, markup=False, mode="repaired").collect()}
    assert got == {0: "x\n\ny", 1: "a\n\nb\n\nc", 2: "a\nb\nc\nd", 3: "a\nb\nc", 4: "a b\nc\nin d", 5: got[5],
                   6: got[6]}
    kept = H.html_nodes(d, mode="repaired").filter("kind = 'tag'").orderBy("doc_id", "pos").collect()
    parents = lambda i: [(r.tag, r.ptag) for r in kept if r.doc_id == i]
    assert parents(5) == [("p", None), ("table", None), ("tr", "table"), ("td", "tr"), ("p", "td"), ("p", "td")]
    assert parents(6) == [("p", None), ("button", "p"), ("p", "button")]
    # literal nesting closes nothing by itself
    got = {r.doc_id: r.text for r in X.render_documents(d, markup=False).collect()}
    assert got[0] == "xy"
    with pytest.raises(ValueError, match="mode"):
        H.html_nodes(d, mode="other")


def test_plain_text(spark):
    html = ("<!-- no --><h1> T  t</h1><p>a <b>b</b><br> c`d <a href='x'>e</a></p><pre> k  l \n\nm</pre><script>no</script>"
            "<ul><li>1<ul><li>2</li></ul></li></ul><table><tr><th>h</th><td>i</td></tr></table><p> </p>")
    got = {r.doc_id: r.text for r in X.render_documents(docs(spark, html, "", "<p></p>", None), markup=False).collect()}
    assert got == {0: "T t\n\na b\nc`d e\n\n k  l\nm\n\n1\n2\n\nh i", 1: "", 2: "", 3: ""}


def test_one_plan_renders_each_document_by_its_own_rules(spark):
    html = "<body><div class='navbar'>bar</div><div class='catlinks'>cat</div><h2>A</h2><pre>x`y</pre><table><tr><td>1</td></tr><tr><td>2</td></tr></table></body>"
    d = spark.createDataFrame([(i, a, "p", html) for i, a in enumerate(["w.zim", "b.zim", "g.zim", "u.zim", "v.zim"])], DOC)
    types = spark.createDataFrame([("w.zim", "wikipedia"), ("b.zim", "gutenberg"), ("g.zim", "spa"), ("v.zim", "video")],
                                  "archive string, type string")
    out = X.render_by_type(d, types)
    got = {r.doc_id: (r.renderer, r.text) for r in out.collect()}
    assert {i: r for i, (r, _) in got.items()} == {0: "wikipedia", 1: "gutenberg", 2: "generic", 3: "generic"}
    for i, kind in [(0, "wikipedia"), (1, "gutenberg"), (2, "generic"), (3, "generic")]:
        alone = X.render_documents(d.filter(F.col("doc_id") == i), kind).first().text
        assert got[i][1] == alone
    # nodes are made once, and once more for documents that hold a table
    plan = X.render_by_type(d, types)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2


def test_raw_export_through_the_gate(spark):
    entry = ("archive string, path string, mimetype string, is_redirect boolean, redirect_path string, size long, "
             "content binary")
    e = spark.createDataFrame([
        ("w.zim", "A/x", "text/html", False, None, 9, b"<p>caf\xe9 `a\n-b"), ("w.zim", "r", "text/html", True, "s", 0, b""),
        ("w.zim", "s", "text/html", True, "A/x", 0, b""), ("w.zim", "img", "image/png", False, None, 3, b"\x89PN"),
        ("w.zim", "lost", "text/html", True, "nowhere", 0, b""), ("v.zim", "t", "text/html", False, None, 3, b"<p>v")], entry)
    cat = spark.createDataFrame([("w.zim", "wikipedia"), ("v.zim", "video")], "archive string, type string")
    req = spark.createDataFrame([(1, "w.zim", "r", "html"), (2, "w.zim", "A/x", "micron"), (3, "w.zim", "img", "html"),
                                 (4, "w.zim", "lost", "html"), (5, "w.zim", "none", "micron"), (6, "w.zim", "A/x", "pdf"),
                                 (7, "w.zim", "", "html"), (8, None, "A/x", "html"), (9, "v.zim", "t", "micron")],
                                "request_id long, archive string, entry_path string, format string")
    got = {}
    for r in RQ.export_requests(req, e, cat).orderBy("request_id", "line_no").collect():
        got.setdefault(r.request_id, []).append((r.status, r.line))
    assert got == {1: [("ok", "\\<p>caf\ufffd \\`a"), ("ok", "\\-b")],
                   2: [("ok", "\\`:top"), ("ok", "caf\ufffd \\\\\\`a -b"), ("ok", "")],
                   3: [("not_text", None)], 4: [("missing_entry", None)], 5: [("missing_entry", None)],
                   9: [("ok", "\\`:top"), ("ok", "v"), ("ok", "")]}


def test_export_is_written_by_format(spark, tmp_path):
    rows = spark.createDataFrame([(1, "html", "ok", 0, "a"), (2, "micron", "ok", 0, "b")],
                                 "request_id long, format string, status string, line_no long, line string")
    RQ.write_export(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("format = 'micron'").select("line").collect()[0].line == "b"


def test_first_words_are_taken_once_a_row(spark):
    """The template names the words many times; a filter on the HTML must not work each of them out anew."""
    import re
    from quire.sources import articles as R
    texts = [None, "", "12 ab", "é1a b2c", "one two three four five six seven eight nine ten", " a b c d e f g h ", "a.b.c.d.e.f.g.h.i.j.k"]
    docs = spark.createDataFrame([(3 * i + 2, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    e = R.entries_from_documents(docs)
    plan = e.filter(e.html.rlike("(?i)<table"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 1 and "regexp_extract_all" not in plan
    for r in e.collect():
        w = (re.findall("[A-Za-z]+", texts[(r.entry_id - 2) // 3] or "") + [""] * 8)[:8]
        w = [x or f"none{i + 1}" for i, x in enumerate(w)]
        assert f"<h4>{w[0]}</h4><h6>{w[1]}</h6>so {w[2]} <em>{w[3]}</em>" in r.html and f"<li>{w[7]}</li>" in r.html


def test_nodes_lie_in_as_many_tasks_as_the_html_needs(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "<p>" + "x" * 100 + "</p>") for i in range(400)], "doc_id long, html string").repartition(1)
    monkeypatch.setattr(H, "TASK_BYTES", 1000)
    nodes = H.html_nodes(docs)
    assert nodes.count() == 800
    assert nodes.rdd.getNumPartitions() == -(-400 * 107 // 1000)
