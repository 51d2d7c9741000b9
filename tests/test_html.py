"""Node nesting and rendering goldens (literal tree-building rules)."""

import pytest

from quire.operators import extract as X
from quire.operators import html as H

PAGE = ("<html><body><nav><a href='/x'>X</a></nav><article><h1>Hello &amp; <i>world</i></h1>"
        "<p>Some <b>bold</b> and <b> </b><i>it</i> text.<br>Second line "
        "<a href='../B/Paris'>Paris</a> and <a href='#Early life'>see</a> "
        "<a href='https://e.org'>ext</a><span id='Here x'>h</span></p><!-- note -->"
        "<ul><li>one</li><li>two<ul><li>two.a</li></ul></li><li></li></ul>"
        "<ol><li>first</li><li>second</li></ol><pre>  code\r\n  `x`  </pre>"
        "<blockquote>quoted <b>bit</b></blockquote></article><footer>f</footer></body></html>")

EXPECTED = """`:top
>Hello & world

Some `!bold`! and  `*it`* text.
Second line `F33f`_`[Paris`:/page/entry.mu`zim=a.zim|entry_path=B/Paris]`_`f and `F33f`_`[see`#early-life]`_`f ext`:here-x`ah

note

• one
• two

  • two.a

1. first
2. second

`B100`F9d9  code`f`b
`B100`F9d9  \\`x\\``f`b

  `*quoted `!bit`!`*
"""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([
        (1, "a.zim", "A/France", PAGE),
        (2, "a.zim", "B/x", "<p><b>x<br><p>y</p><p>z</p></body>"),
        (3, "a.zim", "C", "<body><dl><dt>Term</dt><dd>Def <b>b</b></dd><dd> </dd></dl>"
                          "<h2> </h2><h3>Sub  <span>head</span></h3></body>"),
    ], "doc_id long, archive string, path string, html string")


def test_render_generic(spark, docs):
    out = {r.doc_id: r.text for r in X.render_documents(docs, "generic").collect()}
    assert out[1] == EXPECTED
    # literal nesting: the unclosed <b> swallows every later paragraph
    assert out[2] == "`:top\n`!x\nyz`!\n"
    assert out[3] == "`:top\n`!Term`!\n  Def `!b`!\n\n>>>Sub head\n"


def test_nesting_intervals(spark, docs):
    rows = H.html_nodes(docs.filter("doc_id = 2")).orderBy("pos").collect()
    tags = [(r.kind, r.tag, r.parent, r.end_pos) for r in rows]
    # <p>(0) <b>(1) x(2) <br>(3) <p>(4) y(5) </p> <p>(6) z(7) </p>: b never closes
    assert tags[0] == ("tag", "p", -1, 7)
    assert tags[1] == ("tag", "b", 0, 7)
    assert tags[4] == ("tag", "p", 1, 5)
    assert tags[6] == ("tag", "p", 1, 7)


def test_links_classified(spark):
    html = ("<body><p><a>plain</a> <a href='#S 1'>anchor</a> <a href='https://e.org'>e</a> "
            "<a href='//e.org'>p</a> <a href='mailto:a'>m</a> <a class='extiw' href='W'>w</a> "
            "<a href='HTTPS://e.org'>H</a> <a href='ftp://e.org'>f</a> <a href='Foo?x#y'>foo</a></p>"
            "<h2><a href='Lost'>in heading</a></h2></body>")
    d = spark.createDataFrame([(1, "z.zim", "A/B", html)], "doc_id long, archive string, path string, html string")
    got = [(r.link_kind, r.label, r.target) for r in
           X.links(H.html_nodes(d), d, "generic").orderBy("pos").collect()]
    assert got == [("plain", "plain", None), ("anchor", "anchor", "s-1"), ("external", "e", None),
                   ("external", "p", None), ("external", "m", None), ("external", "w", None),
                   ("entry", "H", "A/HTTPS:/e.org"), ("entry", "f", "A/ftp:/e.org"),
                   ("entry", "foo", "A/Foo")]


def test_boilerplate_rules(spark):
    html = ("<body><div class='navbox x'>gone</div><main><p>kept</p><nav>gone</nav>"
            "<div class='hatnote'>gone</div><p>also <span class='noprint'>gone</span>kept</p></main></body>")
    d = spark.createDataFrame([(1, "z.zim", "A", html)], "doc_id long, archive string, path string, html string")
    assert X.render_documents(d, "generic").first().text == "`:top\nkept\n\nalso kept\n"


def test_gutenberg_first_id_only(spark):
    html = ("<body><div id='pg-header'>h1</div><div id='pg-header'>h2</div>"
            "<pre>> quoted\n</pre></body>")
    d = spark.createDataFrame([(1, "g.zim", "A", html)], "doc_id long, archive string, path string, html string")
    assert X.render_documents(d, "gutenberg").first().text == "`:top\nh2\n\n\\> quoted\n"


def test_table_spans(spark):
    t = ("<body><table><tr><td rowspan='2'>a</td><td colspan='2'>b</td></tr>"
         "<tr><td>c</td><td>d</td></tr><tr><td>x|y</td></tr></table>"
         "<table><tr><td>one row</td></tr></table>"
         "<table><tr><td><table><tr><td>i</td></tr><tr><td>j</td></tr></table></td></tr>"
         "<tr><td>k</td></tr></table></body>")
    d = spark.createDataFrame([(1, "z.zim", "A", t)], "doc_id long, archive string, path string, html string")
    got = X.render_documents(d, "generic").first().text
    assert got == ("`:top\n`t\n| a | b | b |\n|---|---|---|\n| a | c | d |\n| x/y |   |   |\n`t\n")


WIKI = ('<html><body><div class="mw-parser-output">'
        '<p>Intro<sup id="cite_ref-a" class="reference"><a href="#cite_note-a">[1]</a></sup> text.</p>'
        '<div class="mw-heading"><h2>History</h2><span class="mw-editsection">[edit]</span></div>'
        '<p>More<sup class="reference"><a href="#cite_note-a">[2]</a></sup>.</p>'
        '<h3>Early</h3>'
        '<table class="wikitable"><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>'
        '<table><tr><td>x</td></tr><tr><td>y</td></tr></table>'
        '<h2>Notes</h2><ol class="references">'
        '<li id="cite_note-a"><span class="mw-cite-backlink"><a href="#cite_ref-a">^</a></span> '
        '<span class="reference-text">Alpha <i>ref</i></span></li>'
        '<li id="cite_note-b"><span class="mw-cite-backlink"><a href="#cite_ref-b">^</a></span> Beta plain</li>'
        '<li id="cite_note-c">Gamma</li></ol></div></body></html>')

WIKI_EXPECTED = """`:top
Intro`:cite-ref-a[`F5bf`_`[1`#cite-note-a]`_`f] text.

>>Contents

• `F0af`_`[History`#history]`_`f
  • `F0af`_`[Early`#early]`_`f
• `F0af`_`[Notes`#notes]`_`f

-─

>>History

More[`F5bf`_`[2`#cite-note-a]`_`f].

>>>Early

`t
| A | B |
|---|---|
| 1 | 2 |
`t

>>Notes

`:cite-note-a`!2.`! `F0af`_`[↑`#cite-ref-a]`_`f Alpha `*ref`*
`:cite-note-b`!1.`! Beta plain
`:cite-note-c`!2.`! Gamma

`c`F0af`_`[↑ Back to top`#top]`_`f`a
"""


def test_render_wikipedia(spark):
    d = spark.createDataFrame([(1, "w.zim", "A/W", WIKI)], "doc_id long, archive string, path string, html string")
    assert X.render_documents(d, "wikipedia").first().text == WIKI_EXPECTED


def test_references_before_citations(spark):
    html = ('<body><ol class="references"><li id="a">A</li><li id="b">B</li><li id="c">C</li></ol>'
            '<p>x<sup class="reference"><a href="#a">[9]</a></sup></p></body>')
    d = spark.createDataFrame([(1, "w.zim", "A", html)], "doc_id long, archive string, path string, html string")
    text = X.render_documents(d, "wikipedia").first().text
    assert "`:a`!1.`! A\n`:b`!2.`! B\n`:c`!3.`! C" in text
    assert "back to top" not in text.lower()


def test_first_paragraph_description(spark):
    html = ("<body><p>short</p><p>" + "word " * 20 + "</p><div><p>" + "x" * 200 + "</p></div></body>")
    long_first = "<body><p><b>" + "Lead sentence here. " * 3 + "<br><p>" + "more " * 40 + "</p></body>"
    d = spark.createDataFrame([(1, "w.zim", "A", html), (2, "w.zim", "B", long_first)],
                              "doc_id long, archive string, path string, html string")
    got = {r.doc_id: r.description for r in X.descriptions(H.html_nodes(d)).collect()}
    assert got[1] == ("word " * 20).strip()
    # literal nesting: the first p holds everything after it; its last '.' before 180 is at
    # index 58 (not past 60), so the text is cut at 150 characters
    full = ("Lead sentence here. " * 3).strip() + " " + ("more " * 40).strip()
    assert got[2] == full[:150] + "…"


def test_cdata_is_text(spark):
    html = "<body><p>a <![CDATA[x &amp; <y>]]> b</p></body>"
    d = spark.createDataFrame([(1, "z.zim", "A", html)], "doc_id long, archive string, path string, html string")
    assert X.render_documents(d, "generic").first().text == "`:top\na x &amp; <y> b\n"
