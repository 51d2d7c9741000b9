"""Archives of marked-up articles, derived from ``documents``.

The crawl's pages know one shape only.  Here every document becomes an article
of an archive of its language, in the markup that encyclopaedias, books or blogs
have: its whole text, and its first ASCII words in headings, lists, tables,
definitions, quotes, citations, references, links and boilerplate.  This only
gives entries; nothing is extracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.plan import materialize

KINDS = ("wiki", "books", "blog")       # by doc_id modulo 3
WORD, NO_WORD = r"[A-Za-z]+", r"[^A-Za-z]+"
HTML = "text/html; charset=utf-8"

# {1} .. {8} are the first words, {text} the whole text, {no} a number, {id} the document
WIKI = """<html><head><title>{1} {2}</title></head><body><nav><a href="/x">menu</a></nav><div class="mw-parser-output">\
<div class="shortdescription">short {1}</div><table class="infobox"><tr><td>box</td></tr></table>\
<p><b>{1}</b> is {2}<sup class="reference" id="cite_ref-a"><a href="#cite_note-a">[{no}]</a></sup> and \
<a href="../{kind}/{next}.html?q=1#s">{5}</a> <a href="#{6}">{7}</a> <a href="https://e.org/">{8}</a> \
<a href="none.html" class="extiw">{1}</a> <a href="/A/no%20{3}.html">{2}</a>.</p>\
<div class="mw-heading"><h2 id="h">{2} {3}</h2><span class="mw-editsection">[edit]</span></div><p>{text}</p><h3>{4}</h3>\
<ul><li>{1}<ul><li>{2}</li></ul></li><li> </li><li>{3}</li></ul><ol><li>{4}</li><li></li><li>{5}</li></ol>\
<table class="wikitable"><tr><th>{1}</th><th colspan="2">{2}</th></tr>\
<tr><td rowspan="2">{3}</td><td>{4}|{5}</td><td></td></tr><tr><td>{6}</td></tr></table>\
<table><tr><td>left out</td></tr><tr><td>{1}</td></tr></table><blockquote><p>{7}</p> {8}</blockquote>\
<dl><dt>{1}</dt><dd>{2}</dd><dd> </dd></dl><pre>{1}  {2}\n {3} </pre><h2>References</h2>\
<ol class="references"><li id="cite_note-a"><span class="mw-cite-backlink"><a href="#cite_ref-a">^</a></span> \
<span class="reference-text">{5}</span></li><li id="cite_note-b">{6} <i>{7}</i></li></ol></div></body></html>"""

BOOK = """<html><head><title>{1}</title></head><body><header>site</header><div class="document">\
<div id="pg-header">licence</div><div class="navbar">bar</div><h1>{1} {2}</h1>\
<p>{3} <i>{4}</i> <code>{5}</code> <span id="Note.{6}">{6}</span></p><pre>{text}</pre>\
<p>{7}<br>{8}</p><table><tr><td>{1}</td></tr><tr><td>{2}</td></tr></table>\
<table><tr><td><table><tr><td>in</td></tr><tr><td>{1}</td></tr></table></td></tr><tr><td>out</td></tr></table>\
<div id="pg-footer">end</div></div><div>behind</div></body></html>"""

BLOG = """<html><head><title> {3} &amp;\n{4} </title></head><body><nav>menu</nav><main><h4>{1}</h4><h6>{2}</h6>so {3} \
<em>{4}</em><div class="sidebar">side</div><p>{text}</p><p><strong> </strong> <a>{5}</a><a href="mailto:q">{6}</a></p>\
<ul><li><p>{7}</p><ol><li>{8}</li></ol></li></ul></main><footer>foot</footer></body></html>"""


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def entries_from_documents(docs: DataFrame) -> DataFrame:
    """``entries`` of the article archives: a row a document, path ``A/<kind>/<doc_id>.html``."""
    # split stops behind the first words, of which an empty piece may lie in front
    pieces = F.slice(F.split(F.coalesce("text", F.lit("")), NO_WORD, 10), 1, 9)
    # worked out once a row: the optimizer would copy it into all places of the templates
    d = materialize(docs, ["doc_id", F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")],
                    w=F.slice(F.filter(pieces, lambda x: x != ""), 1, 8))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("doc_id") % 3 + 1).cast("int"))
    values = {str(i): F.coalesce(F.get("w", F.lit(i - 1)), F.lit(f"none{i}")) for i in range(1, 9)}
    values |= {"text": _escaped(F.col("text")), "no": (F.col("doc_id") % 9 + 2).cast("string"), "kind": kind,
               # the link leads to a document of the same kind, of the same language or not
               "next": (F.col("doc_id") + 3).cast("string")}
    html = (F.when(kind == "wiki", _filled(WIKI, values)).when(kind == "books", _filled(BOOK, values))
            .otherwise(_filled(BLOG, values)))
    return d.select(
        F.concat(kind, F.lit("-"), "lang", F.lit(".zim")).alias("archive"), F.col("doc_id").cast("bigint").alias("entry_id"),
        F.concat(F.lit("A/"), kind, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".html")).alias("path"),
        F.concat_ws(" ", values["1"], values["2"]).alias("title"), F.lit(HTML).alias("mimetype"),
        F.lit(False).alias("is_redirect"), F.lit(None).cast("string").alias("redirect_path"),
        F.octet_length(html).cast("bigint").alias("size"), html.alias("html"))


def metadata_of(entries: DataFrame) -> DataFrame:
    """``archive_metadata``: books are tagged, encyclopaedias have a blank Title and a Name, English ones a
    Description; blogs have none."""
    a = entries.select("archive").distinct()
    rows = F.array(
        F.struct(F.lit("Tags").alias("key"), F.when(F.col("archive").startswith("books"), F.lit("_cat:Gutenberg;")).alias("v")),
        F.struct(F.lit("Title").alias("key"), F.when(F.col("archive").startswith("wiki"), F.lit("")).alias("v")),
        F.struct(F.lit("Name").alias("key"), F.when(F.col("archive").startswith("wiki"),
                                                    F.concat(F.lit(" All of "), "archive")).alias("v")),
        F.struct(F.lit("Description").alias("key"), F.when(F.col("archive") == "wiki-en.zim", F.lit("English articles")).alias("v")))
    return a.select("archive", F.explode(rows).alias("r")).select("archive", "r.key", F.col("r.v").cast("binary").alias("value")) \
        .filter(F.col("value").isNotNull())
