"""Rendering, links, anchors, catalogue and raw export of article archives, with SQL twins.

The articles are derived from ``documents`` (``sources.articles``) and hold the
markup that the crawl's pages lack.  The twins write what each article must come
to from the document's words and text, without looking at any HTML.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog as C
from quire.operators import extract as X
from quire.operators import html as H
from quire.operators import redirects as RD
from quire.operators import requests as RQ
from quire.plans import sql as S
from quire.session import stored
from quire.sources import archive as A
from quire.sources import articles as R


def _tables(spark, sf_dir):
    """Entries with contents, the same without, and the catalogue (an archive's main entry is that of the lowest id).

    The catalogue needs contents of main pages only: entries are stored without
    them, and articles are made for the documents of main pages.
    """
    docs = A.read_table(spark, sf_dir, "documents")
    e = R.entries_from_documents(docs)
    keys = stored(e.drop("html").withColumn("page_id", F.col("entry_id")), "entries")
    archives, meta = A.archives_table(keys), R.metadata_of(keys)
    ends = stored(RD.resolve_redirects(keys, only_redirects=True), "ends")
    at = keys.select("archive", F.col("path").alias("main_path"), "page_id")
    own = stored(C.resolved_mains(archives, keys, ends).join(at, ["archive", "main_path"]).select(F.col("page_id").alias("doc_id")), "main-ids")
    pages = R.entries_from_documents(docs.join(own, "doc_id", "left_semi")).select(F.col("entry_id").alias("page_id"), "html")
    mains = stored(C.main_pages(archives, keys, ends, pages), "mains")
    d = mains.select(F.col("archive").alias("doc_id"), "archive", F.col("main_path").alias("path"), F.col("main_html").alias("html"))
    desc = X.descriptions(H.html_nodes(d)).withColumnRenamed("doc_id", "archive")
    cat = stored(C.build_catalog(archives, meta, keys, desc, mains=mains, ends=ends), "catalog")
    return e, keys.drop("page_id"), ends, cat


def _t(spark, sf_dir):
    """Entries and the catalogue."""
    e, _, _, cat = _tables(spark, sf_dir)
    return e, cat


def _docs(e):
    return e.withColumnRenamed("entry_id", "doc_id")


def article_catalog(spark, sf_dir):
    return _t(spark, sf_dir)[1]


def article_listing(spark, sf_dir):
    """Routes and cards of all archives, a third of which have no catalogue record yet."""
    e, cat = _t(spark, sf_dir)
    names = C.list_archives(e)
    listing = C.catalog_listing(names, cat.filter(~F.col("archive").startswith("blog")), fallback="blog-de.zim",
                                default_type="wikipedia")
    return listing.join(C.catalog_routes(listing).select("archive", "route"), "archive")


def article_text(spark, sf_dir):
    e, cat = _t(spark, sf_dir)
    return X.render_by_type(_docs(e), cat.select("archive", "type"))


def article_plain(spark, sf_dir):
    e, cat = _t(spark, sf_dir)
    return X.render_by_type(_docs(e), cat.select("archive", "type"), markup=False)


def article_links(spark, sf_dir):
    """Links of encyclopaedia articles, and whether internal ones lead to an entry of their archive."""
    e, _ = _t(spark, sf_dir)
    ln = X.links(H.html_nodes(_docs(e.filter(F.col("archive").startswith("wiki")))), None, "wikipedia")
    known = e.select("archive", F.col("path").alias("target"), F.lit(True).alias("_k"))
    return ln.join(known, ["archive", "target"], "left").select(
        "doc_id", "link_kind", "label", "href", "target",
        F.when(F.col("link_kind") == "entry", F.coalesce("_k", F.lit(False))).alias("resolved"))


def article_anchors(spark, sf_dir):
    e, cat = _t(spark, sf_dir)
    d = X.with_renderer(_docs(e), cat)
    return X.anchors(H.html_nodes(d), X.BY_TYPE).select("doc_id", "anchor")


def article_headings(spark, sf_dir):
    e, cat = _t(spark, sf_dir)
    return X.headings(H.html_nodes(X.with_renderer(_docs(e), cat)), X.BY_TYPE).select("doc_id", "level", "title")


def article_export(spark, sf_dir):
    """Raw export of requested entries in both formats, through the gate."""
    e, keys, ends, cat = _tables(spark, sf_dir)
    # a request an entry; every seventh has no format, every eleventh an unknown one, every thirteenth no path
    n = F.col("entry_id")
    req = keys.select(n.alias("request_id"), "archive", F.when(n % 13 > 0, F.col("path")).alias("entry_path"),
                   F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 11 == 0, F.lit("pdf"))
                   .when(n % 2 == 0, F.lit("html")).otherwise(F.lit("micron")).alias("format"))
    # contents arrive as bytes; every fifth has a byte that is not UTF-8 at its end
    raw = e.withColumn("content", F.concat(F.encode("html", "utf-8"), F.when(n % 5 == 0, F.unhex(F.lit("FF"))).otherwise(
        F.unhex(F.lit(""))))).drop("html")
    out = RQ.export_requests(req, raw, cat, ends, keys)
    return out.select("request_id", "format", "status", "line_no", "line")


QUERIES = {
    "article_catalog": article_catalog,
    "article_listing": article_listing,
    "article_text": article_text,
    "article_plain": article_plain,
    "article_links": article_links,
    "article_anchors": article_anchors,
    "article_headings": article_headings,
    "article_export": article_export,
}

# ---------------------------------------------------------------------------
# SQL twins: what an article comes to, by its words (a list from 1) and its text
# ---------------------------------------------------------------------------
_NL = "chr(10)"
_ONE_LINE = S.py_strip(S.norm_space("text"))


def _guard(x: str) -> str:
    return f"CASE WHEN substring({x}, 1, 1) IN ('#', '>', '-', '<') THEN '\\' || {x} ELSE {x} END"


_LINES = ("string_split(trim(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), chr(10))")
_RSTRIP = f"regexp_replace(x, '{S.WS}+$', '', 'g')"


def _written(template: str) -> str:
    """SQL concatenation of a template whose {1} .. {8} are words and other {names} SQL expressions."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts.append("'" + before.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        parts.append(f"w[{name}]" if name.isdigit() else f"lower(w[{name[1:]}])" if name[0] == "l" and name[1:].isdigit()
                     else name)
    parts.append("'" + rest.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(parts)


_WIKI_TEXT = """`:top
`!{1}`! is {2}`:cite-ref-a[`F5bf`_`[{no}`#cite-note-a]`_`f] and \
`F33f`_`[{5}`:/page/entry.mu`zim={archive}|entry_path=A/wiki/{next}.html]`_`f `F33f`_`[{7}`#{l6}]`_`f {8} {1} \
`F33f`_`[{2}`:/page/entry.mu`zim={archive}|entry_path=A/no {3}.html]`_`f.

>>Contents

• `F0af`_`[{2} {3}`#{l2}-{l3}]`_`f
  • `F0af`_`[{4}`#{l4}]`_`f
• `F0af`_`[References`#references]`_`f

-─

>>{2} {3}

{marked}

>>>{4}

• {1}

  • {2}

• {3}

1. {4}
3. {5}

`t
| {1} | {2} | {2} |
|---|---|---|
| {3} | {4}/{5} |   |
| {3} | {6} |   |
`t

  `*{7} {8}`*

`!{1}`!
  {2}

`B100`F9d9{1}  {2}`f`b
`B100`F9d9 {3}`f`b

>>References

`:cite-note-a`!{no}.`! `F0af`_`[↑`#cite-ref-a]`_`f {5}
`:cite-note-b`!1.`! {6} {7}

`c`F0af`_`[↑ Back to top`#top]`_`f`a
"""
_BOOK_TEXT = """`:top
>{1} {2}

{3} `*{4}`* `B100`F9d9{5}`f`b `:note-{l6}`a{6}

{listed}

{7}
{8}

`t
| {1} |
|---|
| {2} |
`t
"""
_BLOG_TEXT = """`:top
>>>>{1}

>>>>{2}

so {3}

{4}

{marked}

{5}{6}

• {7}

  1. {8}
"""
_WIKI_PLAIN = """{1} is {2}[{no}] and {5} {7} {8} {1} {2}.

{2} {3}

{flat}

{4}

{1}
{2}
{3}

{4}
{5}

{1} {2}
{3} {4}|{5}
{6}

{7} {8}

{1}
{2}

{1}  {2}
 {3}

References

^ {5}
{6} {7}"""
_BOOK_PLAIN = """{1} {2}

{3} {4} {5} {6}

{kept}

{7}
{8}

{1}
{2}

in
{1}
out"""
_BLOG_PLAIN = """{1}

{2}

so {3}

{4}

{flat}

{5}{6}

{7}
{8}"""

_DOCS = f"""
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang,
             regexp_extract_all(coalesce(text, ''), '{R.WORD}')[1:8] AS f, (doc_id % 9 + 2)::VARCHAR AS no,
             (doc_id + 3)::VARCHAR AS next, ['wiki', 'books', 'blog'][doc_id % 3 + 1] AS kind FROM documents),
a AS (SELECT *, kind || '-' || lang || '.zim' AS archive, 'A/' || kind || '/' || doc_id || '.html' AS path,
             list_transform(range(1, 9), lambda i: coalesce(f[i], 'none' || i)) AS w,
             replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
             {_ONE_LINE} AS flat, {_guard(S.escape(_ONE_LINE))} AS marked,
             array_to_string(list_transform({_LINES}, lambda x: {_guard(S.escape(_RSTRIP))}), {_NL}) AS listed,
             array_to_string(list_filter(list_transform({_LINES}, lambda x: {_RSTRIP}), lambda x: x <> ''), {_NL}) AS kept
      FROM d)"""


def _collapsed(x: str) -> str:
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


_TYPE = "CASE kind WHEN 'wiki' THEN 'wikipedia' WHEN 'books' THEN 'gutenberg' ELSE 'generic' END"
_MAIN = """,
m AS (SELECT archive, any_value(kind) AS kind, count(*) AS n, arg_min(path, doc_id) AS main_path,
             arg_min(w, doc_id) AS w, arg_min(flat, doc_id) AS flat, arg_min(no, doc_id) AS no FROM a GROUP BY archive),
s AS (SELECT *, CASE WHEN length(p) > 40 THEN p WHEN length(flat) > 40 THEN flat END AS para
      FROM (SELECT *, """ + _written("{1} is {2} [{no}] and {5} {7} {8} {1} {2} .") + """ AS p FROM m)),
c AS (SELECT *, length(substring(para, 1, 180)) - strpos(reverse(substring(para, 1, 180)), '.') AS cut,
             strpos(substring(para, 1, 180), '.') > 0 AS dot FROM s),
catalog AS (
  SELECT archive, CASE kind WHEN 'wiki' THEN 'All of ' || archive WHEN 'books' THEN w[1]
                            ELSE w[3] || ' &amp; ' || w[4] END AS title, """ + _TYPE + """ AS type,
         CASE WHEN archive = 'wiki-en.zim' THEN 'English articles' WHEN kind <> 'wiki' OR para IS NULL THEN ''
              WHEN length(para) <= 150 THEN para WHEN dot AND cut > 60 THEN substring(para, 1, cut + 1)
              ELSE substring(para, 1, 150) || '…' END AS description, n::BIGINT AS article_count, main_path
  FROM c)"""

_HREFS = """,
l AS (SELECT doc_id, archive, w, next, unnest([
    {'k': 'entry', 'label': w[5], 'href': '../wiki/' || next || '.html?q=1#s', 'to': 'A/wiki/' || next || '.html'},
    {'k': 'anchor', 'label': w[7], 'href': '#' || w[6], 'to': lower(w[6])},
    {'k': 'external', 'label': w[8], 'href': 'https://e.org/', 'to': NULL},
    {'k': 'external', 'label': w[1], 'href': 'none.html', 'to': NULL},
    {'k': 'entry', 'label': w[2], 'href': '/A/no%20' || w[3] || '.html', 'to': 'A/no ' || w[3] || '.html'}]) AS x
  FROM a WHERE kind = 'wiki')"""
_EXPORT = f""",
r AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'html' ELSE 'micron' END AS format FROM a
      WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0),
h AS (SELECT doc_id, format, CASE WHEN format = 'micron' THEN
               CASE kind WHEN 'wiki' THEN {{wiki}} WHEN 'books' THEN {{book}} ELSE {{blog}} END
             ELSE CASE kind WHEN 'wiki' THEN {_written(R.WIKI.replace('{text}', '{escaped}').replace('{kind}', "{'wiki'}"))}
                  WHEN 'books' THEN {_written(R.BOOK.replace('{text}', '{escaped}'))}
                  ELSE {_written(R.BLOG.replace('{text}', '{escaped}'))} END
               || CASE WHEN doc_id % 5 = 0 THEN chr(65533) ELSE '' END END AS text FROM r)
SELECT doc_id AS request_id, format, 'ok' AS status, (i - 1)::BIGINT AS line_no, {_guard(S.escape('ls[i]'))} AS line
FROM (SELECT doc_id, format, ls, unnest(range(1, len(ls) + 1)) AS i
      FROM (SELECT doc_id, format, string_split(text, chr(10)) AS ls FROM h))"""

ORACLE = {
    "article_catalog": f"WITH {_DOCS}{_MAIN} SELECT * FROM catalog",
    "article_listing": f"""WITH {_DOCS}{_MAIN}
SELECT archive, CASE WHEN type = 'generic' THEN archive ELSE title END AS title, t AS type,
       CASE WHEN type = 'generic' THEN '' ELSE description END AS description,
       CASE WHEN type <> 'generic' THEN article_count END AS article_count,
       CASE WHEN type = 'generic' THEN '' ELSE main_path END AS main_path,
       CASE WHEN t = 'wikipedia' THEN '/page/entry.mu`zim=' || archive || '|entry_path='
            || CASE WHEN type = 'generic' THEN '' ELSE main_path END ELSE '/page/zim_index.mu`zim=' || archive END AS route
FROM (SELECT *, CASE WHEN archive = 'blog-de.zim' THEN 'wikipedia' ELSE type END AS t FROM catalog)""",
    "article_text": f"""WITH {_DOCS}
SELECT doc_id, {_TYPE} AS renderer, CASE kind WHEN 'wiki' THEN {_collapsed(_written(_WIKI_TEXT))}
       WHEN 'books' THEN {_collapsed(_written(_BOOK_TEXT))} ELSE {_collapsed(_written(_BLOG_TEXT))} END AS text FROM a""",
    "article_plain": f"""WITH {_DOCS}
SELECT doc_id, {_TYPE} AS renderer, CASE kind WHEN 'wiki' THEN {_collapsed(_written(_WIKI_PLAIN))}
       WHEN 'books' THEN {_collapsed(_written(_BOOK_PLAIN))} ELSE {_collapsed(_written(_BLOG_PLAIN))} END AS text FROM a""",
    "article_links": f"""WITH {_DOCS}{_HREFS}
SELECT l.doc_id, x.k AS link_kind, x.label, x.href, x.to AS target,
       CASE WHEN x.k = 'entry' THEN e.path IS NOT NULL END AS resolved
FROM l LEFT JOIN a e ON x.k = 'entry' AND e.archive = l.archive AND e.path = x.to""",
    "article_anchors": f"""WITH {_DOCS}
SELECT doc_id, 'cite-ref-a' AS anchor FROM a WHERE kind = 'wiki'
UNION ALL SELECT doc_id, 'note-' || lower(w[6]) FROM a WHERE kind = 'books'""",
    "article_headings": f"""WITH {_DOCS}
SELECT doc_id, unnest([2, 3, 2]) AS level, unnest([w[2] || ' ' || w[3], w[4], 'References']) AS title FROM a WHERE kind = 'wiki'
UNION ALL SELECT doc_id, 1, w[1] || ' ' || w[2] FROM a WHERE kind = 'books'
UNION ALL SELECT doc_id, unnest([4, 6]), unnest([w[1], w[2]]) FROM a WHERE kind = 'blog'""",
    "article_export": f"WITH {_DOCS}" + _EXPORT.format(wiki=_collapsed(_written(_WIKI_TEXT)), book=_collapsed(_written(_BOOK_TEXT)),
                                                      blog=_collapsed(_written(_BLOG_TEXT))),
}
