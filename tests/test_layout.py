"""Documents laid out one by one give what the windows over the node table give."""

import random
import re

from pyspark.sql import functions as F

from quire.operators import extract as X
from quire.operators import html as H
from quire.plans import article_q
from quire.sources import articles as R

DOC = "doc_id long, archive string, path string, renderer string, html string"
TAGS = ["p", "div", "span", "b", "i", "code", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "pre", "blockquote",
        "h2", "h3", "a", "sup", "sub", "br", "nav", "main", "article", "em"]
INSIDE = {"ul": ["li"], "ol": ["li"], "dl": ["dt", "dd"], "table": ["tr"], "tr": ["td", "th"], "li": ["span", "a", "ul", "b"]}
ATTRS = ["", "", "", ' class="mw-heading"', ' class="references"', ' class="reference"', ' class="mw-cite-backlink"',
         ' class="reference-text"', ' class="wikitable"', ' class="navbox x"', ' class="external"', ' id="a"', ' id="cite_ref-a"',
         ' id="pg-header"', ' id="É -"', " colspan=3", " rowspan='2'", " rowspan=x colspan=000000000000000000002",
         ' href="#a"', ' href="#cite_ref-a"', ' href="../B/x%20y.html?q#s"', ' href="/A/z"', ' href="//e.org"', " href=''"]
TEXT = ["word", "two  words", " ", "\r\n", "a`b\\c", "# hash", "-dash", "&amp; &lt;x&gt;", "x|y", "1\n2\n\n\n3", "<", "é\u0085  z", "]",
        "<!-- note -->", "<![CDATA[<b>]]>", "<?pi?>"]


def _element(r, depth, inside=""):
    if depth == 0 or r.random() < 0.3:
        return r.choice(TEXT)
    tag = r.choice(INSIDE[inside]) if inside in INSIDE and r.random() < 0.7 else r.choice(TAGS)
    body = "".join(_element(r, depth - 1, tag) for _ in range(r.randint(0, 4)))
    return f"<{tag}{r.choice(ATTRS)}>{body}" + (f"</{tag}>" if r.random() < 0.9 else "")


def _docs(spark):
    r = random.Random(7)
    pages = [re.sub(r"\{(\w+)\}", r"w\1", page) for page in (R.WIKI, R.BOOK, R.BLOG) for _ in range(3)]
    pages += [None, "", "text", "<p></p>", "<table><tr><td>1</td></tr><tr><td>2"]
    pages += ["".join(_element(r, 5) for _ in range(r.randint(2, 12))) for _ in range(400)]
    return spark.createDataFrame([(3 * i + k, [None, "", "z.zim"][i % 3], [None, "", "A/b/c", "/x//"][i % 4], kind, page)
                                  for i, page in enumerate(pages) for k, kind in enumerate(X.RENDERERS)], DOC)


def test_documents_are_laid_out_as_by_windows(spark):
    d = _docs(spark).cache()
    for mode in H.MODES:
        new = X.render_documents(d, X.BY_TYPE, mode=mode, carry=("renderer",))
        old = X.render_documents(d, X.BY_TYPE, nodes=H.html_nodes(d, mode=mode), mode=mode, carry=("renderer",))
        got, want = new.orderBy("doc_id").collect(), old.orderBy("doc_id").collect()
        assert got == want and len(got) == d.count()
        seen = "".join(x.text for x in got)
        assert all(x in seen for x in [">>Contents", "`t\n|", "`:cite-note-a`!", "`[↑`#", "entry.mu`zim=z.zim|", "`!", "• ", "1. "])
    d.unpersist()


def test_rendering_moves_no_nodes(spark):
    """A node's many windows took a document of some hundred nodes a hundredth of a second or more."""
    d = _docs(spark).drop("renderer")
    types = spark.createDataFrame([("z.zim", "wikipedia")], "archive string, type string")
    plan = X.render_by_type(d, types)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("hashpartitioning(doc_id") == 1


def test_few_row_groups_are_dealt_to_many_tasks(spark):
    d = spark.createDataFrame([(i, "a.zim", "p", "<p>x</p>") for i in range(50)], "doc_id long, archive string, path string, html string")
    out = X.render_documents(d.coalesce(1)).select(F.spark_partition_id().alias("p"), "doc_id")
    out.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert out.select("p").distinct().count() > 1
    finally:
        out.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def test_export_reads_contents_for_html_and_for_rendering_alone(spark):
    """Requests were resolved on contents, and rendered texts joined to the contents again."""
    plan = article_q.article_export(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("FileScan parquet") >= 2
    assert len(re.findall(r"FileScan parquet [^\n]*documents\.parquet", plan)) == 2
