"""HTML documents as node relations.

``html_nodes`` turns a table of HTML documents into one row per node:

    nodes(doc_id, pos, parent, end_pos, depth, kind, tag, ptag,
          id, classes, href, colspan, rowspan, text)

``pos`` numbers nodes in document order and ``end_pos`` is the position of the
node's last descendant, so *descendant of x* is ``x.pos < pos <= x.end_pos``.
With intervals that nest, every subtree question becomes a running window over
``(doc_id order by pos)``: "inside a removed element" is a running max of
``end_pos`` over the removed elements seen so far.

Tokenising is native (``regexp_extract_all``).  Nesting is the one sequential
step: a small per-document stack walk in ``mapInPandas``.  In ``literal`` mode an
end tag closes up to the nearest open element of that name and is ignored if
there is none, void and self-closed elements close at once, nothing closes
implicitly.  In ``repaired`` mode a start tag also closes what it cannot stand in,
with all that is open in it: a block closes an open ``p``, an ``li`` the ``li``
before it, and so on (``IMPLIED_ENDS``), as far as the element that holds both.  The same pass reads the few attributes the renderers use and
decodes character references with the standard library, so the node table
leaves Python once.
"""

from __future__ import annotations

import sys

import html as _html
import re

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quire.functions import text as T

# Worker-side functions of this module travel by value, so executors need no
# copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# comments, atomic script/style elements, CDATA sections, tags, text, stray '<'
TOKEN_RE = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
            r"|<!\[CDATA\[.*?\]\]>"
            # a tag ends at the first '>' outside a quoted attribute value
            r"|<[!?/]?[A-Za-z](?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+>|<[!?/]?[A-Za-z][^>]*>"
            r"|<!--.*|[^<]+|<")
# elements that never have children (closed as soon as they open)
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link",
    "menuitem", "meta", "param", "source", "track", "wbr", "basefont", "bgsound",
    "command", "frame", "image", "isindex", "nextid", "spacer",
])
# repaired mode: start tags -> (open elements they end, elements beyond which they do not look)
_P_ENDERS = ("address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
             "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
             "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul")
_HOLDERS = ("table", "td", "th", "caption", "button", "object", "template", "html")
IMPLIED_ENDS = {
    **{tag: [(("p",), _HOLDERS)] for tag in _P_ENDERS},
    "li": [(("li",), ("ul", "ol", "menu", *_HOLDERS)), (("p",), _HOLDERS)],
    "dt": [(("dt", "dd"), ("dl", *_HOLDERS)), (("p",), _HOLDERS)],
    "dd": [(("dt", "dd"), ("dl", *_HOLDERS)), (("p",), _HOLDERS)],
    "td": [(("td", "th"), ("tr", "table"))],
    "th": [(("td", "th"), ("tr", "table"))],
    "tr": [(("tr",), ("table",))],
    **{tag: [(("tbody", "thead", "tfoot", "tr"), ("table",))] for tag in ("tbody", "thead", "tfoot")},
    "option": [(("option",), ("select", "datalist"))],
}
MODES = ("literal", "repaired")
RAW_TEXT_TAGS = ("script", "style")
TASK_BYTES = 8 << 20             # HTML whose nodes one task holds
LEAST_TASKS = 8
FRAME_NODES = 50_000            # nodes handed from Python to Spark at a time
_NAME = re.compile(r"^</?([A-Za-z][^\s/>]*)")

NODE_SCHEMA = StructType([
    StructField("doc_id", LongType()),
    StructField("pos", IntegerType()),
    StructField("parent", IntegerType()),
    StructField("end_pos", IntegerType()),
    StructField("depth", IntegerType()),
    StructField("kind", StringType()),     # tag, text, comment, doctype, pi
    StructField("tag", StringType()),
    StructField("ptag", StringType()),     # parent's tag (null at top level)
    StructField("id", StringType()),
    StructField("class", StringType()),
    StructField("href", StringType()),
    StructField("colspan", StringType()),
    StructField("rowspan", StringType()),
    StructField("text", StringType()),     # decoded character data / comment text
])
ATTRS = ("id", "class", "href", "colspan", "rowspan")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def tokens(html) -> Column:
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN_RE), 0)


def _attrs(rest: str) -> dict:
    """Attributes behind a start tag's name: lower-cased names, first value wins, entities decoded."""
    found = {}
    for name, value in _ATTR.findall(rest):
        name = name.lower()
        if name in ATTRS and name not in found:
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            found[name] = _html.unescape(value)
    return found


def _implied_end(tag, names):
    """Depth of the outermost open element that a start tag ends implicitly; none: the present depth."""
    cut = len(names)
    for ended, holders in IMPLIED_ENDS.get(tag, ()):
        for k in range(cut - 1, -1, -1):
            if names[k] in holders and names[k] not in ended:
                break
            if names[k] in ended:
                cut = k
                if tag not in ("tbody", "thead", "tfoot"):
                    break
    return cut


def _nest_one(doc_id, toks, out, repaired=False):
    """Stack walk over one document's tokens (appends node rows to ``out``)."""
    stack: list[int] = []
    names: list[str] = []
    ends: list[int] = []
    found: list[tuple[int, dict]] = []      # attributes, by position
    pieces: list[str] = []                  # of the last node, if that is character data
    parents, depths, kinds, tags, ptags, texts = (out[c] for c in ("parent", "depth", "kind", "tag", "ptag", "text"))
    for tok in toks:
        if tok[0] != "<" or len(tok) == 1:
            if pieces:
                pieces.append(tok)              # adjacent character data is one string
                continue
            kind, tag, text, opens = "text", None, None, False
            pieces.append(tok)
        else:
            if pieces:
                texts[-1] = _html.unescape("".join(pieces))
                pieces.clear()
            if tok[1] == "/":
                m = _NAME.match(tok)
                name = m.group(1).lower() if m else ""
                if name in names:
                    k = len(names) - 1 - names[::-1].index(name)
                    for node in stack[k:]:
                        ends[node] = len(ends) - 1
                    del stack[k:]
                    del names[k:]
                continue
            kind, tag, text, opens = "tag", None, None, False
            if tok[1].isalpha():
                m = _NAME.match(tok)
                tag = m.group(1).lower()
                if repaired:
                    k = _implied_end(tag, names)
                    for node in stack[k:]:
                        ends[node] = len(ends) - 1
                    del stack[k:]
                    del names[k:]
                if tag in RAW_TEXT_TAGS and "</" in tok:
                    tok = tok[: tok.index(">") + 1]
                else:
                    opens = not (tag in VOID_TAGS or tok.endswith("/>"))
                rest = tok[m.end(): -1] if tok.endswith(">") else tok[m.end():]
                if rest:
                    at = _attrs(rest)
                    if at:
                        found.append((len(ends), at))
            elif tok.startswith("<![CDATA["):
                kind, text = "text", tok[9:-3]      # character data, not entity-decoded
            elif tok.startswith("<!--"):
                kind, text = "comment", tok[4:-3] if tok.endswith("-->") and len(tok) >= 7 else tok[4:]
            elif tok[1] == "!":
                kind, text = "doctype", tok[2:-1]
                if text[:8].upper() == "DOCTYPE ":
                    text = text[8:]
            elif tok[1] == "?":
                kind, text = "pi", tok[2:-1]
        pos = len(ends)
        parents.append(stack[-1] if stack else -1)
        depths.append(len(stack))
        kinds.append(kind)
        tags.append(tag)
        ptags.append(names[-1] if names else None)
        texts.append(text)
        ends.append(pos)
        if opens:
            stack.append(pos)
            names.append(tag)
    if pieces:
        texts[-1] = _html.unescape("".join(pieces))
    for node in stack:
        ends[node] = len(ends) - 1
    out["doc_id"].extend([doc_id] * len(ends))
    out["pos"].extend(range(len(ends)))
    out["end_pos"].extend(ends)
    base = len(out["id"])
    for a in ATTRS:
        out[a].extend([None] * len(ends))
    for pos, at in found:
        for a, value in at.items():
            out[a][base + pos] = value


def _nest_partition(batches, carry=(), repaired=False):
    """Node frames of bounded size: a frame is handed on once it has FRAME_NODES nodes."""
    cols = [f.name for f in NODE_SCHEMA.fields]

    def frame(out, extra):
        made = pd.DataFrame(out, columns=cols)
        for c in carry:
            made[c] = extra[c]
        return made.astype({"pos": "int32", "parent": "int32", "end_pos": "int32", "depth": "int32"})

    for pdf in batches:
        out, extra = {c: [] for c in cols}, {c: [] for c in carry}
        for i, (doc_id, toks) in enumerate(zip(pdf["doc_id"].tolist(), pdf["tokens"])):
            before = len(out["pos"])
            _nest_one(doc_id, list(toks) if toks is not None else [], out, repaired)
            for c in carry:
                extra[c].extend([pdf[c].iat[i]] * (len(out["pos"]) - before))
            if len(out["pos"]) >= FRAME_NODES:
                yield frame(out, extra)
                out, extra = {c: [] for c in cols}, {c: [] for c in carry}
        if out["pos"]:
            yield frame(out, extra)


def html_nodes(docs: DataFrame, key: str = "doc_id", html: str = "html",
               carry: tuple[str, ...] = ("archive", "path", "renderer"), mode: str = "literal") -> DataFrame:
    """Node relation of every document (see module doc); ``mode`` is one of ``MODES``.

    Columns named in ``carry`` (when present) are copied onto every node, so
    later steps that need them (entry links resolve against the document's
    archive and path) need no join back to the documents.

    Nodes are dealt by document over as many partitions as the HTML's size asks
    for.  The steps behind it sort them many times, so a task's memory is that of
    its nodes; their shuffled size says little, as they compress very well.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    repaired = mode == "repaired"
    carry = tuple(c for c in carry if c in docs.columns)
    # the key may be a string (a cache key): ordinals are unique within an archive only
    by_text = isinstance(docs.schema[key].dataType, StringType)
    doc_id = F.col(key) if by_text else F.col(key).cast("bigint")
    toks = docs.select(doc_id.alias("doc_id"), *carry, tokens(html).alias("tokens"))
    first = StructField("doc_id", StringType() if by_text else LongType())
    schema = StructType([first, *NODE_SCHEMA.fields[1:], *[StructField(c, StringType()) for c in carry]])
    held = docs.agg(F.sum(F.octet_length(html))).first()[0] or 0
    nodes = toks.mapInPandas(lambda it: _nest_partition(it, carry, repaired), schema=schema).repartition(
        max(LEAST_TASKS, -(-held // TASK_BYTES)), "doc_id")
    cls = F.col("class")
    return nodes.select(
        "doc_id", *carry, "pos", "parent", "end_pos", "depth", "kind", "tag", "ptag", "id",
        F.when(cls.isNotNull(), F.filter(F.split(T.py_strip(cls), T.PYWS + "+"), lambda x: x != ""))
        .otherwise(F.array().cast("array<string>")).alias("classes"),
        "href", "colspan", "rowspan", "text")


def has_class(name: str) -> Column:
    return F.array_contains("classes", name)


def by_doc(order: bool = True):
    w = Window.partitionBy("doc_id")
    return w.orderBy("pos") if order else w


def running_cover(flag: Column, inclusive: bool = True) -> Column:
    """True when some flagged node at or before this one (strictly before when
    not ``inclusive``) has an interval that reaches this position."""
    w = by_doc().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.max(F.when(flag, F.col("end_pos"))).over(w) >= F.col("pos"), F.lit(False))


def last_open(flag: Column, what: str = "pos") -> Column:
    """Value of ``what`` at the most recent flagged node at or before this one."""
    w = by_doc().rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(flag, F.col(what)), ignorenulls=True).over(w)
