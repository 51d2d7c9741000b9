"""HTML -> text markup as relational jobs over the node table.

Every step is a window over ``(doc_id order by pos)`` on one doc-partitioned
node table (one shuffle), plus co-partitioned joins on ``(doc_id, pos)``:

1. root choice per rule set (first node of the highest-priority selector);
2. boilerplate removal: a running max of ``end_pos`` over removed elements;
3. blocks: outermost block handlers (and bare text) under the root;
4. inline rendering: open/leaf/close *events* ordered by position, wrapped
   markup only when the element holds a non-blank contribution (prefix sums
   of non-blank events, looked up at ``end_pos``);
5. lines per block, then the document: blocks joined by blank lines,
   blank runs collapsed.

Rule sets differ in removal rules, roots and a few blocks.  With ``BY_TYPE`` in
place of a rule set's name, each document's own rule set is taken from its
column ``renderer``: one plan renders documents of all types, each node is made
once, and where rule sets differ an expression chooses by that column.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.plan import materialize
from quire.operators import html as H
from quire.operators import layout as L
from quire.operators.rules import (BACK_TO_TOP, BLOCK_SKIP, BLOCK_TYPES, BOLD, BY_TYPE, CITE_COLOR, CODE, CODE_BG, CODE_FG, CONTENTS_RULE,
                                   DEFAULT_PAGE_ROOT, EXTERNAL_CLASSES, EXTERNAL_PREFIXES, HEADINGS, INLINE_TYPES, ITALIC, LINK_COLOR,
                                   NAV_COLOR, RENDERERS, RULES, TABLE_FENCE, TEXTLIKE, TOP_ANCHOR, WIKI_BLOCK_SKIP)


# Fixed predicates are built once per process: composing a Column costs JVM
# round trips, and these are used dozens of times per plan.
@functools.cache
def _is_tag(*names) -> Column:
    return (F.col("kind") == "tag") & F.col("tag").isin(*names)


@functools.cache
def _class_any_t(names: tuple) -> Column:
    return F.arrays_overlap("classes", F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def _class_any(names) -> Column:
    return _class_any_t(tuple(names))


def _by_kind(kind: str, make) -> Column:
    """What ``make`` gives for the rule set: one, or each document's own."""
    if kind != BY_TYPE:
        return make(kind)
    return (F.when(F.col("renderer") == "wikipedia", make("wikipedia"))
            .when(F.col("renderer") == "gutenberg", make("gutenberg")).otherwise(make("generic")))


def _may_be(kind: str, one: str) -> bool:
    return kind in (one, BY_TYPE)


def _is_kind(kind: str, one: str) -> Column:
    return F.col("renderer") == one if kind == BY_TYPE else F.lit(kind == one)


def _own_columns(kind: str) -> list[str]:
    return ["renderer"] if kind == BY_TYPE else []


# ---------------------------------------------------------------------------
# EXT-2 / EXT-3: root choice and boilerplate removal
# ---------------------------------------------------------------------------

def _root_priority(kind: str) -> Column:
    expr = None
    for prio, (k, v) in enumerate(RULES[kind]["roots"]):
        cond = (F.col("kind") == "tag") & (
            F.array_contains("classes", v) if k == "class"
            else (F.col("tag") == v) if k == "tag" else (F.col("id") == v))
        expr = F.when(cond, F.lit(prio)) if expr is None else expr.when(cond, F.lit(prio))
    return expr


def clean_tree(nodes: DataFrame, kind: str = "generic") -> DataFrame:
    """Adds ``root_pos, in_root, removed, kept`` under the ``kind`` rule set."""
    w_doc = H.by_doc(order=False)
    priority = _by_kind(kind, _root_priority)
    cand = F.when(priority.isNotNull(), F.struct(priority.alias("p"), F.col("pos").alias("q"), F.col("end_pos").alias("e")))
    n = nodes.withColumns(
        {"_root": F.min(cand).over(w_doc), "_last": F.max("pos").over(w_doc)})
    root_pos = F.coalesce(F.col("_root.q"), F.lit(-1))
    root_end = F.coalesce(F.col("_root.e"), F.col("_last"))
    in_root = (F.col("pos") > root_pos) & (F.col("pos") <= root_end)
    n = n.withColumns({"root_pos": root_pos, "root_end": root_end, "in_root": in_root,
                       "_tag_rm": in_root & _by_kind(kind, lambda k: _is_tag(*RULES[k]["tags"]))}).drop("_root", "_last")
    rm = F.col("_tag_rm") | (F.col("in_root") & (F.col("kind") == "tag")
                             & _by_kind(kind, lambda k: _class_any(RULES[k]["classes"])))
    with_ids = [k for k in RENDERERS if RULES[k]["ids"] and _may_be(kind, k)]
    if with_ids:
        # per id, the first element among what the tag pass and the ids before it left
        n = n.withColumn("_gone", F.col("_tag_rm"))
        for one, ident in [(k, i) for k in with_ids for i in RULES[k]["ids"]]:
            n = n.withColumn("_left", F.col("in_root") & ~H.running_cover(F.col("_gone")))
            first = F.min(F.when(F.col("_left") & (F.col("id") == ident) & _is_kind(kind, one), F.col("pos"))).over(w_doc)
            n = n.withColumn("_gone", F.col("_gone") | F.coalesce(F.col("pos") == first, F.lit(False)))
        n = n.withColumn("_rm", rm | F.col("_gone")).drop("_gone", "_left")
    else:
        n = n.withColumn("_rm", rm)
    removed = H.running_cover(F.col("_rm"))
    return n.withColumns({"removed": removed, "kept": F.col("in_root") & ~removed}).drop("_tag_rm", "_rm")


# ---------------------------------------------------------------------------
# EXT-4: blocks
# ---------------------------------------------------------------------------

def blocks(nodes: DataFrame, kind: str = "generic") -> DataFrame:
    """Node table with block assignment.

    Adds ``btype`` (heading/p/list/dl/quote/pre/table/text/wheading) on block
    roots, and for every kept node ``block`` (root pos), ``block_type``,
    ``block_depth`` and ``in_block``.
    """
    n = clean_tree(nodes, kind)
    wiki = _is_kind(kind, "wikipedia")
    skip = _is_tag(*BLOCK_SKIP)
    btype = F.when(F.lit(False), F.lit(""))
    if _may_be(kind, "wikipedia"):
        skip = skip | (wiki & _is_tag(*WIKI_BLOCK_SKIP))
        btype = F.when(wiki & (F.col("tag") == "div") & F.array_contains("classes", "mw-heading"), "wheading")
        btype = btype.when(wiki & _is_tag("ol") & F.array_contains("classes", "references"), "references")
        btype = btype.when(wiki & _is_tag("table") & ~F.array_contains("classes", "wikitable"), "skip")
    for tag, bt in BLOCK_TYPES.items():
        btype = btype.when(_is_tag(tag), bt)
    btype = btype.when(skip, "skip").when(F.col("kind").isin(*TEXTLIKE), "text")
    bt = F.when(F.col("kept"), btype)
    handler = F.col("kept") & bt.isNotNull() & (F.col("kind") == "tag")
    n = n.withColumns({"_bt": bt, "_covered": H.running_cover(handler, inclusive=False)})
    root = F.col("kept") & ~F.col("_covered") & F.col("_bt").isNotNull() & (F.col("_bt") != "skip")
    n = n.withColumn("btype", F.when(root, F.col("_bt")))
    is_root = F.col("btype").isNotNull()
    n = n.withColumns({"block": H.last_open(is_root, "pos"), "_bend": H.last_open(is_root, "end_pos"),
                       "block_type": H.last_open(is_root, "btype"),
                       "block_depth": H.last_open(is_root, "depth")})
    in_block = F.col("kept") & F.col("block").isNotNull() & (F.col("pos") <= F.col("_bend"))
    return n.withColumn("in_block", in_block).drop("_bt", "_covered", "_bend")


# ---------------------------------------------------------------------------
# EXT-5..17: one events table for every block type
# ---------------------------------------------------------------------------

def _ordered_join(col_struct: Column, sep: str) -> Column:
    """array_join of values of collected (pos, v) structs in position order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(col_struct)), lambda x: x["v"]), sep)


@functools.cache
def _link_kind() -> Column:
    href = T.py_strip(F.coalesce("href", F.lit("")))
    ext = F.lit(False)
    for p in EXTERNAL_PREFIXES:
        ext = ext | href.startswith(p)
    ext = ext | _class_any(EXTERNAL_CLASSES)
    return (F.when(href == "", "plain").when(href.startswith("#"), "anchor")
            .when(ext, "external").otherwise("entry"))


@functools.cache
def _cite() -> Column:
    return _is_tag("sup") & F.array_contains("classes", "reference")


def inline_marks(b: DataFrame) -> DataFrame:
    """Adds ``link_kind``, ``_atomic`` (replaced by one rendered value),
    ``_inside_atomic`` and ``_owner`` (the atomic element a node sits in)."""
    inline = F.col("in_block") & F.col("block_type").isin(*INLINE_TYPES) & (F.col("pos") > F.col("block"))
    # regex work on node text happens once per node (a generator keeps the
    # optimizer from copying these expressions into every later use)
    n = materialize(b, b.columns,
                    _piece=F.when(F.col("kind") == "text", T.py_strip(F.col("text"))),
                    _textv=F.when(F.col("kind").isin(*TEXTLIKE), T.escape_markup(T.norm_space(F.col("text")))),
                    link_kind=F.when(_is_tag("a"), _link_kind()))
    atomic = inline & (F.col("link_kind").isin("anchor", "entry") | _cite() | _is_tag("style", "script", "br"))
    n = n.withColumn("_inside_atomic", H.running_cover(atomic, inclusive=False))
    # only outermost atomic elements render; everything below belongs to them
    n = n.withColumn("_atomic", atomic & ~F.col("_inside_atomic"))
    return n.withColumn("_owner", F.when(F.col("_inside_atomic"), H.last_open(F.col("_atomic"), "pos")))


def _entry_link(label: Column, path: Column, archive: Column, page_root: str) -> Column:
    lab = T.clean_label(label)
    fields = F.concat(F.lit("entry_path="), path)
    fields = F.when(F.coalesce(archive, F.lit("")) != "",
                    F.concat(F.lit("zim="), archive, F.lit("|"), fields)).otherwise(fields)
    return F.when((path == "") | (lab == ""), T.escape_markup(lab)).otherwise(
        F.concat(F.lit(f"`F{LINK_COLOR}`_`["), lab, F.lit(f"`:{page_root}/entry.mu`"), fields,
                 F.lit("]`_`f")))


def _anchor_link(label: Column, target: Column, color: str = LINK_COLOR) -> Column:
    lab = T.clean_label(label)
    dest = T.slug(target)
    return (F.when(lab == "", F.lit(""))
            .when(dest == "", T.escape_markup(lab))
            .otherwise(F.concat(F.lit(f"`F{color}`_`["), lab, F.lit("`#"), dest, F.lit("]`_`f"))))


def _with_atomic_values(n: DataFrame, page_root: str) -> DataFrame:
    """Adds ``link_v`` on atomic links and citations.

    Everything below an atomic element is gathered with one window over
    (doc, owner): a link's label is its plain text; a citation uses its first
    ``a`` with an href (number = that link's text, target = slug of the href).
    """
    n = n.withColumn("_grp", F.when(F.col("_atomic"), F.col("pos")).otherwise(F.col("_owner")))
    w = Window.partitionBy("doc_id", "_grp")
    below = F.col("_owner").isNotNull()
    texts = F.array_sort(F.collect_list(F.when(below & (F.col("kind") == "text"),
                                               F.struct(F.col("pos"), F.col("text").alias("v")))).over(w))
    first_a = F.min(F.when(below & _is_tag("a") & F.col("href").isNotNull(),
                           F.struct("pos", "end_pos", "href"))).over(w)
    n = n.withColumns({"_texts": F.when(F.col("_atomic"), texts),
                       "_first_a": F.when(F.col("_atomic") & _cite(), first_a)})
    # links
    is_link = F.col("_atomic") & F.col("link_kind").isin("anchor", "entry")
    href = T.py_strip(F.coalesce("href", F.lit("")))
    lab = F.coalesce(F.array_join(F.transform("_texts", lambda x: x["v"]), ""), F.lit(""))
    link_v = (F.when(F.col("link_kind") == "anchor", _anchor_link(lab, F.substring(href, 2, 1 << 30)))
              .otherwise(_entry_link(lab, T.resolve_path(href, F.col("path")), F.col("archive"), page_root)))
    # citations
    fa = F.col("_first_a")
    in_a = F.filter("_texts", lambda x: (x["pos"] > fa["pos"]) & (x["pos"] <= fa["end_pos"]))
    num = T.citation_number(F.array_join(F.filter(F.transform(in_a, lambda x: T.py_strip(x["v"])),
                                                  lambda v: v != ""), " "))
    cite_ok = F.col("_atomic") & _cite() & fa.isNotNull() & fa["href"].startswith("#")
    target = T.slug(F.substring(fa["href"], 2, 1 << 30))
    sid = F.when(F.coalesce(F.col("id"), F.lit("")) != "", T.slug("id"))
    cite_v = F.concat(F.coalesce(F.concat(F.lit("`:"), sid), F.lit("")), F.lit(f"[`F{CITE_COLOR}`_`["),
                      num, F.lit("`#"), target, F.lit("]`_`f]"))
    v = F.when(is_link, link_v).when(F.col("_atomic") & _cite(), F.when(cite_ok, cite_v).otherwise(F.lit("")))
    n = n.withColumns({"cite_ok": F.coalesce(cite_ok, F.lit(False)), "cite_target": F.when(cite_ok, target),
                       "cite_num": F.when(cite_ok, num), "cite_sid": F.when(cite_ok, sid), "link_v": v})
    return n.drop("_grp", "_texts", "_first_a")


def _references(n: DataFrame) -> DataFrame:
    """Reference lists (wikipedia ``ol.references``): direct ``li`` items.

    Per item: ``ref_anchor`` (slug of its id), back-link span (first
    ``span.mw-cite-backlink``, removed from the text), text span (first
    ``span.reference-text`` outside it) and the back-link target.
    """
    in_refs = F.col("in_block") & (F.col("block_type") == "references")
    is_item = in_refs & _is_tag("li") & (F.col("parent") == F.col("block"))
    n = n.withColumn("_ref_li", is_item)
    n = n.withColumn("ref_owner", F.when(is_item, F.col("pos")).otherwise(F.when(
        in_refs & (F.col("pos") <= H.last_open(is_item, "end_pos")), H.last_open(is_item, "pos"))))
    w = Window.partitionBy("doc_id", "ref_owner")
    inside = F.col("ref_owner").isNotNull() & (F.col("pos") > F.col("ref_owner"))
    back = F.min(F.when(inside & _is_tag("span") & F.array_contains("classes", "mw-cite-backlink"),
                        F.struct("pos", "end_pos"))).over(w)
    n = n.withColumn("_back", back)
    in_back = F.coalesce((F.col("pos") >= F.col("_back.pos")) & (F.col("pos") <= F.col("_back.end_pos")),
                         F.lit(False))
    n = n.withColumn("in_back", in_back)
    back_a = F.min(F.when(F.col("in_back") & (F.col("pos") > F.col("_back.pos")) & _is_tag("a")
                          & F.col("href").isNotNull(), F.struct("pos", "href"))).over(w)
    span = F.min(F.when(inside & ~F.col("in_back") & _is_tag("span")
                        & F.array_contains("classes", "reference-text"), F.struct("pos", "end_pos"))).over(w)
    n = n.withColumn("_span", span).withColumn("_back_a", back_a)
    n = n.withColumn("has_span", F.col("_span").isNotNull())
    n = n.withColumn("in_span", F.coalesce((F.col("pos") > F.col("_span.pos"))
                                           & (F.col("pos") <= F.col("_span.end_pos")), F.lit(False)))
    dest = F.when(F.col("_back_a.href").startswith("#cite_ref"), T.slug(F.substring("_back_a.href", 2, 1 << 30)))
    return (n.withColumn("ref_anchor", F.when(is_item, T.slug(F.coalesce("id", F.lit("")))))
            .withColumn("back_dest", F.when(is_item, dest))
            .drop("_back", "_span", "_back_a"))


def _no_references(n: DataFrame) -> DataFrame:
    """Reference-list columns for rule sets without reference lists."""
    for c, t in [("_ref_li", "boolean"), ("ref_owner", "int"), ("in_back", "boolean"), ("has_span", "boolean"),
                 ("in_span", "boolean"), ("ref_anchor", "string"), ("back_dest", "string")]:
        n = n.withColumn(c, F.lit(None).cast(t))
    return n.withColumn("_ref_li", F.lit(False)).withColumn("in_back", F.lit(False))


def _reference_numbers(n: DataFrame) -> DataFrame:
    """Number and back-link of every reference item, from what was rendered before it.

    The number is the last citation to the item's anchor earlier in the
    document (last write wins), else a running count of unmatched items; the
    back-link needs its target anchor to have been emitted earlier.  Both are
    windows keyed by (doc, anchor) - an as-of lookup without a join.
    """
    key = F.when(F.col("_cite_live"), F.col("cite_target")).when(F.col("_ref_li"), F.col("ref_anchor"))
    n = n.withColumn("_ck", key)
    w = Window.partitionBy("doc_id", "_ck").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_matched", F.when(F.col("_ref_li") & F.col("_ck").isNotNull(),
                                        F.last(F.when(F.col("_cite_live"), F.col("cite_num")),
                                               ignorenulls=True).over(w)))
    unmatched = (F.col("_ref_li") & F.col("_matched").isNull()).cast("int")
    n = n.withColumn("_cnt", F.sum(unmatched).over(H.by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumn("ref_num", F.when(F.col("_ref_li"), F.coalesce("_matched", F.col("_cnt").cast("string"))))
    emits = F.col("_emit").isNotNull()
    key2 = F.when(emits, F.col("_emit")).when(F.col("_ref_li"), F.col("back_dest"))
    n = n.withColumn("_ek", key2)
    w2 = Window.partitionBy("doc_id", "_ek").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.max(emits.cast("int")).over(w2)
    n = n.withColumn("ref_back", F.when(F.col("_ref_li") & F.col("_ek").isNotNull() & (seen == 1),
                                        F.col("back_dest")))
    return n.drop("_ck", "_matched", "_cnt", "_ek")


def _list_structure(n: DataFrame) -> DataFrame:
    """List blocks: ``item`` owner of inline content, ``ordinal`` of direct li.

    At odd offset from the list an element must be an ``li`` (anything else
    is ignored with its subtree); at even offset a ``ul``/``ol`` is a nested
    list and anything else is inline content of the li above it.
    """
    in_list = F.col("in_block") & (F.col("block_type") == "list")
    off = F.col("depth") - F.col("block_depth")
    odd = off % 2 == 1
    ok = (F.col("pos") == F.col("block")) | ((F.col("kind") == "tag") & (
        (odd & (F.col("tag") == "li")) | (~odd & F.col("tag").isin("ul", "ol"))))
    lflag = in_list & ~ok
    n = n.withColumns({"_lflag": lflag, "_off": F.when(in_list, off),
                       "_ltop": lflag & ~H.running_cover(lflag, inclusive=False)})
    n = n.withColumns({"_lt_pos": H.last_open(F.col("_ltop"), "pos"),
                       "_lt_end": H.last_open(F.col("_ltop"), "end_pos"),
                       "_lt_off": H.last_open(F.col("_ltop"), "_off"),
                       "_lt_par": H.last_open(F.col("_ltop"), "parent")})
    under = in_list & F.col("_lt_pos").isNotNull() & (F.col("pos") <= F.col("_lt_end"))
    is_li = in_list & ~under & _is_tag("li")
    is_nested = in_list & ~under & _is_tag("ul", "ol") & (F.col("pos") > F.col("block"))
    w_sib = Window.partitionBy("doc_id", "parent").orderBy("pos")
    return n.withColumns({
        "item": F.when(under & (F.col("_lt_off") % 2 == 0), F.col("_lt_par")),
        "ordinal": F.when(is_li, F.sum(is_li.cast("int")).over(w_sib.rowsBetween(Window.unboundedPreceding, 0))),
        "_is_li": is_li, "_is_nested": is_nested})


def _dl_structure(n: DataFrame) -> DataFrame:
    """Definition lists: direct dt/dd children own their inline content."""
    in_dl = F.col("in_block") & (F.col("block_type") == "dl")
    is_def = in_dl & _is_tag("dt", "dd") & (F.col("parent") == F.col("block"))
    n = n.withColumns({"_is_def": is_def, "_d_pos": H.last_open(is_def, "pos"),
                       "_d_end": H.last_open(is_def, "end_pos")})
    return n.withColumn("def_item", F.when(in_dl & (F.col("pos") > F.col("_d_pos"))
                                           & (F.col("pos") <= F.col("_d_end")), F.col("_d_pos")))


def _emitting(b: DataFrame, kind: str, page_root: str) -> tuple[DataFrame, Column, Column]:
    """Nodes with the anchor that each emits while rendering (``_emit``): id anchors and
    cited sup ids; also the conditions *live* (rendered inline) and *refs* (in a reference list)."""
    n = inline_marks(b)
    n = _references(n) if _may_be(kind, "wikipedia") else _no_references(n)
    n = _with_atomic_values(_dl_structure(_list_structure(n)), page_root)
    inline = F.col("in_block") & F.col("block_type").isin(*INLINE_TYPES)
    refs = F.col("block_type") == "references"
    # items of lists and definition lists are laid out by their block: only what is in them is inline
    own_item = F.col("_is_li") | F.col("_is_nested") | F.col("_is_def")
    live = (inline & (F.col("pos") > F.col("block")) & ~F.col("_inside_atomic") & ~F.coalesce(own_item, F.lit(False))
            & (~refs | (F.col("has_span") & F.col("in_span"))))
    ident = T.slug(F.coalesce("id", F.lit("")))
    no_anchor = _is_tag("br", "style", "script") | _cite()
    anchor_ok = live & (F.col("kind") == "tag") & ~no_anchor & (ident != "")
    anchor = F.when(anchor_ok, F.concat(F.lit("`:"), ident, F.lit("`a")))
    return n.withColumns({"_emit": F.when(anchor_ok, ident).when(live & F.col("cite_ok"), F.col("cite_sid")),
                          "_cite_live": live & F.col("cite_ok"), "_anchor": anchor}), live, refs


def render_events(b: DataFrame, docs: DataFrame, kind: str = "generic",
                  page_root: str = DEFAULT_PAGE_ROOT) -> DataFrame:
    """Rendered lines of every block: (doc_id, block, gkey, idx, line).

    Each node contributes an *open* value at ``pos`` and a *close* value at
    ``end_pos``; grouping by (block, owner) and sorting the collected
    values rebuilds the inline text of every paragraph, list item, definition,
    quote, heading and preformatted block in one aggregation.
    """
    n, live, refs = _emitting(b, kind, page_root)
    if _may_be(kind, "wikipedia"):
        n = _reference_numbers(n)
    else:
        n = n.withColumns({"ref_num": F.lit(None).cast("string"), "ref_back": F.lit(None).cast("string")})
    leaf = (F.when(F.col("kind").isin(*TEXTLIKE), F.col("_textv"))
            .when(_is_tag("br"), F.lit("\n"))
            .when(_is_tag("style", "script"), F.lit(""))
            .when(_cite() | F.col("link_kind").isin("anchor", "entry"), F.coalesce("link_v", F.lit(""))))
    leaf = F.when(live, leaf)
    n = n.withColumn("_leaf", leaf)
    nb = (F.when(F.coalesce(T.py_strip(F.col("_leaf")), F.lit("")) != "", 1).otherwise(0)
          + F.when(F.col("_anchor").isNotNull(), 1).otherwise(0))
    # wrapped iff the next non-blank contribution after this node lies inside it:
    # a running min over the rows that follow (reverse order, so it stays O(n))
    rev = Window.partitionBy("doc_id").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("_next_nb", F.min(F.when(nb > 0, F.col("pos"))).over(rev))
    wrapped = F.coalesce(F.col("_next_nb") <= F.col("end_pos"), F.lit(False))
    is_el = live & (F.col("kind") == "tag") & F.col("_leaf").isNull()
    wrap_open = (F.when(_is_tag(*BOLD), "`!").when(_is_tag(*ITALIC), "`*")
                 .when(_is_tag(*CODE), f"`B{CODE_BG}`F{CODE_FG}"))
    wrap_close = F.when(_is_tag(*BOLD), "`!").when(_is_tag(*ITALIC), "`*").when(_is_tag(*CODE), "`f`b")
    inline_open = F.when(live, F.concat_ws("", F.col("_anchor"),
                                           F.when(is_el & wrapped, wrap_open), F.col("_leaf")))
    inline_close = F.when(is_el & wrapped, wrap_close)
    # heading text: stripped strings of the (first) heading, space separated
    first_h = F.min(F.when(F.col("in_block") & _is_tag(*HEADINGS) & (F.col("pos") > F.col("block")),
                           F.struct("pos", "end_pos", "tag"))).over(Window.partitionBy("doc_id", "block"))
    if _may_be(kind, "wikipedia"):
        n = n.withColumn("_fh", F.when(F.col("block_type") == "wheading", first_h))
    else:
        n = n.withColumn("_fh", F.lit(None).cast("struct<pos:int,end_pos:int,tag:string>"))
    in_heading = (F.col("block_type") == "heading") | (
        (F.col("pos") > F.col("_fh.pos")) & (F.col("pos") <= F.col("_fh.end_pos")))
    piece = F.coalesce(F.col("_piece"), F.lit(""))
    heading_v = F.when(in_heading & (F.col("kind") == "text") & (F.col("pos") > F.col("block")) & (piece != ""),
                       F.concat(F.lit(" "), piece))
    btype = F.col("block_type")
    ref_plain = F.when(F.col("ref_owner").isNotNull() & ~F.col("has_span") & ~F.col("in_back")
                       & (F.col("kind") == "text") & (piece != ""), F.concat(F.lit(" "), piece))
    open_v = (F.when(btype.isin("heading", "wheading"), heading_v)
              .when(refs & ~F.coalesce(F.col("has_span"), F.lit(False)), ref_plain)
              .when(btype == "pre", F.when((F.col("kind") == "text") & (F.col("pos") > F.col("block")),
                                           F.col("text")))
              .when(btype == "text", F.col("text"))
              .otherwise(inline_open))
    close_v = F.when(btype.isin(*INLINE_TYPES), inline_close)
    owner = (F.when(F.col("pos") == F.col("block"), F.col("block"))
             .when(F.col("ref_owner").isNotNull(), F.col("ref_owner"))
             .when(F.col("_is_li") | F.col("_is_nested") | F.col("_is_def"), F.col("pos"))
             .when(F.col("item").isNotNull(), F.col("item"))
             .when(F.col("def_item").isNotNull(), F.col("def_item"))
             .when(btype.isin("list", "dl"), F.lit(None))
             .otherwise(F.col("block")))
    ev = n.filter(F.col("in_block")).select(
        "doc_id", *_own_columns(kind), "block", btype.alias("btype"), owner.alias("owner"), "pos", "end_pos", "tag",
        "ptag", "_off", "ordinal", "_is_li", "_is_nested", "_is_def", "_ref_li", "ref_anchor", "ref_num",
        "ref_back", "has_span",
        F.struct(F.col("pos").cast("bigint").alias("k1"), F.lit(0).alias("k2"),
                 F.lit(0).cast("bigint").alias("k3"), open_v.alias("v")).alias("_o"),
        F.struct(F.col("end_pos").cast("bigint").alias("k1"), F.lit(1).alias("k2"),
                 (-F.col("pos")).cast("bigint").alias("k3"), close_v.alias("v")).alias("_c"),
        F.when(btype.isin("heading", "wheading"),
               F.coalesce(F.col("_fh.tag"), F.when(F.col("pos") == F.col("block"), F.col("tag")))).alias("_htag"),
    ).filter(F.col("owner").isNotNull())
    me = F.col("pos") == F.col("owner")
    g = ev.groupBy("doc_id", "block", "owner").agg(
        F.first("btype").alias("btype"),
        F.array_join(F.transform(F.array_sort(F.concat(F.collect_list("_o"), F.collect_list("_c"))),
                                 lambda x: x["v"]), "").alias("content"),
        F.max(F.when(me, F.col("tag"))).alias("otag"),
        F.max(F.when(me, F.col("ptag"))).alias("optag"),
        F.max(F.when(me, F.col("end_pos"))).alias("oend"),
        F.max(F.when(me, F.col("_off"))).alias("ooff"),
        F.max(F.when(me, F.col("ordinal"))).alias("oordinal"),
        F.max(F.when(me, F.col("_is_li"))).alias("o_li"),
        F.max(F.when(me, F.col("_is_nested"))).alias("o_nested"),
        F.max(F.when(me, F.col("_is_def"))).alias("o_def"),
        F.max(F.when(me, F.col("_ref_li"))).alias("o_ref"),
        F.max(F.when(me, F.col("ref_anchor"))).alias("ref_anchor"),
        F.max(F.when(me, F.col("ref_num"))).alias("ref_num"),
        F.max(F.when(me, F.col("ref_back"))).alias("ref_back"),
        F.max(F.when(me, F.col("has_span"))).alias("has_span"),
        F.max("_htag").alias("htag"),
        *[F.first(c).alias(c) for c in _own_columns(kind)],
    )
    return g.select("doc_id", "block", "owner", F.explode(_format_lines(kind)).alias("l")) \
        .select("doc_id", "block", F.col("l.gkey").alias("gkey"), F.col("l.idx").alias("idx"),
                F.col("l.line").alias("line"), F.col("l.hlevel").alias("hlevel"),
                F.col("l.htitle").alias("htitle"))


def _lines_at(gkey: Column, arr: Column, hlevel: Column | None = None,
              htitle: Column | None = None) -> Column:
    hl = F.lit(None).cast("int") if hlevel is None else hlevel.cast("int")
    ht = F.lit(None).cast("string") if htitle is None else htitle
    return F.transform(arr, lambda x, i: F.struct(gkey.cast("bigint").alias("gkey"), i.alias("idx"),
                                                  x.alias("line"), hl.alias("hlevel"), ht.alias("htitle")))


def _emit_text_block(text: Column) -> Column:
    """Lines of a text block: split at newlines, trim, drop empties, guard."""
    t = F.btrim(text, F.lit("\n"))
    lines = F.filter(F.transform(F.split(t, "\n", -1), lambda s: T.py_strip(s)), lambda s: s != "")
    return F.when(T.py_strip(t) == "", F.array().cast("array<string>")).otherwise(
        F.transform(lines, lambda s: T.guard_line(s)))


def _format_lines(kind: str) -> Column:
    """Per (block, owner) group: array of (gkey, idx, line)."""
    c = F.col("content")
    empty = F.array().cast("array<string>")
    flat = T.py_strip(T.norm_space(c))
    # headings
    level = F.substring("htag", 2, 1).cast("int")
    heading = F.when((F.col("htag").isNotNull()) & (flat != ""), F.array(
        F.concat(F.repeat(F.lit(">"), F.least(level, F.lit(4))), T.escape_markup(flat)))).otherwise(empty)
    # bare text at block level: escape, collapse, trim
    text = _emit_text_block(T.py_strip(T.norm_space(T.escape_markup(c))))
    # preformatted
    pre_t = T.norm_newlines(c)
    pre_l = F.split(pre_t, "\n", -1)
    pre_fmt = _by_kind(kind, lambda k: F.transform(pre_l, lambda s: T.guard_line(T.escape_markup(T.py_rstrip(s))))
                       if k == "gutenberg" else F.transform(pre_l, lambda s: F.concat(
                           F.lit(f"`B{CODE_BG}`F{CODE_FG}"), T.escape_markup(T.py_rstrip(s)), F.lit("`f`b"))))
    pre = F.when(T.py_strip(pre_t) != "", pre_fmt).otherwise(empty)
    quote = F.when(flat != "", F.array(F.concat(F.lit("  `*"), flat, F.lit("`*")))).otherwise(empty)
    # list items
    depth = F.floor((F.col("ooff") - 1) / 2).cast("int")
    bullet = F.when(F.col("optag") == "ol", F.concat(F.col("oordinal").cast("string"), F.lit(".")))\
        .otherwise(F.lit("•"))
    item = F.when(flat != "", F.array(F.concat(F.repeat(F.lit("  "), depth), bullet, F.lit(" "), flat)))\
        .otherwise(empty)
    dl = F.when(flat == "", empty).when(F.col("otag") == "dt", F.array(F.concat(F.lit("`!"), flat, F.lit("`!"))))\
        .otherwise(F.array(F.concat(F.lit("  "), flat)))
    owner_key = F.col("owner").cast("bigint") * 4
    # reference items: anchor, bold number, optional back-link, text
    ref_text = F.when(F.col("has_span"), flat).otherwise(T.py_strip(T.norm_space(T.escape_markup(flat))))
    back = F.when(F.col("ref_back").isNotNull(),
                  F.concat(F.lit(f" `F{NAV_COLOR}`_`[↑`#"), F.col("ref_back"), F.lit("]`_`f"))).otherwise(F.lit(""))
    ref = F.array(F.concat(F.lit("`:"), F.coalesce("ref_anchor", F.lit("")), F.lit("`!"), F.col("ref_num"),
                           F.lit(".`!"), back, F.lit(" "), ref_text))
    sep = _lines_at(F.lit(-1), F.array(F.lit("")))      # blank line before every block
    body = (F.when(F.col("o_nested"), F.concat(
                _lines_at(owner_key - 1, F.array(F.lit(""))),
                _lines_at(F.col("oend").cast("bigint") * 4 + 3, F.array(F.lit("")))))
            .when(F.col("o_li"), _lines_at(owner_key, item))
            .when(F.col("o_def"), _lines_at(owner_key, dl))
            .when(F.col("o_ref"), _lines_at(owner_key, ref))
            .when(F.col("btype").isin("heading", "wheading"),
                  _lines_at(F.lit(0), heading, F.when(F.size(heading) > 0, level), flat))
            .when(F.col("btype") == "p", _lines_at(F.lit(0), _emit_text_block(c)))
            .when(F.col("btype") == "quote", _lines_at(F.lit(0), quote))
            .when(F.col("btype") == "text", _lines_at(F.lit(0), text))
            .when(F.col("btype") == "pre", _lines_at(F.lit(0), pre))
            .otherwise(_lines_at(F.lit(0), empty)))
    return F.when(F.col("owner") == F.col("block"), F.concat(sep, body)).otherwise(body)


# ---------------------------------------------------------------------------
# EXT-12: tables
# ---------------------------------------------------------------------------

def _place_cells(cells: Column) -> Column:
    """Fold over cells sorted by (r, k): first free column of the row, honouring
    earlier row spans.  State keeps only slots of the current and later rows, so
    it stays small; returns struct(cols array<int>, ncol int)."""
    init = F.struct(F.array().cast("array<struct<r:int,c:int>>").alias("occ"),
                    F.array().cast("array<int>").alias("cols"),
                    F.lit(-1).alias("row"), F.lit(0).alias("col"), F.lit(0).alias("ncol"))

    def step(acc, x):
        col0 = F.when(x["r"] != acc["row"], F.lit(0)).otherwise(acc["col"])
        taken = F.array_sort(F.filter(F.transform(F.filter(acc["occ"], lambda o: o["r"] == x["r"]),
                                                  lambda o: o["c"]), lambda c: c >= col0))
        c = F.aggregate(taken, col0, lambda a, oc: F.when(oc == a, a + 1).otherwise(a))
        slots = F.flatten(F.transform(F.sequence(F.lit(0), x["rs"] - 1), lambda dr: F.transform(
            F.sequence(F.lit(0), x["cs"] - 1),
            lambda dc: F.struct((x["r"] + dr).alias("r"), (c + dc).alias("c")))))
        occ = F.filter(F.concat(acc["occ"], slots), lambda o: o["r"] >= x["r"])
        return F.struct(occ.alias("occ"), F.concat(acc["cols"], F.array(c)).alias("cols"),
                        x["r"].alias("row"), (c + x["cs"]).alias("col"),
                        F.greatest(acc["ncol"], c + x["cs"]).alias("ncol"))

    return F.aggregate(cells, init, step, lambda acc: F.struct(acc["cols"].alias("cols"),
                                                               acc["ncol"].alias("ncol")))


def table_lines(b: DataFrame) -> DataFrame:
    """(doc_id, block, gkey, idx, line) for table blocks.

    A table holding another table is skipped; rows are the ``tr`` with direct
    ``th``/``td`` cells, cells copy their value into every covered slot, the
    later cell wins a slot, and at least two rows are needed.
    """
    t = b.filter(F.col("in_block") & (F.col("block_type") == "table"))
    w_tab = Window.partitionBy("doc_id", "block")
    t = t.withColumn("_nested", F.max((_is_tag("table") & (F.col("pos") > F.col("block"))).cast("int"))
                     .over(w_tab))
    t = t.filter(F.col("_nested") == 0)
    is_cell = _is_tag("th", "td") & (F.col("ptag") == "tr")
    t = (t.withColumn("_cell", F.when(is_cell, F.col("pos")).otherwise(
        F.when(F.col("pos") <= H.last_open(is_cell, "end_pos"), H.last_open(is_cell, "pos")))))
    piece = T.py_strip(F.col("text"))
    part = F.when((F.col("kind") == "text") & (F.col("pos") != F.col("_cell")) & (piece != ""),
                  F.struct(F.col("pos"), piece.alias("v")))
    w_cell = Window.partitionBy("doc_id", "block", "_cell")
    t = t.withColumn("_txt", F.array_join(F.transform(F.array_sort(F.collect_list(part).over(w_cell)),
                                                      lambda x: x["v"]), " "))
    cells = t.filter(is_cell)
    cells = (cells.withColumn("r", (F.dense_rank().over(Window.partitionBy("doc_id", "block").orderBy("parent"))
                                    - 1).cast("int"))
             .withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "block", "parent")
                                                  .orderBy("pos"))))
    val = F.replace(T.escape_markup(T.py_strip(T.norm_space("_txt"))), F.lit("|"), F.lit("/"))
    val = F.when(val == "", F.lit(" ")).otherwise(val)
    cells = cells.select("doc_id", "block", F.struct(
        "r", "k", T.cell_span("colspan").alias("cs"), T.cell_span("rowspan").alias("rs"),
        val.alias("v")).alias("cell"))
    tab = cells.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    tab = tab.withColumn("_p", _place_cells(F.col("cells")))
    tab = tab.select("doc_id", "block", "cells", F.col("_p.cols").alias("cols"), F.col("_p.ncol").alias("ncol"),
                     (F.aggregate(F.col("cells"), F.lit(-1), lambda a, x: F.greatest(a, x["r"])) + 1)
                     .alias("nrows"))
    tab = tab.filter((F.col("nrows") >= 2) & (F.col("ncol") > 0))
    placed = F.transform(F.arrays_zip(F.col("cells").alias("x"), F.col("cols").alias("c")),
                         lambda z: F.struct(z["x"]["r"].alias("r"), z["c"].alias("c"), z["x"]["cs"].alias("cs"),
                                            z["x"]["rs"].alias("rs"), z["x"]["v"].alias("v")))
    slots = tab.select("doc_id", "block", "ncol", "nrows", F.posexplode(placed).alias("seq", "p"))
    slots = slots.select("doc_id", "block", "ncol", "nrows", "seq", "p.v", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0), F.col("p.rs") - 1), lambda dr: F.transform(
            F.sequence(F.lit(0), F.col("p.cs") - 1),
            lambda dc: F.struct((F.col("p.r") + dr).alias("r"), (F.col("p.c") + dc).alias("c")))))).alias("s"))
    slots = slots.filter(F.col("s.r") < F.col("nrows"))
    grid = (slots.groupBy("doc_id", "block", F.col("s.r").alias("r"), F.col("s.c").alias("c"))
            .agg(F.max_by("v", "seq").alias("v"), F.max("ncol").alias("ncol"), F.max("nrows").alias("nrows")))
    rows = (grid.groupBy("doc_id", "block", "r")
            .agg(F.collect_list(F.struct("c", "v")).alias("vals"), F.max("ncol").alias("ncol"),
                 F.max("nrows").alias("nrows")))
    cols = F.transform(F.sequence(F.lit(0), F.col("ncol") - 1), lambda c: F.coalesce(
        F.try_element_at(F.filter("vals", lambda x: x["c"] == c), F.lit(1))["v"], F.lit(" ")))
    line = F.concat(F.lit("| "), F.array_join(cols, " | "), F.lit(" |"))
    sep = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), F.col("ncol")), "|"), F.lit("|"))
    r = F.col("r").cast("bigint")
    out = (F.when(r == 0, F.concat(_lines_at(F.lit(0), F.array(F.lit(TABLE_FENCE))),
                                   _lines_at(F.lit(4), F.array(line)), _lines_at(F.lit(6), F.array(sep))))
           .otherwise(_lines_at(r * 4 + 4, F.array(line))))
    out = F.when(r == F.col("nrows") - 1,
                 F.concat(out, _lines_at(F.col("nrows").cast("bigint") * 4 + 4, F.array(F.lit(TABLE_FENCE)))))\
        .otherwise(out)
    return rows.select("doc_id", "block", F.explode(out).alias("l")).select(
        "doc_id", "block", F.col("l.gkey").alias("gkey"), F.col("l.idx").alias("idx"), F.col("l.line").alias("line"))


# ---------------------------------------------------------------------------
# EXT-18: assemble
# ---------------------------------------------------------------------------

def assemble(lines: DataFrame, docs: DataFrame, kind: str = "generic") -> DataFrame:
    """(doc_id, text): top anchor, blocks separated by blank lines, blank runs collapsed.

    wikipedia adds the contents block (level 2/3 headings, only when there are
    at least two) before the first heading, and a back-to-top line when any
    heading was rendered.
    """
    if "hlevel" not in lines.columns:
        lines = lines.withColumn("hlevel", F.lit(None).cast("int")).withColumn("htitle", F.lit(None).cast("string"))
    items = F.array_sort(F.collect_list(F.struct("block", "gkey", "idx", "line", "hlevel", "htitle")))
    body = docs.select("doc_id", *_own_columns(kind)).join(lines.groupBy("doc_id").agg(items.alias("items")), "doc_id", "left")
    plain = F.struct(F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("body"),
                     F.lit("").alias("tail"), F.lit("").alias("lead"))
    body = body.select("doc_id", _by_kind(kind, lambda k: _wiki_body() if k == "wikipedia" else plain).alias("_b")).select(
        "doc_id", "_b.*")
    doc = F.concat(F.lit(TOP_ANCHOR + "\n"), F.coalesce("lead", F.lit("")),
                   T.collapse_blank(F.coalesce("body", F.lit(""))),
                   F.coalesce("tail", F.lit("")))
    return body.select("doc_id", F.concat(T.collapse_blank(doc), F.lit("\n")).alias("text"))


def _wiki_body() -> Column:
    """(body, tail, lead) with the contents block and the way back to the top."""
    heads = F.filter("items", lambda x: x["hlevel"].isNotNull())
    toc = F.filter(heads, lambda x: x["hlevel"].isin(2, 3))
    entries = F.transform(toc, lambda x: F.concat(
        F.when(x["hlevel"] == 3, F.lit("  ")).otherwise(F.lit("")), F.lit(f"• `F{NAV_COLOR}`_`["),
        T.clean_label(x["htitle"]), F.lit("`#"), T.slug(x["htitle"]), F.lit("]`_`f")))
    toc_lines = F.concat(F.array(F.lit(""), F.lit(">>Contents"), F.lit("")), entries,
                         F.array(F.lit(""), F.lit(CONTENTS_RULE), F.lit("")))
    first = F.try_element_at(heads, F.lit(1))["block"]
    placed = F.transform(toc_lines, lambda x, i: F.struct(
        first.alias("block"), F.lit(-2).cast("bigint").alias("gkey"), i.alias("idx"), x.alias("line"),
        F.lit(None).cast("int").alias("hlevel"), F.lit(None).cast("string").alias("htitle")))
    all_items = F.when(F.size(toc) >= 2, F.array_sort(F.concat("items", placed))).otherwise(F.col("items"))
    text = F.array_join(F.transform(all_items, lambda x: x["line"]), "\n")
    tail = F.when(F.size(heads) > 0, F.lit(BACK_TO_TOP)).otherwise(F.lit(""))
    # the empty place of the contents leaves a blank line above a heading that comes first
    lead = F.when((F.size(heads) > 0) & (F.size(toc) < 2)
                  & T.collapse_blank(text).startswith(">"), F.lit("\n")).otherwise(F.lit(""))
    return F.struct(text.alias("body"), tail.alias("tail"), lead.alias("lead"))


def render_documents(docs: DataFrame, kind: str = "generic", page_root: str = DEFAULT_PAGE_ROOT,
                     nodes: DataFrame | None = None, markup: bool = True, mode: str = "literal",
                     carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, text) rendered markup of HTML documents (doc_id, archive, path, html).

    ``kind`` is a rule set, or ``BY_TYPE`` with a column ``renderer``; ``mode`` is
    the way tags are nested (``html.MODES``); ``carry`` names columns of ``docs``.
    Documents are laid out one by one (``operators.layout``); with ``nodes``, a
    node table made before, by the windows of this module, which gives the same
    texts.  ``markup=False`` gives plain text (:func:`plain_text`).
    """
    if markup and nodes is None:
        return L.rendered(docs, kind, page_root, mode, carry)
    if nodes is None:
        nodes = H.html_nodes(docs, mode=mode)
    if markup:
        b = blocks(nodes, kind)
        tables = table_lines(b).withColumns({"hlevel": F.lit(None).cast("int"), "htitle": F.lit(None).cast("string")})
        out = assemble(render_events(b, docs, kind, page_root).unionByName(tables), docs, kind)
    else:
        out = plain_text(nodes, docs, kind)
    return out.join(docs.select("doc_id", *carry), "doc_id").select("doc_id", *carry, "text") if carry else out


LINE_TAGS = ["li", "dt", "dd", "tr"]
CELL_TAGS = ["th", "td"]


def plain_text(nodes: DataFrame, docs: DataFrame, kind: str = "generic") -> DataFrame:
    """(doc_id, text): the words of every block, without markup.

    A block's text is read straight from its interval: strings in document
    order, a new line at ``br``, list items, definitions and table rows, a space
    between cells; white space is collapsed in each line (kept in ``pre``,
    trailing apart), blank lines go, and blocks without words too.  Blocks are
    separated by a blank line.  Comments, scripts and styles have no words, and
    nothing is escaped.
    """
    n = blocks(nodes, kind).filter("in_block")
    piece = (F.when(F.col("kind") == "text", F.when(F.col("block_type") == "pre", T.norm_newlines("text"))
                    .otherwise(T.norm_space(F.col("text"))))
             .when(_is_tag("br", *LINE_TAGS), F.lit("\n")).when(_is_tag(*CELL_TAGS), F.lit(" ")))
    n = n.withColumn("_v", piece).filter(F.col("_v").isNotNull())
    per = n.groupBy("doc_id", "block").agg(_ordered_join(F.struct(F.col("pos"), F.col("_v").alias("v")), "").alias("t"),
                                           F.first("block_type").alias("bt"))
    lines = F.filter(F.transform(F.split("t", "\n", -1), lambda x: F.when(F.col("bt") == "pre", T.py_rstrip(x))
                                 .otherwise(T.py_strip(T.norm_space(x)))), lambda x: x != "")
    text = per.select("doc_id", "block", F.array_join(lines, "\n").alias("v")).filter("v <> ''").groupBy("doc_id").agg(
        _ordered_join(F.struct(F.col("block").alias("pos"), "v"), "\n\n").alias("text"))
    return docs.select("doc_id").join(text, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def headings(nodes: DataFrame, kind: str = "generic") -> DataFrame:
    """(doc_id, block, level, title) of heading blocks (EXT-5)."""
    b = blocks(nodes, kind)
    first_h = F.min(F.when(F.col("in_block") & _is_tag(*HEADINGS) & (F.col("pos") > F.col("block")),
                           F.struct("pos", "end_pos", "tag"))).over(Window.partitionBy("doc_id", "block"))
    h = b.filter(F.col("in_block") & F.col("block_type").isin("heading", "wheading")).withColumn(
        "_fh", F.when(F.col("block_type") == "wheading", first_h))
    own = (F.col("block_type") == "heading") | (
        (F.col("pos") > F.col("_fh.pos")) & (F.col("pos") <= F.col("_fh.end_pos")))
    piece = T.py_strip(F.col("text"))
    g = h.groupBy("doc_id", "block").agg(
        F.max(F.coalesce(F.col("_fh.tag"), F.when(F.col("pos") == F.col("block"), F.col("tag")))).alias("htag"),
        _ordered_join(F.struct(F.col("pos"), F.when(own & (F.col("kind") == "text") & (piece != "")
                                                    & (F.col("pos") > F.col("block")), piece).alias("v")),
                      " ").alias("title"))
    title = T.py_strip(T.norm_space("title"))
    return g.filter(F.col("htag").isNotNull() & (title != "")).select(
        "doc_id", F.col("block").cast("bigint").alias("block"),
        F.substring("htag", 2, 1).cast("int").alias("level"), title.alias("title"))


# ---------------------------------------------------------------------------
# EXT-7 / EXT-19 / JOIN-9: link and anchor tables
# ---------------------------------------------------------------------------

def links(nodes: DataFrame, docs: DataFrame | None = None, kind: str = "generic") -> DataFrame:
    """(doc_id, pos, link_kind, label, href, target, archive) for links in inline
    contexts.  The label is the link's plain text (all text below it)."""
    b = blocks(nodes, kind)
    n = inline_marks(b)
    n = _references(n) if _may_be(kind, "wikipedia") else _no_references(n)
    # of a reference only its text is inline; its back-link is not a link of the article
    inline = (F.col("block_type") != "references") | F.coalesce(F.col("has_span") & F.col("in_span"), F.lit(False))
    is_a = (F.col("in_block") & F.col("block_type").isin(*INLINE_TYPES) & _is_tag("a") & inline
            & (F.col("pos") > F.col("block")) & ~F.col("_inside_atomic"))
    n = n.withColumn("_a", F.when(is_a, F.col("pos")).otherwise(
        F.when(F.col("pos") <= H.last_open(is_a, "end_pos"), H.last_open(is_a, "pos"))))
    piece = F.when((F.col("kind") == "text") & (F.col("pos") != F.col("_a")),
                   F.struct(F.col("pos"), F.col("text").alias("v")))
    w = Window.partitionBy("doc_id", "_a")
    label = F.array_join(F.transform(F.array_sort(F.collect_list(piece).over(w)), lambda x: x["v"]), "")
    a = n.withColumn("label", F.when(is_a, label)).filter(is_a)
    href = T.py_strip(F.coalesce("href", F.lit("")))
    target = (F.when(F.col("link_kind") == "entry", T.resolve_path(href, F.col("path")))
              .when(F.col("link_kind") == "anchor", T.slug(F.substring(href, 2, 1 << 30))))
    return a.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "link_kind",
                    T.clean_label(F.coalesce("label", F.lit(""))).alias("label"),
                    F.col("href"), target.alias("target"), "archive")


def anchors(nodes: DataFrame, kind: str = "generic") -> DataFrame:
    """(doc_id, pos, anchor): the distinct anchors that rendering emits, each at its first place."""
    n, _, _ = _emitting(blocks(nodes, kind), kind, DEFAULT_PAGE_ROOT)
    return (n.filter(F.col("_emit").isNotNull()).groupBy("doc_id", F.col("_emit").alias("anchor"))
            .agg(F.min("pos").cast("bigint").alias("pos")).select("doc_id", "pos", "anchor"))


# ---------------------------------------------------------------------------
# EXT-13 / SORT-4: first qualifying paragraph of a page (description)
# ---------------------------------------------------------------------------
MIN_DESCRIPTION_CHARS = 40


def first_paragraphs(nodes: DataFrame, min_chars: int = MIN_DESCRIPTION_CHARS) -> DataFrame:
    """(doc_id, text): the first ``p`` anywhere in the (uncleaned) page whose
    collapsed text is longer than ``min_chars``.

    A paragraph's collapsed length is sum(len(piece)) + pieces - 1 over its
    stripped, collapsed strings, so prefix sums over ``pos`` give it; the value
    at ``end_pos`` comes from one equi join on (doc_id, pos).  Only the chosen
    paragraph's strings are gathered.
    """
    piece = T.py_strip(T.norm_space(F.col("text")))
    n = nodes.withColumn("_pc", F.when((F.col("kind") == "text") & (piece != ""), piece))
    w = H.by_doc().rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumns({"_cl": F.sum(F.coalesce(F.length("_pc"), F.lit(0))).over(w),
                       "_cn": F.sum(F.col("_pc").isNotNull().cast("int")).over(w)})
    at_end = n.select("doc_id", F.col("pos").alias("end_pos"), F.col("_cl").alias("_cl_e"),
                      F.col("_cn").alias("_cn_e"))
    p = n.filter(_is_tag("p")).join(at_end, ["doc_id", "end_pos"])
    length = (F.col("_cl_e") - F.col("_cl")) + (F.col("_cn_e") - F.col("_cn")) - 1
    first = (p.filter(length > min_chars).groupBy("doc_id")
             .agg(F.min_by(F.struct("pos", "end_pos"), F.col("pos")).alias("_p")))
    texts = n.filter(F.col("_pc").isNotNull()).join(first, "doc_id").filter(
        (F.col("pos") > F.col("_p.pos")) & (F.col("pos") <= F.col("_p.end_pos")))
    return texts.groupBy("doc_id").agg(
        _ordered_join(F.struct(F.col("pos"), F.col("_pc").alias("v")), " ").alias("text"))


def descriptions(nodes: DataFrame, min_chars: int = MIN_DESCRIPTION_CHARS) -> DataFrame:
    """(doc_id, description): first qualifying paragraph cut by the snippet rule."""
    fp = first_paragraphs(nodes, min_chars)
    return fp.select("doc_id", T.snippet(T.py_strip(T.norm_space("text"))).alias("description"))


# ---------------------------------------------------------------------------
# PRJ-9: renderer dispatch by archive type
# ---------------------------------------------------------------------------
RENDERER_BY_TYPE = {"wikipedia": "wikipedia", "gutenberg": "gutenberg"}   # anything else: generic
MEDIA_ARCHIVE_TYPES = ["pdf", "video"]


def with_renderer(docs: DataFrame, types: DataFrame) -> DataFrame:
    """Readable documents with the rule set of their archive's type; media archives are not read."""
    d = docs.join(types.select("archive", "type"), "archive", "left")
    kind = F.coalesce(F.col("type"), F.lit("generic"))
    renderer = F.lit("generic")
    for one, rules in RENDERER_BY_TYPE.items():
        renderer = F.when(kind == one, F.lit(rules)).otherwise(renderer)
    return d.filter(~kind.isin(*MEDIA_ARCHIVE_TYPES)).withColumn("renderer", renderer).drop("type")


def render_by_type(docs: DataFrame, types: DataFrame, page_root: str = DEFAULT_PAGE_ROOT, **options) -> DataFrame:
    """(doc_id, renderer, text): each readable document rendered with its archive's
    rule set, all in one plan.  ``types`` is (archive, type); ``options`` as for :func:`render_documents`.
    """
    return render_documents(with_renderer(docs, types), BY_TYPE, page_root, carry=("renderer",), **options)
