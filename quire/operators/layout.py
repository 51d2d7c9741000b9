"""Rendering of one document at a time.

The rules are those of ``operators.extract``: root and removal, blocks, inline
markup, lists, definitions, citations and references, headings, preformatted
text, tables, contents.  There every step is a window or a group over the node
table, which other tables (links, anchors, headings) are cut from.  A rendered
text needs nothing outside its document, so here a document is walked where it
lies: its nodes (``html._nest_one``) are laid out in document order, with what
the windows hold (last open element, furthest end so far) kept in variables.
No node leaves its task, and a step's cost is that of the document's length.

Each document is walked once: in a first pass those that hold a table, whose
cells cost more than the rest, in a second one the others.
"""

from __future__ import annotations

import functools
import re
import sys
from bisect import bisect_right
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.text import GUARD_CHARS, PYWS, SPAN_MAX, SPAN_MIN
from quire.operators import html as H
from quire.operators.html import NODE_SCHEMA, _nest_one
from quire.operators.rules import (BACK_TO_TOP, BLOCK_SKIP, BLOCK_TYPES, BOLD, BY_TYPE, CITE_COLOR, CODE, CODE_BG, CODE_FG, CONTENTS_RULE,
                                   EXTERNAL_CLASSES, EXTERNAL_PREFIXES, HEADINGS, INLINE_TYPES, ITALIC, LINK_COLOR, NAV_COLOR, RULES,
                                   TABLE_FENCE, TEXTLIKE, TOP_ANCHOR, WIKI_BLOCK_SKIP)

# worker-side functions travel by value, as those of operators.html
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAME_CHARS = 8 << 20           # rendered text handed from Python to Spark at a time
_REMOVED_TAGS = {k: frozenset(r["tags"]) for k, r in RULES.items()}
_REMOVED_CLASSES = {k: frozenset(r["classes"]) for k, r in RULES.items()}
_COLUMNS = [f.name for f in NODE_SCHEMA.fields]
_SPACE = re.compile(PYWS + "+")
_NOT_SLUG = re.compile("[^A-Za-z0-9]+")
_BLANK = re.compile("\n{3,}")
_NEWLINE = re.compile("\r\n?")
_INTEGER = re.compile(f"{PYWS}*[+-]?[0-9]+{PYWS}*")
_FOLDER = re.compile(r"(?:[^\n\r\x85\u2028\u2029]*/)?")     # as "." of functions.text, which ends at a line
_GONE_LABEL = str.maketrans("", "", "`]")
_GONE_PATH = str.maketrans("", "", "`|]")
_WRAPS = ({t: ("`!", "`!") for t in BOLD} | {t: ("`*", "`*") for t in ITALIC}
          | {t: (f"`B{CODE_BG}`F{CODE_FG}", "`f`b") for t in CODE})


# ---------------------------------------------------------------------------
# scalars, as in functions.text
# ---------------------------------------------------------------------------

def _flat(s: str) -> str:
    """White space collapsed and trimmed."""
    return " ".join(s.split())


def _escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace("`", "\\`")


def _slug(s: str | None) -> str:
    return _NOT_SLUG.sub("-", s or "").strip("-").lower()


def _label(s: str) -> str:
    return _flat(s).translate(_GONE_LABEL)


def _guarded(s: str) -> str:
    return "\\" + s if s[:1] in GUARD_CHARS else s


def _collapsed(s: str) -> str:
    return _BLANK.sub("\n\n", s).strip("\n")


def _span(s: str | None) -> int:
    if s is None or not _INTEGER.fullmatch(s):
        return SPAN_MIN
    digits = s.strip()
    n = int(digits) if len(digits) < 19 else SPAN_MIN if digits.startswith("-") else int(digits.lstrip("+0")[:19] or 0)
    return max(SPAN_MIN, min(n, SPAN_MAX))


def _resolved(href: str, base: str | None) -> str:
    """Entry path of a link (``functions.text.resolve_path``)."""
    h = re.split("[#?]", href, maxsplit=1)[0]
    if h == "":
        return ""
    if h.startswith("/"):
        path = h.lstrip("/")
    else:
        folder = _FOLDER.match(base or "").group()
        folder = folder.rstrip("/") or folder
        joined = folder + h if folder == "" or folder.endswith("/") else f"{folder}/{h}"
        parts: list[str] = []
        for x in joined.split("/"):
            if x == ".." and parts and parts[-1] != "..":
                parts.pop()
            elif x not in ("", "."):
                parts.append(x)
        if joined.startswith("/"):
            path = "/" + "/".join(x for x in parts if x != "..")
        else:
            path = "/".join(parts) or "."
    return unquote(path).lstrip("/").translate(_GONE_PATH)


# ---------------------------------------------------------------------------
# a document's nodes: root, removal, blocks
# ---------------------------------------------------------------------------

def _tokens(html: str | None, lengths):
    """The tokens of a document: every character is in one, so their lengths tell them."""
    at = 0
    for length in lengths.tolist():
        yield html[at:at + length]
        at += length


def _nodes(tokens, kind: str, repaired: bool) -> dict:
    """Node columns of a document, with ``classes``, ``in_block`` and each node's ``block`` (the root's position)."""
    n = {c: [] for c in _COLUMNS}
    _nest_one(None, tokens, n, repaired)
    n["classes"] = [c.split() if c else () for c in n["class"]]
    _blocks(n, kind)
    return n


def _root(n: dict, kind: str) -> tuple[int, int]:
    """Position and end of the root: the first node of the highest-priority selector, else the whole document."""
    best = None
    for i, tag in enumerate(n["tag"]):
        if tag is None:
            continue
        for p, (what, value) in enumerate(RULES[kind]["roots"]):
            if best is not None and p >= best[0]:
                break
            if value in n["classes"][i] if what == "class" else (tag if what == "tag" else n["id"][i]) == value:
                best = (p, i)
                break
    return (-1, len(n["tag"]) - 1) if best is None else (best[1], n["end_pos"][best[1]])


def _removed(n: dict, kind: str, lo: int, hi: int) -> set[int]:
    """Elements under the root that a rule removes, by tag, class or id."""
    tags, classes, ids, ends, by_tag, by_class = n["tag"], n["classes"], n["id"], n["end_pos"], _REMOVED_TAGS[kind], _REMOVED_CLASSES[kind]
    gone = {i for i in range(lo + 1, hi + 1) if tags[i] in by_tag}
    present = {x for x in ids if x is not None}
    for ident in RULES[kind]["ids"]:
        if ident not in present:
            continue
        # the first element with the id among what the tags and the ids before it left
        upto = -1
        for i in range(lo + 1, hi + 1):
            if i in gone:
                upto = max(upto, ends[i])
            if ids[i] == ident and upto < i:
                gone.add(i)
                break
    return gone | {i for i in range(lo + 1, hi + 1) if classes[i] and not by_class.isdisjoint(classes[i])}


def _block_type(n: dict, i: int, kind: str) -> str | None:
    tag = n["tag"][i]
    if tag is None:
        return "text"
    if kind == "wikipedia":
        if tag == "div" and "mw-heading" in n["classes"][i]:
            return "wheading"
        if tag == "ol" and "references" in n["classes"][i]:
            return "references"
        if tag == "table" and "wikitable" not in n["classes"][i]:
            return "skip"
    if tag in BLOCK_TYPES:
        return BLOCK_TYPES[tag]
    return "skip" if tag in BLOCK_SKIP or (kind == "wikipedia" and tag in WIKI_BLOCK_SKIP) else None


def _blocks(n: dict, kind: str) -> None:
    """Adds ``btype`` of block roots (by position), ``block`` and ``in_block`` of all nodes."""
    ends, count = n["end_pos"], len(n["pos"])
    lo, hi = _root(n, kind)
    removed = _removed(n, kind, lo, hi)
    btype, block, in_block = {}, [None] * count, [False] * count
    gone_to = covered_to = -1
    last = None
    for i in range(lo + 1, hi + 1):
        if i in removed:
            gone_to = max(gone_to, ends[i])
        if gone_to < i:
            bt = _block_type(n, i, kind)
            if bt is not None:
                if covered_to < i and bt != "skip":
                    btype[i] = bt
                    last = i
                if n["tag"][i] is not None:
                    covered_to = max(covered_to, ends[i])
            in_block[i] = last is not None and i <= ends[last]
        block[i] = last
    n["btype"], n["block"], n["in_block"] = btype, block, in_block


# ---------------------------------------------------------------------------
# lines: (block, gkey, idx, line, heading level, heading text)
# ---------------------------------------------------------------------------

def _link_kind(n: dict, i: int) -> str:
    href = (n["href"][i] or "").strip()
    if href == "":
        return "plain"
    if href.startswith("#"):
        return "anchor"
    if href.startswith(tuple(EXTERNAL_PREFIXES)) or any(c in EXTERNAL_CLASSES for c in n["classes"][i]):
        return "external"
    return "entry"


def _entry_link(label: str, path: str, archive: str | None, page_root: str) -> str:
    lab = _label(label)
    if path == "" or lab == "":
        return _escaped(lab)
    fields = f"entry_path={path}"
    if archive:
        fields = f"zim={archive}|{fields}"
    return f"`F{LINK_COLOR}`_`[{lab}`:{page_root}/entry.mu`{fields}]`_`f"


def _anchor_link(label: str, target: str) -> str:
    lab, dest = _label(label), _slug(target)
    if lab == "":
        return ""
    return _escaped(lab) if dest == "" else f"`F{LINK_COLOR}`_`[{lab}`#{dest}]`_`f"


def _citation(n: dict, i: int) -> tuple[str, str, str | None] | None:
    """(number, target, own anchor) of a citation by its first ``a`` with an href, if that leads to an anchor."""
    ends, tags, hrefs = n["end_pos"], n["tag"], n["href"]
    a = next((j for j in range(i + 1, ends[i] + 1) if tags[j] == "a" and hrefs[j] is not None), None)
    if a is None or not hrefs[a].startswith("#"):
        return None
    pieces = [n["text"][j].strip() for j in range(a + 1, ends[a] + 1) if n["kind"][j] == "text"]
    number = " ".join(x for x in pieces if x).strip().strip("[]").strip() or "*"
    return number, _slug(hrefs[a][1:]), _slug(n["id"][i]) if n["id"][i] else None


def _reference(n: dict, i: int) -> dict:
    """What the item ``i`` of a reference list holds: back-link, text span and the back-link's target."""
    ends, tags, classes, in_block = n["end_pos"], n["tag"], n["classes"], n["in_block"]
    own = [j for j in range(i + 1, ends[i] + 1) if in_block[j]]
    back = next((j for j in own if tags[j] == "span" and "mw-cite-backlink" in classes[j]), None)
    within = (back, ends[back]) if back is not None else (0, -1)
    span = next((j for j in own if tags[j] == "span" and "reference-text" in classes[j]
                 and not within[0] <= j <= within[1]), None)
    href = next((n["href"][j] for j in own if within[0] < j <= within[1] and tags[j] == "a" and n["href"][j] is not None), None)
    return {"back": within, "span": (span, ends[span]) if span is not None else None, "anchor": _slug(n["id"][i]),
            "dest": _slug(href[1:]) if href is not None and href.startswith("#cite_ref") else None}


def flow_lines(n: dict, kind: str, archive: str | None, path: str | None, page_root: str) -> list[tuple]:
    """Lines of all blocks but tables, and the blank line before every block."""
    kinds, tags, parents, ends, texts, ids = n["kind"], n["tag"], n["parent"], n["end_pos"], n["text"], n["id"]
    depths, classes, in_block, block, btype = n["depth"], n["classes"], n["in_block"], n["block"], n["btype"]
    values: dict[int, list] = {}        # by owner: (position, 0 opens or 1 closes, order, value)
    owners: dict[int, tuple] = {}       # role of an owner and what its line needs
    first_heading: dict[int, int] = {}  # by block
    ordinals: dict[int, int] = {}       # by parent
    cited: dict[str, str] = {}          # anchor -> number of its last citation so far
    emitted: set[str] = set()           # anchors so far
    inline_rows, shown = [], []         # shown: positions of what is not blank
    atomic_to = item_to = -1
    unmatched = 0
    top = ref = definition = None
    for i in range(len(kinds)):
        if not in_block[i]:
            continue
        b, tag = block[i], tags[i]
        bt = btype[b]
        inline = i > b and bt in INLINE_TYPES
        # outermost links, citations and breaks render as one value; what is below belongs to them
        inside = atomic_to >= i
        link = _link_kind(n, i) if tag == "a" else None
        cite = tag == "sup" and "reference" in classes[i]
        atomic = inline and (link in ("anchor", "entry") or cite or tag in ("style", "script", "br"))
        if atomic:
            atomic_to = max(atomic_to, ends[i])
        role, owner = None, b
        # list items: at odd offset an li, at even offset a nested list; anything else is content, or ignored
        if bt == "list":
            off = depths[i] - depths[b]
            fits = i == b or (tag == "li" if off % 2 else tag in ("ul", "ol"))
            if not fits:
                if item_to < i:
                    top = (ends[i], off, parents[i])
                item_to = max(item_to, ends[i])
            if top is not None and i <= top[0]:
                owner = top[2] if top[1] % 2 == 0 else None
            elif tag == "li":
                ordinals[parents[i]] = ordinals.get(parents[i], 0) + 1
                role, owner = ("li", off, n["ptag"][i], ordinals[parents[i]]), i
            elif i > b:
                role, owner = ("nested",), i
            else:
                owner = b
        elif bt == "dl":
            if tag in ("dt", "dd") and parents[i] == b:
                definition = i
                role, owner = ("def", tag), i
            elif i > b:
                owner = definition if definition is not None and definition < i <= ends[definition] else None
        elif bt == "references":
            if tag == "li" and parents[i] == b:
                ref = (i, _reference(n, i))
                item = ref[1]
                number = cited.get(item["anchor"])
                if number is None:
                    unmatched += 1
                role = ("ref", item, number if number is not None else str(unmatched),
                        item["dest"] if item["dest"] in emitted else None)
            if ref is not None and ref[0] <= i <= ends[ref[0]]:
                owner = ref[0]
        if i == b:
            owner = b
        in_item = ref[1] if bt == "references" and owner != b else None
        live = inline and not inside and role is None
        if bt == "references":
            span = in_item["span"] if in_item else None
            live = inline and not inside and span is not None and span[0] < i <= span[1]
        # what the node shows by itself
        leaf = anchor = None
        if live:
            if kinds[i] in TEXTLIKE:
                leaf = _escaped(_SPACE.sub(" ", texts[i]))
            elif tag == "br":
                leaf = "\n"
            elif tag in ("style", "script"):
                leaf = ""
            elif cite:
                found = _citation(n, i)
                leaf = ""
                if found is not None:
                    number, target, own = found
                    leaf = f"{'' if own is None else '`:' + own}[`F{CITE_COLOR}`_`[{number}`#{target}]`_`f]"
                    cited[target] = number
                    if own is not None:
                        emitted.add(own)
            elif link in ("anchor", "entry"):
                href = (n["href"][i] or "").strip()
                lab = "".join(texts[j] for j in range(i + 1, ends[i] + 1) if kinds[j] == "text")
                leaf = (_anchor_link(lab, href[1:]) if link == "anchor"
                        else _entry_link(lab, _resolved(href, path), archive, page_root))
            if tag is not None and ids[i] and not cite and tag not in ("br", "style", "script"):
                ident = _slug(ids[i])
                if ident:
                    anchor = f"`:{ident}`a"
                    emitted.add(ident)
            if anchor is not None or (leaf is not None and leaf.strip()):
                shown.append(i)
        if bt == "wheading" and i > b and b not in first_heading and tag in HEADINGS:
            first_heading[b] = i
        if owner is None:
            continue
        if owner == i:
            values[i] = []
            owners[i] = (b, role)
        # what it gives its owner's text
        v = None
        if bt in ("heading", "wheading"):
            h = first_heading.get(b)
            if kinds[i] == "text" and i > b and (bt == "heading" or (h is not None and h < i <= ends[h])):
                piece = texts[i].strip()
                v = " " + piece if piece else None
        elif bt == "references" and (in_item is None or in_item["span"] is None):
            if in_item is not None and kinds[i] == "text" and not in_item["back"][0] <= i <= in_item["back"][1]:
                piece = texts[i].strip()
                v = " " + piece if piece else None
        elif bt == "pre":
            v = texts[i] if kinds[i] == "text" and i > b else None
        elif bt == "text":
            v = texts[i]
        elif live:
            if leaf is None:
                inline_rows.append((i, owner, anchor or ""))
            else:
                v = (anchor or "") + leaf
        if v:
            values[owner].append((i, 0, 0, v))
    # an element's markup is written if something inside it shows
    for i, owner, anchor in inline_rows:
        opens, closes = _WRAPS.get(tags[i], ("", ""))
        at = bisect_right(shown, i)
        if opens and at < len(shown) and shown[at] <= ends[i]:
            values[owner].append((i, 0, 0, anchor + opens))
            values[owner].append((ends[i], 1, -i, closes))
        elif anchor:
            values[owner].append((i, 0, 0, anchor))
    lines = []
    for owner, (b, role) in owners.items():
        content = "".join(v[3] for v in sorted(values[owner]))
        if owner == b:
            lines.append((b, -1, 0, "", None, None))
            h = first_heading.get(b)
            lines += _block_lines(b, btype[b], tags[b] if h is None else tags[h], content, kind)
        else:
            lines += _item_lines(b, owner, ends[owner], role, content)
    return lines


def _text_lines(text: str) -> list[str]:
    """Lines of a text block: split at newlines, trimmed, without empty ones, guarded."""
    return [_guarded(x) for x in (s.strip() for s in text.split("\n")) if x]


def _block_lines(b: int, bt: str, htag: str | None, content: str, kind: str) -> list[tuple]:
    flat = _flat(content)
    if bt in ("heading", "wheading"):
        if flat == "":
            return []
        level = int(htag[1])
        return [(b, 0, 0, ">" * min(level, 4) + _escaped(flat), level, flat)]
    if bt == "p":
        made = _text_lines(content)
    elif bt == "text":
        made = _text_lines(_flat(_escaped(content)))
    elif bt == "quote":
        made = [f"  `*{flat}`*"] if flat else []
    elif bt == "pre":
        held = _NEWLINE.sub("\n", content).strip("\n")
        made = [] if held.strip() == "" else [_escaped(s.rstrip()) for s in held.split("\n")]
        made = [_guarded(s) if kind == "gutenberg" else f"`B{CODE_BG}`F{CODE_FG}{s}`f`b" for s in made]
    else:
        made = []       # what lists, definitions and references show is their items'; tables are laid out apart
    return [(b, 0, k, line, None, None) for k, line in enumerate(made)]


def _item_lines(b: int, owner: int, end: int, role: tuple, content: str) -> list[tuple]:
    flat, key = _flat(content), owner * 4
    if role[0] == "nested":
        return [(b, key - 1, 0, "", None, None), (b, end * 4 + 3, 0, "", None, None)]
    if role[0] == "ref":
        _, item, number, back = role
        text = flat if item["span"] is not None else _flat(_escaped(flat))
        to = "" if back is None else f" `F{NAV_COLOR}`_`[↑`#{back}]`_`f"
        return [(b, key, 0, f"`:{item['anchor']}`!{number}.`!{to} {text}", None, None)]
    if flat == "":
        return []
    if role[0] == "li":
        _, off, ptag, ordinal = role
        line = "  " * ((off - 1) // 2) + (f"{ordinal}." if ptag == "ol" else "•") + " " + flat
    else:
        line = f"`!{flat}`!" if role[1] == "dt" else "  " + flat
    return [(b, key, 0, line, None, None)]


def table_blocks(n: dict) -> list[tuple[int, str]]:
    """(block, lines) of tables: cells copy their value into every slot they cover, the later cell wins a slot.

    A table that holds another is left out, and one of less than two rows.
    """
    kinds, tags, ends, in_block, block = n["kind"], n["tag"], n["end_pos"], n["in_block"], n["block"]
    out = []
    for b in (b for b, bt in n["btype"].items() if bt == "table"):
        own = [i for i in range(b, ends[b] + 1) if in_block[i] and block[i] == b]
        if any(tags[i] == "table" for i in own[1:]):
            continue
        cells: dict[int, list[str]] = {}        # by position: pieces of text
        cell = None
        for i in own:
            if tags[i] in ("th", "td") and n["ptag"][i] == "tr":
                cell = i
                cells[i] = []
            elif cell is not None and i <= ends[cell] and kinds[i] == "text":
                piece = n["text"][i].strip()
                if piece:
                    cells[cell].append(piece)
        rows = sorted({n["parent"][i] for i in cells})
        if len(rows) < 2:
            continue
        rank = {p: r for r, p in enumerate(rows)}
        grid: list[dict[int, str]] = [{} for _ in rows]
        width, row, col = 0, -1, 0
        for i in sorted(cells, key=lambda i: (n["parent"][i], i)):
            r = rank[n["parent"][i]]
            col = 0 if r != row else col
            row = r
            while col in grid[r]:
                col += 1
            wide, high = _span(n["colspan"][i]), _span(n["rowspan"][i])
            value = _escaped(_flat(" ".join(cells[i]))).replace("|", "/") or " "
            for line in grid[r:r + high]:
                line.update(dict.fromkeys(range(col, col + wide), value))
            col += wide
            width = max(width, col)
        lines = ["| " + " | ".join(line.get(c, " ") for c in range(width)) + " |" for line in grid]
        out.append((b, "\n".join([TABLE_FENCE, lines[0], "|" + "|".join(["---"] * width) + "|", *lines[1:], TABLE_FENCE])))
    return out


def document(lines: list[tuple], kind: str) -> str:
    """The text of a document: top anchor, blocks separated by blank lines, blank runs collapsed.

    wikipedia adds the contents (headings of level 2 and 3, if there are two)
    before the first heading, and the way back to the top if there is a heading.
    """
    tail = lead = ""
    if kind == "wikipedia":
        lines = sorted(lines, key=lambda x: x[:3])
        heads = [x for x in lines if x[4] is not None]
        contents = [x for x in heads if x[4] in (2, 3)]
        if len(contents) >= 2:
            made = ["", ">>Contents", "", *[f"{'  ' if x[4] == 3 else ''}• `F{NAV_COLOR}`_`[{_label(x[5])}`#{_slug(x[5])}]`_`f"
                                            for x in contents], "", CONTENTS_RULE, ""]
            lines += [(heads[0][0], -2, k, x, None, None) for k, x in enumerate(made)]
        if heads:
            tail = BACK_TO_TOP
    body = _collapsed("\n".join(x[3] for x in sorted(lines, key=lambda x: x[:3])))
    # the empty place of the contents leaves a blank line above a heading that comes first
    if tail and len(contents) < 2 and body.startswith(">"):
        lead = "\n"
    return _collapsed(f"{TOP_ANCHOR}\n{lead}{body}{tail}") + "\n"


# ---------------------------------------------------------------------------
# over tables of documents
# ---------------------------------------------------------------------------

def _kinds(pdf, kind: str) -> list[str]:
    if kind != BY_TYPE:
        return [kind] * len(pdf)
    return [k if k in ("wikipedia", "gutenberg") else "generic" for k in pdf["renderer"]]


def _lay_out(batches, kind: str, page_root: str, repaired: bool, keep: tuple[str, ...]):
    """Adds ``text`` where the lengths of tokens are given; frames are handed on once their texts have FRAME_CHARS characters."""
    for pdf in batches:
        texts, done, held = [], 0, 0
        for html, lengths, k, archive, path, text in zip(pdf["html"], pdf["lengths"], _kinds(pdf, kind), pdf["archive"],
                                                         pdf["path"], pdf["text"]):
            if lengths is not None:
                n = _nodes(_tokens(html, lengths), k, repaired)
                tables = [(b, 0, 0, t, None, None) for b, t in table_blocks(n)]
                text = document(flow_lines(n, k, archive, path, page_root) + tables, k)
            texts.append(text)
            held += len(text or "")
            if held >= FRAME_CHARS:
                yield pdf[list(keep)].iloc[done:done + len(texts)].assign(text=texts)
                texts, done, held = [], done + len(texts), 0
        if texts:
            yield pdf[list(keep)].iloc[done:].assign(text=texts)


def rendered(docs: DataFrame, kind: str, page_root: str, mode: str = "literal", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *carry, text) of documents (doc_id, archive, path, html; ``renderer`` with ``BY_TYPE``)."""
    if mode not in H.MODES:
        raise ValueError(f"mode {mode!r} is none of {H.MODES}")
    keep = ("doc_id", *carry)
    needed = list(dict.fromkeys([*keep, "archive", "path", *(["renderer"] if kind == BY_TYPE else [])]))
    # a file's only row group would be one task; the number is given, as the shuffled size, by which partitions
    # are put together again, says little about the work
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(*needed, "html").repartition(count, "doc_id")
    fields = {f.name: f for f in [*d.schema.fields, StructField("text", StringType())]}

    def laid(rows: DataFrame, columns: list[str]) -> DataFrame:
        step = functools.partial(_lay_out, kind=kind, page_root=page_root, repaired=mode == "repaired", keep=tuple(columns))
        return rows.mapInPandas(step, StructType([fields[c] for c in [*columns, "text"]]))

    # one string and a few numbers a document reach Python, not its tokens
    lengths = F.transform(H.tokens("html"), F.length)
    table = F.coalesce(F.col("html").rlike("(?i)<table"), F.lit(False))
    first = laid(d.select(*needed, "html", F.lit(None).cast("string").alias("text"), F.when(table, lengths).alias("lengths")),
                 [*needed, "html"])
    done = F.col("text").isNotNull()
    return laid(first.select(*needed, "text", F.when(~done, F.col("html")).alias("html"), F.when(~done, lengths).alias("lengths")),
                list(keep))
