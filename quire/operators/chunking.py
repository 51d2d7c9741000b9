"""Chunking of rendered text into size-bounded parts, with a section index.

A document is one row, so everything here runs *inside the row* on arrays
with Spark's higher-order functions: no shuffle, no per-document grouping,
and the work is spread over the input splits.  Only the greedy split itself
is sequential.  Documents of up to ``LONG_LINES`` lines go through a fold
(``aggregate``) whose state holds the break positions and the running byte
count.  The engine copies that state at every line, which would make the fold
quadratic, so longer documents jump from break to break over prefix sums of
their line sizes: a binary search a break, linear in the document.

Line-table variants (:func:`in_table_flags`, :func:`prev_heading_flags`)
work on ``(doc, line_no, line)`` relations with window functions, for lines
that come from elsewhere.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.plan import materialize

# Worker-side functions of this module travel by value, so executors need no
# copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
DEFAULT_CAP = 4096          # target part size in bytes
SECTION_NUM, SECTION_DEN = 3, 5   # a section heading breaks once a part is past 3/5 of cap
TABLE_FENCE = "`t"
LONG_LINES = 4096           # documents of more lines are split outside the fold
INTRO_LABEL = "Introduction"
MAX_SECTION_LABELS = 3


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_lines(text) -> Column:
    """Text -> array of lines (split on '\\n'; '' gives one empty line)."""
    return F.split(F.coalesce(_c(text), F.lit("")), "\n", -1)


def _line_facts(lines: Column) -> Column:
    """Per line: byte cost, section flag, fence flag, previous-line-is-heading, index."""
    return F.transform(lines, lambda x, i: F.struct(
        (F.octet_length(x) + 1).cast("bigint").alias("b"),
        (x.startswith(">>") & ~x.startswith(">>>")).alias("sec"),
        # strip().startswith("`t") only needs the leading whitespace: anchored, O(1)
        x.rlike("^" + T.PYWS + "*" + TABLE_FENCE).alias("fence"),
        ((i > 0) & F.coalesce(F.try_element_at(lines, F.greatest(i, F.lit(1))).startswith(">"), F.lit(False))).alias("ph"),
        i.alias("i"),
    ))


def chunk_breaks(lines, cap: int = DEFAULT_CAP) -> Column:
    """0-based indexes of the lines that start a new part (greedy, exact).

    Break before a line iff it may break (not inside a table, not the first
    line, previous line not a heading) and either the part would exceed
    ``cap`` bytes or the line is a level-2 section and the part is already
    past 3/5 of ``cap``.
    """
    lines = _c(lines)
    threshold = cap * SECTION_NUM // SECTION_DEN
    init = F.struct(F.array().cast("array<int>").alias("breaks"),
                    F.lit(0).cast("bigint").alias("size"),
                    F.lit(False).alias("tbl"))

    def step(acc, x):
        can = ~acc["tbl"] & (x["i"] > 0) & ~x["ph"]
        brk = can & ((acc["size"] + x["b"] > cap) | (x["sec"] & (acc["size"] > threshold)))
        return F.struct(
            F.when(brk, F.concat(acc["breaks"], F.array(x["i"]))).otherwise(acc["breaks"]).alias("breaks"),
            F.when(brk, x["b"]).otherwise(acc["size"] + x["b"]).alias("size"),
            (acc["tbl"] != x["fence"]).alias("tbl"),
        )

    return F.aggregate(_line_facts(lines), init, step)["breaks"]


def _jump_breaks(text: str, cap: int) -> list[int]:
    """The breaks of one document: from each break straight to the next one."""
    import numpy as np

    lines = text.split("\n")
    n = len(lines)
    ends = np.append(np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1, len(text.encode()) + 1)
    before = np.concatenate([[0], ends])                # bytes before each line, newlines included
    fence = np.fromiter((x.lstrip().startswith(TABLE_FENCE) for x in lines), bool, n)
    in_table = (np.cumsum(fence) - fence) % 2 == 1
    heading = np.fromiter((x.startswith(">") for x in lines), bool, n)
    can = ~in_table
    can[0] = False
    can[1:] &= ~heading[:-1]
    section = can & np.fromiter((x.startswith(">>") and not x.startswith(">>>") for x in lines), bool, n)
    can, section = np.flatnonzero(can), np.flatnonzero(section)
    threshold = cap * SECTION_NUM // SECTION_DEN

    def first(places, at):
        k = np.searchsorted(places, at)
        return int(places[k]) if k < len(places) else n

    breaks, at = [], 0
    while True:
        full = np.searchsorted(before[1:], before[at] + cap, side="right")       # the line that goes over the cap
        late = np.searchsorted(before, before[at] + threshold, side="right")     # lines past the section threshold
        at = min(first(can, max(full, at + 1)), first(section, max(late, at + 1)))
        if at == n:
            return breaks
        breaks.append(at)


def _long_breaks(text: Column, cap: int) -> Column:
    """Breaks of the texts that are not null, as an array column."""
    @F.pandas_udf("array<int>")
    def jump(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _jump_breaks(x, cap) for x in texts], dtype=object)

    return jump(text)


def _with_breaks(docs: DataFrame, keep: list[str], text: str, cap: int) -> DataFrame:
    """``keep`` columns with the lines (``_l``) and breaks (``_b``) of every document."""
    # lines and breaks are materialised columns: lambdas then read a column
    # instead of re-splitting the text for every element
    b = materialize(docs.select(*dict.fromkeys([*keep, text])), [*dict.fromkeys([*keep, text])], _l=split_lines(text))
    is_long = F.size("_l") > LONG_LINES
    # nulls stand for the documents of the other way, which skips them
    b = materialize(b, [*keep, "_l"], _far=_long_breaks(F.when(is_long, F.col(text)), cap))
    return materialize(b, [*keep, "_l"], _b=F.coalesce("_far", chunk_breaks(F.when(~is_long, F.col("_l")), cap)))


def chunk_array(lines, breaks) -> Column:
    """Array of part texts from lines and break positions."""
    lines, breaks = _c(lines), _c(breaks)
    starts = F.concat(F.array(F.lit(0)), breaks)
    ends = F.concat(breaks, F.array(F.size(lines)))
    return F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda r: F.array_join(F.slice(lines, r["s"] + 1, r["e"] - r["s"]), "\n"))


def chunk_documents(docs: DataFrame, key: str, text: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(key, chunk_no, text, bytes) - one row per part, 1-based numbering."""
    b = _with_breaks(docs, [key], text, cap)
    parts = b.select(key, chunk_array("_l", "_b").alias("_parts"))
    return parts.select(key, F.posexplode("_parts").alias("_p", "text")).select(
        key, (F.col("_p") + 1).cast("bigint").alias("chunk_no"), "text",
        T.byte_size("text").alias("bytes"))


def part_lines(docs: DataFrame, key: str, text: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(key, chunk_no, first, lines): a row a part with its lines and the number of its
    first line, so that work on lines goes through each line once."""
    b = _with_breaks(docs, [key], text, cap)
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("_b")).alias("s"),
                          F.concat(F.col("_b"), F.array(F.size("_l"))).alias("e"))
    parts = F.transform(bounds, lambda r: F.struct(
        r["s"].alias("first"), F.slice(F.col("_l"), r["s"] + 1, r["e"] - r["s"]).alias("lines")))
    return b.select(key, F.posexplode(parts).alias("_p", "_part")).select(
        key, (F.col("_p") + 1).cast("bigint").alias("chunk_no"), "_part.first", "_part.lines")


def line_chunks(docs: DataFrame, key: str, text: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(key, line_no, chunk_no, line) - the part number of every line (0-based line_no)."""
    e = part_lines(docs, key, text, cap).select(key, "chunk_no", "first", F.posexplode("lines").alias("_i", "line"))
    return e.select(key, (F.col("first") + F.col("_i")).cast("bigint").alias("line_no"), "chunk_no", "line")


# -- CHK-2 ---------------------------------------------------------------------

def section_structs(lines, first) -> Column:
    """Array of (line_no, level, title) for '>>'/'>>>' section lines of a part.

    Only lines starting '>>' (and not '>>>>') are looked at further, so long
    body lines cost one prefix test each.
    """
    lines = _c(lines)
    cand = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
                    lambda s: s["x"].startswith(">>") & ~s["x"].startswith(">>>>"))
    tagged = F.transform(cand, lambda s: F.struct(
        (_c(first) + s["i"]).cast("bigint").alias("line_no"),
        (F.length(s["x"]) - F.length(F.regexp_replace(s["x"], "^>+", ""))).cast("int").alias("level"),
        T.py_strip(F.regexp_replace(s["x"], "^>+", "")).alias("title"),
    ))
    return F.filter(tagged, lambda s: (s["title"] != "") & s["level"].isin(2, 3))


def section_index(docs: DataFrame, key: str, text: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(key, chunk_no, line_no, level, title) for every level-2/3 section line."""
    p = part_lines(docs, key, text, cap)
    s = p.select(key, "chunk_no", F.explode(section_structs("lines", "first")).alias("s"))
    return s.select(key, "chunk_no", "s.line_no", "s.level", "s.title")


# -- CHK-3 / AGG-5 / AGG-6 -------------------------------------------------------

def part_index(docs: DataFrame, key: str, text: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(key, chunk_no, bytes, label, sections): part list with up to three section
    titles in document order; an untitled first part is the Introduction."""
    p = materialize(part_lines(docs, key, text, cap), [key, "chunk_no"],
                    _text=F.array_join("lines", "\n"), _secs=section_structs("lines", "first"))
    no = F.col("chunk_no")
    titles = F.transform("_secs", lambda s: s["title"])
    first3 = F.slice(titles, 1, MAX_SECTION_LABELS)
    desc = F.when((F.size(titles) == 0) & (no == 1), F.lit(INTRO_LABEL)) \
        .otherwise(F.array_join(first3, ", "))
    size = T.byte_size("_text")
    return p.select(
        key, no.alias("chunk_no"), size.alias("bytes"),
        F.concat(F.lit("Part "), no.cast("string"), F.lit(" — "), T.human_size(size)).alias("label"),
        desc.alias("sections"))


def chunk_stats(docs: DataFrame, key: str, text: str, cap: int = DEFAULT_CAP) -> DataFrame:
    """(key, parts, bytes, max_part_bytes, size_label): per-document part facts."""
    b = _with_breaks(docs.withColumn("_t", F.col(text)), [key, "_t"], "_t", cap)
    sizes = F.transform(chunk_array("_l", "_b"), lambda p: F.octet_length(p).cast("bigint"))
    return b.select(
        key,
        (F.size("_b") + 1).cast("bigint").alias("parts"),
        T.byte_size("_t").alias("bytes"),
        F.array_max(sizes).alias("max_part_bytes"),
        T.human_size(T.byte_size("_t")).alias("size_label"),
    )


# -- PRJ-7 / CHK-4 / WIN-8 ---------------------------------------------------------

def select_part(requests: DataFrame, parts_total: DataFrame, key: str,
                chunk: str = "chunk") -> DataFrame:
    """Resolve a part request: null -> full view, 'parts' -> part index, else an
    integer clamped to [1, total] (not an integer -> 1), with prev/next flags."""
    j = requests.join(parts_total, key)
    c = F.col(chunk)
    n = T.strict_int(c)
    idx = F.greatest(F.lit(1), F.least(F.coalesce(n, F.lit(1)), F.col("parts")))
    view = F.when(c.isNull(), "full").when(c == "parts", "parts").otherwise("part")
    part = F.when(view == "part", idx)
    return j.select(
        key, c.alias(chunk), view.alias("view"), part.cast("bigint").alias("part_no"),
        F.col("parts").cast("bigint").alias("total"),
        F.when(view == "part", part > 1).alias("has_prev"),
        F.when(view == "part", part < F.col("parts")).alias("has_next"))


# -- WIN-6 / WIN-7 / WIN-10 on line tables -------------------------------------------

def in_table_flags(lines: DataFrame, key: str) -> DataFrame:
    """Add ``in_table``: an odd number of fence lines strictly before this line."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    fence = T.py_strip("line").startswith(TABLE_FENCE).cast("int")
    return lines.withColumn("in_table", F.coalesce(F.sum(fence).over(w) % 2 == 1, F.lit(False)))


def prev_heading_flags(lines: DataFrame, key: str) -> DataFrame:
    """Add ``prev_heading``: the previous line starts with '>'."""
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("prev_heading",
                            F.coalesce(F.lag("line").over(w).startswith(">"), F.lit(False)))


def collapse_blank(text) -> Column:
    """Runs of three or more newlines collapse to two (outer newlines trimmed)."""
    return T.collapse_blank(text)


# -- derived markup for plain documents -----------------------------------------------

SHORT_LINE_CHARS = 40   # a non-empty line up to this many characters becomes a section heading


def headed_markup(text) -> Column:
    """Plain text -> markup lines: short lines become '>>' sections, and a
    document's first line becomes its '>' title."""
    lines = split_lines(text)
    marked = F.transform(lines, lambda x, i: F.when(i == 0, F.concat(F.lit(">"), x))
                         .when((F.length(x) > 0) & (F.length(x) <= SHORT_LINE_CHARS),
                               F.concat(F.lit(">>"), x))
                         .otherwise(x))
    return F.array_join(marked, "\n")
