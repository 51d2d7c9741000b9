"""String, path and number scalars (Column -> Column).

Everything here is a composition of built-in Spark SQL functions, so it stays
inside whole-stage code generation.  Names follow the behaviour they model,
not any engine internals.

Python's ``str.split``/``strip``/``\\s`` treat a wider set of characters as
whitespace than Java's ``\\s``; :data:`PYWS` spells that set out so text is
collapsed and trimmed the way the reference's Python does it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour for identical output)
# ---------------------------------------------------------------------------
# Python's Unicode whitespace set, as a Java regex character class.
PYWS = (r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A"
        r"\u2028\u2029\u202F\u205F\u3000]")
# The same class in RE2 spelling, for the DuckDB oracle.
PYWS_RE2 = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Renderer version that is part of every cache validator.
RENDER_VERSION = "2"
# Lines whose first character is one of these are escaped with a backslash.
GUARD_CHARS = ["#", ">", "-", "<"]
# Table cell span attributes are clamped into this range.
SPAN_MIN, SPAN_MAX = 1, 50


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def norm_space(col) -> Column:
    """Collapse every run of (Python) whitespace to one space; null -> ''."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), PYWS + "+", " ")


def py_strip(col) -> Column:
    """Trim Python whitespace at both ends (Spark's ``trim`` only trims spaces)."""
    return F.regexp_replace(_c(col), f"^{PYWS}+|{PYWS}+$", "")


def py_rstrip(col) -> Column:
    return F.regexp_replace(_c(col), f"{PYWS}+$", "")


def escape_markup(col) -> Column:
    """Double backslashes, then prefix backticks with a backslash; null -> ''."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`"))


def slug(col) -> Column:
    """ASCII slug: non-alphanumeric runs -> '-', trimmed of '-', lower-cased."""
    s = py_strip(norm_space(col))
    return F.lower(F.btrim(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), F.lit("-")))


def clean_label(col) -> Column:
    """Normalised, stripped label without backticks or closing brackets."""
    return F.translate(py_strip(norm_space(col)), "`]", "")


def guard_line(col) -> Column:
    """Prefix a backslash when the line starts with a markup character."""
    c = _c(col)
    return F.when(F.substring(c, 1, 1).isin(*GUARD_CHARS), F.concat(F.lit("\\"), c)).otherwise(c)


def unquote(col) -> Column:
    """Percent-decode like Python's ``urllib.parse.unquote``.

    '+' stays '+', malformed escapes are kept verbatim, undecodable bytes
    become U+FFFD.  Spark's ``url_decode`` turns '+' into a space and fails on
    stray '%', so those are pre-escaped.
    """
    c = F.regexp_replace(_c(col), "%(?![0-9A-Fa-f]{2})", "%25")
    c = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.try_url_decode(c)


def _normpath_segments(joined: Column) -> Column:
    """POSIX normpath of a relative or absolute path (array fold over segments)."""
    segs = F.split(joined, "/")
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
              F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return folded


def resolve_path(href, base) -> Column:
    """Resolve a link target against the current entry path.

    Cut at the first '#' or '?'; a leading '/' means archive-absolute (no
    normalisation); otherwise join to dirname(base) and normalise.  Then
    percent-decode, drop leading '/', delete backtick, pipe and ']'.
    """
    h = F.regexp_extract(py_strip(F.coalesce(_c(href), F.lit(""))), "^([^#?]*)", 1)
    b = F.coalesce(_c(base), F.lit(""))
    # posixpath.dirname: everything up to the last '/', trailing slashes trimmed
    head = F.regexp_extract(b, "^(.*/)?", 1)
    base_dir = F.when(F.regexp_replace(head, "/+$", "") == "", head) \
        .otherwise(F.regexp_replace(head, "/+$", ""))
    joined = F.when((base_dir == "") | base_dir.endswith("/"), F.concat(base_dir, h)) \
        .otherwise(F.concat(base_dir, F.lit("/"), h))
    absolute = joined.startswith("/")
    segs = _normpath_segments(joined)
    # '..' can not climb above the root of an absolute path
    segs = F.when(absolute, F.filter(segs, lambda s: s != "..")).otherwise(segs)
    normed = F.array_join(segs, "/")
    normed = F.when(absolute, F.concat(F.lit("/"), normed)) \
        .otherwise(F.when(normed == "", F.lit(".")).otherwise(normed))
    path = F.when(h.startswith("/"), F.regexp_replace(h, "^/+", "")).otherwise(normed)
    path = F.regexp_replace(unquote(path), "^/+", "")
    path = F.translate(path, "`|]", "")
    return F.when(h == "", F.lit("")).otherwise(path)


def byte_size(col) -> Column:
    """UTF-8 byte length; null -> 0."""
    return F.coalesce(F.octet_length(_c(col)), F.lit(0)).cast("bigint")


def human_size(col) -> Column:
    """'n B' below 1 KiB, one-decimal KB below 1 MiB, else one-decimal MB.

    Rounds half to even on the exact binary quotient, like Python's ``%.1f``.
    """
    n = _c(col).cast("bigint")
    kb = F.bround(n.cast("double") / F.lit(1024.0), 1).cast("decimal(38,1)").cast("string")
    mb = F.bround(n.cast("double") / F.lit(1048576.0), 1).cast("decimal(38,1)").cast("string")
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1048576, F.concat(kb, F.lit(" KB")))
            .otherwise(F.concat(mb, F.lit(" MB"))))


def book_path(col) -> Column:
    """'Title_cover.123' -> 'Title.123' (book archives)."""
    return F.regexp_replace(F.coalesce(_c(col), F.lit("")), r"_cover\.([0-9]+)$", ".$1")


def safe_query(col) -> Column:
    """Query text made safe for a link field list."""
    return F.translate(F.replace(_c(col), F.lit("|"), F.lit(" ")), "`]", "")


def visible_length(html) -> Column:
    """Length of the tag-stripped, trimmed text of an HTML string."""
    return F.length(py_strip(F.regexp_replace(_c(html), "<[^>]+>", "")))


def snippet(col) -> Column:
    """Cut text over 150 chars at the last '.' before index 180 (if past 60)."""
    c = _c(col)
    s = F.substring(c, 1, 180)
    r = F.instr(F.reverse(s), ".")
    cut = F.when(r == 0, F.lit(-1)).otherwise(F.length(s) - r)
    return (F.when(F.length(c) <= 150, c)
            .when(cut > 60, F.substring(c, 1, cut + 1))
            .otherwise(F.concat(F.substring(c, 1, 150), F.lit("…"))))


def cache_key(archive, path) -> Column:
    """SHA-256 hex of archive NUL path."""
    return F.sha2(F.concat(_c(archive), F.lit("\x00"), _c(path)), 256)


def validator(size, version: str = RENDER_VERSION) -> Column:
    return F.concat(_c(size).cast("string"), F.lit("-" + version))


def base_name(col) -> Column:
    return F.substring_index(F.coalesce(_c(col), F.lit("")), "/", -1)


def stem(col) -> Column:
    """File name without its last extension (leading dots are not extensions)."""
    b = base_name(col)
    m = F.regexp_extract(b, r"^(\.*[^.].*)\.[^.]*$", 1)
    return F.when(m == "", b).otherwise(m)


def thousands(col) -> Column:
    """Integer with ',' thousands separators."""
    return F.format_number(_c(col).cast("bigint"), 0)


def strict_int(col) -> Column:
    """Integer parse like Python ``int(str)``; anything else -> null.  Beyond 64 bits
    the value saturates, so clamping a huge page or part number still clamps high."""
    c = _c(col)
    ok = c.rlike(r"^" + PYWS + r"*[+-]?[0-9]+" + PYWS + r"*$")
    n = F.regexp_replace(py_strip(c), r"^\+", "")
    beyond = F.when(n.startswith("-"), F.lit(-(2 ** 63) + 1)).otherwise(F.lit(2 ** 63 - 1))
    return F.when(ok, F.coalesce(n.try_cast("bigint"), beyond))


def cell_span(col) -> Column:
    """Span attribute as integer in 1..50; missing or not an integer -> 1."""
    v = strict_int(col)
    return F.greatest(F.lit(SPAN_MIN), F.least(F.coalesce(v, F.lit(1)), F.lit(SPAN_MAX))).cast("int")


def citation_number(col) -> Column:
    """Citation label: trimmed, brackets stripped, trimmed again; empty -> '*'."""
    n = py_strip(F.btrim(py_strip(_c(col)), F.lit("[]")))
    return F.coalesce(F.nullif(n, F.lit("")), F.lit("*"))


def norm_newlines(col) -> Column:
    """CRLF / CR -> LF, then trim leading and trailing newlines."""
    return F.btrim(F.regexp_replace(_c(col), "\r\n?", "\n"), F.lit("\n"))


def collapse_blank(col) -> Column:
    """Runs of three or more newlines -> two; leading/trailing newlines trimmed."""
    return F.btrim(F.regexp_replace(_c(col), "\n{3,}", "\n\n"), F.lit("\n"))
