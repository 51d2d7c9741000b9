"""Archive catalogue: classification, titles, counts, listing and refresh.

All per-archive work is ``groupBy(archive)`` with partial (map-side)
aggregation, so a huge archive is pre-aggregated inside each map task before
the shuffle; joins are between one-row-per-archive relations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import redirects as RD
from quire.session import stored

# ---------------------------------------------------------------------------
# Fixed values (classification rules and defaults)
# ---------------------------------------------------------------------------
ARCHIVE_TYPES = ["gutenberg", "video", "pdf", "wikipedia", "spa", "generic"]
MEDIA_TYPES = ["pdf", "video"]
MEDIA_RATIO = 0.1               # strictly greater than this share -> media archive
MIN_VISIBLE_CHARS = 40          # tag-stripped main page shorter than this -> spa
WIKI_MARKER = "mw-parser-output"
REFRESH_MARKERS = ['http-equiv="refresh"', "http-equiv='refresh'"]
TYPE_KEYS = ["Tags", "Name", "Scraper"]
TITLE_KEYS = ["Title", "Name"]


def _decode(value: Column) -> Column:
    """Bytes -> UTF-8 text with invalid sequences replaced (never raises)."""
    return F.make_valid_utf8(value.cast("string"))


# -- SRC-1 / SET-2 -----------------------------------------------------------

def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary`` if it has rows, else ``fallback`` (one plan, no driver check)."""
    # equi anti join on a constant key against the (at most one-row) "has rows" set
    has = primary.select(F.lit(1).alias("_k")).limit(1)
    rest = (fallback.withColumn("_k", F.lit(1))
            .join(F.broadcast(has), "_k", "left_anti").drop("_k"))
    return primary.unionByName(rest)


def list_archives(entries: DataFrame, fallback: str | None = None) -> DataFrame:
    """Archive names ending '.zim', ascending; the fallback name when none exist."""
    names = (entries.select(T.base_name("archive").alias("archive")).distinct()
             .filter(F.col("archive").endswith(".zim")))
    if fallback:
        spark = entries.sparkSession
        fb = spark.createDataFrame([(fallback.rsplit("/", 1)[-1],)], "archive string")
        names = with_fallback(names, fb)
    return names.orderBy("archive")   # SORT-1: code-point (binary) order


def valid_archive_name(col) -> Column:
    """FIL-1: the base name must end in '.zim'."""
    return T.base_name(col).endswith(".zim")


# -- SRC-4 -----------------------------------------------------------------

def first_metadata(meta: DataFrame, keys: list[str], alias: str = "value") -> DataFrame:
    """Per archive, the first key (in preference order) whose raw value is non-empty,
    decoded and stripped.  A whitespace-only value still wins and yields ''."""
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    return (meta.filter(F.col("key").isin(*keys) & (F.octet_length("value") > 0))
            .groupBy("archive")
            .agg(F.min_by("value", rank).alias("_v"))
            .select("archive", T.py_strip(_decode(F.col("_v"))).alias(alias)))


# -- AGG-1 / WIN-1 ------------------------------------------------------------

def sample_first(entries: DataFrame, n: int) -> DataFrame:
    """First ``n`` entries per archive by entry id.

    ``row_number() <= n`` is planned as a partial window group limit: every map
    task keeps at most ``n`` rows per archive before the shuffle.
    """
    w = Window.partitionBy("archive").orderBy("entry_id")
    return (entries.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn"))


def media_class(mimetype) -> Column:
    """FIL-5: 'video' (webm or video/*), else 'pdf', else null."""
    m = F.col(mimetype) if isinstance(mimetype, str) else mimetype
    return (F.when(m.contains("webm") | m.startswith("video"), F.lit("video"))
            .when(m.contains("pdf"), F.lit("pdf")))


def _ends(entries: DataFrame, ends: DataFrame | None) -> DataFrame:
    """Where redirects end: ``ends`` as resolved before, or resolved here."""
    return ends if ends is not None else RD.resolve_redirects(entries, only_redirects=True)


def target_mimetypes(entries: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(archive, mimetype) of every entry; a redirect has its final target's, or null if it has none."""
    own = entries.filter(~F.col("is_redirect")).select("archive", "mimetype")
    ends = _ends(entries, ends)
    at = entries.select("archive", F.col("path").alias("final_path"), "mimetype")
    return own.unionByName(ends.join(at, ["archive", "final_path"], "left").select("archive", "mimetype"))


def media_ratio(entries: DataFrame, first_n: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Shares of video and PDF among the entries with a mimetype.

    All entries of an archive count; ``first_n`` limits it to the first ones
    by entry id (redirects still end at any entry).
    """
    if first_n is None:
        kinds = target_mimetypes(entries, ends)
    else:
        low = sample_first(entries, first_n)
        ends = _ends(entries, ends).select("archive", "path", "final_path")
        at = entries.select("archive", F.col("path").alias("final_path"), F.col("mimetype").alias("_m"))
        kinds = (low.join(ends, ["archive", "path"], "left").join(at, ["archive", "final_path"], "left")
                 .select("archive", F.when(F.col("is_redirect"), F.col("_m")).otherwise(F.col("mimetype"))
                         .alias("mimetype")))
    cls = media_class("mimetype")
    return (kinds.groupBy("archive").agg(
        F.count("mimetype").alias("sampled"),
        F.count_if(cls == "video").cast("bigint").alias("video"),
        F.count_if(cls == "pdf").cast("bigint").alias("pdf"),
    ).select("archive", "sampled", "video", "pdf",
             F.try_divide("video", "sampled").alias("video_ratio"),
             F.try_divide("pdf", "sampled").alias("pdf_ratio")))


# -- SRC-5 -------------------------------------------------------------------

def resolved_mains(archives: DataFrame, entries: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(archive, main_path): the path of what is behind the main entry, '' if there is nothing."""
    own = entries.select("archive", F.col("path").alias("main_path"), "is_redirect")
    to = _ends(entries, ends).select("archive", F.col("path").alias("main_path"), F.col("final_path").alias("_end"))
    j = (archives.select("archive", "main_path").join(own, ["archive", "main_path"], "left")
         .join(to, ["archive", "main_path"], "left"))
    path = F.when(F.col("is_redirect"), F.col("_end")).when(~F.col("is_redirect"), F.col("main_path"))
    return j.select("archive", F.coalesce(path, F.lit("")).alias("main_path"))


def main_pages(archives: DataFrame, entries: DataFrame, ends: DataFrame | None = None,
               pages: DataFrame | None = None) -> DataFrame:
    """(archive, main_path, main_html) of what is behind each archive's main entry.

    A main entry that redirects is followed to the end.  html is '' where that
    is not HTML; path and html are '' without a main entry, or where it ends
    nowhere.  ``entries`` has ``html``, or names the row of ``pages(page_id,
    html)`` that holds it; contents are only read for main pages.
    """
    mains = resolved_mains(archives, entries, ends)
    holds = "html" if pages is None else "page_id"
    e = (entries.filter(F.col("mimetype").startswith("text/html"))
         .select("archive", F.col("path").alias("main_path"), holds).join(mains, ["archive", "main_path"]))
    if pages is not None:
        e = e.join(pages.select("page_id", "html"), "page_id")
    return mains.join(e.select("archive", F.col("html").alias("main_html")), "archive", "left").select(
        "archive", "main_path", F.coalesce("main_html", F.lit("")).alias("main_html"))


# -- AGG-2 -------------------------------------------------------------------

def classify_archives(meta: DataFrame, entries: DataFrame, mains: DataFrame,
                      first_n: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(archive, type): first matching rule of the fixed rule list; ``first_n`` as in media_ratio."""
    # one pivot aggregate: a column a key
    values = (meta.filter(F.col("key").isin(*TYPE_KEYS) & (F.octet_length("value") > 0)).groupBy("archive")
              .agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in TYPE_KEYS]))
    tags = values.select("archive", F.lower(F.concat_ws(" ", *[
        F.coalesce(T.py_strip(_decode(F.col(k))), F.lit("")) for k in TYPE_KEYS])).alias("tags"))
    ratios = media_ratio(entries, first_n, ends)
    html = F.coalesce(F.col("main_html"), F.lit(""))
    low = F.lower(html)
    sampled = F.coalesce(F.col("sampled"), F.lit(0))
    kind = (F.when(F.coalesce("tags", F.lit("")).contains("gutenberg"), "gutenberg")
            .when((sampled > 0) & (F.col("video") / sampled > MEDIA_RATIO), "video")
            .when((sampled > 0) & (F.col("pdf") / sampled > MEDIA_RATIO), "pdf")
            .when(html.contains(WIKI_MARKER), "wikipedia")
            .when(low.contains(REFRESH_MARKERS[0]) | low.contains(REFRESH_MARKERS[1]), "spa")
            .when((html != "") & (T.visible_length(html) < MIN_VISIBLE_CHARS), "spa")
            .otherwise("generic"))
    return (mains.join(tags, "archive", "left").join(ratios, "archive", "left")
            .select("archive", kind.alias("type")))


# -- AGG-3 -------------------------------------------------------------------

def html_title(html) -> Column:
    """First <title> of raw HTML, whitespace collapsed, entities not decoded."""
    raw = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    return T.py_strip(T.norm_space(raw))


def archive_titles(meta: DataFrame, mains: DataFrame) -> DataFrame:
    """Title, else Name, else the main page's <title>, else the file stem."""
    md = first_metadata(meta, TITLE_KEYS, alias="md_title")
    t = mains.join(md, "archive", "left")
    title = F.coalesce(F.nullif(F.coalesce("md_title", F.lit("")), F.lit("")),
                       F.nullif(html_title(F.coalesce("main_html", F.lit(""))), F.lit("")),
                       T.stem("archive"))
    return t.select("archive", title.alias("title"))


# -- AGG-4 -------------------------------------------------------------------

def article_counts(entries: DataFrame) -> DataFrame:
    """Articles = non-redirect HTML entries (our definition of the header count)."""
    return entries.groupBy("archive").agg(
        F.count_if(~F.col("is_redirect") & F.col("mimetype").startswith("text/html"))
        .cast("bigint").alias("article_count"))


# -- AGG-8 -------------------------------------------------------------------

def build_catalog(archives: DataFrame, meta: DataFrame, entries: DataFrame,
                  descriptions: DataFrame | None = None, first_n: int | None = None,
                  mains: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """One catalogue record per archive.

    ``mains`` (:func:`main_pages`) and ``ends`` (resolved redirects) are worked
    out from ``entries`` where they are not given; with ``mains``, ``entries``
    needs no ``html``.

    ``descriptions`` (archive, description) overrides the metadata
    description fallback (the first-paragraph snippet of wikipedia main pages
    comes from the extraction jobs).
    """
    if mains is None:
        mains = main_pages(archives, entries, ends)
    kinds = classify_archives(meta, entries, mains, first_n, ends)
    titles = archive_titles(meta, mains)
    desc = first_metadata(meta, ["Description"], alias="md_desc")
    out = (mains.join(kinds, "archive").join(titles, "archive")
           .join(desc, "archive", "left")
           .join(archives.select("archive", "article_count"), "archive", "left"))
    description = F.coalesce(F.nullif(F.coalesce("md_desc", F.lit("")), F.lit("")), F.lit(""))
    if descriptions is not None:
        out = out.join(descriptions.withColumnRenamed("description", "_snip"), "archive", "left")
        description = F.coalesce(
            F.nullif(F.coalesce("md_desc", F.lit("")), F.lit("")),
            F.when(F.col("type") == "wikipedia", F.col("_snip")),
            F.lit(""))
    return out.select("archive", "title", "type", description.alias("description"),
                      F.col("article_count").cast("bigint").alias("article_count"),
                      "main_path")


# -- JOIN-3 / JOIN-4 / PRJ-1 / PRJ-2 ----------------------------------------------

def available_archives(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """Names that have a catalogue record."""
    return names.join(catalog.select("archive"), "archive", "left_semi")


def archive_type(type_col, is_fallback, default_type: str = "wikipedia") -> Column:
    """Catalogue type if non-empty; the configured type for the fallback archive; else generic."""
    return F.coalesce(F.nullif(F.coalesce(type_col, F.lit("")), F.lit("")),
                      F.when(is_fallback, F.lit(default_type)), F.lit("generic"))


def catalog_listing(names: DataFrame, catalog: DataFrame, fallback: str | None = None,
                    default_type: str = "wikipedia") -> DataFrame:
    """Listing rows with the reference's per-field defaults (empty values fall back too)."""
    is_fb = F.lit(False) if not fallback else (F.col("archive") == F.lit(fallback.rsplit("/", 1)[-1]))
    j = names.select("archive").join(catalog, "archive", "left")
    return j.select(
        "archive",
        F.coalesce(F.nullif(F.coalesce("title", F.lit("")), F.lit("")), F.col("archive")).alias("title"),
        archive_type(F.col("type"), is_fb, default_type).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.col("article_count").cast("bigint").alias("article_count"),
        F.coalesce("main_path", F.lit("")).alias("main_path"),
    )


# -- SRC-6 ---------------------------------------------------------------------

def resolve_main_path(catalog: DataFrame, archives: DataFrame) -> DataFrame:
    """Catalogue main path if non-empty, else that of ``archives``, else ''.

    ``archives`` holds resolved paths (:func:`resolved_mains`).
    """
    j = catalog.select("archive", F.col("main_path").alias("c_main")).join(
        archives.select("archive", F.col("main_path").alias("a_main")), "archive", "left")
    return j.select("archive", F.coalesce(F.nullif(F.coalesce("c_main", F.lit("")), F.lit("")),
                                          F.col("a_main"), F.lit("")).alias("main_path"))


# -- FIL-3 / PRJ-3 / PRJ-4 / PRJ-5 --------------------------------------------------

def readable_archives(catalog: DataFrame) -> DataFrame:
    return catalog.filter(~F.col("type").isin(*MEDIA_TYPES))


def _with_main_path(rows: DataFrame, archives: DataFrame | None) -> DataFrame:
    """Rows whose empty main path is the archive's own, where ``archives`` is given."""
    if archives is None:
        return rows
    paths = resolve_main_path(rows.select("archive", "main_path"), archives)
    return rows.drop("main_path").join(paths, "archive", "left")


def catalog_routes(listing: DataFrame, archives: DataFrame | None = None, page_root: str = "/page") -> DataFrame:
    """Link target per archive: wikipedia -> main entry; media -> none; else archive card."""
    listing = _with_main_path(listing, archives)
    route = (F.when(F.col("type") == "wikipedia",
                    F.concat(F.lit(f"{page_root}/entry.mu`zim="), "archive",
                             F.lit("|entry_path="), "main_path"))
             .when(F.col("type").isin(*MEDIA_TYPES), F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit(f"{page_root}/zim_index.mu`zim="), "archive")))
    return listing.select("archive", "type", route.alias("route"))


def catalog_info(listing: DataFrame) -> DataFrame:
    """'type · 1,234 articles'; a zero or missing count is left out."""
    cnt = F.when(F.coalesce("article_count", F.lit(0)) != 0,
                 F.concat(T.thousands("article_count"), F.lit(" articles")))
    typ = F.nullif(F.coalesce("type", F.lit("")), F.lit(""))
    return listing.select("archive", F.concat_ws(" · ", typ, cnt).alias("info"))


def archive_cards(catalog: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """Archive card fields: title (default name), description, count line, main link."""
    catalog = _with_main_path(catalog, archives)
    return catalog.select(
        "archive",
        F.coalesce(F.nullif(F.coalesce("title", F.lit("")), F.lit("")), "archive").alias("title"),
        F.nullif(F.coalesce("description", F.lit("")), F.lit("")).alias("description"),
        F.when(F.coalesce("article_count", F.lit(0)) != 0,
               F.concat(T.thousands("article_count"), F.lit(" entries"))).alias("count_line"),
        F.nullif(F.coalesce("main_path", F.lit("")), F.lit("")).alias("main_link"),
    )


# -- PRJ-6 -----------------------------------------------------------------------

def default_archive(requests: DataFrame, available: DataFrame) -> DataFrame:
    """Requests without an archive get the first available name (min, one row)."""
    first = F.broadcast(available.agg(F.min("archive").alias("_first"))
                        .withColumn("_k", F.lit(1)))
    return (requests.withColumn("_k", F.lit(1)).join(first, "_k", "left")
            .withColumn("archive", F.coalesce(F.nullif(F.col("archive"), F.lit("")), F.col("_first")))
            .drop("_first", "_k"))


# -- SRC-8 / SET-3 -------------------------------------------------------------------

def catalog_errors(archives: DataFrame, meta: DataFrame, entries: DataFrame) -> DataFrame:
    """(archive, error): archives whose record cannot be built, with the first reason.

    What a whole-archive job would stumble over is looked for in the data:
    a missing or unsuited name, no entries, entries without a path or with a
    negative or missing size, and one path twice.
    """
    per = entries.groupBy("archive").agg(
        F.count_if(F.col("path").isNull()).alias("_pathless"),
        F.count_if(F.coalesce(F.col("size"), F.lit(-1)) < 0).alias("_sizeless"))
    twice = (entries.groupBy("archive", "path").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
             .groupBy("archive").agg(F.min("path").alias("_twice")))
    j = archives.select("archive").join(per, "archive", "left").join(twice, "archive", "left")
    error = (F.when(~F.coalesce(valid_archive_name("archive"), F.lit(False)), F.lit("not an archive name"))
             .when(F.col("_pathless").isNull(), F.lit("no entries"))
             .when(F.col("_pathless") > 0, F.lit("entry without a path"))
             .when(F.col("_sizeless") > 0, F.lit("entry without a size"))
             .when(F.col("_twice").isNotNull(), F.concat(F.lit("two entries at "), F.col("_twice"))))
    return j.select("archive", error.alias("error")).filter(F.col("error").isNotNull())


def refresh_catalog(archives: DataFrame, meta: DataFrame, entries: DataFrame,
                    existing: DataFrame | None, force: bool = False,
                    descriptions: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Catalogue with new archives added; existing rows kept unless ``force``; a row a failed archive.

    Only archives missing from ``existing`` are scanned: the anti join is
    applied to ``archives`` and ``entries`` before any aggregation.  An archive
    that fails (:func:`catalog_errors`) does not stop the others: its row holds
    nothing but the name and ``error``, and :func:`written_catalog` leaves it
    out, so the next refresh tries it again.
    """
    if existing is not None and not force:
        archives = archives.join(existing.select("archive"), "archive", "left_anti")
        entries = entries.join(existing.select("archive"), "archive", "left_anti")
    errors = stored(catalog_errors(archives, meta, entries), "catalog-errors")
    sound = archives.join(errors, "archive", "left_anti")
    fresh = build_catalog(sound, meta, entries.join(errors, "archive", "left_anti"), descriptions, ends=ends)
    out = fresh.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
    if existing is None or force:
        return out
    return existing.select(*fresh.columns).withColumn("error", F.lit(None).cast("string")).unionByName(out)


def written_catalog(refreshed: DataFrame) -> DataFrame:
    """The rows of a refresh that are written: those without an error."""
    return refreshed.filter(F.col("error").isNull()).drop("error")
