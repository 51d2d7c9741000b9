"""Archive-shaped tables derived from the crawl tables.

The library works on three relations:

``entries(archive, entry_id, path, title, mimetype, is_redirect,
redirect_path, size, html)``
    one row per archive entry; ``html`` is the decoded content.
``archive_metadata(archive, key, value)``
    long key/value table (keys Title, Name, Description, Tags, Scraper).
``archives(archive, entry_count, article_count, main_path)``
    one row per archive.

A deployment that already stores entries as Parquet reads them with
:func:`read_entries`; the test tables only hold raw ``pages`` (page_id, url,
html), so :func:`entries_from_pages` maps those onto the entry shape.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.html_text import html_unescape
from quire.operators import catalog as C
from quire.operators.redirects import resolve_redirects
from quire.session import stored

# ---------------------------------------------------------------------------
# Fixed values of the pages -> entries mapping (shared with the SQL oracle)
# ---------------------------------------------------------------------------
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)"
URL_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"
URL_REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?(.*)$"
TITLE_TAG = r"(?is)<title>(.*?)</title>"
ARCHIVE_SUFFIX = ".zim"
# The crawl holds only HTML pages, and every page is an HTML entry.  To exercise
# the media paths of the catalogue, every 13th page also gives a video entry and
# every 17th (not 13th) a PDF entry, in archives of their own.  Every 11th page's
# entry is a redirect to its archive's main page, and the main page of an archive
# whose lowest page id is divisible by 3 redirects to the archive's last entry.
VIDEO_EVERY, PDF_EVERY, REDIRECT_EVERY, MAIN_REDIRECT_EVERY = 13, 17, 11, 3
VIDEO_PREFIX, PDF_PREFIX = "video.", "pdf."
MEDIA_ID_BASE = 1_000_000_000_000
HTML_MIMETYPE = "text/html; charset=utf-8"
VIDEO_MIMETYPE = "video/webm"
PDF_MIMETYPE = "application/pdf"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries already stored in the entry shape (Parquet)."""
    return spark.read.parquet(path)


def url_host(url) -> Column:
    return F.regexp_extract(url, URL_HOST, 1)


def url_path(url) -> Column:
    """All of the URL behind its host, query string and fragment included; the
    scheme leads it unless it is https.  With the host it names the whole URL."""
    scheme = F.regexp_extract(url, URL_SCHEME, 1)
    rest = F.regexp_extract(url, URL_REST, 1)
    return F.when(scheme == "https", rest).otherwise(F.concat(scheme, F.lit(":"), rest))


def page_title(html) -> Column:
    """First <title> (case-insensitive, across newlines), collapsed, entities decoded."""
    raw = F.regexp_extract(html, TITLE_TAG, 1)
    return T.py_strip(T.norm_space(html_unescape(raw)))


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """Map the crawl's ``pages`` onto archive entries, without their contents.

    archive = URL host + '.zim'; path = the rest of the URL; of pages with one
    URL the lowest ``page_id`` stays.  ``page_id`` names the page that holds an
    entry's content (:func:`with_contents`).  Pages are read once, titles are
    decoded once, and only keys are shuffled and stored.
    """
    base = pages.select(
        F.col("page_id").cast("bigint").alias("entry_id"),
        F.concat(url_host("url"), F.lit(ARCHIVE_SUFFIX)).alias("archive"),
        url_path("url").alias("path"),
        page_title("html").alias("title"),
        F.octet_length("html").cast("bigint").alias("size"),
    )
    kept = base.groupBy("archive", "path").agg(
        F.min_by(F.struct("entry_id", "title", "size"), "entry_id").alias("_e")).select("archive", "path", "_e.*")
    is_video = F.col("entry_id") % VIDEO_EVERY == 0
    media = F.struct(
        F.concat(F.when(is_video, F.lit(VIDEO_PREFIX)).otherwise(F.lit(PDF_PREFIX)), "archive").alias("archive"),
        F.concat("path", F.when(is_video, F.lit(".webm")).otherwise(F.lit(".pdf"))).alias("path"),
        (F.col("entry_id") + MEDIA_ID_BASE).alias("entry_id"),
        F.when(is_video, F.lit(VIDEO_MIMETYPE)).otherwise(F.lit(PDF_MIMETYPE)).alias("mimetype"))
    page = F.struct("archive", "path", "entry_id", F.lit(HTML_MIMETYPE).alias("mimetype"))
    both = F.when(is_video | (F.col("entry_id") % PDF_EVERY == 0), F.array(page, media)).otherwise(F.array(page))
    typed = stored(kept.select("title", "size", F.col("entry_id").alias("page_id"), F.explode(both).alias("_x"))
                   .select("_x.*", "title", "size", "page_id"), "entries")
    # main page = lowest entry id of the archive: partial (map-side) min and max
    is_html = F.col("mimetype").startswith("text/html")
    mains = typed.groupBy("archive").agg(
        F.min_by("path", "entry_id").alias("_main_path"), F.min("entry_id").alias("_main_id"),
        F.max_by("path", F.when(is_html, F.col("entry_id"))).alias("_last_path"),
        F.max(F.when(is_html, F.col("entry_id"))).alias("_last_id"))
    is_main = F.col("entry_id") == F.col("_main_id")
    is_last = F.coalesce(F.col("entry_id") == F.col("_last_id"), F.lit(False))
    to = F.when(is_html & ~is_last, F.when(is_main & (F.col("entry_id") % MAIN_REDIRECT_EVERY == 0), F.col("_last_path"))
                .when(~is_main & (F.col("entry_id") % REDIRECT_EVERY == 0), F.col("_main_path")))
    return typed.join(mains, "archive").withColumn("redirect_path", to).select(
        "archive", "entry_id", "path", "title", "mimetype", F.col("redirect_path").isNotNull().alias("is_redirect"),
        "redirect_path", "size", "page_id")


def with_contents(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries with their ``html`` ('' for media), joined by page id."""
    html = pages.select(F.col("page_id").cast("bigint").alias("_page"), "html")
    page = F.when(F.col("mimetype").startswith("text/html"), F.col("page_id"))
    return (entries.withColumn("_page", page).join(html, "_page", "left").drop("_page", "page_id")
            .withColumn("html", F.coalesce("html", F.lit(""))))


def archive_metadata_from_pages(entries: DataFrame) -> DataFrame:
    """Archive metadata derived from its entries.

    Tags = sorted language tags seen in the entry paths (first path segment),
    ``_lang:xx`` joined with ';'.  The crawl has no Title/Name/Description, so
    titles fall back to the main page's <title> and then the file stem.
    """
    lang = F.regexp_extract("path", r"^(?:[a-z]+:)?([^/:?#]+)/", 1)
    per = (entries.select("archive", lang.alias("lang"))
           .filter(F.col("lang") != "")
           .groupBy("archive")
           .agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("_lang:"), "lang"))), ";")
                .alias("tags")))
    return per.select("archive", F.lit("Tags").alias("key"), F.col("tags").cast("binary").alias("value"))


def archives_table(entries: DataFrame) -> DataFrame:
    """One row per archive: entry count, article count, main path (that of the main entry, as it is)."""
    return entries.groupBy("archive").agg(
        F.count(F.lit(1)).alias("entry_count"),
        F.count_if(~F.col("is_redirect") & F.col("mimetype").startswith("text/html"))
        .cast("bigint").alias("article_count"),
        F.min_by("path", "entry_id").alias("main_path"),
    )


class Tables:
    """The archive relations of one test scale, each made once, when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.pages = read_table(spark, sf_dir, "pages")

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)

    @functools.cached_property
    def entries(self) -> DataFrame:
        """All entries, without contents; stored."""
        return stored(entries_from_pages(self.pages), "entries")

    @functools.cached_property
    def contents(self) -> DataFrame:
        """Entries with ``html``."""
        return with_contents(self.entries, self.pages)

    @functools.cached_property
    def ends(self) -> DataFrame:
        """Where redirects end; stored."""
        return stored(resolve_redirects(self.entries, only_redirects=True), "ends")

    @functools.cached_property
    def mains(self) -> DataFrame:
        """Main pages, behind redirects; stored."""
        return stored(C.main_pages(self.archives, self.entries, self.ends, self.pages), "mains")

    @functools.cached_property
    def catalog(self) -> DataFrame:
        return C.build_catalog(self.archives, self.archive_metadata, self.entries, mains=self.mains, ends=self.ends)

    @functools.cached_property
    def archives(self) -> DataFrame:
        return archives_table(self.entries)

    @functools.cached_property
    def archive_metadata(self) -> DataFrame:
        return archive_metadata_from_pages(self.entries)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    """The archive relations for one test scale."""
    return Tables(spark, sf_dir)
