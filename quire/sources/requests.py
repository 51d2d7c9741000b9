"""Request tables derived from the test tables.

The reference answers one request per process; here many requests are a
table and run as one job.  Requests are derived from the data itself so the
work grows with it:

* page requests - one per crawl page: archive = URL host (only for https
  URLs; an http URL stands for a request without an archive), entry path =
  URL path, ``chunk``/``page_number`` = the URL's ``page`` parameter, and a
  title query = first title term + the first three letters of the second.
* part requests - one per ``part`` row against a ``parts.zim`` archive whose
  entries are the part names: the same query rule on ``p_name``, page number
  = ``p_size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.plan import materialize
from quire.operators.search import terms
from quire.sources import archive as A

PARTS_ARCHIVE = "parts.zim"
PAGE_PARAM = r"[?&]page=([^&#]*)"


def title_query(title) -> Column:
    t = terms(title)
    second = F.substring(F.coalesce(F.try_element_at(t, F.lit(2)), F.lit("")), 1, 3)
    first = F.coalesce(F.try_element_at(t, F.lit(1)), F.lit(""))
    return F.when(F.size(t) >= 2, F.concat(first, F.lit(" "), second)).otherwise(first)


def page_requests(pages: DataFrame) -> DataFrame:
    """(request_id, archive, entry_path, chunk, format, query, page_number)."""
    https = F.regexp_extract("url", r"^([A-Za-z]+)://", 1) == "https"
    param = F.nullif(F.regexp_extract("url", PAGE_PARAM, 1), F.lit(""))
    base = materialize(pages, ["page_id", "url"], _title=A.page_title("html"))
    base = materialize(base, ["page_id", "url"], query=title_query("_title"))
    return base.select(
        F.col("page_id").cast("bigint").alias("request_id"),
        F.when(https, F.concat(A.url_host("url"), F.lit(A.ARCHIVE_SUFFIX))).alias("archive"),
        A.url_path("url").alias("entry_path"),
        param.alias("chunk"),
        F.lit(None).cast("string").alias("format"),
        "query",
        param.alias("page_number"),
    )


def search_requests(pages: DataFrame) -> DataFrame:
    """Title-search requests against the archive of each page."""
    base = materialize(pages, ["page_id", "url"], _title=A.page_title("html"))
    base = materialize(base, ["page_id", "url"], query=title_query("_title"))
    return base.select(
        F.col("page_id").cast("bigint").alias("request_id"),
        F.concat(A.url_host("url"), F.lit(A.ARCHIVE_SUFFIX)).alias("archive"),
        "query",
        F.nullif(F.regexp_extract("url", PAGE_PARAM, 1), F.lit("")).alias("page_number"),
    )


def with_media(requests: DataFrame) -> DataFrame:
    """Each request against its host's archive and against the host's media archives."""
    archives = F.array("archive", *[F.concat(F.lit(p), "archive") for p in (A.VIDEO_PREFIX, A.PDF_PREFIX)])
    return requests.withColumn("archive", F.explode(archives))


def part_entries(part: DataFrame) -> DataFrame:
    """A 'parts.zim' archive whose entries are titled by the part names."""
    return part.select(
        F.lit(PARTS_ARCHIVE).alias("archive"),
        F.col("p_partkey").cast("bigint").alias("entry_id"),
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"),
        F.col("p_name").alias("title"),
        F.lit(A.HTML_MIMETYPE).alias("mimetype"),
        F.lit(False).alias("is_redirect"),
        F.lit(None).cast("string").alias("redirect_path"),
        F.octet_length("p_name").cast("bigint").alias("size"),
    )


def part_requests(part: DataFrame) -> DataFrame:
    base = materialize(part, ["p_partkey", "p_size"], query=title_query("p_name"))
    return base.select(
        F.col("p_partkey").cast("bigint").alias("request_id"),
        F.lit(PARTS_ARCHIVE).alias("archive"),
        "query",
        F.col("p_size").cast("string").alias("page_number"),
    )
