"""Request resolution: redirects, entry lookup and request status.

Requests are a table, so a million page views resolve as one join job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog as C
from quire.operators import extract as X
from quire.operators import redirects as RD
from quire.operators.redirects import resolve_redirects  # noqa: F401
from quire.session import stored

RAW_FORMATS = ["micron", "html"]


def request_status(requests: DataFrame, entries: DataFrame, catalog: DataFrame,
                   available: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(request_id, archive, entry_path, status, final_path, title).

    First match: no archive available -> ``no_archive``; no entry path ->
    ``prompt``; archive unknown -> ``missing_archive``; entry unknown ->
    ``missing_entry``; media archive -> ``media``; target not HTML ->
    ``not_text``; else ``ok``.  An archive is known if it has entries, with or
    without a catalogue record.  Book paths of gutenberg archives are
    normalised first.  Redirects are followed to the end; the title is that of
    the first target, like a reader that opens the entry.
    """
    r = C.default_archive(requests, available)
    names = entries.select("archive").distinct().withColumn("_known", F.lit(True))
    r = (r.join(catalog.select("archive", "type"), "archive", "left").join(names, "archive", "left")
         .withColumn("entry_path", F.coalesce("entry_path", F.lit(""))))
    at = F.when(F.col("type") == "gutenberg", T.book_path("entry_path")).otherwise(F.col("entry_path"))
    r = r.withColumn("_at", at)
    own = entries.select("archive", F.col("path").alias("_at"), "is_redirect", F.col("redirect_path").alias("_hop"),
                         F.col("mimetype").alias("_m0"), F.col("title").alias("_t0"), F.lit(True).alias("_found"))
    if ends is None:
        ends = RD.resolve_redirects(entries, only_redirects=True)
    ends = ends.select(
        "archive", F.col("path").alias("_at"), F.col("final_path").alias("_end"))
    last = entries.select("archive", F.col("path").alias("_end"), F.col("mimetype").alias("_m1"))
    first = entries.select("archive", F.col("path").alias("_hop"), F.col("title").alias("_t1"))
    j = (r.join(own, ["archive", "_at"], "left").join(ends, ["archive", "_at"], "left")
         .join(last, ["archive", "_end"], "left").join(first, ["archive", "_hop"], "left"))
    redirected = F.coalesce(F.col("is_redirect"), F.lit(False))
    final_path = F.when(redirected, F.col("_end")).otherwise(F.col("_at"))
    mimetype = F.when(redirected, F.col("_m1")).otherwise(F.col("_m0"))
    title = F.when(redirected, F.col("_t1")).otherwise(F.col("_t0"))
    status = (F.when(F.coalesce(F.col("archive"), F.lit("")) == "", "no_archive")
              .when(F.col("entry_path") == "", "prompt")
              .when(~T.base_name("archive").endswith(".zim") | F.col("_known").isNull(), "missing_archive")
              .when(F.col("_found").isNull() | (redirected & F.col("_end").isNull()), "missing_entry")
              .when(F.col("type").isin(*C.MEDIA_TYPES), "media")
              .when(~F.coalesce(mimetype, F.lit("")).startswith("text/html"), "not_text")
              .otherwise("ok"))
    return j.select("request_id", "archive", "entry_path", status.alias("status"),
                    F.when(status.isin("ok", "media", "not_text"), final_path).alias("final_path"),
                    F.when(status.isin("ok", "media", "not_text"), title).alias("title"))


def raw_requests(requests: DataFrame) -> DataFrame:
    """PRJ-10: raw export only for formats micron/html with archive and path present."""
    return requests.filter(F.col("format").isin(*RAW_FORMATS)
                           & (F.coalesce("archive", F.lit("")) != "")
                           & (F.coalesce("entry_path", F.lit("")) != ""))


def decode_content(content) -> Column:
    """SRC-9: bytes as UTF-8 text, what is not UTF-8 as U+FFFD; never fails."""
    return F.make_valid_utf8(F.col(content).cast("string") if isinstance(content, str) else content.cast("string"))


def export_requests(requests: DataFrame, entries: DataFrame, catalog: DataFrame, ends: DataFrame | None = None,
                    keys: DataFrame | None = None) -> DataFrame:
    """Raw export of requested entries: (request_id, format, status, line_no, line).

    Only requests that pass the gate (:func:`raw_requests`) are answered.  A
    redirect is followed first; a request whose entry is missing, or is not
    HTML, gives one row with that status and no line.  ``html`` exports the
    entry's decoded content, ``micron`` its rendering by its archive's type, also
    of archives that are closed to readers.  Each entry is decoded and rendered
    once, however many requests name it.  ``entries`` hold bytes in ``content``,
    or text in ``html``; ``keys`` are the same entries without it, where they are
    at hand: requests are then resolved without reading contents.
    """
    keys = entries if keys is None else keys
    asked = raw_requests(requests).select("request_id", "format", "archive", "entry_path")
    to = (ends if ends is not None else RD.resolve_redirects(keys, only_redirects=True)).select(
        "archive", F.col("path").alias("entry_path"), F.col("final_path").alias("_end"))
    types = catalog.select("archive", "type")
    asked = asked.join(types, "archive", "left").withColumn(
        "entry_path", F.when(F.col("type") == "gutenberg", T.book_path("entry_path")).otherwise(F.col("entry_path")))
    own = keys.select("archive", F.col("path").alias("entry_path"), "is_redirect")
    found = asked.join(own, ["archive", "entry_path"], "left").join(to, ["archive", "entry_path"], "left")
    at = F.when(F.col("is_redirect"), F.col("_end")).when(~F.col("is_redirect"), F.col("entry_path"))
    kinds = keys.select("archive", "path", "mimetype")
    found = stored(found.select("request_id", "format", "archive", "type", at.alias("path"))
                   .join(kinds, ["archive", "path"], "left"), "export-requests")
    readable = F.coalesce(F.col("mimetype").startswith("text/html"), F.lit(False))
    ok = found.filter(readable)
    body = F.col("html") if "html" in entries.columns else decode_content("content")
    # hints: requests are many as well, and grow past what Spark would send through the driver
    wanted = (entries.join(ok.select("archive", "path").distinct().hint("merge"), ["archive", "path"], "left_semi")
              .select("archive", "path", body.alias("html"), T.cache_key("archive", "path").alias("doc_id")))
    read = wanted.join(ok.filter(F.col("format") == "html").select("archive", "path").distinct(),
                       ["archive", "path"], "left_semi").select("archive", "path", F.lit("html").alias("format"),
                                                                F.col("html").alias("text"))
    drawn = wanted.join(ok.filter(F.col("format") == "micron").select("archive", "path", "type").distinct(), ["archive", "path"])
    renderer = F.when(F.col("type").isin("wikipedia", "gutenberg"), F.col("type")).otherwise(F.lit("generic"))
    drawn = drawn.withColumn("renderer", renderer)
    rendered = X.render_documents(drawn, X.BY_TYPE, carry=("archive", "path")).select(
        "archive", "path", F.lit("micron").alias("format"), "text")
    lines = (ok.hint("merge").join(read.unionByName(rendered), ["archive", "path", "format"])
             .select("request_id", "format", F.lit("ok").alias("status"),
                     F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
             .select("request_id", "format", "status", F.col("line_no").cast("bigint").alias("line_no"),
                     T.guard_line(T.escape_markup("raw")).alias("line")))
    status = F.when(F.col("mimetype").isNull(), F.lit("missing_entry")).otherwise(F.lit("not_text"))
    rest = found.filter(~readable).select("request_id", "format", status.alias("status"), F.lit(None).cast("bigint").alias("line_no"),
                                          F.lit(None).cast("string").alias("line"))
    return lines.unionByName(rest)


def write_export(exported: DataFrame, path: str) -> None:
    """Write an export partitioned by the requested format, lines in order."""
    (exported.repartition("format", "request_id").sortWithinPartitions("format", "request_id", "line_no")
     .write.partitionBy("format").parquet(path))


def export_raw(entries: DataFrame, text_col: str = "html") -> DataFrame:
    """(archive, path, line_no, line): escaped and guarded lines of readable entries."""
    e = entries.filter(F.col("mimetype").startswith("text/html"))
    return e.select("archive", "path", F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1))
                    .alias("line_no", "raw")).select(
        "archive", "path", F.col("line_no").cast("bigint").alias("line_no"),
        T.guard_line(T.escape_markup("raw")).alias("line"))
