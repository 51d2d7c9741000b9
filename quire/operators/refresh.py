"""Render cache and incremental refresh.

The cache is a Parquet table ``render_cache(cache_key, archive, path,
validator, text)``.  A hit needs the stored validator to equal the current one
(entry size + renderer version), so only new or changed entries are rendered;
an upsert replaces rows by key (last writer wins).  A written cache is a
version (``sources.versions``), so a failed job never leaves a half written
one behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.sources import versions as V

CACHE_SCHEMA = "cache_key string, archive string, path string, validator string, text string"
CACHE_COLUMNS = ["cache_key", "archive", "path", "validator", "text"]


def with_cache_keys(entries: DataFrame, version: str = T.RENDER_VERSION) -> DataFrame:
    return entries.withColumn("cache_key", T.cache_key("archive", "path")) \
        .withColumn("validator", T.validator(F.col("size"), version))


def cached_render(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (archive, path, validator) with ``hit`` and the cached text."""
    r = requests.withColumn("cache_key", T.cache_key("archive", "path"))
    c = cache.select("cache_key", F.col("validator").alias("_cv"), F.col("text").alias("cached_text"))
    j = r.join(c, "cache_key", "left")
    hit = F.coalesce(F.col("_cv") == F.col("validator"), F.lit(False))
    return j.select(*requests.columns, "cache_key", hit.alias("hit"),
                    F.when(hit, F.col("cached_text")).alias("cached_text"))


def last_writes(rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per cache key: the greatest by ``order``, then by validator and text."""
    cols = CACHE_COLUMNS
    by = [c for c in [*(order or []), "validator", "text"]]
    last = rows.groupBy("cache_key").agg(F.max(F.struct(*by, "archive", "path")).alias("_l"))
    return last.select("cache_key", *[F.col(f"_l.{c}").alias(c) for c in cols[1:]])


def upsert_cache(cache: DataFrame, fresh: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Cache rows replaced by key with the fresh ones; of several fresh rows the last by ``order``."""
    cols = CACHE_COLUMNS
    new = last_writes(fresh, order)
    keep = cache.select(*cols).join(new.select("cache_key"), "cache_key", "left_anti")
    return keep.unionByName(new.select(*cols))


def render_missing(entries: DataFrame, cache: DataFrame, render) -> DataFrame:
    """Render only entries without a valid cache row; returns fresh cache rows.

    ``render`` maps a DataFrame (doc_id, archive, path, html) to (doc_id, text);
    the document key is the cache key, as entry ids repeat between archives.
    Of several entries with one key the one of the greatest id is rendered.
    """
    e = with_cache_keys(entries)
    valid = cache.select("cache_key", "validator")
    todo = e.select("cache_key", "validator", "entry_id", "size").join(valid, ["cache_key", "validator"], "left_anti")
    # keys alone are aggregated; contents are read for the chosen ones
    last = todo.groupBy("cache_key").agg(F.max(F.struct("entry_id", "size", "validator")).alias("_e")).select(
        "cache_key", "_e.entry_id", "_e.size", "_e.validator")
    docs = (e.join(last, ["cache_key", "entry_id", "size", "validator"], "left_semi")
            .select(F.col("cache_key").alias("doc_id"), "archive", "path", "html", "validator")
            .dropDuplicates(["doc_id"]))
    out = render(docs.select("doc_id", "archive", "path", "html"))
    return (docs.select(F.col("doc_id"), F.col("doc_id").alias("cache_key"), "archive", "path", "validator")
            .join(out, "doc_id").drop("doc_id"))


def render_incremental(entries: DataFrame, cache: DataFrame, render) -> DataFrame:
    """(archive, path, validator, text, from_cache) for every entry: hits reuse the
    cached text, misses are rendered."""
    e = with_cache_keys(entries)
    hits = (e.select("cache_key", "archive", "path", "validator")
            .join(cache.select("cache_key", "validator", "text"), ["cache_key", "validator"])
            .withColumn("from_cache", F.lit(True)))
    fresh = render_missing(entries, cache, render).withColumn("from_cache", F.lit(False))
    cols = ["cache_key", "archive", "path", "validator", "text", "from_cache"]
    return hits.select(*cols).unionByName(fresh.select(*cols))


def write_cache(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Make ``rows`` the cache under ``path``: a new data folder, then the manifest that names it.

    A job that fails before the manifest is written leaves the old cache in place.
    """
    folder = V.new_folder(path, "cache")
    rows.select(*CACHE_COLUMNS).write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{folder}")
    V.publish(spark, path, [folder])


def read_latest_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache that :func:`write_cache` left last under ``path``, empty if there is none.

    Only the current version's files are read, and a version without rows is one like any other.
    """
    folders, _ = V.current(spark, path)
    return V.read(spark, folders, CACHE_SCHEMA)
