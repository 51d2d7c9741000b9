"""Catalogue queries over the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog as C
from quire.plans import sql as S
from quire.sources import archive as A


def _t(spark: SparkSession, sf_dir: str) -> A.Tables:
    return A.load(spark, sf_dir)


def _catalog(t: A.Tables) -> DataFrame:
    return t.catalog


def archive_list(spark, sf_dir):
    return C.list_archives(_t(spark, sf_dir)["entries"])


def media_ratio(spark, sf_dir):
    t = _t(spark, sf_dir)
    return C.media_ratio(t["entries"], ends=t["ends"])


def archive_classify(spark, sf_dir):
    t = _t(spark, sf_dir)
    return C.classify_archives(t["archive_metadata"], t["entries"], t["mains"], ends=t["ends"])


def archive_title(spark, sf_dir):
    t = _t(spark, sf_dir)
    return C.archive_titles(t["archive_metadata"], t["mains"])


def article_count(spark, sf_dir):
    return C.article_counts(_t(spark, sf_dir)["entries"])


def catalog_build(spark, sf_dir):
    return _catalog(_t(spark, sf_dir))


def catalog_listing(spark, sf_dir):
    t = _t(spark, sf_dir)
    cat = _catalog(t)
    names = C.available_archives(C.list_archives(t["entries"]), cat)
    return C.catalog_listing(names, cat)


def catalog_routes(spark, sf_dir):
    t = _t(spark, sf_dir)
    cat = _catalog(t)
    return C.catalog_routes(C.catalog_listing(C.list_archives(t["entries"]), cat), t["mains"])


def catalog_info(spark, sf_dir):
    t = _t(spark, sf_dir)
    cat = _catalog(t)
    return C.catalog_info(C.catalog_listing(C.list_archives(t["entries"]), cat))


def archive_cards(spark, sf_dir):
    t = _t(spark, sf_dir)
    return C.archive_cards(_catalog(t), t["mains"])


def readable_archives(spark, sf_dir):
    return C.readable_archives(_catalog(_t(spark, sf_dir))).select("archive", "type")


def main_path(spark, sf_dir):
    t = _t(spark, sf_dir)
    # every other record has lost its path, as older sidecars have none
    cat = _catalog(t).withColumn("main_path", F.when(F.length("archive") % 2 == 0, F.col("main_path")).otherwise(""))
    return C.resolve_main_path(cat, C.resolved_mains(t["archives"], t["entries"], t["ends"]))


def _older(t: A.Tables) -> DataFrame:
    """What an earlier run left: mobile hosts ('m.' prefix), by an older title rule (file stem)."""
    return (t["mains"].filter(F.col("archive").startswith("m.")).join(t["archives"].drop("main_path"), "archive")
            .select("archive", T.stem("archive").alias("title"), F.lit("generic").alias("type"),
                    F.lit("").alias("description"), F.col("article_count").cast("bigint").alias("article_count"),
                    "main_path"))


def catalog_refresh(spark, sf_dir):
    """Incremental catalogue: rows already catalogued are kept, the rest are built."""
    t = _t(spark, sf_dir)
    return C.written_catalog(C.refresh_catalog(
        t["archives"], t["archive_metadata"], t["contents"], _older(t), ends=t["ends"]))


def catalog_refresh_errors(spark, sf_dir):
    """A refresh of damaged archives: PDF archives have lost their entries' sizes, blogs hold their first
    path twice.  They end as a row with an error, all others are built."""
    t = _t(spark, sf_dir)
    e = t["contents"]
    e = e.withColumn("size", F.when(~F.col("archive").startswith(A.PDF_PREFIX), F.col("size")))
    first = e.filter(F.col("archive").startswith("blog.")).groupBy("archive").agg(F.min("path").alias("path"))
    e = e.unionByName(e.join(first, ["archive", "path"], "left_semi"))
    out = C.refresh_catalog(t["archives"], t["archive_metadata"], e, _older(t), ends=t["ends"])
    return out.select("archive", "title", "type", "article_count", "main_path", "error")


QUERIES = {
    "archive_list": archive_list,
    "media_ratio": media_ratio,
    "archive_classify": archive_classify,
    "archive_title": archive_title,
    "article_count": article_count,
    "catalog_build": catalog_build,
    "catalog_listing": catalog_listing,
    "catalog_routes": catalog_routes,
    "catalog_info": catalog_info,
    "archive_cards": archive_cards,
    "readable_archives": readable_archives,
    "main_path": main_path,
    "catalog_refresh": catalog_refresh,
    "catalog_refresh_errors": catalog_refresh_errors,
}

ORACLE = {
    "archive_list": S.with_entries(
        "SELECT DISTINCT archive FROM entries WHERE archive LIKE '%.zim'"),
    "media_ratio": S.with_catalog(
        "SELECT archive, sampled, video, pdf, video / sampled AS video_ratio, "
        "pdf / sampled AS pdf_ratio FROM _ratio"),
    "archive_classify": S.with_catalog("SELECT archive, type FROM _kind"),
    "archive_title": S.with_catalog("SELECT archive, title FROM _title"),
    "article_count": S.with_entries(
        "SELECT archive, count(*) FILTER (WHERE NOT is_redirect AND mimetype LIKE 'text/html%') "
        "AS article_count FROM entries GROUP BY archive"),
    "catalog_build": S.with_catalog("SELECT * FROM catalog"),
    "catalog_listing": S.with_catalog(
        "SELECT archive, coalesce(nullif(title, ''), archive) AS title, "
        "coalesce(nullif(type, ''), 'generic') AS type, coalesce(description, '') AS description, "
        "article_count, coalesce(main_path, '') AS main_path FROM catalog WHERE archive LIKE '%.zim'"),
    "catalog_routes": S.with_catalog(
        "SELECT archive, type, CASE WHEN type = 'wikipedia' THEN "
        "'/page/entry.mu`zim=' || archive || '|entry_path=' || main_path "
        "WHEN type IN ('pdf', 'video') THEN NULL "
        "ELSE '/page/zim_index.mu`zim=' || archive END AS route FROM catalog"),
    "catalog_info": S.with_catalog(
        "SELECT archive, concat_ws(' · ', nullif(type, ''), CASE WHEN coalesce(article_count, 0) <> 0 "
        "THEN format('{:,}', article_count) || ' articles' END) AS info FROM catalog"),
    "archive_cards": S.with_catalog(
        "SELECT archive, coalesce(nullif(title, ''), archive) AS title, "
        "nullif(description, '') AS description, CASE WHEN coalesce(article_count, 0) <> 0 "
        "THEN format('{:,}', article_count) || ' entries' END AS count_line, "
        "nullif(main_path, '') AS main_link FROM catalog"),
    "readable_archives": S.with_catalog(
        "SELECT archive, type FROM catalog WHERE type NOT IN ('pdf', 'video')"),
    "main_path": S.with_catalog(
        "SELECT c.archive, coalesce(nullif(CASE WHEN length(c.archive) % 2 = 0 THEN c.main_path ELSE '' END, ''), "
        "m.main_path, '') AS main_path FROM catalog c LEFT JOIN _main m USING (archive)"),
    "catalog_refresh": S.with_catalog(
        "SELECT archive, " + S.stem("archive") + " AS title, 'generic' AS type, '' AS description, "
        "article_count, main_path FROM catalog "
        "WHERE starts_with(archive, 'm.') "
        "UNION ALL SELECT * FROM catalog WHERE NOT starts_with(archive, 'm.')"),
    "catalog_refresh_errors": S.with_catalog(
        "SELECT archive, " + S.stem("archive") + " AS title, 'generic' AS type, article_count, main_path, "
        "NULL::VARCHAR AS error FROM catalog WHERE starts_with(archive, 'm.') "
        "UNION ALL SELECT archive, NULL, NULL, NULL, NULL, 'entry without a size' FROM catalog "
        f"WHERE starts_with(archive, '{A.PDF_PREFIX}') "
        "UNION ALL SELECT archive, NULL, NULL, NULL, NULL, 'two entries at ' || min(path) FROM entries "
        "WHERE starts_with(archive, 'blog.') GROUP BY archive "
        "UNION ALL SELECT archive, title, type, article_count, main_path, NULL FROM catalog "
        f"WHERE NOT starts_with(archive, 'm.') AND NOT starts_with(archive, 'blog.') AND NOT starts_with(archive, '{A.PDF_PREFIX}')"),
}
