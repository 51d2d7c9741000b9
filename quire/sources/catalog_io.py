"""Catalogue sidecars: one JSON record per archive.

Reading uses an explicit schema in PERMISSIVE mode: an unreadable record
becomes an empty (all-null) record instead of failing the job, and listing
defaults are applied afterwards (see ``catalog.catalog_listing``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = ("archive string, title string, type string, description string, "
                  "article_count bigint, main_path string")


def write_catalog(catalog: DataFrame, path: str) -> None:
    catalog.select("archive", "title", "type", "description", "article_count", "main_path") \
        .write.mode("overwrite").json(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    df = (spark.read.schema(CATALOG_SCHEMA + ", _corrupt string")
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path))
    fields = ["title", "type", "description", "article_count", "main_path"]
    # a corrupt record keeps nothing but (at most) its archive name
    return df.select("archive", *[F.when(F.col("_corrupt").isNull(), F.col(c)).alias(c) for c in fields]) \
        .filter(F.col("archive").isNotNull())
