"""Versioned table folders: data first, then a manifest that names it.

A table that is replaced or extended in steps lives under one path::

    <path>/<name>-<stamp>/      data folders, never changed once written
    <path>/manifest/seq=<...>/  one row a version: the data folders it consists of

A version counts once its manifest row is there, and Spark's committer puts it
there whole or not at all.  A job that dies half-way leaves data that nothing
names; readers read what the newest manifest names and nothing else.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "folders array<string>, upto bigint"


def _stamp() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def new_folder(path: str, name: str) -> str:
    """Name of a fresh data folder, relative to ``path``."""
    return f"{name}-{_stamp()}"


def publish(spark: SparkSession, path: str, folders: list[str], upto: int | None = None) -> None:
    """Make these data folders (relative to ``path``, oldest first) the current version.

    ``upto`` is a number of the writer's own, such as the first log epoch that
    the folders do not hold.
    """
    (spark.createDataFrame([(folders, upto)], MANIFEST_SCHEMA).coalesce(1)
     .write.mode("errorifexists").json(f"{path.rstrip('/')}/manifest/seq={_stamp()}"))


def current(spark: SparkSession, path: str) -> tuple[list[str], int | None]:
    """Data folders of the current version, oldest first, as full paths, and its ``upto``; none: no version yet."""
    root = path.rstrip("/")
    try:
        manifests = spark.read.schema(MANIFEST_SCHEMA + ", seq string").json(f"{root}/manifest")
    except AnalysisException as ex:
        if ex.getCondition() == "PATH_NOT_FOUND":
            return [], None
        raise
    newest = manifests.orderBy(F.desc("seq")).first()      # one row a version
    return ([f"{root}/{f}" for f in newest["folders"]], newest["upto"]) if newest else ([], None)


def read(spark: SparkSession, folders: list[str], schema: str) -> DataFrame:
    """The rows of data folders; an empty table if there are none."""
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
