"""Shared-storage helpers of the training-data operators."""

from __future__ import annotations

import hashlib
import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that deletes the shuffle files of a query when it has ended.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a plain local session, where driver and executors are one process,
    may do without the setting: it gets a scratch folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="quire-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: lost executors cost a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    write_freed(df, path)
    return spark.read.schema(df.schema).parquet(path)


def write_freed(df: DataFrame, path: str) -> None:
    """Write ``df`` as Parquet; its job's shuffle files go as soon as it has ended.

    Else they stay on the executors' disks until the driver happens to collect
    the job's plan.
    """
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(FREED)
        else:
            conf.set(FREED, before)


class Scratch:
    """Stored tables of one computation, by name; ``drop`` deletes them once its result is stored.

    A table replaces the one of its name, which nothing but tables already
    stored may have been made from.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        write_freed(df, path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete the tables of these names, all without names."""
        for name in names or list(self.paths):
            if path := self.paths.pop(name, None):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def free_driver(spark: SparkSession) -> None:
    """Have the driver collect the plans of finished jobs now.

    Many small jobs in a row leave more plans than data; a heap that has grown
    by them is not given back, and what they broadcast stays on executors.
    """
    spark._jvm.java.lang.System.gc()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors, which may not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for folder, _, names in sorted(os.walk(top)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(top)))
    content = packed.getvalue()
    # the driver serves the file to executors for as long as the application runs
    path = os.path.join(tempfile.mkdtemp(prefix="quire-sources-"), f"quire-{hashlib.sha256(content).hexdigest()[:16]}.zip")
    with open(path, "wb") as f:
        f.write(content)
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def refuse_clash(columns, written) -> None:
    """Raise the one error that operators give where a kept column has the name of one they write."""
    clash = sorted(set(written) & set(columns))
    if clash:
        raise ValueError(f"columns {clash} are written by the operator; rename them first")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    r"""Array of the words ``[^\x20\x09-\x0D]+`` of a text (null: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def once(df: DataFrame, keep: list[str], **cols: Column) -> DataFrame:
    """Compute ``cols`` once a row, even if later steps use them often.

    Without the one-row generator the optimizer copies each expression into
    every place that reads it, lambda bodies included.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
