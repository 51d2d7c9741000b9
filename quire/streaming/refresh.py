"""Incremental render as a Structured Streaming job.

New or changed entries arrive as Parquet files in a folder.  Each micro-batch
renders only entries whose (key, validator) has no cache row yet and appends
the fresh rows to the cache under ``epoch=<batch id>``.  Readers take the
newest row per cache key (merge on read), so a batch never rewrites the whole
cache, and re-running a batch after a failure overwrites only its own epoch
folder (idempotent).  ``compact_cache`` merges finished epochs into a base
table, which a manifest makes current in one step; readers then read the base
and the epochs behind it.  ``trigger(availableNow=True)`` processes what is there
and stops, which is how a scheduled refresh runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import extract as X
from quire.operators import refresh as RF
from quire.sources import versions as V

ENTRY_SCHEMA = ("archive string, entry_id bigint, path string, title string, mimetype string, "
                "is_redirect boolean, redirect_path string, size bigint, html string")
CACHE_LOG_SCHEMA = RF.CACHE_SCHEMA + ", epoch bigint"


def _log(cache_dir: str) -> str:
    return f"{cache_dir.rstrip('/')}/log"


def read_cache(spark: SparkSession, cache_dir: str, before: int | None = None) -> DataFrame:
    """Newest cache row per key, of epochs below ``before``: the base and the log behind it."""
    folders, upto = V.current(spark, cache_dir)
    log = spark.read.schema(CACHE_LOG_SCHEMA).parquet(_log(cache_dir))
    if before is not None:
        log = log.filter(F.col("epoch") < before)
    if not folders:
        return RF.last_writes(log, ["epoch"])
    base = V.read(spark, folders, RF.CACHE_SCHEMA).withColumn("epoch", F.lit(upto - 1).cast("bigint"))
    # epochs are folders, so those that the base holds are not read
    return RF.last_writes(base.unionByName(log.filter(F.col("epoch") >= upto)), ["epoch"])


def init_cache(spark: SparkSession, cache_dir: str) -> None:
    """Create an empty cache log (epoch -1) so the first batch has something to read."""
    (spark.createDataFrame([], RF.CACHE_SCHEMA)
     .write.mode("overwrite").parquet(f"{_log(cache_dir)}/epoch=-1"))


def compact_cache(spark: SparkSession, cache_dir: str) -> int | None:
    """Merge all epochs but the newest into a new base; returns the first epoch behind it.

    The newest epoch stays out, as a restarted stream may run it again.  What
    was merged stays where it is until :func:`drop_merged_epochs`.
    """
    log = spark.read.schema(CACHE_LOG_SCHEMA).parquet(_log(cache_dir))
    newest = log.agg(F.max("epoch")).first()[0]
    _, upto = V.current(spark, cache_dir)
    if newest is None or newest <= (upto if upto is not None else -1):
        return upto
    folder = V.new_folder(cache_dir, "base")
    read_cache(spark, cache_dir, before=newest).select(*RF.CACHE_COLUMNS) \
        .write.mode("errorifexists").parquet(f"{cache_dir.rstrip('/')}/{folder}")
    V.publish(spark, cache_dir, [folder], upto=newest)
    return newest


def drop_merged_epochs(spark: SparkSession, cache_dir: str) -> None:
    """Delete the epoch folders that the current base holds, once no reader of an older version is left."""
    _, upto = V.current(spark, cache_dir)
    if upto is None:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(_log(cache_dir))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("epoch=") and 0 <= int(name[6:]) < upto:
            fs.delete(status.getPath(), True)


def _batch(cache_dir: str, kind: str):
    def run(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        entries = batch.filter(F.col("mimetype").startswith("text/html"))
        # a replayed batch must not see what its first run wrote
        cache = read_cache(spark, cache_dir, before=epoch_id)
        fresh = RF.render_missing(entries, cache, lambda d: X.render_documents(d, kind))
        (fresh.select("cache_key", "archive", "path", "validator", "text")
         .write.mode("overwrite").parquet(f"{_log(cache_dir)}/epoch={epoch_id}"))
    return run


def start_incremental_render(spark: SparkSession, entries_dir: str, cache_dir: str,
                             checkpoint_dir: str, kind: str = "generic", available_now: bool = True):
    """Start the refresh stream; returns the StreamingQuery."""
    src = spark.readStream.schema(ENTRY_SCHEMA).parquet(entries_dir)
    w = src.writeStream.foreachBatch(_batch(cache_dir, kind)).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
