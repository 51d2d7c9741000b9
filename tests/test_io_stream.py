"""Catalogue sidecars and the streaming incremental refresh."""

import tempfile

from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.operators import refresh as RF
from quire.sources import archive as A
from quire.sources import catalog_io as CIO
from quire.sources import versions as V
from quire.streaming import refresh as S

SF = "/root/testdata/sf0.001"


def test_catalog_roundtrip_with_bad_record(spark):
    d = tempfile.mkdtemp(prefix="quire-cat-")
    cat = spark.createDataFrame([("a.zim", "A", "generic", "", 3, "x"), ("b.zim", None, "", None, None, "")],
                                CIO.CATALOG_SCHEMA)
    CIO.write_catalog(cat, d + "/cat")
    with open(d + "/cat/part-bad.json", "w") as fh:
        fh.write('{"archive": "c.zim", "title": \n')
    back = {r.archive: r for r in CIO.read_catalog(spark, d + "/cat").collect()}
    assert back["a.zim"].title == "A" and back["a.zim"].article_count == 3
    names = spark.createDataFrame([("a.zim",), ("b.zim",), ("z.zim",)], "archive string")
    listing = {r.archive: (r.title, r.type) for r in
               C.catalog_listing(names, CIO.read_catalog(spark, d + "/cat")).collect()}
    assert listing == {"a.zim": ("A", "generic"), "b.zim": ("b.zim", "generic"), "z.zim": ("z.zim", "generic")}


def test_streaming_incremental_render(spark):
    d = tempfile.mkdtemp(prefix="quire-stream-")
    entries = A.load(spark, SF)["contents"].select(*[
        c.split()[0] for c in S.ENTRY_SCHEMA.split(", ")])
    entries.filter(F.col("entry_id") < 25).write.mode("append").parquet(d + "/in")
    S.init_cache(spark, d + "/cache")
    q = S.start_incremental_render(spark, d + "/in", d + "/cache", d + "/ckpt")
    q.awaitTermination(300)
    first = S.read_cache(spark, d + "/cache").count()
    html = entries.filter((F.col("entry_id") < 25) & F.col("mimetype").startswith("text/html")).count()
    assert first == html
    # a second drop: new entries plus an unchanged copy of the first ones
    entries.write.mode("append").parquet(d + "/in")
    q = S.start_incremental_render(spark, d + "/in", d + "/cache", d + "/ckpt")
    q.awaitTermination(300)
    total = entries.filter(F.col("mimetype").startswith("text/html")).count()
    assert S.read_cache(spark, d + "/cache").count() == total
    # the unchanged entries were not rendered again: epoch 1 only holds the new ones
    log = spark.read.schema(S.CACHE_LOG_SCHEMA).parquet(d + "/cache/log")
    assert log.filter("epoch = 1").count() == total - html
    # merging the finished epochs changes nothing that readers see, and the stream goes on behind the base
    before = sorted(map(tuple, S.read_cache(spark, d + "/cache").collect()))
    assert S.compact_cache(spark, d + "/cache") == 1 and S.compact_cache(spark, d + "/cache") == 1
    assert sorted(map(tuple, S.read_cache(spark, d + "/cache").collect())) == before
    S.drop_merged_epochs(spark, d + "/cache")
    assert [r[0] for r in spark.read.schema(S.CACHE_LOG_SCHEMA).parquet(d + "/cache/log").select("epoch")
            .distinct().collect()] == [1]
    assert sorted(map(tuple, S.read_cache(spark, d + "/cache").collect())) == before
    plan = S.read_cache(spark, d + "/cache")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(epoch" in plan
    changed = entries.limit(1).withColumn("size", F.col("size") + 1).withColumn("html", F.lit("<p>changed</p>"))
    S._batch(d + "/cache", "generic")(changed, 2)
    assert "changed" in "".join(r.text for r in S.read_cache(spark, d + "/cache").collect())
    assert S.compact_cache(spark, d + "/cache") == 2 and S.read_cache(spark, d + "/cache").count() == total


def test_cache_versions(spark, tmp_path):
    def rows(*texts):
        return spark.createDataFrame([(t, "a", t, "1-2", t) for t in texts], RF.CACHE_SCHEMA)

    path = str(tmp_path / "cache")
    texts = lambda: sorted(r.text for r in RF.read_latest_cache(spark, path).collect())
    assert texts() == []
    RF.write_cache(spark, rows("one", "two"), path)
    assert texts() == ["one", "two"]
    # data without a manifest is what a job leaves that died half-way
    rows("half").write.parquet(f"{path}/{V.new_folder(path, 'cache')}")
    assert texts() == ["one", "two"]
    RF.write_cache(spark, rows(), path)
    assert texts() == []
    RF.write_cache(spark, rows("three"), path)
    assert texts() == ["three"]
    files = RF.read_latest_cache(spark, path).inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) == 1
