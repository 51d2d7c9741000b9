"""Classification and metadata goldens (AGG-2, SRC-4, AGG-3)."""

from quire.operators import catalog as C

ENTRY_SCHEMA = "archive string, entry_id long, path string, title string, mimetype string, " \
               "is_redirect boolean, redirect_path string, size long, html string"


def _entries(spark, archive, mimes, main_html=""):
    rows = [(archive, i, f"p{i}", f"t{i}", m, False, None, 1, main_html if i == 0 else "")
            for i, m in enumerate(mimes)]
    return spark.createDataFrame(rows, ENTRY_SCHEMA)


def _classify(spark, entries, meta_rows=()):
    from quire.sources.archive import archives_table
    meta = spark.createDataFrame(list(meta_rows), "archive string, key string, value binary")
    arch = archives_table(entries)
    mains = C.main_pages(arch, entries)
    return {r.archive: r.type for r in C.classify_archives(meta, entries, mains).collect()}


def test_media_thresholds(spark):
    html = "text/html"
    e = (_entries(spark, "v10.zim", [html] * 90 + ["video/mp4"] * 10, "<p>" + "x" * 80 + "</p>")
         .unionByName(_entries(spark, "v11.zim", [html] * 89 + ["video/webm"] * 11))
         .unionByName(_entries(spark, "both.zim", [html] * 39 + ["video/mp4"] * 11 + ["application/pdf"] * 50))
         .unionByName(_entries(spark, "vp.zim", [html] * 80 + ["video/pdf"] * 20, "<p>" + "y" * 80 + "</p>")))
    got = _classify(spark, e)
    assert got["v10.zim"] == "generic"
    assert got["v11.zim"] == "video"
    assert got["both.zim"] == "video"
    assert got["vp.zim"] == "video"


def test_gutenberg_tag_wins(spark):
    e = _entries(spark, "g.zim", ["video/webm"] * 5)
    got = _classify(spark, e, [("g.zim", "Tags", b"_category:Gutenberg")])
    assert got["g.zim"] == "gutenberg"


def test_main_page_rules(spark):
    wiki = '<div class="mw-parser-output"><meta http-equiv="refresh"></div>'
    e = (_entries(spark, "w.zim", ["text/html"], wiki)
         .unionByName(_entries(spark, "s.zim", ["text/html"], "<meta http-equiv='REFRESH' content='0'>" + "z" * 60))
         .unionByName(_entries(spark, "t39.zim", ["text/html"], "<p>" + "a" * 39 + "</p>"))
         .unionByName(_entries(spark, "t40.zim", ["text/html"], "<p>" + "a" * 40 + "</p>")))
    got = _classify(spark, e)
    assert got == {"w.zim": "wikipedia", "s.zim": "spa", "t39.zim": "spa", "t40.zim": "generic"}


def test_first_metadata(spark):
    meta = spark.createDataFrame([("a.zim", "Title", b"  "), ("a.zim", "Name", b"X"),
                                  ("b.zim", "Name", b"X"), ("c.zim", "Name", b"\xffok ")],
                                 "archive string, key string, value binary")
    got = {r.archive: r.value for r in C.first_metadata(meta, ["Title", "Name"]).collect()}
    assert got == {"a.zim": "", "b.zim": "X", "c.zim": "�ok"}


def test_listing_defaults(spark):
    names = spark.createDataFrame([("a.zim",), ("b.zim",), ("fb.zim",)], "archive string")
    cat = spark.createDataFrame([("a.zim", "", "", None, None, None)],
                                "archive string, title string, type string, description string, "
                                "article_count long, main_path string")
    got = {r.archive: (r.title, r.type, r.description, r.main_path) for r in
           C.catalog_listing(names, cat, fallback="/x/fb.zim").collect()}
    assert got == {"a.zim": ("a.zim", "generic", "", ""), "b.zim": ("b.zim", "generic", "", ""),
                   "fb.zim": ("fb.zim", "wikipedia", "", "")}
