"""Cases that earlier versions got wrong."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import catalog as C
from quire.operators import extract as X
from quire.operators import html as H
from quire.operators import refresh as RF
from quire.operators import requests as RQ
from quire.operators import search as Q
from quire.streaming import refresh as SR

ENTRY = ("archive string, entry_id long, path string, title string, mimetype string, is_redirect boolean, "
         "redirect_path string, size long, html string")
HTML = "text/html"


def entries(spark, rows):
    return spark.createDataFrame(rows, ENTRY)


def page(archive, entry_id, path, html, title="T"):
    return (archive, entry_id, path, title, HTML, False, None, len(html), html)


def hop(archive, entry_id, path, to, title="R"):
    return (archive, entry_id, path, title, HTML, True, to, 0, "")


def render(spark, html, kind="generic"):
    docs = spark.createDataFrame([(1, "a.zim", "p", html)], "doc_id long, archive string, path string, html string")
    return X.render_documents(docs, kind).first()["text"]


def test_entries_of_two_archives_with_one_id_stay_apart(spark):
    e = entries(spark, [page("a.zim", 1, "x", "<p>AAA</p>"), page("b.zim", 1, "x", "<p>BBB</p>")])
    empty = spark.createDataFrame([], RF.CACHE_SCHEMA)
    rows = RF.render_incremental(e, empty, lambda d: X.render_documents(d, "generic")).collect()
    text = {r["archive"]: r["text"] for r in rows}
    assert len(rows) == 2 and "AAA" in text["a.zim"] and "BBB" not in text["a.zim"] and "BBB" in text["b.zim"]


def test_a_replayed_epoch_writes_the_same_rows(spark, tmp_path):
    cache = str(tmp_path / "cache")
    SR.init_cache(spark, cache)
    batch = entries(spark, [page("a.zim", 1, "x", "<p>one</p>"), page("a.zim", 2, "x", "<p>two</p>")])
    for _ in range(2):
        SR._batch(cache, "generic")(batch, 0)
        rows = SR.read_cache(spark, cache).collect()
        assert len(rows) == 1 and "two" in rows[0]["text"]


def test_upsert_keeps_the_last_fresh_row(spark):
    schema = RF.CACHE_SCHEMA + ", at long"
    fresh = spark.createDataFrame([("k", "a", "p", "1-2", "new", 2), ("k", "a", "p", "9-2", "old", 1)], schema)
    rows = RF.upsert_cache(spark.createDataFrame([("k", "a", "p", "0-2", "was")], RF.CACHE_SCHEMA), fresh, ["at"])
    assert [r["text"] for r in rows.collect()] == ["new"]


def test_versions_of_a_cache_are_read_newest_first(spark, tmp_path):
    row = lambda text: spark.createDataFrame([("k", "a", "p", "1-2", text)], RF.CACHE_SCHEMA)
    for text in ("first", "second"):
        RF.write_cache(spark, row(text), str(tmp_path))
    assert [r["text"] for r in RF.read_latest_cache(spark, str(tmp_path)).collect()] == ["second"]


def test_chains_of_any_length_and_cycles(spark):
    rows = [hop("a.zim", i, f"p{i}", f"p{i + 1}") for i in range(20)] + [page("a.zim", 20, "p20", "x")]
    rows += [hop("a.zim", 30, "c0", "c1"), hop("a.zim", 31, "c1", "c2"), hop("a.zim", 32, "c2", "c0"),
             hop("a.zim", 33, "into", "c1"), hop("a.zim", 34, "self", "self"), hop("a.zim", 35, "lost", "nowhere")]
    got = {r["path"]: (r["final_path"], r["hops"], r["resolved"]) for r in RQ.resolve_redirects(entries(spark, rows)).collect()}
    assert [got[f"p{i}"] for i in range(21)] == [("p20", 20 - i, True) for i in range(21)]
    assert all(not got[p][2] and got[p][0] is None for p in ("c0", "c1", "c2", "into", "self", "lost"))
    assert len(got) == len(rows)


def test_status_follows_book_paths_and_chains(spark):
    e = entries(spark, [page("g.zim", 1, "Book.1", "x"), hop("g.zim", 2, "r1", "r2"), hop("g.zim", 3, "r2", "Book.1"),
                        page("n.zim", 1, "only", "x")])
    catalog = spark.createDataFrame([("g.zim", "gutenberg")], "archive string, type string")
    requests = spark.createDataFrame([(1, "g.zim", "Book_cover.1"), (2, "g.zim", "r1"), (3, "n.zim", "only"),
                                      (4, "x.zim", "p"), (5, "g.zim", "none")],
                                     "request_id long, archive string, entry_path string")
    got = {r["request_id"]: (r["status"], r["final_path"])
           for r in RQ.request_status(requests, e, catalog, catalog.select("archive")).collect()}
    assert got == {1: ("ok", "Book.1"), 2: ("ok", "Book.1"), 3: ("ok", "only"),
                   4: ("missing_archive", None), 5: ("missing_entry", None)}


def test_media_ratio_follows_redirects_and_skips_entries_without_type(spark):
    rows = [("m.zim", i, f"v{i}", "", "video/webm", False, None, 1, "") for i in range(2)]
    rows += [hop("m.zim", 10 + i, f"h{i}", "v0") for i in range(3)] + [hop("m.zim", 20, "bad", "gone")]
    rows += [("m.zim", 30 + i, f"n{i}", "", None, False, None, 1, "") for i in range(4)] + [page("m.zim", 40, "t", "x")]
    r = C.media_ratio(entries(spark, rows)).first()
    assert (r["sampled"], r["video"], r["pdf"]) == (6, 5, 0)
    assert C.media_ratio(entries(spark, rows), first_n=3).first()["sampled"] == 3


def test_main_paths_fall_back_to_the_archive(spark):
    listing = spark.createDataFrame([("w.zim", "W", "wikipedia", "", 1, "")],
                                    "archive string, title string, type string, description string, "
                                    "article_count long, main_path string")
    archives = spark.createDataFrame([("w.zim", "Main")], "archive string, main_path string")
    assert C.catalog_routes(listing, archives).first()["route"].endswith("|entry_path=Main")
    assert C.archive_cards(listing, archives).first()["main_link"] == "Main"


def test_single_archive_fallback(spark):
    e = entries(spark, [page("notes.txt", 1, "x", "x")])
    assert [r[0] for r in C.list_archives(e, "/data/one.zim").collect()] == ["one.zim"]
    e = entries(spark, [page("two.zim", 1, "x", "x")])
    assert [r[0] for r in C.list_archives(e, "/data/one.zim").collect()] == ["two.zim"]


def test_integers_beyond_64_bits_saturate(spark):
    rows = spark.createDataFrame([("99999999999999999999",), ("-99999999999999999999",), (" 7 ",), ("x",)], "v string")
    got = [(r[0], r[1]) for r in rows.select(T.strict_int("v"), T.cell_span("v")).collect()]
    assert got == [(2 ** 63 - 1, 50), (-(2 ** 63) + 1, 1), (7, 7), (None, 1)]


def test_quoted_attribute_values_may_hold_angle_brackets(spark):
    out = render(spark, "<p><a title=\"a > b\" href=\"Foo\">foo</a> <b class=x'>y</b></p>")
    assert "a > b" not in out and "Foo" in out and "`!y`!" in out


def test_ids_of_items_emit_no_anchor(spark):
    out = render(spark, "<ul><li id='x1'>one <b id='x2'>two</b></li></ul><dl><dt id='x3'>t</dt><dd id='x4'>d</dd></dl>")
    assert "`:x2`a" in out and not any(f"`:{i}`a" in out for i in ("x1", "x3", "x4"))


def test_anchors_are_those_rendered_and_distinct(spark):
    docs = spark.createDataFrame([(1, "<ul><li id='li1'><i id='a'>x</i></li></ul><p><i id='a'>y</i><i id='b'>z</i></p>")],
                                 "doc_id long, html string")
    rows = X.anchors(H.html_nodes(docs.withColumn("archive", F.lit("a.zim")).withColumn("path", F.lit("p")))).collect()
    assert sorted(r["anchor"] for r in rows) == ["a", "b"]


def test_wikipedia_page_that_starts_with_a_heading(spark):
    body = "<div class='mw-parser-output'><h2>First</h2><p>text</p></div>"
    assert render(spark, body, "wikipedia").startswith("`:top\n\n>>First")


def test_gutenberg_ids_are_searched_after_each_removal(spark):
    ids = X.RULES["gutenberg"]["ids"]
    inner, outer = ids[-1], ids[0]
    html = f"<div id='{outer}'><p id='{inner}'>gone</p></div><p id='{inner}'>gone too</p><p>stays</p>"
    out = render(spark, html, "gutenberg")
    assert "stays" in out and "gone" not in out


def test_spellings_of_one_query_rank_apart(spark):
    e = entries(spark, [page("a.zim", 1, "p1", "x", "paris fr"), page("a.zim", 2, "p2", "x", "paris-fr"),
                        hop("a.zim", 3, "p3", "p1", "paris france")])
    req = spark.createDataFrame([(1, "a.zim", "paris fr", "1"), (2, "a.zim", "paris-fr", "1")],
                                "request_id long, archive string, query string, page_number string")
    rows = Q.search_page(req, Q.build_index(e)).orderBy("request_id", "number").collect()
    assert [r["path"] for r in rows if r["request_id"] == 1][0] == "p1"
    assert [r["path"] for r in rows if r["request_id"] == 2][0] == "p2"
    assert {r["size_label"] for r in rows} == {"1 B"}


def test_a_hot_query_is_ranked_in_bands(spark):
    e = entries(spark, [page("a.zim", i, f"p{i:03d}", "x", f"alpha {chr(97 + i % 5)}{i:03d}") for i in range(100)])
    req = spark.createDataFrame([(1, "a.zim", "alpha", "3"), (2, "a.zim", "alpha", "99999999999999999999")],
                                "request_id long, archive string, query string, page_number string")
    rows = Q.search_page(req, Q.build_index(e)).collect()
    titles = sorted(r["title"] for r in e.select("title").collect())
    got = lambda i: [r["title"] for r in sorted((r for r in rows if r["request_id"] == i), key=lambda r: r["number"])]
    assert got(1) == titles[30:45] and got(2) == titles[90:]


def test_a_main_entry_that_redirects_is_followed(spark):
    wiki = "<html><title>W</title><div class='mw-parser-output'><p>x</p></div></html>"
    e = entries(spark, [hop("w.zim", 1, "mainPage", "A/Old"), hop("w.zim", 2, "A/Old", "A/Main"), page("w.zim", 3, "A/Main", wiki),
                        hop("c.zim", 1, "x", "y"), hop("c.zim", 2, "y", "x"), hop("d.zim", 1, "x", "nowhere"),
                        page("p.zim", 1, "x", "<p>plain text that is long enough to be read by people</p>")])
    mains = spark.createDataFrame([("w.zim", 3, 1, "mainPage"), ("c.zim", 2, 0, "x"), ("d.zim", 1, 0, "x"), ("p.zim", 1, 1, "x"),
                                   ("e.zim", 0, 0, None)], "archive string, entry_count long, article_count long, main_path string")
    meta = spark.createDataFrame([], "archive string, key string, value binary")
    got = {r.archive: (r.title, r.type, r.main_path) for r in C.build_catalog(mains, meta, e).collect()}
    assert got == {"w.zim": ("W", "wikipedia", "A/Main"), "c.zim": ("c", "generic", ""), "d.zim": ("d", "generic", ""),
                   "p.zim": ("p", "generic", "x"), "e.zim": ("e", "generic", "")}


def test_media_share_must_exceed_a_tenth(spark):
    rows = [page("a.zim", i, f"p{i}", "x") for i in range(9)] + [("a.zim", 9, "v", "V", "video/webm", False, None, 1, "")]
    rows += [(("b.zim", *r[1:])) for r in rows] + [("b.zim", 10, "w", "V", "video/mp4", False, None, 1, "")]
    e = entries(spark, rows)
    mains = spark.createDataFrame([("a.zim", ""), ("b.zim", "")], "archive string, main_html string")
    meta = spark.createDataFrame([], "archive string, key string, value binary")
    assert {r.archive: r.type for r in C.classify_archives(meta, e, mains).collect()} == {"a.zim": "generic", "b.zim": "video"}


def test_one_failing_archive_does_not_stop_a_refresh(spark):
    e = entries(spark, [page("a.zim", 1, "x", "<title>A</title>"), page("b.zim", 1, "x", ""), page("b.zim", 2, "x", ""),
                        page("c.zim", 1, None, ""), page("d.txt", 1, "x", "")])
    names = spark.createDataFrame([(n, 1, 1, "x") for n in ("a.zim", "b.zim", "c.zim", "d.txt", "e.zim")],
                                  "archive string, entry_count long, article_count long, main_path string")
    meta = spark.createDataFrame([], "archive string, key string, value binary")
    out = C.refresh_catalog(names, meta, e, None)
    assert {r.archive: r.error for r in out.collect()} == {
        "a.zim": None, "b.zim": "two entries at x", "c.zim": "entry without a path", "d.txt": "not an archive name",
        "e.zim": "no entries"}
    written = C.written_catalog(out)
    assert [r.title for r in written.collect()] == ["A"] and "error" not in written.columns
    # the next refresh tries the failed ones again, and only them
    again = C.refresh_catalog(names, meta, entries(spark, [page("e.zim", 1, "x", "<title>E</title>")]), written)
    assert {r.archive: r.error for r in again.collect()}["e.zim"] is None


def test_redirects_that_share_a_target_are_spread(spark, monkeypatch):
    from quire.operators import redirects as RD

    monkeypatch.setattr(RD, "HOT_TARGET", 50)
    rows = [hop("a.zim", i, f"r{i}", "main") for i in range(300)] + [page("a.zim", 900, "main", "x")]
    rows += [hop("a.zim", 1000 + i, f"s{i}", f"r{i}") for i in range(100)] + [hop("a.zim", 2000, "lost", "gone")]
    out = RD.resolve_redirects(entries(spark, rows), only_redirects=True)
    got = {r.path: (r.final_path, r.hops, r.resolved) for r in out.collect()}
    assert len(got) == 401 and got["r7"] == ("main", 1, True) and got["s7"] == ("main", 2, True)
    assert got["lost"] == (None, 1, False)
    assert "_salt" in out._jdf.queryExecution().executedPlan().toString()
