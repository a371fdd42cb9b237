"""State machines, merges and pages on small literal tables."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import blobs, times, urls
from tidemark.functions import vectors as VF
from tidemark.operators import browse, documents, extract, ledger, merge, triage, vectors
from tidemark.sources import archive

UTC = datetime.UTC
T0 = datetime.datetime(2024, 1, 1, tzinfo=UTC)


def at(sec):
    return T0 + datetime.timedelta(seconds=sec)


@pytest.fixture(scope="module")
def articles(spark):
    # Ten rows on one second, and some around it.
    rows = [(i, f"A{i % 3}", f"a{i % 3}", "x" if i % 2 else "y", at(0 if i < 10 else i), at(1) if i == 4 else None) for i in range(1, 25)]
    return spark.createDataFrame(rows, "id long, author_name string, author_lc string, country string, published_at timestamp, hidden_at timestamp").cache()


@pytest.mark.parametrize("order", ["new", "old"])
def test_pages_cover_each_row_once_and_back(articles, order):
    want = [r.id for r in articles.where("hidden_at is null").orderBy(F.desc("published_at") if order == "new" else "published_at", F.desc("id") if order == "new" else "id").collect()]
    seen, cursor, pages = [], None, []
    while True:
        rows = browse.browse_page(articles, order=order, cursor=cursor, limit=4).collect()
        pages.append(rows)
        seen += [r.id for r in rows]
        if not rows[0].has_more:
            break
        cursor = browse.Cursor(rows[-1].published_at.replace(tzinfo=UTC), rows[-1].id)
    assert seen == want
    first = pages[2][0]
    back = browse.browse_page(articles, order=order, cursor=browse.Cursor(first.published_at.replace(tzinfo=UTC), first.id), going="prev", limit=4).collect()
    assert [r.id for r in back] == [r.id for r in pages[1]]


def test_keyset_and_prefix_push_down(spark, articles, tmp_path):
    path = str(tmp_path / "a")
    articles.write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = spark.read.parquet(path)

    def plan(d):
        return d._jdf.queryExecution().toString()

    page = plan(browse.browse_page(df, country="x", author="A1", cursor=browse.Cursor(at(5), 3)))
    assert "TakeOrderedAndProject" in page and "LessThanOrEqual(published_at" in page and "EqualTo(author_lc,a1)" in page and "IsNull(hidden_at)" in page
    assert "StringStartsWith(author_lc,a" in plan(browse.author_prefix_range(df, "A"))
    assert "StringStartsWith" not in plan(df.where(F.lower("author_name").startswith("a")))  # negative control


def test_suggestions(spark, articles):
    assert [r.author_name for r in browse.suggest_authors(articles, "A").collect()] == ["A0", "A1", "A2"]
    for bad in ("", "\U0010ffff", "a\ud800b", "%", "a_"):
        assert browse.suggest_authors(articles, bad).count() == 0


def test_date_jump_and_calendar(spark):
    d = datetime.date(2026, 7, 20)
    assert browse.date_jump(d, "old").published_at == datetime.datetime(2026, 7, 20, 7, tzinfo=UTC)
    assert browse.date_jump(datetime.date(2026, 1, 19), "new").published_at == datetime.datetime(2026, 1, 20, 8, tzinfo=UTC)
    assert browse.date_jump(datetime.date.max, "new") is None and times.parse_game_date("2026-13-01") is None
    days = spark.createDataFrame([(705,), (3576,), (6822,)], "d int").select(times.game_day_to_date(F.col("d")).cast("string").alias("x"))
    assert [r.x for r in days.collect()] == ["2009-10-25", "2017-09-04", "2026-07-25"]
    row = spark.createDataFrame([("Day 6,819, 21:34", "Jul 21 2026 05:53:10 GMT"), ("nonsense", "also")], "c string, p string").select(times.comment_time(F.col("c")).alias("c"), times.published_at(F.col("p")).alias("p")).collect()
    assert row[0].c == datetime.datetime(2026, 7, 23, 4, 34) and row[0].p == datetime.datetime(2026, 7, 21, 5, 53, 10)
    assert row[1].c is None and row[1].p is None


def test_urls(spark):
    cases = {
        "https://a.example/x": ("ok", "a.example"), "//B.example:8080/x": ("ok", "b.example"), "http://u:p@c.example/": ("ok", "c.example"), "ftp://a/": ("blocked", "a"),
        "/relative": ("blocked", None), "http://10.1.2.3/": ("blocked", "10.1.2.3"), "http://8.8.8.8/": ("ok", "8.8.8.8"), "http://0177.0.0.1/": ("blocked", "0177.0.0.1"),
        "http://2130706433/": ("blocked", "2130706433"), "http://[::1]/": ("blocked", "["), "http://[2606:4700:4700::1111]:80/x": ("ok", "[2606"), "http://[::1/": ("blocked", "["),
        "http://224.0.0.1/": ("blocked", "224.0.0.1"), "http://100.64.0.1/": ("blocked", "100.64.0.1"), "http://192.0.0.9/": ("ok", "192.0.0.9"), "": ("blocked", None),
    }
    df = spark.createDataFrame([(u,) for u in cases] + [(None,)], "source_url string")
    got = {r.source_url: (r.verdict, r.h) for r in urls.classify_url_table(df).withColumn("h", urls.url_host(F.col("source_url"))).collect()}
    assert got.pop(None)[0] == "blocked"
    assert got == cases


def test_blob_types(spark):
    heads = [("89504e470d0a1a0a", "image/png"), ("ffd8ff00", "image/jpeg"), ("474946383961", "image/gif"), ("424d", "image/bmp"), ("4d4d002a", "image/tiff"), ("524946460000000057454250", "image/webp"), ("52494646", None), ("", None)]
    df = spark.createDataFrame([(bytearray.fromhex(h), m) for h, m in heads], "data binary, want string")
    for r in df.withColumn("got", blobs.sniff_mime(F.col("data"))).withColumn("s", blobs.serving_type(F.col("data"))).collect():
        assert r.got == r.want and r.s.inline == (r.want is not None)
    got = df.select(blobs.resolve_mime(F.lit("image/svg+xml; q=1"), F.col("data")).alias("m")).distinct().collect()
    assert [r.m for r in got] == ["image/svg+xml; q=1"]


def test_outcomes(spark):
    png = bytearray.fromhex("89504e470d0a1a0a")
    rows = [
        ("blocked", None, 200, png, None, "dead", "blocked"), ("unresolved", None, 200, png, None, "error", "nxdomain"), ("ok", "too_large", None, None, None, "error", "alive"),
        ("ok", "blocked", None, None, None, "dead", "blocked"), ("ok", "timeout", None, None, None, "error", "unreachable"), ("ok", None, 404, None, None, "dead", "gone"),
        ("ok", None, 429, png, None, "error", "http-error"), ("ok", None, 200, bytearray(), "image/png", "error", "not-image"), ("ok", None, 200, bytearray(b"<html>"), "text/html", "dead", "not-image"),
        ("ok", None, 200, png, "text/html", "ok", "alive"), ("ok", None, 302, None, None, "error", "not-image"),
    ]
    df = spark.createDataFrame(rows, "v string, f string, h int, d binary, m string, capture string, probe string")
    args = [F.col(c) for c in "vfhdm"]
    for r in df.withColumn("c", blobs.classify_capture(*args)).withColumn("p", blobs.classify_probe(*args)).collect():
        assert (r.c.status, r.p) == (r.capture, r.probe), r
    pages = spark.createDataFrame([(404, "", None), (200, "postBody", None), (200, "Just a moment", None), (500, "x", None), (None, None, "Timeout")], "h int, b string, e string")
    got = [tuple(r.o) for r in pages.select(blobs.classify_fetch(F.col("h"), F.col("b"), F.col("e")).alias("o")).collect()]
    assert [g[0] for g in got] == ["missing", "ok", "error", "error", "error"]
    assert "challenge" in got[2][1] and got[3][1] == "http 500, no postBody in 1 bytes" and got[4][1] == "Timeout"


IMG = "article_id long, position long, source_url string, sha256 string, status string, attempts int, checked_at timestamp"


@pytest.fixture(scope="module")
def images(spark):
    rows = [
        (1, 0, "http://a/0", None, "pending", 0, None), (1, 1, "http://a/1", "d1", "ok", 1, T0), (1, 2, "http://b/2", None, "error", 4, T0),
        (2, 0, "http://b/0", None, "error", 5, T0), (2, 1, "http://c/1", None, "dead", 1, T0), (2, 2, "/rel", None, "pending", 0, None), (3, 0, "http://a/1", "d1", "ok", 1, T0),
    ]
    return spark.createDataFrame(rows, IMG).cache()


def test_claims(images):
    ids = lambda df: [(r.article_id, r.position) for r in df.collect()]
    assert ids(triage.claim_images(images, 9, at(10), 100)) == [(2, 2), (1, 0)]
    assert ids(triage.claim_images(images, 9, at(200), 100)) == [(2, 2), (1, 0), (1, 2)]
    assert ids(triage.claim_images(images, 9, at(200), 100, ["b"])) == [(1, 0)]  # a row without a host goes too


def test_interleave(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate("aaabbc")], "pos long, host string")
    assert "".join(r.host for r in triage.interleave_by_host(df).collect()) == "abcaba"


def test_hosts(spark, images):
    pick = lambda *h: spark.createDataFrame([(x,) for x in h], "host string")
    killed, refused = triage.kill_hosts(images, pick("a", "b"))
    status = {(r.article_id, r.position): (r.status, r.attempts) for r in killed.collect()}
    assert status[(1, 0)] == ("pending", 0) and status[(1, 2)] == ("dead", 4) and [(r.host, r.ok) for r in refused.collect()] == [("a", 2)]
    assert triage.kill_hosts(images, pick("a"), force=True)[0].where("status = 'dead'").count() == 2
    again = {(r.article_id, r.position): (r.status, r.attempts) for r in triage.requeue_hosts(images, pick("c", "b", "xb")).collect()}
    assert again[(2, 1)] == ("pending", 0) and again[(2, 0)] == ("pending", 0) and again[(1, 1)] == ("ok", 1)
    probes = spark.createDataFrame([("a", "gone"), ("b", "nxdomain"), ("c", "http-error")], "host string, verdict string")
    backlog = triage.host_backlog(images, 1)
    assert [r.host for r in backlog.collect()] == ["b", None, "a"]
    assert triage.writeoff_report(backlog, probes).first().asDict() == {"hosts": 1, "rows": 2}


def test_ledger(spark):
    ev = [(1, 1, at(1), "error", "e1"), (1, 2, at(2), "stale", None), (1, 3, at(3), "error", "e3"), (2, 4, at(1), "ok", None), (3, 5, at(1), "missing", None)]
    led = ledger.fetch_ledger(spark.createDataFrame(ev, "article_id long, seq long, ts timestamp, outcome string, error string"))
    got = {r.article_id: (r.status, r.attempts, r.last_error) for r in led.collect()}
    assert got == {1: ("error", 1, "e3"), 2: ("ok", 1, None), 3: ("missing", 1, None)}
    ids = spark.range(1, 6).select(F.col("id").alias("article_id"), F.col("id").alias("pos"))
    unseen = lambda **k: sorted(r.article_id for r in ledger.filter_unseen(ids, led, **k).collect())
    assert unseen() == [4, 5] and unseen(retry_errors=True) == [1, 4, 5]
    marked = {r.article_id: (r.status, r.attempts, r.changed) for r in ledger.mark_stale(led, ids).collect()}
    assert marked == {1: ("stale", 0, True), 2: ("stale", 0, True), 3: ("missing", 1, False)}
    batch = ledger.walk_batch(spark, led, 6, 2).collect()
    assert [(r.article_id, r.next_cursor) for r in batch] == [(6, 4), (5, 4)]


def test_coverage(spark):
    present = spark.createDataFrame([(1,), (2,), (5,), (7,), (2_000_000,)], "id long")
    log = spark.createDataFrame([(6, "missing"), (3, "missing")], "article_id long, status string")
    got = [(r.first_id, r.last_id, r.n, r.kind) for r in ledger.coverage_gaps(present, log, 1, 2_000_001).orderBy("first_id").collect()]
    assert got == [(3, 4, 2, "gap"), (6, 6, 1, "deleted"), (8, 1_999_999, 1_999_992, "gap"), (2_000_001, 2_000_001, 1, "gap")]


ART = "id long, title string, body string, lang string, hidden_at timestamp"


def test_merge_articles_and_vectors(spark):
    old = spark.createDataFrame([(1, "t", "b", "en", T0), (2, "t", None, None, None), (3, "t", "same", None, None)], ART)
    new = spark.createDataFrame([(1, "t2", "b2", None, None), (2, "t", "now", None, None), (3, "new title", "same", None, None), (4, "n", "n", "fr", None)], ART)
    once = merge.merge_articles(old, new)
    rows = {r.id: tuple(r) for r in once.collect()}
    assert rows[1][1:4] == ("t2", "b2", "en") and rows[1][4] is not None and rows[4][3] is None
    assert sorted(merge.merge_articles(once, new).collect()) == sorted(once.collect())
    vec = spark.createDataFrame([(i, [1.0], "m", T0) for i in (1, 2, 3)], "article_id long, embedding array<float>, model string, updated_at timestamp")
    cleared = {r.article_id: r.model for r in merge.queue_vectors(merge.invalidate_vectors(vec, old, new), once).collect()}
    assert cleared == {1: None, 2: None, 3: "m", 4: None}
    saved = {r.article_id: r.model for r in merge.save_vectors(vec, spark.createDataFrame([(1, [2.0]), (9, [2.0])], "article_id long, embedding array<float>"), "n", T0).collect()}
    assert saved == {1: "n", 2: "m", 3: "m"}
    assert {r.article_id: r.model for r in merge.switch_model(vec, "m").collect()} == {1: "m", 2: "m", 3: "m"}
    good, bad = merge.split_rejects(spark.createDataFrame([(1, 3, 0), (2, 0, 0), (3, 2, 2)], "id long, comment_count int, n_comments int"))
    assert sorted(r.id for r in good.collect()) == [2, 3] and bad.first().last_error == "comments vanished"


def test_merge_children(spark, images):
    old = spark.createDataFrame([(1, 10, 0, "a"), (2, 10, 1, "b")], "id long, article_id long, position long, body string")
    batch = spark.createDataFrame([(1, 11, 5, "x", 1), (1, 12, 6, "y", 2), (3, 10, 2, "c", 3)], "id long, article_id long, position long, body string, ordinal int")
    assert sorted(map(tuple, merge.merge_comments(old, batch).collect())) == [(1, 10, 6, "y"), (2, 10, 1, "b"), (3, 10, 2, "c")]
    more = spark.createDataFrame([(1, 7, "http://a/1"), (1, 0, "http://a/1"), (1, 9, "http://n/9")], "article_id long, position long, source_url string")
    got = {(r.article_id, r.source_url): (r.position, r.status, r.sha256) for r in merge.merge_images(images, more).collect()}
    assert got[(1, "http://a/1")] == (0, "ok", "d1") and got[(1, "http://n/9")] == (9, "pending", None) and len(got) == 8
    res = spark.createDataFrame([(1, "http://a/0", "ok", "dz"), (9, "?", "ok", None)], "article_id long, source_url string, status string, sha256 string")
    done = {(r.article_id, r.source_url): (r.status, r.sha256, r.attempts) for r in merge.record_image_result(images, res, T0).collect()}
    assert done[(1, "http://a/0")] == ("ok", "dz", 1) and len(done) == 7
    blobs_ = spark.createDataFrame([("d1", "image/png")], "sha256 string, mime string")
    new = spark.createDataFrame([("d1", "image/gif", 1), ("d2", "first", 2), ("d2", "second", 3)], "sha256 string, mime string, ordinal int")
    assert sorted(map(tuple, merge.save_blobs(blobs_, new).collect())) == [("d1", "image/png"), ("d2", "first")]
    hid = merge.hide_articles(spark.createDataFrame([(1, "", "", "", T0), (2, "", "", "", None)], ART), spark.createDataFrame([(1,), (2,)], "id long"), at(9))
    assert {r.id: (r.changed, r.hidden_at) for r in hid.collect()} == {1: (False, datetime.datetime(2024, 1, 1)), 2: (True, datetime.datetime(2024, 1, 1, 0, 0, 9))}


def test_image_states(spark, images, articles):
    b = spark.createDataFrame([("d1", T0)], "sha256 string, withheld_at timestamp")
    states = {(r.article_id, r.position): r.state for r in documents.image_map(images, b, articles).collect()}
    assert states[(1, 1)] == "withheld" and states[(1, 2)] == "waiting" and states[(2, 0)] == "exhausted" and states[(2, 1)] == "dead"
    counts = {r.article_id: (r.ok, r.dead, r.waiting, r.exhausted) for r in documents.image_status_counts(images, b, articles).collect()}
    assert counts[1] == (0, 0, 2, 0) and counts[2] == (0, 1, 1, 1)
    st = spark.createDataFrame([(1, 0, "u0", "d0", "ok"), (1, 1, "u1", "d0", "ok"), (1, 2, "u2", "d2", "ok"), (1, 3, "u3", "d2", "ok"), (1, 4, "u4", "d4", "dead")], "article_id long, position long, source_url string, sha256 string, state string")
    left = documents.gallery_leftovers(st, spark.createDataFrame([(1, "u0")], "article_id long, source_url string")).collect()
    assert [tuple(r) for r in left] == [(1, 2, "d2")]


PAGE = """<html><head><title>Title published by Jo on day 6,822 of x</title><meta name="description" content="abc. 2 comments. x"></head><body>
<div class="postContent"><h2><a href="/x"> Big  title </a></h2><meta itemprop="datePublished" content="Jul 21 2026 05:53:10 GMT"><a href="/en/main/news/latest/all/South-Korea/1">c</a>
<div class="postBody"><p>First.<br data-x="a>b">Second <b>bold</b></p><br><br><p>Third</p><img><img src="//h/1.png"><img src="http://h/2.png"><bread>x</bread></div></div>
<div class="commentWrapper" id="comment7"><div style="padding-left: 60px"><a href="/en/citizen/profile/42" title="Jo">p</a><div class="details"><span>Day 6,819, 21:34</span><p><!-- c -->
 hello </p></div></div></div><div class="commentWrapper" id="odd"></div><div class="commentWrapper" id="comment9"><div class="details"><p>[removed]</p></div></div></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>no article</p>"), (3, None), (4, PAGE.replace("Jul 21", "Zzz 99"))], "page_id long, html string")
    out = {r.page_id: r.article for r in extract.extract_articles(df).collect()}
    a = out[1]
    assert out[2] is None and out[3] is None and out[4] is None
    assert (a.title, a.country, a.author_name, a.author_id, a.e_day, a.comment_count) == ("Big  title", "South Korea", "Jo", 42, 6822, 2)
    assert a.body == "First.\nSecond bold\n\nThird\nx" and [tuple(i) for i in a.images] == [(0, "//h/1.png"), (1, "http://h/2.png")]
    assert [(c.id, c.position, c.depth, c.author_id, c.body) for c in a.comments] == [(7, 0, 2, 42, "hello"), (9, 2, 0, None, None)]
    assert a.comments[0].posted_at == datetime.datetime(2026, 7, 23, 4, 34) and a.comments[1].body_raw is None
    assert extract.extract_comments(df.where("page_id = 1")).count() == 2


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>First.</p><p>Second.</p>", "First.\nSecond."), ('one<br data-x="a>b">c &amp; d', "one\nc & d"), ("a<bread>b</bread>c", "a b c"), ("a\n  b\t c", "a b c"),
        ("a<br/><BR ><br>b", "a\n\nb"), ("<!-- x > y --><script>var t='</p>';</script>t", "t"), ("&lt;b&gt; &#233;&#x1F600; &nosuch; &#0; AT&T", "<b> \xe9\U0001f600 &nosuch; &#0; AT&T"),
        ("<ul><li>x</li><li>y</li></ul>z", "x\ny\n\nz"), ("", ""), ("<article>in</article>side", "in\tside".replace("\t", " ")),
    ],
)
def test_body_text(spark, html, text):
    df = spark.createDataFrame([(f"<article>{html}</article><p>after</p>",)], "html string")
    assert df.select(extract.extract_body_text(F.col("html"))).first()[0] == text


def test_vectors(spark):
    rows = [(1, [0.6, 0.8], "m"), (2, [float("nan"), 1.0], "m"), (3, [3.0, 4.0], "m"), (4, [1.0], "m"), (5, [1.0, 0.0], "x"), (6, None, "m"), (7, [float("inf"), 0.0], "m")]
    good, bad = vectors.valid_vectors(spark.createDataFrame(rows, "article_id long, embedding array<float>, model string"), "m", 2)
    assert [r.article_id for r in good.collect()] == [1]
    assert {r.article_id: r.reason for r in bad.collect()} == {2: "non-finite", 3: "norm", 4: "length", 5: "model", 6: "missing", 7: "non-finite"}
    import numpy as np

    enc = vectors.hash_encoder(128)([f"t{i}" for i in range(60)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(enc)], "article_id long, embedding array<float>")
    coded = vectors.with_codes(df, 128)
    signs = {r.article_id: r.code for r in coded.collect()}
    flip = lambda a, b: sum((x ^ y & 0xFFFFFFFFFFFFFFFF).bit_count() if False else ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, y in zip(signs[a], signs[b], strict=True))
    assert flip(3, 9) == int(((enc[3] > 0) != (enc[9] > 0)).sum())
    found = vectors.search_two_stage(coded, enc[7].tolist(), candidates=20, limit=3).collect()
    assert found[0].article_id == 7 and found[0].score == pytest.approx(1)
    near = vectors.knn_join(df.select(F.col("article_id").alias("query_id"), "embedding"), df.select(F.col("article_id").alias("id"), "embedding"), 3, query_block=7, exclude_self=True).collect()
    sims = enc.astype(float) @ enc.T.astype(float) - 9 * np.eye(60)
    assert {(r.query_id, r.rank): r.id for r in near if r["rank"] == 1} == {(i, 1): int(sims[i].argmax()) for i in range(60)}
    assert VF.norm is not None


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(bytearray(b"a"), 1), (bytearray(b"a"), 2), (bytearray(b"b"), 3)], "content binary, n int")
    path = str(tmp_path / "blobs")
    assert archive.sink_blob_store(df, path).count() == 2
    assert archive.sink_blob_store(df.unionByName(spark.createDataFrame([(bytearray(b"c"), 4)], df.schema)), path).count() == 1
    assert spark.read.parquet(path).count() == 3
    snap = archive.Snapshots(spark, str(tmp_path / "snap"))
    assert snap.read() is None and snap.save(spark.range(3), 0) and not snap.save(spark.range(9), 0) and snap.save(spark.range(4), 1)
    assert snap.read().count() == 4
    other = archive.Snapshots(spark, str(tmp_path / "snap"))
    other.read()
    assert snap.save(spark.range(5), 0, "a later stream")
    with pytest.raises(RuntimeError):
        other.save(spark.range(6), 5)
    assert snap.read().count() == 5
    feed = "<rss><link>http://x/en/article/channel-9</link><item><link>http://x/en/article/slug-2797019/1/20</link></item><item><link>http://x/en/article/2797018 </link></item></rss>"
    got = archive.src_feed(spark.createDataFrame([(1, feed)], "page int, xml string")).collect()
    assert [(r.pos, r.article_id) for r in got] == [(0, 2797019), (1, 2797018)]


def test_repeated_changes_pick_the_same_row(spark):
    vec = spark.createDataFrame([(1, [1.0], "m", T0)], "article_id long, embedding array<float>, model string, updated_at timestamp")
    for rows in ([(1, [2.0]), (1, [3.0])], [(1, [3.0]), (1, [2.0])]):
        assert merge.save_vectors(vec, spark.createDataFrame(rows, "article_id long, embedding array<float>"), "n", T0).first().embedding == [3.0]
    late = spark.createDataFrame([(1, [9.0], 1), (1, [2.0], 2)], "article_id long, embedding array<float>, ordinal int")
    assert merge.save_vectors(vec, late, "n", T0).first().embedding == [2.0]
    img = spark.createDataFrame([(1, "u", "pending", None, 0, T0)], "article_id long, source_url string, status string, sha256 string, attempts int, checked_at timestamp")
    for rows in ([(1, "u", "ok", "d"), (1, "u", "error", None)], [(1, "u", "error", None), (1, "u", "ok", "d")]):
        got = merge.record_image_result(img, spark.createDataFrame(rows, "article_id long, source_url string, status string, sha256 string"), T0).first()
        assert (got.status, got.attempts) == ("ok", 1)


def test_appended_columns_replace_their_namesakes(spark):
    from pyspark.sql import types as T

    from tidemark.sources.arrow import append_columns

    df = spark.createDataFrame([("a", 1, 5.0), (None, 2, 6.0)], "t string, n int, `odd.name` double")
    out = append_columns(df, ["t"], [T.StructField("n", T.LongType())], lambda ts: [[len(t or "") for t in ts]])
    assert out.columns == ["t", "odd.name", "n"] and sorted(map(tuple, out.select("n").collect())) == [(0,), (1,)]


@pytest.mark.parametrize(("n", "k", "bits"), [(80, 12, 8), (60, 90, 4), (1, 3, 4)])
def test_code_index_finds_what_a_full_scan_finds(spark, tmp_path, n, k, bits):
    rng = np.random.default_rng(n)
    words = rng.integers(-(2**63), 2**63 - 1, (n, 1), dtype=np.int64)
    words[n // 3 : 2 * n // 3] = words[: 2 * n // 3 - n // 3] ^ (1 << rng.integers(0, 63, (2 * n // 3 - n // 3, 1)))  # near copies
    words[2 * n // 3 :] = words[0]  # a hot code
    coded = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(words)], "article_id long, code array<bigint>")
    index = vectors.code_index(coded, str(tmp_path / "index"), bits)
    asked = coded.where("article_id % 20 = 0").withColumnRenamed("article_id", "query_id")
    got = {(r.query_id, r.article_id, r.distance) for r in vectors.nearest_codes(index, asked, k, bits).collect()}
    far = lambda a, b: sum(int(x ^ y & (1 << 64) - 1).bit_count() for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True))
    want = {(q, i, d) for q in range(0, n, 20) for d, i in sorted((far(words[q], words[i]), i) for i in range(n))[:k]}
    assert got == want


def test_code_index_reads_few_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    coded = spark.createDataFrame([(i, [int(w)]) for i, w in enumerate(rng.integers(-(2**63), 2**63 - 1, 500))], "article_id long, code array<bigint>")
    index = vectors.code_index(coded, str(tmp_path / "index"), 4)
    asked = coded.where("article_id = 7").withColumnRenamed("article_id", "query_id")
    names = {f for f in (r.f for r in index.where("value IN (1, 2)").select(F.input_file_name().alias("f")).distinct().collect())}
    assert len(names) <= 32 < index.select(F.input_file_name()).distinct().count()
    assert vectors.nearest_codes(index, asked, 1, 4).first().article_id == 7


def test_knn_join_in_blocks_equals_one_matrix(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(150)], "id long, embedding array<double>").unionByName(
        spark.createDataFrame([(900 + i, [1.0] * 8) for i in range(40)], "id long, embedding array<double>")
    )
    asked = df.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    one, dealt = (vectors.knn_join(asked, df, 7, exclude_self=True, **how).select("query_id", "id", "rank") for how in ({}, {"query_block": 16, "query_bytes": 0}))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, dealt.collect()))
    assert one.count() == 7 * asked.count()
    assert vectors.knn_join(asked.limit(0), df, 7).count() == 0


def test_named_entities(spark):
    page = "<article><p>caf&eacute; &Ntilde;and&uacute; &szlig; &frac12; &amp;lt; &nosuchname; &apos;</p></article>"
    got = spark.createDataFrame([(page,)], "html string").select(extract.extract_body_text(F.col("html")).alias("t")).first().t
    assert got == "café Ñandú ß ½ &lt; &nosuchname; '"
