"""Feeds as XML, ids never seen before, folded ledgers, mergeable length sketches, and what a failing encoder leaves."""

import datetime
import time

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import audit, ledger, merge
from tidemark.operators.vectors import embed_job, ngram_encoder, valid_vectors
from tidemark.sources import archive
from tidemark.sources.changes import ChangeTable
from tidemark.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
ITEM = "<item><link>http://x/en/article/t-{}</link></item>"


def feeds(spark, *xml):
    return spark.createDataFrame(list(enumerate(xml)), "n int, xml string")


def test_feeds(spark):
    df = feeds(
        spark,
        f"\n<?xml version='1.0'?><rss xmlns:a='u'><channel><link>http://x/en/article/c-1</link><a:link href='q'/>{ITEM.format(2)}<!-- {ITEM.format(3)} --><item><a:link>http://x/en/article/4</a:link></item></channel></rss>",
        "<rss><channel><item><link><![CDATA[http://x/en/article/a-5/1/20?a=1&b=2]]></link></item><item><link> http://x/en/article/6?a=1&amp;b=2 </link></item></channel></rss>",
        f"<rss><channel>{ITEM.format(7)}{ITEM.format(8)}<item><link>http://x/en/art",
        "",
        None,
        "<rss><channel><link>http://x/en/article/c-9</link></channel></rss>",
        f"<rss><channel>{ITEM.format(10)}</channel></rss>",
        "<rss><channel><item><title>none</title></item><item><link/></item><item><link>http://x/en/article/99999999999999999999</link></item></channel></rss>",
        "Bad gateway",
    )
    got = sorted((r.n, r.pos, r.article_id) for r in archive.src_feed(df).collect() if r.article_id is not None)
    assert got == [(0, 0, 2), (1, 0, 5), (1, 1, 6), (2, 0, 7), (2, 1, 8), (6, 0, 10)]
    assert {r.n: r.reason for r in archive.feed_rejects(df).collect()} == {2: "malformed", 3: "empty", 4: "missing", 8: "malformed"}
    clash = df.withColumn("feed", F.lit("f")).withColumn("reason", F.lit("r"))
    assert archive.src_feed(clash).columns == ["n", "feed", "reason", "pos", "article_id"] and archive.feed_rejects(clash).count() == 4
    assert archive.src_feed(df.limit(0)).count() == 0


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.01)


def test_an_old_id_stays_out(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "article_id long, ts timestamp"
    day = lambda n: T0 + datetime.timedelta(days=n)
    seen = ChangeTable(spark, str(tmp_path / "seen"), ["article_id"], 4)
    log = spark.createDataFrame([(1, "error", 2), (2, "error", 5), (3, "ok", 1)], "article_id long, status string, attempts int")

    def run(**kw):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        jobs.stream_feed_unseen(stream, seen, str(tmp_path / "cp"), **kw).awaitTermination()
        return sorted((r.article_id, r.ts, r.batch_id) for r in seen.read().collect())

    put(spark, src, [(1, day(0)), (1, day(0)), (2, day(0)), (None, day(0))], schema)
    put(spark, src, [(3, day(1)), (2, day(1))], schema)
    assert run() == [(1, day(0), 0), (2, day(0), 0), (3, day(1), 1)]
    put(spark, src, [(1, day(40)), (3, day(40)), (4, day(40))], schema)
    assert run() == [(1, day(0), 0), (2, day(0), 0), (3, day(1), 1), (4, day(40), 2)]
    put(spark, src, [(1, day(50)), (2, day(50)), (3, day(50))], schema)
    assert [r[0] for r in run(ledger=lambda: log) if r[2] == 3] == [1]  # failed and under the ceiling


def test_folded_ledger_equals_the_whole(spark, tmp_path):
    """A third of all events are one article's; the steps of three micro-batches compose to the ledger of all events."""
    ev = spark.range(600).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("bigint").alias("article_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"),
        F.element_at(F.array(*map(F.lit, ("ok", "error", "stale", "missing", "error", "ok", "ok"))), (F.col("id") * 13 % 7 + 1).cast("int")).alias("outcome"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("e"), F.col("id"))).alias("error"),
    ).where("NOT (article_id = 5 AND outcome = 'stale')")
    src = str(tmp_path / "ev")
    for i in range(3):
        ev.where(F.floor(F.col("seq") / 200) == i).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.01)
    table = ChangeTable(spark, str(tmp_path / "ledger"), ["article_id"], 4)
    jobs.stream_ledger(spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src), table, str(tmp_path / "cp")).awaitTermination()
    assert table.version() == 3
    want = ledger.fetch_ledger(ev)
    assert sorted(map(tuple, table.read().select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stored_length_sketches_merge(spark):
    rng = np.random.default_rng(5)
    n = np.minimum(rng.lognormal(5, 1, 20_000).astype(int), 4000)
    rows = spark.createDataFrame([(int(i % 40), int(x)) for i, x in enumerate(n)], "day int, n int").withColumn("body", F.repeat(F.lit("x"), F.col("n")))
    rows = rows.unionByName(rows.limit(50).withColumns({"body": F.lit(None).cast("string"), "day": F.lit(99)}))
    got = audit.profile_of_sketches(audit.length_sketches(rows, ["day"])).first()
    assert (round(got.mean, 6), got.longest) == (round(n.mean(), 6), n.max())
    for q, value in ((0.5, got.p50), (0.9, got.p90), (0.99, got.p99)):
        assert (n < value).mean() - 0.005 <= q <= (n <= value).mean() + 0.005
    assert audit.length_profile(rows).first().longest == n.max()
    assert tuple(audit.length_profile(rows.limit(0)).first()) == (None,) * 5
    assert tuple(audit.length_profile(rows.where("day = 99")).first()) == (None,) * 5


def test_samples_nest_and_repeat(spark):
    rows = spark.range(1000).select(F.col("id").alias("article_id"), F.lit("ok").alias("status"))
    ids = lambda n, seed=7: {r.article_id for r in ledger.sample_ids(rows.repartition(5), n, seed=seed).collect()}
    assert ids(50) == ids(50) < ids(200) and ids(50) != ids(50, 8)
    assert ledger.outcome_distribution(rows, 10).first().n == 10 and ledger.outcome_distribution(rows).first().n == 1000


def test_ngram_vectors():
    encode = ngram_encoder(64)
    a, b, c, short, empty = encode(["the harbour lights were out all night", "the harbour lights were out all day", "quite another matter, said she", "a", ""])
    assert a @ b > 0.7 > 0.4 > abs(a @ c)
    for v in (a, b, c, short, empty):
        assert abs(np.linalg.norm(v) - 1) < 1e-6
    text = "a\U0001f600bé"
    want = np.zeros(64)
    for i in range(len(text) - 2):
        h = (ord(text[i]) * 1_000_003 + ord(text[i + 1]) * 998_244_353 + ord(text[i + 2]) * 1_000_000_007) % (2**31 - 1)
        want[h % 64] += -1 if h // 64 % 2 else 1
    assert np.allclose(encode([text])[0], want / np.linalg.norm(want))


def test_a_failed_batch_stays_queued(spark):
    def moody():
        inner = ngram_encoder(8)

        def encode(texts):
            if any("down" in t for t in texts):
                raise TimeoutError("no answer")
            return inner(texts)

        return encode

    queue = spark.createDataFrame([(i, None, None, T0) for i in range(6)], "article_id long, embedding array<float>, model string, updated_at timestamp")
    arts = spark.createDataFrame([(i, f"t{i}", "down" if i == 3 else "up") for i in range(6)], "id long, title string, body string").coalesce(1)
    made = embed_job(arts, moody, batch=2).withColumn("model", F.lit("m"))
    good, bad = valid_vectors(made, "m", 8)
    saved = merge.save_vectors(queue, good, "m", T0)
    assert sorted(r.article_id for r in saved.where("embedding IS NULL").collect()) == [2, 3]
    assert {(r.article_id, r.reason, r.error) for r in bad.collect()} == {(2, "missing", "TimeoutError: no answer"), (3, "missing", "TimeoutError: no answer")}
