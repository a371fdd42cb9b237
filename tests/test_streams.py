"""State machines over clock-driven sequences; batch and stream agree."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.extract import PLAIN
from tidemark.operators.vectors import hash_encoder
from tidemark.sources.archive import src_pages
from tidemark.streaming import jobs, state

T0 = datetime.datetime(2024, 1, 1)


def frame(spark, rows, column, kind):
    return spark.createDataFrame([("k", T0 + datetime.timedelta(seconds=s), i, v) for i, (s, v) in enumerate(rows)], f"key string, ts timestamp, seq long, {column} {kind}")


def outputs(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("seq").collect()]


def test_circuit(spark):
    rows = [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (6, False), (904, True), (905.5, True), (906, True), (907, True)]
    out = state.run_batch(frame(spark, rows, "failed", "boolean"), ["key"], state.host_circuit(3, 900))
    assert outputs(out, "failures", "open") == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True), (0, True), (1, True), (1, False), (2, False), (3, True)]


def test_watchdog(spark):
    four = [(i, "failure") for i in range(4)]
    calm = state.run_batch(frame(spark, [*four, (4, "ok"), *[(5 + i, "failure") for i in range(4)]], "outcome", "string"), ["key"], state.watchdog())
    assert not any(r.alarm for r in calm.collect())
    loud = state.run_batch(frame(spark, [*four, (4, "failure"), (5, "ok"), (6, "breach")], "outcome", "string"), ["key"], state.watchdog())
    assert outputs(loud, "alarm") == [(False,)] * 4 + [(True,), (False,), (True,)]


def test_throttle(spark):
    rows = [(0, False), (1, True), (50, True), (100.5, True), (101, True), (150, True)]
    out = state.run_batch(frame(spark, rows, "delivered", "boolean"), ["key"], state.throttle(100))
    assert outputs(out, "sent") == [(True,), (True,), (False,), (False,), (True,), (False,)]


def test_image_queue(spark):
    rows = [(0, "error"), (1, "dead"), (2, "requeue"), (3, "kill"), (4, "ok"), (5, "requeue"), (6, "kill")]
    out = state.run_batch(frame(spark, rows, "event", "string"), ["key"], state.image_queue())
    assert outputs(out, "status", "attempts") == [("error", 1), ("dead", 2), ("pending", 0), ("dead", 0), ("ok", 1), ("ok", 1), ("ok", 1)]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    ev = spark.range(300).select(
        (F.col("id") % 7).alias("article_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").alias("seq"),
        F.element_at(F.array(*map(F.lit, ("ok", "error", "stale", "missing", "error"))), (F.col("id") * 13 % 5 + 1).cast("int")).alias("outcome"),
    )
    path = str(tmp_path / "ev")
    for i in range(files):
        ev.where(F.floor(F.col("seq") / (300 / files)) == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.drain(spark, jobs.stream_machine(stream, ["article_id"], state.ledger(), "10 days"), "t")
    want = state.run_batch(ev, ["article_id"], state.ledger())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_ingest_and_embed(spark, tmp_path):
    page = "<html><body><article><h1>{0}</h1><p>{1}</p><img src='http://h/{0}.png'></article></body></html>"
    schema = "page_id long, url string, http_status int, html string"
    src, root = str(tmp_path / "pages"), str(tmp_path / "root")
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([(1, "u", 200, page.format("a", "body")), (2, "u", 404, ""), (3, "u", 200, "Just a moment"), (4, "u", 200, "<article")])
    run = lambda: jobs.stream_ingest(src_pages(spark, src, True), root, str(tmp_path / "cp"), PLAIN, "<article").awaitTermination()
    run()
    tables = jobs.ingest_tables(spark, root)
    read = lambda n: tables[n].read()
    assert {r.article_id: r.status for r in read("ledger").collect()} == {1: "ok", 2: "missing", 3: "error", 4: "error"}
    vecs = tables["vectors"]
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    q = jobs.stream_embed(ticks, lambda: read("articles"), vecs, lambda: hash_encoder(8), "m", 8, str(tmp_path / "cpe"), T0)
    q.awaitTermination(60)
    q.stop()
    assert vecs.read().first().model == "m"
    put([(1, "u", 200, page.format("a", "another body")), (5, "u", 200, page.format("e", "five"))])
    run()
    arts = {r.id: (r.title, r.body) for r in read("articles").collect()}
    assert arts[1] == ("a", "a\nanother body") and set(arts) == {1, 5}
    assert {r.article_id: r.attempts for r in read("ledger").collect()}[1] == 2
    assert {(r.article_id, r.source_url, r.status) for r in read("images").collect()} == {(1, "http://h/a.png", "pending"), (5, "http://h/e.png", "pending")}


def _fed(spark, tmp_path, batches, column, kind):
    """A stream that reads one micro-batch for each list of (key, seconds, value)."""
    path, schema = str(tmp_path / "fed"), f"host string, ts timestamp, seq long, {column} {kind}"
    n = 0
    for rows in batches:
        put = [(k, T0 + datetime.timedelta(seconds=s), n + i, v) for i, (k, s, v) in enumerate(rows)]
        n += len(put)
        spark.createDataFrame(put, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)  # files are read by age
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_an_opening_ends_by_its_timer(spark, tmp_path):
    """Nothing more is heard of host a; another host's events move the time on."""
    feed = _fed(spark, tmp_path, [[("a", 0, True), ("a", 1, True), ("b", 2, False)], [("b", 500, False)], [("b", 5000, False)], [("b", 9000, False)]], "failed", "boolean")
    out = jobs.drain(spark, jobs.stream_machine(feed, ["host"], state.host_circuit(2, 900), "10 seconds"), "timer").where("host = 'a'").orderBy("ts")
    rows = [(r.seq is None, r.failures, r.open) for r in out.collect()]
    assert rows == [(False, 1, False), (False, 2, True), (True, 0, False)]
    assert out.collect()[-1].ts == T0 + datetime.timedelta(seconds=901, milliseconds=1)


def test_a_new_failure_puts_the_timer_off(spark, tmp_path):
    feed = _fed(spark, tmp_path, [[("a", 0, True), ("a", 1, True)], [("a", 800, True), ("b", 1000, False)], [("b", 1500, False)], [("b", 9000, False)]], "failed", "boolean")
    out = jobs.drain(spark, jobs.stream_machine(feed, ["host"], state.host_circuit(2, 900), "10 seconds"), "timer").where("host = 'a' AND seq IS NULL").collect()
    assert [r.ts for r in out] == [T0 + datetime.timedelta(seconds=1700, milliseconds=1)]


def test_lapsed_states_are_not_kept(spark, tmp_path):
    """Every micro-batch brings ten new keys; the rows in the state store stay level."""
    feed = _fed(spark, tmp_path, [[(f"k{b}-{i}", b * 100 + i, True) for i in range(10)] for b in range(10)], "delivered", "boolean")
    path = str(tmp_path / "out")
    q = jobs.stream_machine(feed, ["host"], state.throttle(60), "5 seconds").writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-cp").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in q.recentProgress if p["numInputRows"]]
    assert len(kept) == 10 and max(kept[5:]) <= max(kept[:5])
    assert spark.read.parquet(path).where("sent").count() == 100
