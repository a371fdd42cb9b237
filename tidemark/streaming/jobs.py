"""Structured Streaming jobs: ingest, feed, ledger, queue and embedding drains.

Sinks are idempotent by batch id, so a batch that runs again after a failure changes nothing more.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.blobs import classify_fetch
from tidemark.operators import merge
from tidemark.operators.extract import Profile, extract_articles
from tidemark.operators.ledger import apply_fold, fold_outcomes
from tidemark.operators.triage import MAX_ATTEMPTS
from tidemark.operators.vectors import claim_embeddings, embed_job, valid_vectors
from tidemark.sources.archive import stream_id
from tidemark.sources.changes import ChangeTable
from tidemark.sources.shared import fresh_path, materialise
from tidemark.streaming.state import Machine, run_stream


def drain(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote."""
    path = fresh_path(spark, name)
    query = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def stream_machine(events: DataFrame, keys: list[str], machine: Machine, delay: str = "1 hour") -> DataFrame:
    return run_stream(events.withWatermark("ts", delay), keys, machine)


def latest(states: DataFrame, keys: list[str]) -> DataFrame:
    """The last output of each key."""
    cols = [c for c in states.columns if c not in keys]
    last = F.max_by(F.struct(*cols), F.struct("ts", "seq"))
    return states.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def stream_feed_dedupe(items: DataFrame, delay: str = "1 day") -> DataFrame:
    """Feed items (article_id, ts) whose id has not been seen within the delay; bounded state, no table. For good: `stream_feed_unseen`."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["article_id"])


def stream_feed_unseen(
    items: DataFrame, seen: ChangeTable, checkpoint: str, ledger: Callable[[], DataFrame] | None = None, max_attempts: int = MAX_ATTEMPTS
) -> StreamingQuery:
    """Feed items (article_id, ts) that were never seen before, however long ago: kept in `seen` (key article_id) as article_id, ts, batch_id.

    A batch reads the buckets of its own ids only and adds what is new, so its cost follows the batch; consumers read the rows of a batch_id. With a
    `ledger`, an id whose last attempt failed, with attempts under the ceiling, is given out again.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        version = seen.version()
        ids = df.where("article_id IS NOT NULL").groupBy("article_id").agg(F.min("ts").alias("ts"))
        known = seen.read(version, only=ids.select("article_id"))
        if known is not None:
            if ledger is not None:
                again = ledger().where((F.col("status") == "error") & (F.col("attempts") < max_attempts))
                known = known.join(again.select("article_id"), "article_id", "left_anti")
            ids = ids.join(known.select("article_id"), "article_id", "left_anti")
        fresh = materialise(ids.withColumn("batch_id", F.lit(batch_id).cast("bigint")), "unseen")
        seen.save(fresh, read_version=version, batch_id=batch_id, writer=f"feed {stream_id(seen.spark, checkpoint)}")
        if seen.changes_since_base() >= COMPACT_AFTER:
            seen.compact()

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ledger(events: DataFrame, table: ChangeTable, checkpoint: str) -> StreamingQuery:
    """Events (article_id, ts, seq, outcome, error) folded into the ledger `table` (key article_id).

    A micro-batch becomes one step an article by built-in aggregation, pre-aggregated before the shuffle, so a busy article is no burden to one task; the step is then
    applied to the rows it concerns. Within a micro-batch events count in (ts, seq) order, micro-batches as they come.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        version = table.version()
        step = materialise(fold_outcomes(df.where("article_id IS NOT NULL")), "ledger-step")
        old = table.read(version, only=step.select("article_id"))
        rows = step.drop("reset") if old is None else apply_fold(old, step)
        table.save(rows, read_version=version, batch_id=batch_id, writer=f"ledger {stream_id(table.spark, checkpoint)}")
        if table.changes_since_base() >= COMPACT_AFTER:
            table.compact()

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The tables that the ingest job keeps, and what names a row in each.
INGEST_KEYS = {"articles": ["id"], "images": ["article_id", "source_url"], "comments": ["id"], "vectors": ["article_id"], "ledger": ["article_id"]}
#: Commits after which a table is compacted.
COMPACT_AFTER = 20


def ingest_tables(spark: SparkSession, root: str, buckets: int = 16) -> dict[str, ChangeTable]:
    return {name: ChangeTable(spark, f"{root}/{name}", keys, buckets) for name, keys in INGEST_KEYS.items()}


def stream_ingest(pages: DataFrame, root: str, checkpoint: str, profile: Profile = Profile(), marker: str = "postBody", buckets: int = 16) -> StreamingQuery:
    """Landed pages -> outcome -> article -> merges; the ledger gets a row for each page whatever becomes of it.

    Each table under `root` is merged when it is read: a batch reads the rows of its own articles only and writes those that it changes, so the
    bytes written follow the batch and not the table. A table is compacted after COMPACT_AFTER changes. A batch that runs again skips
    the tables that it had committed; one that meets another writer's commit fails and runs again.
    """
    spark = pages.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        writer = f"ingest {stream_id(spark, checkpoint)}"
        page_id, seen, newest_first = (_free(df.columns, n) for n in ("article_id", "outcome", "place"))
        # Of pages that repeat in a batch the one fetched last counts, else the greatest: the same one if the batch runs again.
        newest = W.partitionBy("page_id").orderBy(*(F.desc(c) for c in ("fetched_at", "http_status", "html") if c in df.columns))
        once = df.withColumn(newest_first, F.row_number().over(newest)).where(F.col(newest_first) == 1).select("page_id", "http_status", "html", *(c for c in ("url",) if c in df.columns))
        judged = once.withColumn(seen, classify_fetch(F.col("http_status"), F.col("html"), F.lit(None).cast("string"), marker))
        parsed = materialise(extract_articles(judged, profile).withColumnRenamed("page_id", page_id), "ingest-parsed")
        outcome = F.col(seen)
        ok = outcome["status"] == "ok"
        articles = parsed.where(ok & F.col("article").isNotNull()).select(
            F.col(page_id).alias("id"), "article.title", "article.body", "article.body_raw", "article.author_id", "article.author_name", "article.country",
            "article.published_at", "article.e_day", "article.comment_count", F.size("article.comments").alias("n_comments"), "article.images", "article.comments",
            F.lit(None).cast("timestamp").alias("hidden_at"), F.lit(None).cast("string").alias("lang"),
        )
        good, bad = merge.split_rejects(articles)
        rejected = bad.select(F.col("article_id").alias(page_id), F.lit(True).alias("vanished"))
        status = F.when(~ok, outcome["status"]).when(F.col("article").isNull() | F.col("vanished").isNotNull(), "error").otherwise("ok")
        error = F.when(~ok, outcome["error"]).when(F.col("article").isNull(), "unparseable page").when(F.col("vanished").isNotNull(), "comments vanished")
        log = parsed.join(rejected, page_id, "left").select(F.col(page_id).alias("article_id"), status.alias("status"), error.alias("last_error"))
        images = good.select(F.col("id").alias("article_id"), F.inline("images")).select(
            "article_id", "position", "source_url", F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
            F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("timestamp").alias("checked_at"),
        )
        said = good.select(F.col("id").alias("article_id"), F.inline("comments")).withColumn("ordinal", F.struct("article_id", "position"))
        fresh = good.drop("images", "comments")

        tables = ingest_tables(spark, root, buckets)
        versions = {n: t.version() for n, t in tables.items()}
        ids = parsed.select(F.col(page_id).alias("article_id"))
        asked = {"articles": ids.withColumnRenamed("article_id", "id"), "comments": said.select("id")}
        empty = {
            "articles": fresh.limit(0), "images": images.limit(0), "comments": said.drop("ordinal").limit(0),
            "vectors": spark.createDataFrame([], "article_id bigint, embedding array<float>, model string, updated_at timestamp"),
            "ledger": log.withColumn("attempts", F.lit(0)).limit(0),
        }
        old = {n: t.read(versions[n], only=asked.get(n, ids)) for n, t in tables.items()}
        old = {n: empty[n] if rows is None else rows for n, rows in old.items()}
        articles_now = merge.merge_articles(old["articles"], fresh)
        attempts = old["ledger"].select("article_id", F.col("attempts").alias("before"))
        new = {
            "vectors": merge.queue_vectors(merge.invalidate_vectors(old["vectors"], old["articles"], fresh), articles_now),
            "images": merge.merge_images(old["images"], images),
            "comments": merge.merge_comments(old["comments"], said),
            "ledger": log.join(attempts, "article_id", "left").select("article_id", "status", "last_error", (F.coalesce("before", F.lit(0)) + 1).alias("attempts")),
            "articles": articles_now,  # last: the vectors' comparison needs the old bodies if the batch runs again
        }
        for name, rows in new.items():
            tables[name].replace(old[name], rows, read_version=versions[name], batch_id=batch_id, writer=writer)
        for table in tables.values():
            if table.changes_since_base() >= COMPACT_AFTER:
                table.compact()

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _free(taken: list[str], name: str) -> str:
    """`name`, or the first longer one that no column has."""
    while name in taken:
        name += "_"
    return name


def stream_embed(
    requests: DataFrame,
    articles: Callable[[], DataFrame],
    vectors: ChangeTable,
    make_encoder: Callable,
    model: str,
    dims: int,
    checkpoint: str,
    as_of: datetime.datetime,
    limit: int = 10_000,
) -> StreamingQuery:
    """Each micro-batch of `requests` drains up to `limit` queued vectors; refused ones stay queued."""

    def batch(df: DataFrame, batch_id: int) -> None:
        version = vectors.version()
        queue = vectors.read(version)
        claimed = materialise(claim_embeddings(queue, articles(), limit), "claimed")
        made = embed_job(claimed, make_encoder).withColumn("model", F.lit(model))
        good, _ = valid_vectors(made, model, dims)
        # Only what was claimed can change, so only that is written.
        waiting = queue.join(claimed.select(F.col("id").alias("article_id")), "article_id", "left_semi")
        filled = materialise(merge.save_vectors(waiting, good, model, as_of).where("embedding IS NOT NULL"), "embedded")
        vectors.save(filled, read_version=version, batch_id=batch_id, writer=f"embed {stream_id(vectors.spark, checkpoint)}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


