"""The fetch ledger and what is read off it: retries, unseen ids, runs of failures.

Events: article_id, seq, ts, outcome (ok, missing, error, stale), error. Ledger: article_id, status, attempts, last_error, updated_at.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.triage import MAX_ATTEMPTS, retry_gate


def fold_outcomes(events: DataFrame) -> DataFrame:
    """Events of any stretch of time as one step an article: the ledger's columns and `reset`, whether there was a `stale` event in it
    (`attempts` then counts from the last one on, else all). Steps compose: see `apply_fold`.

    Two aggregations, of the last reset and of the events after it, both pre-aggregated on the way: no window over a busy article's
    whole history. The join between them is on the same key.
    """
    order = F.struct("ts", "seq")
    resets = F.max(F.when(F.col("outcome") == "stale", order))
    marks = events.groupBy("article_id").agg(resets.alias("reset_at"))
    counted = events.join(marks, "article_id").withColumn("after", F.col("reset_at").isNull() | (order > F.col("reset_at")))
    return counted.groupBy("article_id").agg(
        F.max_by("outcome", order).alias("status"),
        F.count_if("after").alias("attempts"),
        F.max_by("error", order).alias("last_error"),
        F.max("ts").alias("updated_at"),
        F.bool_or(F.col("reset_at").isNotNull()).alias("reset"),
    )


def fetch_ledger(events: DataFrame) -> DataFrame:
    """One row per article: attempts since the last reset (a `stale` event), the latest status, error and time."""
    return fold_outcomes(events).drop("reset")


def apply_fold(ledger: DataFrame, step: DataFrame) -> DataFrame:
    """The ledger rows of the articles in `step` (from `fold_outcomes`) after it; articles without a row begin at no attempts."""
    before = ledger.select("article_id", F.col("attempts").alias("before"))
    carried = F.when(F.col("reset"), F.lit(0).cast("bigint")).otherwise(F.coalesce("before", F.lit(0).cast("bigint")))
    return step.join(before, "article_id", "left").select("article_id", "status", (F.col("attempts") + carried).alias("attempts"), "last_error", "updated_at")


def mark_stale(ledger: DataFrame, selection: DataFrame) -> DataFrame:
    """Rows of the selection that are ok or error become stale with no attempts; others are untouched. `changed` tells which."""
    picked = selection.select("article_id").distinct().withColumn("__hit", F.lit(True))
    hit = F.col("__hit").isNotNull() & F.col("status").isin("ok", "error")
    return (
        ledger.join(picked, "article_id", "left")
        .withColumn("changed", hit)
        .withColumn("attempts", F.when(F.col("changed"), 0).otherwise(F.col("attempts")))
        .withColumn("status", F.when(F.col("changed"), "stale").otherwise(F.col("status")))
        .select(*ledger.columns, "changed")
    )


def claim_retryable(ledger: DataFrame, limit: int, as_of: datetime.datetime, cooldown_sec: float) -> DataFrame:
    return ledger.where(retry_gate(as_of, cooldown_sec)).orderBy(F.desc("article_id")).limit(limit)


def filter_unseen(ids: DataFrame, ledger: DataFrame, retry_errors: bool = False, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Ids (article_id, pos) without a ledger row. With `retry_errors`, an error under the ceiling does not count as seen."""
    seen = ledger
    if retry_errors:
        seen = ledger.where(~((F.col("status") == "error") & (F.col("attempts") < max_attempts)))
    return ids.join(seen.select("article_id"), "article_id", "left_anti")


def walk_batch(spark: SparkSession, ledger: DataFrame, cursor: int, limit: int, floor: int = 1, retry_errors: bool = False) -> DataFrame:
    """The next `limit` unseen ids downward from the cursor, and the cursor that follows them."""
    ids = spark.range(floor, cursor + 1).select(F.col("id").alias("article_id"))
    batch = filter_unseen(ids, ledger, retry_errors).orderBy(F.desc("article_id")).limit(limit)
    return batch.withColumn("next_cursor", F.min("article_id").over(W.partitionBy(F.lit(1))) - 1)


def failure_runs(events: DataFrame) -> DataFrame:
    """events (key, ts, seq, failed) with `run`: consecutive failures up to each event; a success gives 0."""
    order = W.partitionBy("key").orderBy("ts", "seq")
    islands = events.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order))
    within = W.partitionBy("key", "island").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    return islands.withColumn("run", F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(within).cast("bigint")).drop("island")


def coverage_gaps(present: DataFrame, ledger: DataFrame, low: int, high: int) -> DataFrame:
    """Absent ids of [low, high] as contiguous islands: first_id, last_id, n, deleted, kind.

    A block is a fixable gap; a single id that the ledger logs as missing was deleted upstream. Gaps are
    read between neighbours of what is present, so only one sort of the present ids is needed.
    """
    spark = present.sparkSession
    ids = present.select(F.col("id").cast("bigint").alias("id")).where(F.col("id").between(low, high)).distinct()
    edges = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("bigint") for x in (low - 1, high + 1)))).alias("id"))
    # Neighbours inside id ranges, then across their edges: no window over the whole table in one task.
    span = 1 << 20
    blocks = ids.unionByName(edges).withColumn("b", F.floor(F.col("id") / span))
    near = W.partitionBy("b").orderBy("id")
    inner = blocks.withColumn("nxt", F.lead("id").over(near)).select("id", "nxt", "b")
    ends = blocks.groupBy("b").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    across = ends.withColumn("nxt", F.lead("lo").over(W.orderBy("b"))).select(F.col("hi").alias("id"), "nxt")
    pairs = inner.where("nxt IS NOT NULL").select("id", "nxt").unionByName(across.where("nxt IS NOT NULL"))
    gaps = pairs.where("nxt - id > 1").select((F.col("id") + 1).alias("first_id"), (F.col("nxt") - 1).alias("last_id"))
    single = ledger.where("status = 'missing'").select(F.col("article_id").alias("first_id"), F.lit(True).alias("logged"))
    n = F.col("last_id") - F.col("first_id") + 1
    deleted = (n == 1) & F.coalesce("logged", F.lit(False))
    return gaps.join(single, "first_id", "left").select("first_id", "last_id", n.alias("n"), F.when(deleted, "deleted").otherwise("gap").alias("kind"))


def stale_progress(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count_if(F.col("status") == "stale").alias("waiting"))


def bodies_without_markup(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("body_raw").isNull()).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def sample_ids(rows: DataFrame, count: int, by: str = "article_id", seed: int = 7) -> DataFrame:
    """A random sample of `count` rows: those whose ids hash lowest. Each task keeps its own lowest and only those meet, the same rows come out
    on every run, and a larger sample holds a smaller one."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(by).cast("string")))
    return rows.orderBy(mark, by).limit(count)


def outcome_distribution(outcomes: DataFrame, count: int | None = None, by: str = "article_id", seed: int = 7) -> DataFrame:
    """Status histogram, over a random sample of `count` rows if asked for (`by` names the rows)."""
    rows = outcomes if count is None else sample_ids(outcomes, count, by, seed)
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
