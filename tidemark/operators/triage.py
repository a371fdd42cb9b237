"""The image queue: gates, claims, hosts and their write-off.

Images: article_id, position, source_url, sha256, status (pending, ok, dead, error), attempts, checked_at.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.blobs import WRITE_OFF
from tidemark.functions.urls import url_host

MAX_ATTEMPTS = 5


def dedupe_images(images: DataFrame) -> DataFrame:
    """One row per (article, URL): a captured one first, then the lowest position."""
    best = W.partitionBy("article_id", "source_url").orderBy(F.col("sha256").isNull(), "position")
    return images.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def with_host(images: DataFrame) -> DataFrame:
    return images.withColumn("host", url_host(F.col("source_url")))


def retry_gate(as_of: datetime.datetime, cooldown_sec: float, status: str = "status", at: str = "updated_at", retried: tuple[str, ...] = ("error", "stale")) -> Column:
    """Rows that may be tried again: under the attempt ceiling and past the cooldown."""
    before = as_of - datetime.timedelta(seconds=cooldown_sec)
    return F.col(status).isin(*retried) & (F.col("attempts") < MAX_ATTEMPTS) & (F.col(at) <= F.lit(before))


def exclude_hosts(images: DataFrame, hosts: list[str]) -> DataFrame:
    """Rows whose host is not listed. A non-empty list also drops rows without a host; an empty one keeps them."""
    return images.where(~F.col("host").isin(*hosts)) if hosts else images


def claim_images(images: DataFrame, limit: int, as_of: datetime.datetime, cooldown_sec: float, excluded: list[str] = ()) -> DataFrame:
    """The next `limit` rows to fetch, newest article first; pending rows never wait."""
    open_ = (F.col("status") == "pending") | retry_gate(as_of, cooldown_sec, at="checked_at", retried=("error",))
    return exclude_hosts(with_host(images).where(open_), list(excluded)).orderBy(F.desc("article_id"), "position").limit(limit)


def interleave_by_host(claimed: DataFrame) -> DataFrame:
    """Round-robin over hosts in first-seen order, each host's own order kept. Input: host and `pos` of a claimed batch."""
    own = W.partitionBy("host")
    rounds = claimed.withColumn("round", F.row_number().over(own.orderBy("pos"))).withColumn("first", F.min("pos").over(own))
    return rounds.orderBy("round", "first")


def sample_url_per_host(images: DataFrame) -> DataFrame:
    """The next queued URL of each host in drain order."""
    queued = with_host(images).where(F.col("status").isin("pending", "error"))
    first = F.min_by("source_url", F.struct(-F.col("article_id"), F.col("position")))
    return queued.groupBy("host").agg(first.alias("sample_url"))


def host_backlog(images: DataFrame, min_rows: int = 1) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "error", "ok", "dead")]
    depth = F.col("pending") + F.col("error")
    return with_host(images).groupBy("host").agg(*counts).where(depth >= min_rows).orderBy(depth.desc(), "host")


def stuck_hosts(images: DataFrame, limit: int) -> DataFrame:
    """Hosts with most dead and failed rows."""
    stuck = with_host(images).where(F.col("status").isin("dead", "error"))
    return stuck.groupBy("host").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "host").limit(limit)


def join_verdicts(backlog: DataFrame, probes: DataFrame) -> DataFrame:
    return backlog.join(probes.select("host", "verdict"), "host", "left")


def writeoff_candidates(backlog: DataFrame, probes: DataFrame) -> DataFrame:
    """Hosts without a single capture whose probe says that nothing is there."""
    return join_verdicts(backlog, probes).where((F.col("ok") == 0) & F.col("verdict").isin(*WRITE_OFF))


def writeoff_report(backlog: DataFrame, probes: DataFrame) -> DataFrame:
    return writeoff_candidates(backlog, probes).agg(
        F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum(F.col("pending") + F.col("error")), F.lit(0)).cast("bigint").alias("rows")
    )


def requeue_hosts(images: DataFrame, hosts: DataFrame) -> DataFrame:
    """Dead and failed rows of exactly these hosts go back to pending with no attempts."""
    picked = hosts.select("host").distinct().withColumn("__hit", F.lit(True))
    rows = with_host(images).join(picked, "host", "left")
    hit = F.col("__hit").isNotNull() & F.col("status").isin("dead", "error")
    return rows.withColumn("attempts", F.when(hit, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).select(*images.columns)


def kill_hosts(images: DataFrame, hosts: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(images with the queued rows of these hosts dead, attempts kept; refused hosts with their ok count).

    A host with any capture is refused unless forced.
    """
    named = with_host(images)
    picked = hosts.select("host").distinct()
    captured = named.where("status = 'ok'").join(picked, "host", "left_semi").groupBy("host").agg(F.count(F.lit(1)).alias("ok"))
    allowed = picked if force else picked.join(captured, "host", "left_anti")
    rows = named.join(allowed.withColumn("__hit", F.lit(True)), "host", "left")
    dead = F.col("__hit").isNotNull() & F.col("status").isin("pending", "error")
    refused = captured.where(F.lit(not force))
    return rows.withColumn("status", F.when(dead, "dead").otherwise(F.col("status"))).select(*images.columns), refused
