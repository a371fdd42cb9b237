"""Reading the archive: filters, keyset pages, suggestions and totals.

Articles: id, title, author_name, author_lc (stored, so that predicates push down), country,
published_at, comment_count, hidden_at.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.times import game_date_to_utc

PAGE_SIZE = 50


@dataclass(frozen=True)
class Cursor:
    published_at: datetime.datetime
    article_id: int


def visible_only(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("hidden_at").isNull())


def filter_country(articles: DataFrame, country: str | None) -> DataFrame:
    return articles if country is None else articles.where(F.col("country") == country)


def filter_author(articles: DataFrame, author: str | None) -> DataFrame:
    return articles if author is None else articles.where(F.col("author_lc") == author.lower())


def keyset_predicate(articles: DataFrame, cursor: Cursor | None, descending: bool) -> DataFrame:
    """Rows past the cursor in (published_at, id) order; written out so that Parquet can prune on it."""
    if cursor is None:
        return articles
    ts, i = F.col("published_at"), F.col("id")
    at = F.lit(cursor.published_at)
    if descending:
        return articles.where((ts <= at) & ((ts < at) | (i < cursor.article_id)))
    return articles.where((ts >= at) & ((ts > at) | (i > cursor.article_id)))


def date_jump(day: datetime.date, order: str) -> Cursor | None:
    """Cursor of a game day: its midnight oldest-first, the next day's newest-first (none after the last date)."""
    if order == "old":
        return Cursor(game_date_to_utc(day), 0)
    if day == datetime.date.max:
        return None
    return Cursor(game_date_to_utc(day + datetime.timedelta(days=1)), 0)


def browse_page(
    articles: DataFrame,
    *,
    country: str | None = None,
    author: str | None = None,
    order: str = "new",
    cursor: Cursor | None = None,
    going: str = "next",
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """One page in display order with `place` (1-based) and `has_more`; the extra row only sets has_more."""
    forward = going == "next"
    descending = (order == "new") == forward
    rows = keyset_predicate(filter_author(filter_country(visible_only(articles), country), author), cursor, descending)
    way = F.desc if descending else F.asc
    page = rows.orderBy(way("published_at"), way("id")).limit(limit + 1)
    # At most limit + 1 rows from here on.
    near = W.orderBy(way("published_at"), way("id"))
    whole = W.partitionBy(F.lit(1))
    numbered = page.withColumn("place", F.row_number().over(near)).withColumn("has_more", F.count(F.lit(1)).over(whole) > limit)
    kept = numbered.where(F.col("place") <= limit)
    if not forward:
        kept = kept.withColumn("place", F.count(F.lit(1)).over(whole) + 1 - F.col("place"))
    return kept.withColumn("place", F.col("place").cast("int")).orderBy("place")


def author_prefix_range(articles: DataFrame, prefix: str) -> DataFrame:
    """Rows whose lower-cased author starts with `prefix`; % and _ are ordinary characters.

    Prefixes that no stored name can have (empty, ending in the last code point, lone surrogates) match nothing.
    """
    low = prefix.lower()
    broken = any(0xD800 <= ord(c) <= 0xDFFF for c in low)
    if not low or ord(low[-1]) >= 0x10FFFF or broken:
        return articles.limit(0)
    return articles.where(F.col("author_lc").startswith(low))


def suggest_authors(articles: DataFrame, prefix: str, limit: int = 8) -> DataFrame:
    """The latest spelling of each name under the prefix, first `limit` by name."""
    found = author_prefix_range(visible_only(articles), prefix)
    latest = F.max_by("author_name", F.struct("published_at", "id"))
    return found.groupBy("author_lc").agg(latest.alias("author_name")).orderBy("author_lc").limit(limit)


def distinct_countries(articles: DataFrame) -> DataFrame:
    return visible_only(articles).where(F.col("country").isNotNull()).select("country").distinct().orderBy("country")


def archive_stats(articles: DataFrame, frontier: int | None) -> DataFrame:
    return visible_only(articles).agg(
        F.count(F.lit(1)).alias("articles"), F.min("published_at").alias("oldest"), F.max("published_at").alias("newest")
    ).withColumn("frontier", F.lit(frontier).cast("bigint"))


def missing_reason(requested: DataFrame, ledger: DataFrame, frontier: int) -> DataFrame:
    """Why each requested id is absent: deleted upstream, failed and to be retried, or not reached yet."""
    reason = F.when(F.col("status") == "missing", "deleted").when(F.col("status").isin("error", "stale"), "retry").otherwise("uncollected")
    joined = requested.join(ledger.select(F.col("article_id").alias("id"), "status"), "id", "left")
    return joined.select("id", reason.alias("reason"), F.when(reason == "uncollected", F.lit(frontier)).cast("bigint").alias("frontier"))
