"""Browsing, audits and snapshot merges."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import audit, browse, ledger, merge
from tidemark.plans import standins as S
from tidemark.plans.registry import query
from tidemark.sources.shared import materialise

UTC = datetime.UTC
AT = datetime.datetime(1998, 6, 1, tzinfo=UTC)
AS_OF = datetime.datetime(2024, 2, 1, tzinfo=UTC)


@query(f"""SELECT id, country, {S.stamp_sql("published_at")}, CAST(row_number() OVER (ORDER BY published_at DESC, id DESC) AS INT) AS place, n > 50 AS has_more
    FROM (SELECT *, count(*) OVER () AS n FROM (SELECT o_orderkey AS id, o_orderpriority AS country, o_orderdate AS published_at FROM orders
        WHERE o_orderstatus <> 'F' AND o_orderpriority = '2-HIGH' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1998-06-01', 700) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 51))
    ORDER BY published_at DESC, id DESC LIMIT 50""")
def browse_newest_after(spark: SparkSession, sf: str) -> DataFrame:
    page = browse.browse_page(S.orders_only(spark, sf), country="2-HIGH", cursor=browse.Cursor(AT, 700))
    return page.select("id", "country", S.stamp("published_at"), "place", "has_more")


@query(f"""SELECT id, country, {S.stamp_sql("published_at")}, CAST(51 - row_number() OVER (ORDER BY published_at, id) AS INT) AS place, n > 50 AS has_more
    FROM (SELECT *, count(*) OVER () AS n FROM (SELECT o_orderkey AS id, o_orderpriority AS country, o_orderdate AS published_at FROM orders
        WHERE o_orderstatus <> 'F' AND o_orderpriority = '2-HIGH' AND (o_orderdate, o_orderkey) > (TIMESTAMP '1998-06-01', 700) ORDER BY o_orderdate, o_orderkey LIMIT 51))
    ORDER BY published_at, id LIMIT 50""")
def browse_prev_page(spark: SparkSession, sf: str) -> DataFrame:
    page = browse.browse_page(S.orders_only(spark, sf), country="2-HIGH", cursor=browse.Cursor(AT, 700), going="prev")
    return page.select("id", "country", S.stamp("published_at"), "place", "has_more")


@query(f"""WITH {S.ARTICLES_SQL} SELECT id, author_name, {S.stamp_sql("published_at")} FROM articles WHERE hidden_at IS NULL AND author_lc = 'customer#000000005'
    AND (published_at, id) < (TIMESTAMP '1999-01-02 08:00:00', 0) ORDER BY articles.published_at DESC, id DESC LIMIT 50""")
def browse_author_on_day(spark: SparkSession, sf: str) -> DataFrame:
    cursor = browse.date_jump(datetime.date(1999, 1, 1), "new")
    page = browse.browse_page(S.articles(spark, sf), author="Customer#000000005", cursor=cursor)
    return page.select("id", "author_name", S.stamp("published_at"))


@query(f"""WITH {S.ARTICLES_SQL} SELECT id, author_name, {S.stamp_sql("published_at")} FROM articles WHERE hidden_at IS NULL AND author_lc = 'customer#000000005'
    AND (published_at, id) > (TIMESTAMP '1996-01-01 08:00:00', 0) ORDER BY articles.published_at, id LIMIT 50""")
def browse_author_from_day(spark: SparkSession, sf: str) -> DataFrame:
    cursor = browse.date_jump(datetime.date(1996, 1, 1), "old")
    page = browse.browse_page(S.articles(spark, sf), author="CUSTOMER#000000005", order="old", cursor=cursor)
    return page.select("id", "author_name", S.stamp("published_at"))


@query(f"""WITH {S.ARTICLES_SQL} SELECT author_lc, arg_max(author_name, (published_at, id)) AS author_name FROM articles
    WHERE hidden_at IS NULL AND author_lc >= 'customer#0000000' AND author_lc < 'customer#0000001' GROUP BY 1 ORDER BY 1 LIMIT 8""")
def author_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return browse.suggest_authors(S.articles(spark, sf), "CUSTOMER#0000000")


@query("SELECT DISTINCT o_orderpriority AS country FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IS NOT NULL")
def country_list(spark: SparkSession, sf: str) -> DataFrame:
    return browse.distinct_countries(S.orders_only(spark, sf))


@query("""SELECT count(*) AS articles, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS oldest, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS newest,
    CAST(123 AS BIGINT) AS frontier FROM orders WHERE o_orderstatus <> 'F'""")
def archive_stats(spark: SparkSession, sf: str) -> DataFrame:
    return browse.archive_stats(S.orders_only(spark, sf), 123).select("articles", S.stamp("oldest"), S.stamp("newest"), "frontier")


@query("""SELECT o_orderkey AS id, strftime(DATE '2007-11-21' + CAST(o_orderkey % 7000 AS INT), '%Y-%m-%d') AS game_day,
    strftime(timezone('America/Los_Angeles', timezone('UTC', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS local,
    strftime(timezone('UTC', timezone('America/Los_Angeles', o_orderdate)), '%Y-%m-%d %H:%M:%S') AS midnight FROM orders""")
def game_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return S.orders_only(spark, sf).select(
        "id", times.game_day_to_date(F.col("id") % 7000 + 1).cast("string").alias("game_day"),
        F.date_format(times.to_game_time(F.col("published_at")), "yyyy-MM-dd HH:mm:ss").alias("local"),
        F.date_format(times.game_midnight(F.to_date("published_at")), "yyyy-MM-dd HH:mm:ss").alias("midnight"),
    )


@query("""SELECT avg(length(text)) AS mean, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.9) AS p90, round(quantile_cont(length(text), 0.99), 6) AS p99,
    CAST(max(length(text)) AS INT) AS longest FROM documents""")
def length_profile(spark: SparkSession, sf: str) -> DataFrame:
    return audit.length_profile(S.documents(spark, sf), exact=True).withColumn("p99", F.round("p99", 6))


@query("""SELECT source, p.q AS quantile, true AS within, count(*) AS texts, CAST(max(length(text)) AS INT) AS longest FROM documents, (SELECT unnest([50, 90, 99]) AS q) p GROUP BY 1, 2""")
def length_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of each source and day of ids, merged by source. `within`: the sketched quantile's true rank is off by at most 1 % of the rows (or one row)."""
    docs = S.documents(spark, sf).withColumn("day", F.floor(F.col("id") / 100))
    profile = audit.profile_of_sketches(materialise(audit.length_sketches(docs, ["country", "day"]), "length-sketches"), ["country"])
    marks = profile.select(F.col("country").alias("c"), F.posexplode(F.array("p50", "p90", "p99")).alias("at", "value"), "longest")
    ranked = docs.select("country", F.length("body").alias("n")).join(marks, F.col("country").eqNullSafe(F.col("c")))
    counts = ranked.groupBy("country", "at", "longest").agg(F.count("n").alias("texts"), F.count_if(F.col("n") < F.col("value")).alias("below"), F.count_if(F.col("n") <= F.col("value")).alias("upto"))
    aim = F.element_at(F.array(*map(F.lit, audit.QUANTILES)), F.col("at") + 1) * F.col("texts")
    slack = F.greatest(0.01 * F.col("texts"), F.lit(1.0))
    within = (F.col("below") <= aim + slack) & (F.col("upto") >= aim - slack)
    return counts.select(F.col("country").alias("source"), F.element_at(F.array(F.lit(50), F.lit(90), F.lit(99)), F.col("at") + 1).alias("quantile"), within.alias("within"), "texts", "longest")


@query("""SELECT CAST(year(o_orderdate) AS INT) AS year, round(count(*) / count(DISTINCT CAST(o_orderdate AS DATE)), 6) AS per_day, count(*) AS articles FROM orders GROUP BY 1""")
def publication_rate(spark: SparkSession, sf: str) -> DataFrame:
    return audit.publication_rate(S.orders_only(spark, sf)).withColumn("per_day", F.round("per_day", 6))


@query(f"""WITH {S.IMAGES_SQL} SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN 'early' WHEN year(o_orderdate) BETWEEN 1997 AND 2001 THEN 'late' END AS era,
    round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END), 6) AS resolving, count(*) AS urls FROM images JOIN orders ON o_orderkey = article_id GROUP BY 1""")
def survival_by_era(spark: SparkSession, sf: str) -> DataFrame:
    out = audit.survival_by_era(S.images(spark, sf), S.orders_only(spark, sf), [("early", 1995, 1996), ("late", 1997, 2001)])
    return out.withColumn("resolving", F.round("resolving", 6))


@query("""SELECT count(*) AS articles, round(avg(n), 6) AS mean, median(n) AS median, round(avg(chars), 6) AS mean_chars
    FROM (SELECT conv_id, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY 1)""")
def thread_profile(spark: SparkSession, sf: str) -> DataFrame:
    return audit.thread_profile(S.comments(spark, sf)).withColumn("mean", F.round("mean", 6)).withColumn("mean_chars", F.round("mean_chars", 6))


@query("""WITH g AS (SELECT doc_id AS id, doc_id - row_number() OVER (ORDER BY doc_id) AS isle FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
    SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS n, CASE WHEN count(*) = 1 AND min(id) % 2 = 0 THEN 'deleted' ELSE 'gap' END AS kind FROM g GROUP BY isle""")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    top = docs.agg(F.max("id")).first()[0]
    log = docs.where("id % 2 = 0").select(F.col("id").alias("article_id"), F.lit("missing").alias("status"))
    return ledger.coverage_gaps(S.table(spark, sf, "labels").select(F.col("doc_id").alias("id")), log, 0, top)


# Merges: documents as the old snapshot, an edited part of them and some new rows as the change set.


def _change(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    old = S.documents(spark, sf)
    fresh = S.edited(old).withColumn("lang", F.lit("xx")).withColumn("hidden_at", F.lit(None).cast("timestamp"))
    more = fresh.where("id % 30 = 0").withColumn("id", F.col("id") + 10_000_000)
    return old, fresh.unionByName(more)


_CHANGE_SQL = f"""{S.DOCS_SQL}, {S.EDITED_SQL}, change AS (SELECT id, title, body, country FROM edited UNION ALL SELECT id + 10000000, title, body, country FROM edited WHERE id % 30 = 0)"""


@query(f"""WITH {_CHANGE_SQL} SELECT coalesce(o.id, n.id) AS id, md5(CASE WHEN n.id IS NULL THEN o.title ELSE n.title END) AS title, md5(CASE WHEN n.id IS NULL THEN o.body ELSE n.body END) AS body,
    o.lang, CASE WHEN n.id IS NULL THEN o.country ELSE n.country END AS country, o.hidden_at IS NOT NULL AS hidden FROM docs o FULL JOIN change n ON o.id = n.id""")
def merge_articles(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _change(spark, sf)
    once = merge.merge_articles(old, new)
    return merge.merge_articles(once, new).select("id", F.md5("title").alias("title"), F.md5("body").alias("body"), "lang", "country", F.col("hidden_at").isNotNull().alias("hidden"))


@query("""WITH c AS (SELECT conv_id * 100 + turn AS id, conv_id AS article_id, turn AS position, text AS body FROM conversations),
    b AS (SELECT id, position + 1 AS position, body || '?' AS body FROM c WHERE id % 2 = 0)
    SELECT c.id, c.article_id, coalesce(b.position, c.position) AS position, md5(coalesce(b.body, c.body)) AS body FROM c LEFT JOIN b USING (id)""")
def merge_comments(spark: SparkSession, sf: str) -> DataFrame:
    c = S.comments(spark, sf).select((F.col("article_id") * 100 + F.col("position")).alias("id"), "article_id", "position", "body")
    late = c.where("id % 2 = 0").select("id", (F.col("article_id") + 1).alias("article_id"), (F.col("position") + 1).alias("position"), F.concat("body", F.lit("?")).alias("body"), F.lit(2).alias("ordinal"))
    early = late.withColumn("body", F.lit("lost")).withColumn("ordinal", F.lit(1))
    return merge.merge_comments(c, early.unionByName(late)).withColumn("body", F.md5("body"))


@query(f"""WITH {S.IMAGES_SQL}, d AS (SELECT DISTINCT ON (article_id, source_url) * FROM images ORDER BY article_id, source_url, sha256 IS NULL, position),
    b AS (SELECT article_id, source_url || CASE WHEN position % 3 = 0 THEN '?v=2' ELSE '' END AS source_url, abs(position - 1) AS position FROM d),
    m AS (SELECT article_id, source_url, min(position) AS position FROM b GROUP BY 1, 2)
    SELECT article_id, source_url, least(d.position, m.position) AS position, coalesce(d.status, 'pending') AS status, coalesce(d.attempts, 0) AS attempts, d.sha256
    FROM d FULL JOIN m USING (article_id, source_url)""")
def merge_images_twice(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.operators.triage import dedupe_images

    old = dedupe_images(S.images(spark, sf))
    url = F.concat("source_url", F.when(F.col("position") % 3 == 0, "?v=2").otherwise(""))
    batch = old.select("article_id", url.alias("source_url"), F.abs(F.col("position") - 1).alias("position"))
    return merge.merge_images(merge.merge_images(old, batch), batch).drop("checked_at")


@query(f"""WITH {_CHANGE_SQL}, v AS (SELECT id AS article_id, 'm' AS model FROM docs WHERE id % 5 <> 0)
    SELECT coalesce(v.article_id, x.id) AS article_id, CASE WHEN e.id IS NULL THEN v.model END AS model
    FROM (SELECT id FROM docs UNION SELECT id FROM change) x LEFT JOIN v ON v.article_id = x.id LEFT JOIN (SELECT id FROM docs WHERE id % 9 = 0) e ON e.id = v.article_id""")
def vector_invalidations(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _change(spark, sf)
    v = old.where("id % 5 <> 0").select(F.col("id").alias("article_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit("m").alias("model"))
    cleared = merge.invalidate_vectors(v, old, new)
    return merge.queue_vectors(cleared, merge.merge_articles(old, new)).select("article_id", "model")


@query(f"""WITH {S.DOCS_SQL} SELECT id, hidden_at IS NULL AND id % 7 = 0 AS changed,
    CASE WHEN hidden_at IS NOT NULL THEN '2024-01-01' WHEN id % 7 = 0 THEN '2024-02-01' END AS hidden FROM docs""")
def hide_articles(spark: SparkSession, sf: str) -> DataFrame:
    docs = S.documents(spark, sf)
    out = merge.hide_articles(docs, docs.where("id % 7 = 0").select("id"), AS_OF)
    return out.select("id", "changed", F.date_format("hidden_at", "yyyy-MM-dd").alias("hidden"))


@query("""SELECT sha256(text) AS sha256, substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) AS shard, count(DISTINCT doc_id) AS articles FROM documents GROUP BY 1, 2""")
def blob_radius(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.functions import blobs
    from tidemark.sources.archive import blob_rows

    rows = blob_rows(S.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.encode("text", "utf-8").alias("content")))
    return merge.blob_blast_radius(rows).select("sha256", blobs.shard(F.col("sha256")).alias("shard"), "articles")


@query("""WITH b AS (SELECT sha256(text) AS sha256, min(doc_id) AS first FROM documents GROUP BY 1)
    SELECT sha256, CASE WHEN first % 2 = 0 THEN 'stored' ELSE 'image/' || first END AS mime FROM b
    WHERE first % 2 = 1 UNION ALL SELECT sha256, 'stored' FROM b WHERE first % 2 = 0""")
def save_blobs(spark: SparkSession, sf: str) -> DataFrame:
    d = S.table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("image/"), F.col("doc_id").cast("string")).alias("mime"))
    stored = d.groupBy("sha256").agg(F.min("ordinal").alias("o")).where("o % 2 = 0").select("sha256", F.lit("stored").alias("mime"))
    return merge.save_blobs(stored, d)


@query(f"""WITH {S.IMAGES_SQL}, {S.BLOBS_SQL} SELECT sha256, withheld_at IS NULL AND CAST(substr(sha256, 2) AS INT) % 4 = 0 AS changed, coalesce(n, 0) AS articles
    FROM blobs LEFT JOIN (SELECT sha256, count(DISTINCT article_id) AS n FROM images WHERE sha256 IS NOT NULL GROUP BY 1) USING (sha256)""")
def withhold_blobs(spark: SparkSession, sf: str) -> DataFrame:
    b = S.blobs(spark, sf)
    out = merge.withhold_blobs(b, b.where(F.substring("sha256", 2, 9).cast("int") % 4 == 0), AS_OF)
    return out.join(merge.blob_blast_radius(S.images(spark, sf)), "sha256", "left").select("sha256", "changed", F.coalesce("articles", F.lit(0)).alias("articles"))
