"""The archive's tables, stood in for by the given ones; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.extract import extract_image_refs
from tidemark.sources.archive import utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark.read.parquet(f"{sf}/{name}.parquet"))


def stamp(col: str) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias(col)


def stamp_sql(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {col.split('.')[-1]}"


def orders_only(spark: SparkSession, sf: str) -> DataFrame:
    """Articles without authors, straight from one table: predicates reach the scan."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("country"),
        F.col("o_orderdate").alias("published_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("hidden_at"),
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("author_name"), F.lower("c_name").alias("author_lc"))
    return orders_only(spark, sf).join(names, "author_id", "left")


ARTICLES_SQL = """articles AS (SELECT o_orderkey AS id, o_custkey AS author_id, o_orderpriority AS country, o_orderdate AS published_at,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS hidden_at, c_name AS author_name, lower(c_name) AS author_lc
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""

STATUS = ("pending", "ok", "dead", "error")


def images(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url", "html")
    p = F.col("page_id")
    made = pages.select(
        p.alias("article_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), p % 5)).alias("position"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+", 0).alias("root"),
    ).select("article_id", "position", F.concat("root", F.lit("/img/"), F.col("position").cast("string"), F.lit(".png")).alias("source_url"))
    links = extract_image_refs(pages, attribute="href", tag="a").select("article_id", (F.col("position") + F.col("article_id") % 5 + 1).alias("position"), "source_url")
    a, n = F.col("article_id"), F.col("position")
    kind = (7 * a + n) % 4
    status = F.element_at(F.array(*(F.lit(s) for s in STATUS)), (kind + 1).cast("int"))
    return made.unionByName(links).select(
        "article_id", "position", "source_url", status.alias("status"), ((a + 3 * n) % 7).cast("int").alias("attempts"),
        F.when(kind == 1, F.concat(F.lit("d"), ((3 * a + n) % 50).cast("string"))).alias("sha256"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=((37 * a + 11 * n) % 1440).cast("int"))).alias("checked_at"),
    )


IMAGES_SQL = r"""raw_images AS (
    SELECT page_id AS article_id, k AS position, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/img/' || k || '.png' AS source_url
    FROM (SELECT page_id, url, unnest(range(0, page_id % 5 + 1)) AS k FROM pages)
    UNION ALL SELECT page_id, i - 1 + page_id % 5 + 1, u FROM (SELECT page_id, unnest(l) AS u, generate_subscripts(l, 1) AS i
        FROM (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*?\bhref="([^"]+)"', 1) AS l FROM pages))),
images AS (SELECT article_id, position, source_url, CASE (7 * article_id + position) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'ok' WHEN 2 THEN 'dead' ELSE 'error' END AS status,
    CAST((article_id + 3 * position) % 7 AS INT) AS attempts, CASE WHEN (7 * article_id + position) % 4 = 1 THEN 'd' || ((3 * article_id + position) % 50) END AS sha256,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST((37 * article_id + 11 * position) % 1440 AS INT)) AS checked_at,
    lower(split_part(regexp_replace(nullif(regexp_extract(source_url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)', 1), ''), '^.*@', ''), ':', 1)) AS host
    FROM raw_images)"""


def blobs(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of `images`, every fifth withheld."""
    return images(spark, sf).where("sha256 IS NOT NULL").select("sha256").distinct().withColumn(
        "withheld_at", F.when(F.substring("sha256", 2, 9).cast("int") % 5 == 0, F.lit("2024-06-01").cast("timestamp"))
    )


BLOBS_SQL = """blobs AS (SELECT DISTINCT sha256, CASE WHEN CAST(substr(sha256, 2) AS INT) % 5 = 0 THEN TIMESTAMP '2024-06-01' END AS withheld_at
    FROM images WHERE sha256 IS NOT NULL)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_type")
    outcome = F.when(e == "error", "error").when(e == "purchase", "stale").when(e == "signup", "missing").otherwise("ok")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("article_id"), F.col("event_id").alias("seq"), "ts", outcome.alias("outcome"), F.when(outcome == "error", F.col("props")).alias("error")
    )


EVENTS_SQL = """ev AS (SELECT user_id AS article_id, event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'stale'
    WHEN 'signup' THEN 'missing' ELSE 'ok' END AS outcome, CASE WHEN event_type = 'error' THEN props END AS error FROM events),
led AS (SELECT e.article_id, arg_max(outcome, (ts, seq)) AS status, count(*) FILTER (WHERE r.rts IS NULL OR (ts, seq) > (r.rts, r.rseq)) AS attempts, max(ts) AS updated_at
    FROM ev e LEFT JOIN (SELECT article_id, max(ts) AS rts, arg_max(seq, (ts, seq)) AS rseq FROM ev WHERE outcome = 'stale' GROUP BY 1) r USING (article_id) GROUP BY e.article_id)"""


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Articles with texts: a title (the first line) and a body."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), "lang",
        F.col("source").alias("country"), F.when(F.col("doc_id") % 11 == 0, F.lit("2024-01-01").cast("timestamp")).alias("hidden_at"),
    )


DOCS_SQL = """docs AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, text AS body, lang, source AS country,
    CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '2024-01-01' END AS hidden_at FROM documents)"""


def edited(docs: DataFrame) -> DataFrame:
    """A later change set of `documents`: every third row, every ninth with another body, every sixth with another title."""
    return docs.where("id % 3 = 0").withColumn("body", F.when(F.col("id") % 9 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))).withColumn(
        "title", F.when(F.col("id") % 6 == 0, F.concat(F.lit("new "), "title")).otherwise(F.col("title"))
    )


EDITED_SQL = """edited AS (SELECT id, CASE WHEN id % 6 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN id % 9 = 0 THEN body || '!' ELSE body END AS body,
    lang, country, hidden_at FROM docs WHERE id % 3 = 0)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The vector table: every fourth row is still queued, models alternate."""
    v = F.col("vec_id")
    queued = v % 4 == 3
    return table(spark, sf, "embeddings").select(
        v.alias("article_id"), F.when(~queued, F.col("embedding")).alias("embedding"),
        F.when(~queued, F.when(F.col("label") % 2 == 0, "model/a").otherwise("model/b")).alias("model"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


VECTORS_SQL = """vecs AS (SELECT vec_id AS article_id, CASE WHEN vec_id % 4 <> 3 THEN embedding END AS embedding,
    CASE WHEN vec_id % 4 <> 3 THEN CASE WHEN label % 2 = 0 THEN 'model/a' ELSE 'model/b' END END AS model FROM embeddings)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("position"), F.col("role").alias("author_name"), F.col("text").alias("body"))
