"""Hosts, queues, ledgers and their streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import blobs, urls
from tidemark.operators import browse, ledger, merge, triage
from tidemark.plans import standins as S
from tidemark.plans.registry import query
from tidemark.sources import archive
from tidemark.sources.archive import utc
from tidemark.sources.changes import ChangeTable
from tidemark.sources.shared import fresh_path
from tidemark.streaming import jobs, state

AS_OF = datetime.datetime(2024, 1, 1, 12, tzinfo=datetime.UTC)
BUSY = ["tionsh.example.net", "m.ththth.example.net", "therha.example.com"]


@query(f"""WITH {S.IMAGES_SQL} SELECT host, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'error') AS error,
    count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'dead') AS dead FROM images GROUP BY 1 HAVING count(*) FILTER (WHERE status IN ('pending', 'error')) >= 2""")
def host_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return triage.host_backlog(S.images(spark, sf), 2)


@query(f"""WITH {S.IMAGES_SQL} SELECT host, count(*) AS rows FROM images WHERE status IN ('dead', 'error') GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 20""")
def stuck_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return triage.stuck_hosts(S.images(spark, sf), 20)


_OPEN = "(status = 'pending' OR status = 'error' AND attempts < 5 AND checked_at <= TIMESTAMP '2024-01-01 11:00:00')"


@query(f"""WITH {S.IMAGES_SQL} SELECT article_id, position, source_url, host FROM images WHERE {_OPEN} AND host NOT IN ('{"', '".join(BUSY)}')
    ORDER BY article_id DESC, position LIMIT 500""")
def claim_images_excluding(spark: SparkSession, sf: str) -> DataFrame:
    return triage.claim_images(S.images(spark, sf), 500, AS_OF, 3600, BUSY).select("article_id", "position", "source_url", "host")


@query(f"""WITH {S.IMAGES_SQL} SELECT article_id, position, host FROM images WHERE {_OPEN} ORDER BY article_id DESC, position LIMIT 500""")
def claim_images_all(spark: SparkSession, sf: str) -> DataFrame:
    return triage.claim_images(S.images(spark, sf), 500, AS_OF, 3600).select("article_id", "position", "host")


@query(f"""WITH {S.IMAGES_SQL}, c AS (SELECT host, source_url, article_id * 100000 + position AS pos FROM images WHERE status = 'pending'),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY pos) AS round, min(pos) OVER (PARTITION BY host) AS first FROM c)
    SELECT pos, CAST(round AS INT) AS round, first FROM r""")
def interleave_claims(spark: SparkSession, sf: str) -> DataFrame:
    claimed = triage.with_host(S.images(spark, sf)).where("status = 'pending'").withColumn("pos", F.col("article_id") * 100000 + F.col("position"))
    return triage.interleave_by_host(claimed).select("pos", "round", "first")


@query(f"""WITH {S.IMAGES_SQL} SELECT host, arg_min(source_url, (-article_id, position)) AS sample_url FROM images WHERE status IN ('pending', 'error') GROUP BY 1""")
def sample_url_per_host(spark: SparkSession, sf: str) -> DataFrame:
    return triage.sample_url_per_host(S.images(spark, sf))


@query(f"""WITH {S.IMAGES_SQL} SELECT article_id, source_url, position, status FROM (SELECT *, row_number() OVER (PARTITION BY article_id, source_url ORDER BY sha256 IS NULL, position) AS n FROM images) WHERE n = 1""")
def dedupe_image_refs(spark: SparkSession, sf: str) -> DataFrame:
    return triage.dedupe_images(S.images(spark, sf)).select("article_id", "source_url", "position", "status")


#: The audited column: page URLs, and an address in several spellings made from the page id.
_AUDIT = ("url", "'http://' || (page_id % 256) || '.' || (page_id % 7) || '.2.3/x'", "'//10.0.0.' || page_id || '/x'", "'ftp://a.b/' || page_id",
          "'http://user@127.0.0.' || page_id % 300 || ':80/'", "'https://0' || page_id || '.1.1.1/'", "'http:///none' || page_id")
_AUDIT_ROWS = "SELECT page_id, unnest([" + ", ".join(_AUDIT) + "]) AS source_url FROM pages"


def _v4(n: str) -> str:
    import ipaddress

    nets = [ipaddress.ip_network(b) for b in urls.NON_PUBLIC_V4]
    return " OR ".join(f"{n} BETWEEN {int(b[0])} AND {int(b[-1])}" for b in nets)


@query(rf"""WITH u AS ({_AUDIT_ROWS}), a AS (SELECT *, CASE WHEN source_url LIKE '//%' THEN 'https:' || source_url ELSE source_url END AS v FROM u),
    h AS (SELECT *, lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
        coalesce(lower(split_part(regexp_replace(nullif(regexp_extract(v, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)', 1), ''), '^.*@', ''), ':', 1)), '') AS host FROM a),
    k AS (SELECT *, regexp_matches(host, '^(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){{3}}$') AS canon,
        regexp_matches(host, '^[0-9.]*[0-9][0-9.]*$') AS digits FROM h),
    n AS (SELECT *, CASE WHEN canon THEN CAST(split_part(host, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(host, '.', 2) AS BIGINT) * 65536
        + CAST(split_part(host, '.', 3) AS BIGINT) * 256 + CAST(split_part(host, '.', 4) AS BIGINT) END AS ip FROM k)
    SELECT page_id, source_url, CASE WHEN scheme NOT IN ('http', 'https') OR host = '' THEN 'blocked' WHEN canon AND ({_v4("ip")}) THEN 'blocked'
        WHEN digits AND NOT canon THEN 'blocked' ELSE 'ok' END AS verdict FROM n""")
def url_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "pages").select("page_id", F.explode(F.array(*(F.expr(e) for e in _AUDIT))).alias("source_url"))
    return urls.classify_url_table(rows)


@query(rf"""WITH u AS ({_AUDIT_ROWS}) SELECT page_id, source_url FROM u WHERE page_id % 2 = 0 AND (NOT regexp_matches(source_url, '(?i)^https?://')
    OR regexp_matches(source_url, '(?i)(://|@)(localhost|127\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|169\.254\.|0\.0\.0\.0)'))""")
def audit_private_blobs(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.table(spark, sf, "pages").select("page_id", F.explode(F.array(*(F.expr(e) for e in _AUDIT))).alias("source_url"))
    return urls.audit_private_blobs(rows.withColumn("status", F.when(F.col("page_id") % 2 == 0, "ok").otherwise("dead"))).drop("status")


def _probes(spark: SparkSession, sf: str) -> DataFrame:
    """A probe per host; what came back follows from the length of its name."""
    n = F.length("host")
    sample = triage.sample_url_per_host(S.images(spark, sf)).where("host IS NOT NULL")
    got = sample.select(
        "host", F.when(n % 7 == 0, "unresolved").when(n % 7 == 1, "blocked").otherwise("ok").alias("v"), F.when(n % 7 == 2, "timeout").alias("fault"),
        F.when(n % 7 == 3, 404).when(n % 7 == 4, 503).otherwise(200).alias("http"), F.when(n % 7 == 5, F.unhex(F.lit("89504E470D0A1A0A00"))).otherwise(F.encode(F.lit("<html>"), "utf-8")).alias("data"),
    )
    return got.select("host", blobs.classify_probe(F.col("v"), F.col("fault"), F.col("http"), F.col("data"), F.lit("text/html")).alias("verdict"))


_PROBE_SQL = """probes AS (SELECT host, CASE length(host) % 7 WHEN 0 THEN 'nxdomain' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unreachable' WHEN 3 THEN 'gone' WHEN 4 THEN 'http-error'
    WHEN 5 THEN 'alive' ELSE 'not-image' END AS verdict FROM (SELECT DISTINCT host FROM images WHERE host IS NOT NULL AND status IN ('pending', 'error'))),
backlog AS (SELECT host, count(*) FILTER (WHERE status IN ('pending', 'error')) AS depth, count(*) FILTER (WHERE status = 'ok') AS ok FROM images GROUP BY 1 HAVING depth >= 1)"""


@query(f"""WITH {S.IMAGES_SQL}, {_PROBE_SQL} SELECT host, depth, ok, verdict FROM backlog LEFT JOIN probes USING (host)""")
def probe_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    out = triage.join_verdicts(triage.host_backlog(S.images(spark, sf)), _probes(spark, sf))
    return out.select("host", (F.col("pending") + F.col("error")).alias("depth"), "ok", "verdict")


@query(f"""WITH {S.IMAGES_SQL}, {_PROBE_SQL} SELECT count(*) AS hosts, CAST(coalesce(sum(depth), 0) AS BIGINT) AS rows FROM backlog JOIN probes USING (host)
    WHERE ok = 0 AND verdict IN ('nxdomain', 'blocked', 'unreachable', 'gone', 'not-image')""")
def writeoff_report(spark: SparkSession, sf: str) -> DataFrame:
    return triage.writeoff_report(triage.host_backlog(S.images(spark, sf)), _probes(spark, sf))


@query(f"""WITH {S.IMAGES_SQL} SELECT article_id, position, CASE WHEN pick AND status IN ('dead', 'error') THEN 'pending' ELSE status END AS status,
    CASE WHEN pick AND status IN ('dead', 'error') THEN 0 ELSE attempts END AS attempts FROM (SELECT *, coalesce(length(host) % 3 = 0, false) AS pick FROM images)""")
def requeue_hosts(spark: SparkSession, sf: str) -> DataFrame:
    img = S.images(spark, sf)
    hosts = triage.with_host(img).select("host").distinct().where(F.length("host") % 3 == 0)
    return triage.requeue_hosts(img, hosts).select("article_id", "position", "status", "attempts")


@query(f"""WITH {S.IMAGES_SQL}, h AS (SELECT host, count(*) FILTER (WHERE status = 'ok') AS ok FROM images WHERE length(host) % 2 = 0 GROUP BY 1)
    SELECT article_id, position, CASE WHEN h.ok = 0 AND status IN ('pending', 'error') THEN 'dead' ELSE status END AS status, attempts FROM images LEFT JOIN h USING (host)""")
def kill_hosts(spark: SparkSession, sf: str) -> DataFrame:
    img = S.images(spark, sf)
    hosts = triage.with_host(img).select("host").distinct().where(F.length("host") % 2 == 0)
    return triage.kill_hosts(img, hosts)[0].select("article_id", "position", "status", "attempts")


@query(f"""WITH {S.IMAGES_SQL} SELECT host, count(*) AS ok FROM images WHERE length(host) % 2 = 0 AND status = 'ok' GROUP BY 1""")
def kill_hosts_refused(spark: SparkSession, sf: str) -> DataFrame:
    img = S.images(spark, sf)
    return triage.kill_hosts(img, triage.with_host(img).select("host").distinct().where(F.length("host") % 2 == 0))[1]


@query(f"""WITH {S.IMAGES_SQL}, d AS (SELECT DISTINCT ON (article_id, source_url) * FROM images ORDER BY article_id, source_url, sha256 IS NULL, position)
    SELECT article_id, source_url, CASE WHEN position % 2 = 0 THEN 'ok' ELSE status END AS status, CASE WHEN position % 2 = 0 THEN 'new' ELSE sha256 END AS sha256,
    attempts + CASE WHEN position % 2 = 0 THEN 1 ELSE 0 END AS attempts FROM d""")
def record_image_result(spark: SparkSession, sf: str) -> DataFrame:
    img = triage.dedupe_images(S.images(spark, sf))
    got = img.where("position % 2 = 0").select("article_id", "source_url", F.lit("ok").alias("status"), F.lit("new").alias("sha256"))
    unknown = got.withColumn("source_url", F.concat(F.lit("?"), "source_url"))
    return merge.record_image_result(img, got.unionByName(unknown), AS_OF).select("article_id", "source_url", "status", "sha256", "attempts")


# The ledger.


@query(f"""WITH {S.EVENTS_SQL} SELECT article_id, status, attempts, {S.stamp_sql("updated_at")} FROM led""")
def fetch_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.fetch_ledger(S.events(spark, sf)).select("article_id", "status", "attempts", S.stamp("updated_at"))


@query(f"""WITH {S.EVENTS_SQL} SELECT article_id, status, attempts FROM led WHERE status IN ('error', 'stale') AND attempts < 5 AND updated_at <= TIMESTAMP '2024-01-30 20:00:00'
    ORDER BY article_id DESC LIMIT 40""")
def retry_queue(spark: SparkSession, sf: str) -> DataFrame:
    now = datetime.datetime(2024, 1, 30, 21, tzinfo=datetime.UTC)
    return ledger.claim_retryable(ledger.fetch_ledger(S.events(spark, sf)), 40, now, 3600).select("article_id", "status", "attempts")


@query(f"""WITH {S.EVENTS_SQL} SELECT o_orderkey AS article_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM led WHERE article_id = o_orderkey AND NOT (status = 'error' AND attempts < 5))""")
def unseen_ids(spark: SparkSession, sf: str) -> DataFrame:
    ids = S.orders_only(spark, sf).select(F.col("id").alias("article_id"))
    return ledger.filter_unseen(ids, ledger.fetch_ledger(S.events(spark, sf)), retry_errors=True)


@query(f"""WITH {S.EVENTS_SQL}, b AS (SELECT r AS article_id FROM range(1, 1001) t(r) WHERE r NOT IN (SELECT article_id FROM led) ORDER BY 1 DESC LIMIT 900)
    SELECT article_id, min(article_id) OVER () - 1 AS next_cursor FROM b""")
def walk_batch(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.walk_batch(spark, ledger.fetch_ledger(S.events(spark, sf)), 1000, 900)


@query(f"""WITH {S.EVENTS_SQL} SELECT o_orderkey AS id, CASE WHEN status = 'missing' THEN 'deleted' WHEN status IN ('error', 'stale') THEN 'retry' ELSE 'uncollected' END AS reason,
    CAST(CASE WHEN status IN ('missing', 'error', 'stale') THEN NULL ELSE 77 END AS BIGINT) AS frontier FROM orders LEFT JOIN led ON article_id = o_orderkey""")
def missing_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return browse.missing_reason(S.orders_only(spark, sf).select("id"), ledger.fetch_ledger(S.events(spark, sf)), 77)


@query(f"""WITH {S.EVENTS_SQL}, i AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY article_id ORDER BY ts, seq) AS isle FROM ev)
    SELECT article_id AS key, seq, CAST(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY article_id, isle ORDER BY ts, seq) AS BIGINT) AS run FROM i""")
def failure_runs(spark: SparkSession, sf: str) -> DataFrame:
    ev = S.events(spark, sf).select(F.col("article_id").alias("key"), "ts", "seq", (F.col("outcome") == "error").alias("failed"))
    return ledger.failure_runs(ev).select("key", "seq", "run")


@query(f"""WITH {S.EVENTS_SQL} SELECT article_id, changed, CASE WHEN changed THEN 'stale' ELSE status END AS status, CASE WHEN changed THEN 0 ELSE attempts END AS attempts
    FROM (SELECT *, article_id % 2 = 0 AND status IN ('ok', 'error') AS changed FROM led)""")
def mark_stale(spark: SparkSession, sf: str) -> DataFrame:
    led = ledger.fetch_ledger(S.events(spark, sf))
    return ledger.mark_stale(led, led.where("article_id % 2 = 0").select("article_id")).select("article_id", "changed", "status", "attempts")


@query(f"""WITH {S.EVENTS_SQL} SELECT count(*) FILTER (WHERE status = 'stale') AS waiting FROM led""")
def stale_progress(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.stale_progress(ledger.fetch_ledger(S.events(spark, sf)))


@query("""SELECT count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE doc_id % 13 = 0""")
def bodies_without_markup(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.bodies_without_markup(S.documents(spark, sf).withColumn("body_raw", F.when(F.col("id") % 13 != 0, F.col("body"))))


@query(f"""WITH {S.EVENTS_SQL} SELECT outcome AS status, count(*) AS n FROM ev GROUP BY 1""")
def outcome_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.outcome_distribution(S.events(spark, sf).select(F.col("outcome").alias("status")))


@query(f"""WITH {S.EVENTS_SQL} SELECT outcome AS status, count(*) AS n FROM (SELECT * FROM ev ORDER BY md5('7:' || seq), seq LIMIT 500) GROUP BY 1""")
def outcome_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.outcome_distribution(S.events(spark, sf).select("seq", F.col("outcome").alias("status")), 500, "seq")


# A feed made of the pages: twenty to a feed page, each page of the feed repeating the last item of the one before.

_ITEM = "<item><title>{0}</title><link>https://x.example/en/article/some-title-{0}/1/20</link></item>"


def _feeds(spark: SparkSession, sf: str) -> DataFrame:
    p = S.table(spark, sf, "pages").select("page_id", F.floor(F.col("page_id") / 20).cast("bigint").alias("page"))
    again = p.where("page_id % 20 = 19").withColumn("page", F.col("page") + 1)
    item = F.format_string(_ITEM.format("%1$d"), F.col("page_id"))
    rows = p.unionByName(again).groupBy("page").agg(F.sort_array(F.collect_list(F.struct((-F.col("page_id")).alias("o"), item.alias("i")))).alias("l"))
    return rows.select("page", F.concat(F.lit("<rss><channel><link>https://x.example/en/article/channel-1</link>"), F.array_join(F.transform("l", lambda x: x["i"]), ""), F.lit("</channel></rss>")).alias("xml"))


_FEED_SQL = """p AS (SELECT page_id, page_id // 20 AS page FROM pages), f AS (SELECT * FROM p UNION ALL SELECT page_id, page + 1 FROM p WHERE page_id % 20 = 19),
items AS (SELECT page_id AS article_id, page, CAST(row_number() OVER (PARTITION BY page ORDER BY page_id DESC) - 1 AS INT) AS pos FROM f)"""


@query(f"WITH {_FEED_SQL} SELECT page, pos, article_id FROM items")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    return archive.src_feed(_feeds(spark, sf))


@query(f"WITH {_FEED_SQL} SELECT article_id, min(page) AS page, arg_min(pos, (page, pos)) AS pos FROM items GROUP BY 1")
def feed_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return archive.feed_union_distinct(archive.src_feed(_feeds(spark, sf)))


#: Every seventh feed is cut off, every eleventh is empty; links carry an escaped query, each third one as a character data section.
_ODD_ITEM = "<item><title>{0} &amp; more</title><atom:link>https://x.example/en/article/other-1</atom:link><link>%2$shttps://x.example/en/article/t-{0}/1/20?a=1%3$sb=2%4$s</link></item>"


def _odd_feeds(spark: SparkSession, sf: str) -> DataFrame:
    p, f = F.col("page_id"), F.floor(F.col("page_id") / 5).cast("bigint")
    section = p % 3 == 0
    item = F.format_string(
        _ODD_ITEM.format("%1$d"), p, F.when(section, "<![CDATA[").otherwise(""), F.when(section, "&").otherwise("&amp;"), F.when(section, "]]>").otherwise("")
    )
    rows = S.table(spark, sf, "pages").groupBy(f.alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", item.alias("i")))), lambda x: x["i"]), "\n").alias("items"))
    xml = F.concat(F.lit('\n<?xml version="1.0"?><rss xmlns:atom="http://www.w3.org/2005/Atom"><channel><atom:link href="z"/><link>https://x.example/en/article/c-1</link>'), "items", F.lit("</channel></rss>"))
    whole = rows.select("feed", xml.alias("xml"))
    return whole.select("feed", F.when(F.col("feed") % 11 == 0, "").when(F.col("feed") % 7 == 0, F.expr("left(xml, length(xml) - 19)")).otherwise(F.col("xml")).alias("xml"))


_ODD_SQL = """SELECT page_id // 5 AS feed, CAST(row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) - 1 AS INT) AS pos, page_id AS article_id,
    row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id DESC) = 1 AS last FROM pages"""


@query(f"""SELECT feed, pos, article_id FROM ({_ODD_SQL}) WHERE feed % 11 <> 0 AND (feed % 7 <> 0 OR NOT last)""")
def feed_odd_items(spark: SparkSession, sf: str) -> DataFrame:
    """Entities, sections and namespaces; of feeds that are cut off, the whole items."""
    return archive.src_feed(_odd_feeds(spark, sf))


@query("""SELECT feed, CASE WHEN feed % 11 = 0 THEN 'empty' ELSE 'malformed' END AS reason FROM (SELECT DISTINCT page_id // 5 AS feed FROM pages) WHERE feed % 11 = 0 OR feed % 7 = 0""")
def feed_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return archive.feed_rejects(_odd_feeds(spark, sf)).select("feed", "reason")


# Streams over the events table; each drains all that is there, and the last state of a key is compared.


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{sf}/events.parquet"
    # As a pattern: the stream reader takes a plain path for a directory, and small tables are single files.
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/events.parque[t]")
    return utc(raw).select(
        F.col("user_id").alias("article_id"), F.col("event_id").alias("seq"), "ts",
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "stale").when(F.col("event_type") == "signup", "missing").otherwise("ok").alias("outcome"),
    )


@query(f"""WITH {S.EVENTS_SQL} SELECT article_id, status, CAST(attempts AS INT) AS attempts FROM led""")
def stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "stream-ledger")
    table = ChangeTable(spark, f"{path}/ledger", ["article_id"])
    jobs.stream_ledger(_event_stream(spark, sf).withColumn("error", F.lit(None).cast("string")), table, f"{path}/checkpoint").awaitTermination()
    return table.read().select("article_id", "status", F.col("attempts").cast("int").alias("attempts"))


@query("SELECT user_id AS article_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events GROUP BY 1")
def stream_feed_unseen(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "feed-unseen")
    seen = ChangeTable(spark, f"{path}/seen", ["article_id"])
    jobs.stream_feed_unseen(_event_stream(spark, sf).select("article_id", "ts"), seen, f"{path}/checkpoint").awaitTermination()
    return seen.read().select("article_id", S.stamp("ts"))


@query("SELECT DISTINCT user_id AS article_id FROM events")
def stream_feed_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.drain(spark, jobs.stream_feed_dedupe(_event_stream(spark, sf), "60 days"), "stream-feed").select("article_id")


def _fold_sql(start: str, step: str) -> str:
    """A machine in SQL: the events of a key one after the other. `step` gives the columns of `start` from `r` (state) and `e` (event)."""
    return f"""RECURSIVE {S.EVENTS_SQL}, e AS MATERIALIZED (SELECT article_id, seq, outcome, epoch_us(ts) AS us, row_number() OVER (PARTITION BY article_id ORDER BY ts, seq) AS n FROM ev),
    r AS (SELECT DISTINCT article_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, {start} FROM e
          UNION ALL SELECT e.article_id, e.n, e.seq, {step} FROM r JOIN e ON e.article_id = r.article_id AND e.n = r.n + 1)"""


_DAY = 86_400_000_000
_OPEN = f"r.opened IS NOT NULL AND e.us - r.opened <= {_DAY}"
_COUNT = f"CASE WHEN e.outcome = 'error' THEN 1 + CASE WHEN r.opened IS NULL OR {_OPEN} THEN r.failures ELSE 0 END ELSE 0 END"
_CIRCUIT_SQL = _fold_sql("0 AS failures, CAST(NULL AS BIGINT) AS opened", f"{_COUNT}, CASE WHEN {_COUNT} >= 2 THEN e.us WHEN {_OPEN} THEN r.opened END")


@query(f"""WITH {_CIRCUIT_SQL}, late AS (SELECT max(us) - {_DAY} * 3 AS mark FROM e)
    SELECT 'h' || article_id AS host, seq, CAST(failures AS INT) AS failures, opened IS NOT NULL AS "open" FROM r WHERE n > 0
    UNION ALL SELECT 'h' || r.article_id, NULL, 0, false FROM r JOIN (SELECT article_id, max(n) AS n FROM r GROUP BY 1) USING (article_id, n), late WHERE r.opened IS NOT NULL AND ceil((r.opened + {_DAY} + 1) / 1000) <= floor(mark / 1000)""")
def host_circuit(spark: SparkSession, sf: str) -> DataFrame:
    """Two failures in a row open a host for a day. Hosts that are still open three days before the end are closed by their timers."""
    ev = _event_stream(spark, sf).select(F.concat(F.lit("h"), F.col("article_id").cast("string")).alias("host"), "ts", "seq", (F.col("outcome") == "error").alias("failed"))
    return jobs.drain(spark, jobs.stream_machine(ev, ["host"], state.host_circuit(2, 86_400), "3 days"), "circuit").select("host", "seq", "failures", "open")


@query(f"""WITH {S.EVENTS_SQL}, i AS (SELECT *, sum(CASE WHEN outcome = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY article_id ORDER BY ts, seq) AS isle FROM ev)
    SELECT article_id AS key, seq, CAST(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER w AS INT) AS run, sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER w >= 3 AS alarm
    FROM i WINDOW w AS (PARTITION BY article_id, isle ORDER BY ts, seq)""")
def watchdog_runs(spark: SparkSession, sf: str) -> DataFrame:
    ev = _event_stream(spark, sf).select(F.col("article_id").alias("key"), "ts", "seq", F.when(F.col("outcome") == "error", "failure").otherwise("ok").alias("outcome"))
    return jobs.drain(spark, jobs.stream_machine(ev, ["key"], state.watchdog(3), "30 days"), "watchdog").select("key", "seq", "run", "alarm")


_FREE = "(r.last IS NULL OR e.us - r.last >= 43200000000)"


@query(f"""WITH {_fold_sql("CAST(NULL AS BIGINT) AS last, false AS sent", f"CASE WHEN {_FREE} AND e.outcome <> 'missing' THEN e.us ELSE r.last END, {_FREE}")}
    SELECT article_id AS key, seq, sent FROM r WHERE n > 0""")
def throttle_alerts(spark: SparkSession, sf: str) -> DataFrame:
    ev = _event_stream(spark, sf).select(F.col("article_id").alias("key"), "ts", "seq", (F.col("outcome") != "missing").alias("delivered"))
    return jobs.drain(spark, jobs.stream_machine(ev, ["key"], state.throttle(43_200), "30 days"), "throttle").select("key", "seq", "sent")


@query(f"""WITH {_fold_sql("'pending' AS status, 0 AS attempts", """CASE WHEN e.outcome = 'stale' THEN CASE WHEN r.status IN ('dead', 'error') THEN 'pending' ELSE r.status END
            WHEN e.outcome = 'missing' THEN CASE WHEN r.status IN ('pending', 'error') THEN 'dead' ELSE r.status END ELSE e.outcome END,
            CASE WHEN e.outcome = 'stale' THEN CASE WHEN r.status IN ('dead', 'error') THEN 0 ELSE r.attempts END WHEN e.outcome = 'missing' THEN r.attempts ELSE r.attempts + 1 END""")}
    SELECT article_id, arg_max(status, n) AS status, CAST(arg_max(attempts, n) AS INT) AS attempts FROM r GROUP BY article_id""")
def stream_image_queue(spark: SparkSession, sf: str) -> DataFrame:
    move = F.when(F.col("outcome") == "stale", "requeue").when(F.col("outcome") == "missing", "kill").otherwise(F.col("outcome"))
    ev = _event_stream(spark, sf).select("article_id", F.lit("http://h/x.png").alias("source_url"), "ts", "seq", move.alias("event"))
    out = jobs.drain(spark, jobs.stream_machine(ev, ["article_id", "source_url"], state.image_queue(), "30 days"), "image-queue")
    return jobs.latest(out, ["article_id", "source_url"]).select("article_id", "status", "attempts")
