"""Sources and sinks of the archive: pages, feeds, blobs and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("html", T.StringType()),
    ]
)


def utc(df: DataFrame) -> DataFrame:
    """Zone-less timestamps as instants (session zone UTC); watermarks and zone functions need them so."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def src_pages(spark: SparkSession, path: str, streaming: bool = False, schema: T.StructType = PAGES) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)


#: What is read of a feed. Prefixed elements (`atom:link`) are other names and stay out; items stand in the channel or beside it.
FEED = "channel struct<item: array<struct<link: array<string>>>>, item array<struct<link: array<string>>>, malformed string"


def _parsed(xml: F.Column) -> F.Column:
    return F.from_xml(F.regexp_replace(xml, r"^[\s\uFEFF]+", ""), FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"})


def src_feed(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(…, pos, article_id) from <item><link> in feed order; the channel's own link is not an item.

    Feeds are read as XML: entities, character data sections, comments and namespaces are what they mean. A feed that is not well formed still gives the items
    that stand in it whole, found as text, and is listed by `feed_rejects`. Null and empty feeds give nothing.
    """
    found, keep = _free("feed", feeds.columns), [c for c in feeds.columns if c != xml]
    feed = F.col(found)
    none = F.array().cast("array<struct<link: array<string>>>")
    sound = F.concat(*(F.coalesce(items, none) for items in (feed["channel"]["item"], feed["item"])))
    torn = F.transform(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1)), lambda i: F.regexp_extract(i, r"(?s)<link>(.*?)</link>", 1))
    # The id is the number that ends the path segment after "article"; a page number may follow it.
    segment = lambda u: F.element_at(F.split(F.split_part(F.trim(u), F.lit("/article/"), F.lit(2)), "[/?#]"), 1)
    id_of = lambda u: F.regexp_extract(segment(u), "(?:^|-)([0-9]+)$", 1)
    first = lambda i: F.get(F.filter(F.transform(F.coalesce(i["link"], F.array().cast("array<string>")), lambda u: id_of(F.coalesce(u, F.lit("")))), lambda a: a != ""), 0)
    ids = F.when(feed["malformed"].isNull(), F.transform(sound, first)).otherwise(F.transform(torn, id_of))
    rows = feeds.withColumn(found, _parsed(F.col(xml))).where(feed.isNotNull())
    return rows.select(*keep, F.posexplode(F.filter(ids, lambda i: i != ""))).select(*keep, "pos", F.col("col").try_cast("bigint").alias("article_id"))


def feed_rejects(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """The feeds that are missing, empty or not well formed, with `reason`."""
    text, reason = F.trim(F.col(xml)), _free("reason", feeds.columns)
    why = F.when(F.col(xml).isNull(), "missing").when(text == "", "empty").when(_parsed(F.col(xml))["malformed"].isNotNull(), "malformed")
    return feeds.withColumn(reason, why).where(F.col(reason).isNotNull())


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def feed_union_distinct(items: DataFrame) -> DataFrame:
    """Ids of all feed pages (page, pos, article_id), once each, in order of first occurrence."""
    return items.groupBy("article_id").agg(F.min(F.struct("page", "pos")).alias("first")).orderBy("first").select("article_id", F.col("first.page").alias("page"), F.col("first.pos").alias("pos"))


def src_blobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def blob_rows(blobs: DataFrame, content: str = "content") -> DataFrame:
    """`blobs` with sha256 and shard (`ab/cd`)."""
    from tidemark.functions.blobs import digest, shard

    return blobs.withColumn("sha256", digest(F.col(content))).withColumn("shard", shard(F.col("sha256")))


def sink_blob_store(blobs: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Store bytes under their digest, in a table partitioned by its first byte; stored ones are not written again. Returns the rows written."""
    spark = blobs.sparkSession
    rows = blob_rows(blobs, content).withColumn("prefix", F.substring("sha256", 1, 2))
    # The first of equal bytes is as good as any; digests meet before their bytes do.
    fresh = rows.dropDuplicates(["sha256"])
    stored = read_table(spark, path)
    if stored is not None:
        fresh = fresh.join(stored.select("sha256"), "sha256", "left_anti")
    batch = uuid.uuid4().hex
    # A task writes one stretch of the digests, so it opens few of the 256 folders.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.conv(F.substring("sha256", 1, 6), 16, 10).cast("bigint") * n / (1 << 24))
    fresh.withColumn("batch", F.lit(batch)).repartition(n, stretch).write.mode("append").partitionBy("prefix").parquet(path)
    return spark.read.parquet(path).where(F.col("batch") == batch)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where nothing has been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop) else None


class Snapshots:
    """Versions of one table in a folder: `v=<n>` directories and a pointer that is written last.

    A version is complete once the pointer table names it; a failed write leaves an unnamed folder
    behind, and a batch id that its writer has published before is skipped. A writer is one run of a stream: name it by the stream's own id,
    as batch ids start anew with a fresh checkpoint. Saving fails if the table has changed since this object read it, or if
    another writer published the same version, so no update is lost unseen; the batch then runs again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._read: int | None = None

    def _pointer(self) -> tuple[int, str | None, dict[str, int]]:
        """(version, folder, last batch id of each writer)."""
        found = read_table(self.spark, f"{self.path}/pointer")
        if found is None:
            return 0, None, {}
        now = found.agg(F.max(F.struct("version", "folder")).alias("p")).first()["p"]
        done = found.groupBy("writer").agg(F.max("batch_id").alias("b")).collect()  # one row per job that writes here
        return now["version"], now["folder"], {r["writer"]: r["b"] for r in done}

    def read(self) -> DataFrame | None:
        self._read, folder, _ = self._pointer()
        return self.spark.read.parquet(f"{self.path}/{folder}") if folder else None

    def save(self, snapshot: DataFrame, batch_id: int = -1, writer: str = "") -> bool:
        version, _, done = self._pointer()
        if 0 <= batch_id <= done.get(writer, -1):
            return False
        if self._read is not None and version != self._read:
            raise RuntimeError(f"{self.path} is at version {version}; what is to be saved was made from {self._read}")
        folder = f"v={version + 1}-{uuid.uuid4().hex[:8]}"
        snapshot.write.parquet(f"{self.path}/{folder}")
        row = self.spark.range(1).select(
            F.lit(version + 1).alias("version"), F.lit(folder).alias("folder"), F.lit(writer).alias("writer"), F.lit(batch_id).cast("bigint").alias("batch_id")
        )
        row.write.mode("append").parquet(f"{self.path}/pointer")
        now, winner, _ = self._pointer()
        if now == version + 1 and winner != folder:
            raise RuntimeError(f"another writer published version {now} of {self.path} at the same time")
        self._read = None
        return True


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps as long as it keeps its checkpoint."""
    return spark.read.text(f"{checkpoint}/metadata").first()[0]


def sink_snapshot(spark: SparkSession, path: str, snapshot: DataFrame, batch_id: int = -1, writer: str = "") -> bool:
    """Publish a snapshot; repeating a batch replaces nothing and duplicates nothing."""
    return Snapshots(spark, path).save(snapshot, batch_id, writer)
