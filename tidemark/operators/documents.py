"""Detail pages as nested rows, and what hangs on an article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blobs import image_state
from tidemark.operators.browse import visible_only
from tidemark.operators.triage import MAX_ATTEMPTS


def semi_visible_parent(children: DataFrame, articles: DataFrame) -> DataFrame:
    """Children whose article exists and is visible."""
    return children.join(visible_only(articles).select(F.col("id").alias("article_id")), "article_id", "left_semi")


def join_image_blobs(images: DataFrame, blobs: DataFrame) -> DataFrame:
    """Image slots with the tombstone of their blob. Only withheld digests are joined: they are the few."""
    gone = blobs.where(F.col("withheld_at").isNotNull()).select("sha256", "withheld_at")
    return images.join(gone, "sha256", "left")


def image_map(images: DataFrame, blobs: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, position, source_url, sha256, state) for visible articles."""
    rows = semi_visible_parent(join_image_blobs(images, blobs), articles)
    return rows.select("article_id", "position", "source_url", "sha256", image_state(F.col("status"), F.col("attempts"), F.col("sha256"), F.col("withheld_at")).alias("state"))


def image_status_counts(images: DataFrame, blobs: DataFrame, articles: DataFrame) -> DataFrame:
    """ok, dead, waiting and exhausted per article. A withheld capture is in no bucket."""
    rows = semi_visible_parent(join_image_blobs(images, blobs), articles)
    s, spent = F.col("status"), F.col("attempts") >= MAX_ATTEMPTS
    return rows.groupBy("article_id").agg(
        F.count_if((s == "ok") & F.col("withheld_at").isNull()).alias("ok"),
        F.count_if(s == "dead").alias("dead"),
        F.count_if((s == "pending") | ((s == "error") & ~spent)).alias("waiting"),
        F.count_if((s == "error") & spent).alias("exhausted"),
    )


def article_documents(articles: DataFrame, comments: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Visible articles with their comments by position, and their image map if given."""
    thread = comments.select("article_id", F.struct("position", *[c for c in comments.columns if c not in ("article_id", "position")]).alias("c"))
    nested = thread.groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_list("c")).alias("comments"))
    out = visible_only(articles).join(nested, "id", "left")
    if states is not None:
        cells = states.groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("position", "source_url", "state", "sha256"))).alias("images"))
        out = out.join(cells, "id", "left")
    return out


def gallery_leftovers(states: DataFrame, shown: DataFrame) -> DataFrame:
    """(article_id, position, sha256) of captures not shown in the body: neither their URL nor another URL
    of the same bytes is, and one row per digest, the first by position. `shown`: article_id, source_url."""
    cited = shown.select("article_id", "source_url").distinct()
    seen = states.where(F.col("sha256").isNotNull()).join(cited, ["article_id", "source_url"], "left_semi").select("article_id", "sha256").distinct()
    left = states.where((F.col("state") == "ok") & F.col("sha256").isNotNull()).join(cited, ["article_id", "source_url"], "left_anti").join(seen, ["article_id", "sha256"], "left_anti")
    return left.groupBy("article_id", "sha256").agg(F.min("position").alias("position")).select("article_id", "position", "sha256")
