"""Snapshot merges: old snapshot and change set in, new snapshot out. Applying a change set twice changes nothing more."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_distinct(a: Column, b: Column) -> Column:
    """NULL-safe inequality."""
    return ~a.eqNullSafe(b)


def _full(old: DataFrame, new: DataFrame, keys: list[str], rules: dict) -> DataFrame:
    """Old rows with their changes, and new rows, by a rule per column of `old`: rule(old value, new value, changed, known).

    Written as left, semi and anti joins against the change set rather than as one full join: a change set under
    the broadcast threshold then leaves the old snapshot where it is, however large that has grown.
    """
    o, n = (df.select(*keys, F.struct(*[c for c in df.columns if c not in keys], F.lit(True).alias("__is")).alias(s)) for df, s in ((old, "o"), (new, "n")))
    met = old.select(*keys).join(new.select(*keys), keys, "left_semi")
    fresh = n.join(met, keys, "left_anti").withColumn("o", F.lit(None).cast(o.schema["o"].dataType))
    both = o.join(n, keys, "left").unionByName(fresh)
    hit = F.col("n").isNotNull()
    known = F.col("o").isNotNull()
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
            continue
        a = F.col("o")[c]
        b = F.col("n")[c] if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        default = lambda a, b, hit, known: F.when(hit, b).otherwise(a)
        out.append(rules.get(c, default)(a, b, hit, known).cast(old.schema[c].dataType).alias(c))
    return both.select(*out)


def split_rejects(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles to merge, rejects): a page that claims comments but yields none is an error before anything is written.

    `pages`: article columns with comment_count and n_comments (parsed).
    """
    vanished = (F.col("comment_count") > 0) & (F.col("n_comments") == 0)
    bad = pages.where(vanished).select(F.col("id").alias("article_id"), F.lit("error").alias("status"), F.lit("comments vanished").alias("last_error"))
    return pages.where(~vanished).drop("n_comments"), bad


def merge_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every column is replaced, except lang and hidden_at."""
    keep = lambda a, b, hit, known: a
    return _full(old, new, ["id"], {"lang": keep, "hidden_at": keep})


def merge_comments(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Additive: updates by id, deletes nothing, keeps the first article_id. Of equal ids in a batch the last (`ordinal`) wins."""
    cols = [c for c in batch.columns if c not in ("id", "ordinal")]
    last = batch.groupBy("id").agg(F.max_by(F.struct(*cols), "ordinal").alias("r")).select("id", "r.*")
    return _full(old, last, ["id"], {"article_id": lambda a, b, hit, known: F.when(known, a).otherwise(b)})


def merge_images(old: DataFrame, batch: DataFrame) -> DataFrame:
    """New URLs wait; known ones keep status, digest and attempts and take the smaller position; vanished ones stay."""
    first = batch.groupBy("article_id", "source_url").agg(F.min("position").alias("position"))
    keep = lambda fresh: lambda a, b, hit, known: F.when(known, a).otherwise(fresh)
    return _full(
        old, first, ["article_id", "source_url"],
        {
            "position": lambda a, b, hit, known: F.least(a, b),
            "status": keep(F.lit("pending")), "attempts": keep(F.lit(0)), "sha256": keep(F.lit(None)), "checked_at": keep(F.lit(None)),
        },
    )


def invalidate_vectors(vectors: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors whose article's body differs between the old snapshot and the change set lose vector and model. A new title alone does not count."""
    changed = (
        old.select("id", F.col("body").alias("b0"))
        .join(new.select("id", F.col("body").alias("b1")), "id")
        .where(is_distinct(F.col("b0"), F.col("b1")))
        .select(F.col("id").alias("article_id"), F.lit(True).alias("__hit"))
    )
    rows = vectors.join(changed, "article_id", "left")
    hit = F.col("__hit").isNotNull()
    clear = {c: F.when(~hit, F.col(c)).alias(c) for c in ("embedding", "model")}
    return rows.select(*(clear.get(c, F.col(c)) for c in vectors.columns))


def seed_missing_queue(vectors: DataFrame, articles: DataFrame) -> DataFrame:
    """A queue row (null vector) for every article that has none."""
    fresh = articles.select(F.col("id").alias("article_id")).distinct().join(vectors.select("article_id"), "article_id", "left_anti")
    return vectors.unionByName(fresh, allowMissingColumns=True)


queue_vectors = seed_missing_queue


def last_of(batch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: that of the highest `ordinal` if there is such a column, else the greatest row."""
    cols = [c for c in batch.columns if c not in (*keys, "ordinal")]
    order = F.col("ordinal") if "ordinal" in batch.columns else F.struct(*cols)
    return batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*")


def save_vectors(vectors: DataFrame, batch: DataFrame, model: str, as_of: datetime.datetime) -> DataFrame:
    """Vector, model and time for the known ids of a batch (article_id, embedding); unknown ids are ignored."""
    ordinal = [c for c in ("ordinal",) if c in batch.columns]
    new = last_of(batch.select("article_id", "embedding", *ordinal), ["article_id"]).withColumnRenamed("embedding", "__v")
    hit = F.col("__v").isNotNull()
    rows = vectors.join(new, "article_id", "left")
    put = {
        "embedding": F.coalesce("__v", "embedding"),
        "model": F.when(hit, F.lit(model)).otherwise(F.col("model")),
        "updated_at": F.when(hit, F.lit(as_of)).otherwise(F.col("updated_at")),
    }
    return rows.select(*(put[c].alias(c) if c in put else F.col(c) for c in vectors.columns))


update_from_batch = save_vectors


def switch_model(vectors: DataFrame, model: str) -> DataFrame:
    """Vectors of another model are queued again; a null model is untouched."""
    other = F.coalesce(F.col("model") != model, F.lit(False))
    clear = {c: F.when(~other, F.col(c)).alias(c) for c in ("embedding", "model")}
    return vectors.select(*(clear.get(c, F.col(c)) for c in vectors.columns))


def record_image_result(images: DataFrame, results: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """Status, digest and one more attempt by (article, URL); unknown keys are ignored, a missing digest keeps the old one."""
    ordinal = [c for c in ("ordinal",) if c in results.columns]
    last = last_of(results.select("article_id", "source_url", "status", "sha256", *ordinal), ["article_id", "source_url"])
    new = last.withColumnsRenamed({"status": "__s", "sha256": "__d"})
    rows = images.join(new, ["article_id", "source_url"], "left")
    hit = F.col("__s").isNotNull()
    put = {
        "status": F.coalesce("__s", "status"),
        "sha256": F.when(hit, F.coalesce("__d", "sha256")).otherwise(F.col("sha256")),
        "attempts": F.col("attempts") + F.when(hit, 1).otherwise(0),
        "checked_at": F.when(hit, F.lit(as_of)).otherwise(F.col("checked_at")),
    }
    return rows.select(*(put[c].alias(c) if c in put else F.col(c) for c in images.columns))


def save_blobs(blobs: DataFrame, batch: DataFrame) -> DataFrame:
    """New digests are added; the first writer (`ordinal`) of a digest wins, so its declared type sticks."""
    cols = [c for c in batch.columns if c not in ("sha256", "ordinal")]
    first = batch.groupBy("sha256").agg(F.min_by(F.struct(*cols), "ordinal").alias("r")).select("sha256", "r.*")
    return blobs.unionByName(first.join(blobs.select("sha256"), "sha256", "left_anti"), allowMissingColumns=True)


def _tombstone(rows: DataFrame, selection: DataFrame, key: str, column: str, as_of: datetime.datetime) -> DataFrame:
    picked = selection.select(key).distinct().withColumn("__hit", F.lit(True))
    joined = rows.join(picked, key, "left")
    changed = F.col("__hit").isNotNull() & F.col(column).isNull()
    return joined.withColumn("changed", changed).withColumn(column, F.when(F.col("changed"), F.lit(as_of)).otherwise(F.col(column))).select(*rows.columns, "changed")


def hide_articles(articles: DataFrame, selection: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """hidden_at is set once: the first time stands. `changed` tells the rows that it was set on."""
    return _tombstone(articles, selection, "id", "hidden_at", as_of)


def withhold_blobs(blobs: DataFrame, selection: DataFrame, as_of: datetime.datetime) -> DataFrame:
    return _tombstone(blobs, selection, "sha256", "withheld_at", as_of)


def blob_blast_radius(images: DataFrame) -> DataFrame:
    """Distinct articles that cite each blob."""
    cited = images.where(F.col("sha256").isNotNull()).select("sha256", "article_id").distinct()
    return cited.groupBy("sha256").agg(F.count(F.lit(1)).alias("articles"))
