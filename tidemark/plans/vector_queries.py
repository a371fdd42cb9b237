"""Embedding jobs and retrieval."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.vectors import binary_quantise
from tidemark.operators import merge, vectors
from tidemark.operators.browse import visible_only
from tidemark.plans import standins as S
from tidemark.plans.registry import query
from tidemark.sources.changes import ChangeTable
from tidemark.sources.shared import fresh_path, materialise
from tidemark.streaming import jobs

DIMS = 64
AS_OF = datetime.datetime(2024, 2, 1, tzinfo=datetime.UTC)


@query(f"""WITH {S.VECTORS_SQL} SELECT count(*) FILTER (WHERE embedding IS NULL) AS pending, count(*) FILTER (WHERE embedding IS NOT NULL) AS done, count(DISTINCT model) AS models FROM vecs""")
def drain_progress(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.drain_progress(S.vectors(spark, sf))


@query(f"""WITH {S.VECTORS_SQL} SELECT article_id, CASE WHEN model IS DISTINCT FROM 'model/a' THEN 'model' WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'length'
    WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 0.05 THEN 'norm' END AS reason FROM vecs""")
def vector_check(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = vectors.valid_vectors(S.vectors(spark, sf), "model/a", DIMS)
    return bad.select("article_id", "reason").unionByName(good.select("article_id", F.lit(None).cast("string").alias("reason")))


@query(f"""WITH {S.VECTORS_SQL}, {S.DOCS_SQL} SELECT id FROM vecs JOIN docs ON id = article_id WHERE embedding IS NULL AND hidden_at IS NULL ORDER BY id DESC LIMIT 100""")
def claim_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.claim_embeddings(S.vectors(spark, sf), S.documents(spark, sf), 100).select("id")


@query(f"""WITH {S.DOCS_SQL} SELECT id, md5(substr(title || chr(10) || chr(10) || body, 1, 20000)) AS embedded FROM docs""")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    return S.documents(spark, sf).select("id", F.md5(vectors.embed_text()).alias("embedded"))


#: The encoder sign by sign: a component and a sign for each trigram of code points, summed and brought to unit length.
_ENCODED_SQL = f"""{S.VECTORS_SQL}, {S.DOCS_SQL}, todo AS MATERIALIZED (SELECT v.article_id, list_transform(string_split(rpad(t, CAST(greatest(length(t), 3) AS INT), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT)) AS c
    FROM vecs v JOIN (SELECT id, substr(title || chr(10) || chr(10) || body, 1, 20000) AS t FROM docs WHERE hidden_at IS NULL) d ON d.id = v.article_id WHERE v.embedding IS NULL),
grams AS (SELECT article_id, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 1000003 + c[i + 1] * 998244353 + c[i + 2] * 1000000007) % 2147483647)) AS h FROM todo),
counts AS (SELECT article_id, h % {DIMS} AS dim, sum(1 - 2 * (h // {DIMS} % 2)) AS n FROM grams GROUP BY 1, 2),
encoded AS (SELECT t.article_id, r.dim, CAST(CASE WHEN l.len = 0 THEN CASE WHEN r.dim = 0 THEN 1 ELSE 0 END ELSE coalesce(c.n, 0) / sqrt(CAST(l.len AS DOUBLE)) END AS FLOAT) AS value
    FROM todo t CROSS JOIN (SELECT unnest(range({DIMS})) AS dim) r LEFT JOIN counts c ON c.article_id = t.article_id AND c.dim = r.dim JOIN (SELECT article_id, sum(n * n) AS len FROM counts GROUP BY 1) l ON l.article_id = t.article_id)"""


def _components(vecs: DataFrame) -> DataFrame:
    return vecs.select("article_id", "model", F.posexplode("embedding").alias("dim", "value")).select("article_id", "model", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


@query(f"""WITH {_ENCODED_SQL} SELECT article_id, 'trigrams/64' AS model, CAST(dim AS INT) AS dim, round(CAST(value AS DOUBLE), 6) AS value FROM encoded""")
def embed_job(spark: SparkSession, sf: str) -> DataFrame:
    """The queued vectors of visible articles, component by component."""
    queue = S.vectors(spark, sf)
    made = vectors.embed_job(vectors.join_queue_articles(queue, S.documents(spark, sf)), lambda: vectors.ngram_encoder(DIMS))
    good, _ = vectors.valid_vectors(made.withColumn("model", F.lit("trigrams/64")), "trigrams/64", DIMS)
    return _components(merge.save_vectors(queue, good, "trigrams/64", AS_OF).where("model = 'trigrams/64'"))


@query(f"""WITH {_ENCODED_SQL}, e AS (SELECT article_id, CAST(dim AS INT) AS dim, round(CAST(value AS DOUBLE), 6) AS value FROM encoded)
    SELECT article_id, 'trigrams/64' AS model, dim, value FROM e
    UNION ALL SELECT article_id, model, NULL, NULL FROM vecs WHERE article_id NOT IN (SELECT article_id FROM e)""")
def stream_embed(spark: SparkSession, sf: str) -> DataFrame:
    """The whole queue drained by one request, in a table merged on read; rows that were not embedded come without components."""
    path = fresh_path(spark, "stream-embed")
    table = ChangeTable(spark, f"{path}/vectors", ["article_id"])
    table.save(S.vectors(spark, sf))
    # One request: the regions make one row of it, so the stream has one micro-batch.
    asked = spark.readStream.schema(spark.read.parquet(f"{sf}/region.parquet").schema).parquet(f"{sf}/region.parque[t]")
    waiting = table.read().where("embedding IS NULL").count()
    jobs.stream_embed(asked, lambda: S.documents(spark, sf), table, lambda: vectors.ngram_encoder(DIMS), "trigrams/64", DIMS, f"{path}/checkpoint", AS_OF, waiting).awaitTermination()
    after = table.read()
    rest = after.where("NOT model <=> 'trigrams/64'").select("article_id", "model", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("double").alias("value"))
    return _components(after.where("model = 'trigrams/64'")).unionByName(rest)


@query(f"""WITH {S.VECTORS_SQL} SELECT article_id, CASE WHEN model = 'model/a' THEN model END AS model, embedding IS NOT NULL AND model = 'model/a' AS filled FROM vecs""")
def switch_model(spark: SparkSession, sf: str) -> DataFrame:
    out = merge.switch_model(S.vectors(spark, sf), "model/a")
    return out.select("article_id", "model", F.col("embedding").isNotNull().alias("filled"))


@query(f"""WITH {S.VECTORS_SQL} SELECT article_id, CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i <= 32 THEN CAST(2 ^ (i - 1) AS BIGINT) ELSE 0 END)) AS BIGINT) AS low,
    CAST(list_sum(list_transform(embedding, lambda x, i: CASE WHEN x > 0 AND i > 32 THEN CAST(2 ^ (i - 33) AS BIGINT) ELSE 0 END)) AS BIGINT) AS high FROM vecs WHERE embedding IS NOT NULL""")
def binary_quantise_codes(spark: SparkSession, sf: str) -> DataFrame:
    code = binary_quantise(F.col("embedding"), DIMS)[0]
    half = F.lit((1 << 32) - 1)
    rows = S.vectors(spark, sf).where("embedding IS NOT NULL").select("article_id", code.alias("c"))
    return rows.select("article_id", F.col("c").bitwiseAND(half).alias("low"), F.shiftrightunsigned("c", 32).alias("high"))


#: The stated query set: visible vectors whose id is divisible by 20. Codes as 64 signs, compared sign by sign.
_SEARCH_SQL = f"""{S.VECTORS_SQL}, {S.DOCS_SQL}, seen AS MATERIALIZED (SELECT article_id, CAST(embedding AS DOUBLE[]) AS v, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c, title
    FROM vecs JOIN docs ON id = article_id WHERE embedding IS NOT NULL AND hidden_at IS NULL),
pairs AS MATERIALIZED (SELECT q.article_id AS query_id, b.article_id, b.title, list_cosine_similarity(q.v, b.v) AS score, 64 - CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(b.c AS DOUBLE[])) AS INT)
    - CAST(list_dot_product(list_transform(q.c, lambda x: CAST(1 - x AS DOUBLE)), list_transform(b.c, lambda x: CAST(1 - x AS DOUBLE))) AS INT) AS far
    FROM seen q JOIN seen b ON q.article_id % 20 = 0 AND q.article_id <> b.article_id),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY far, article_id) <= 500),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, article_id) AS rank FROM near QUALIFY rank <= 20),
exact AS (SELECT query_id, article_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, article_id) AS rank FROM pairs QUALIFY rank <= 20)"""


def _search(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits with article columns, queries, the vectors of visible articles)."""
    docs = S.documents(spark, sf)
    seen = materialise(S.vectors(spark, sf).where("embedding IS NOT NULL").join(visible_only(docs).select(F.col("id").alias("article_id")), "article_id", "left_semi").select("article_id", "embedding"), "searchable")
    coded = vectors.with_codes(seen, DIMS)
    index = vectors.code_index(coded, fresh_path(spark, "code-index"), bits=4)
    queries = seen.where("article_id % 20 = 0").select(F.col("article_id").alias("query_id"), "embedding")
    return vectors.search_many(coded, index, queries, docs, bits=4), queries, seen


@query(f"WITH {_SEARCH_SQL} SELECT query_id, article_id, title, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM hits")
def search_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    """500 candidates by sign code through the stored index, re-ranked, with the articles' columns."""
    return _search(spark, sf)[0].select("query_id", "article_id", "title", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_SEARCH_SQL} SELECT round(avg(CASE WHEN h.article_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM exact e LEFT JOIN hits h USING (query_id, article_id)")
def search_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the true 20 nearest that the two stages find."""
    hits, queries, seen = _search(spark, sf)
    exact = vectors.knn_join(queries, seen.withColumnRenamed("article_id", "id"), 20, exclude_self=True)
    return vectors.recall_at_k(hits.select("query_id", F.col("article_id").alias("id"), "rank"), exact.select("query_id", "id"), 20).withColumn("recall", F.round("recall", 6))


def _knn(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    queries = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")  # the stated query set
    return vectors.knn_join(queries, e, 5, exclude_self=True), e


_KNN_SQL = """e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
k AS (SELECT * FROM (SELECT q.id AS query_id, b.id, list_cosine_similarity(q.v, b.v) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.v, b.v), 12) DESC, b.id) AS rank
    FROM e q JOIN e b ON q.id % 20 = 0 AND q.id <> b.id) WHERE rank <= 5)"""


@query(f"WITH {_KNN_SQL} SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM k")
def knn_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf)[0].withColumn("score", F.round("score", 6))


@query(f"WITH {_KNN_SQL} SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT k.query_id, bool_or(a.label = b.label) AS hit FROM k JOIN e a ON a.id = k.query_id JOIN e b ON b.id = k.id GROUP BY 1)")
def knn_recall(spark: SparkSession, sf: str) -> DataFrame:
    near, e = _knn(spark, sf)
    near = materialise(near, "knn-near")  # read twice
    labels = e.select("id", "label")
    first = near.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    # One expected id a query: the best neighbour of its label, or the query itself, which is never found.
    want = first.groupBy("query_id").agg(F.coalesce(F.min_by(F.when(F.col("label") == F.col("wanted"), F.col("id")), F.when(F.col("label") == F.col("wanted"), F.col("rank"))), F.col("query_id")).alias("id"))
    return vectors.recall_at_k(near, want, 5).withColumn("recall", F.round("recall", 6))
