"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, filter_audit, line_quality, lm_score, nn_descent, packing, pii, secret_scan, simhash, token_align, toxicity, warc
from tidemark.sources.shared import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def span_digest(spans: str, kinds: tuple[str, ...]) -> F.Column:
    """Lowercase hex of kind:start:end, comma-joined, for the spans of `kinds` in their order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.sha2(span_text(chosen), 256)


def span_text(spans: F.Column | str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op1_trigram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_backoff_score under the name it had while that one scored bigrams."""
    return op1_backoff_score(spark, sf_dir)


def op2_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in pii.KINDS),
        F.sha2(span_text(pii.by_kind(F.col("base"))), 256).alias("base_sha256"),
        span_text(pii.by_kind(F.concat("base", "added"))).alias("spans"),
    )


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    made = chat.format_conversations(chat.as_messages(turns.unionByName(extra)))
    back = made.select(
        F.col("tree").alias("conv_id"), chat.read_back(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), "loss").alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_quality.verdicts(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "words_left", F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("lines_removed"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in secret_scan.BASE_RULES)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in base), span_digest("secrets", base).alias("base_sha256"), span_text("secrets").alias("spans"))


def op6_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    # Legacy input of both versions; the converter tells them apart by their version blocks.
    odd = F.pmod(F.coalesce(F.col("page_id").try_cast("bigint"), F.lit(0)), F.lit(2)) == 1
    arcs = [warc.write_arc(pages.where(odd), 1), warc.write_arc(pages.where(~odd), 2)]
    records = materialise(warc.read_warc(spark, warc.convert(spark, arcs)), "warc-records")
    # Only revisits look for the page of their response; all other rows have no key to join on.
    revisits = records.where("refers_id IS NOT NULL")
    wanted = revisits.select(F.col("refers_id").alias("wanted")).distinct()
    firsts = records.where("refers_id IS NULL").join(wanted, F.col("id") == F.col("wanted")).select(F.col("wanted").alias("refers_id"), F.col("key").alias("refers_to"))
    rows = records.where("refers_id IS NULL").withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits.join(firsts, "refers_id", "left"))
    return rows.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("sentences", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("worst"),
    )


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pieces = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))  # the ranks are the vocabulary of byte_bpe_50k.json
    out = token_align.align(_table(spark, sf_dir, "documents"), ranks, pieces)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.neighbours(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_backoff_score, op2_contextual_pii, op3_reply_trees, op4_line_quality, op5_secret_scan,
        op6_nnls_packing, op7_arc_to_warc, op8_toxic_sentences, op9_simhash_groups, op10_decontamination, op1_trigram_score,
        op11_token_alignment, op12_nn_descent, op13_filter_audit,
    )
}

#: Words of a text: A-Z lowered or not, cut at ASCII white space, no empty ones.
def _words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '[ \x09-\x0D]+'), lambda x: x <> '')"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_backoff_score": f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words_sql(_LOWER)} AS ws FROM documents),
        uni AS MATERIALIZED (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs),
        tri AS MATERIALIZED (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS p, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS q FROM uni),
        c1 AS MATERIALIZED (SELECT w, count(*) AS n FROM uni GROUP BY w),
        c2 AS MATERIALIZED (SELECT p, w, count(*) AS n FROM tri WHERE p IS NOT NULL GROUP BY p, w),
        c3 AS MATERIALIZED (SELECT q, p, w, count(*) AS n FROM tri WHERE q IS NOT NULL GROUP BY q, p, w),
        total AS (SELECT count(*) AS n FROM uni),
        one AS (SELECT tri.r, tri.q, c3.n AS n3, c0.n AS n0, tri.p, c2.n AS n2, b.n AS nb, c1.n AS n1, total.n AS n FROM tri CROSS JOIN total JOIN c1 ON c1.w = tri.w
                LEFT JOIN c2 ON c2.p = tri.p AND c2.w = tri.w LEFT JOIN c1 b ON b.w = tri.p
                LEFT JOIN c3 ON c3.q = tri.q AND c3.p = tri.p AND c3.w = tri.w LEFT JOIN c2 c0 ON c0.p = tri.q AND c0.w = tri.p),
        scored AS (SELECT r, CASE WHEN q IS NOT NULL AND n3 >= 2 THEN ln(n3 / n0)
                         ELSE CASE WHEN q IS NOT NULL THEN ln(0.4) ELSE 0 END
                              + CASE WHEN p IS NOT NULL AND n2 >= 2 THEN ln(n2 / nb) ELSE CASE WHEN p IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(n1 / n) END END AS s FROM one)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(sum(s), 0), 4) AS log_score
        FROM docs LEFT JOIN scored USING (r) GROUP BY r, doc_id, ws""",
    "op3_reply_trees": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, regexp_replace(regexp_replace(text, '(<)(\\*)(\|im_(?:start|end)\|>|/?s>)', '\1\\\2\3', 'g'),
                                       '(\[)(\\*)(/?INST\])', '\1\\\2\3', 'g') AS body FROM t)
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(body) + 24) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op4_line_quality": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('h:' || source, '-') AS host, coalesce(text, '') AS text,
                   {_words_sql("text")} AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        f AS MATERIALIZED (SELECT r, doc_id, host, text, ws, list_filter(ls, lambda x: regexp_matches(x, '[^ \\x09-\\x0D]')) AS ls,
                   list_transform(range(1, len(ws) - 3), lambda i: list_aggregate(ws[i:i+4], 'string_agg', ' ')) AS wins FROM d),
        win AS MATERIALIZED (SELECT r, unnest(wins) AS w, generate_subscripts(wins, 1) AS i FROM f),
        dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM win) WHERE n > 1),
        cov AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
        sk AS MATERIALIZED (SELECT f.r, CASE WHEN len(wins) > 0 THEN list_sort(list_distinct(list_transform(wins, lambda x: md5(x))))[1:32] ELSE [md5(text)] END AS s FROM f),
        ln AS MATERIALIZED (SELECT r, host, trim(regexp_replace(lower(l), '[ \\x09-\\x0D]+', ' ', 'g')) AS l FROM (SELECT r, host, unnest(ls) AS l FROM f)),
        per AS MATERIALIZED (SELECT host, l, s, count(DISTINCT r) AS n FROM ln JOIN sk USING (r) GROUP BY host, l, s),
        many AS MATERIALIZED (SELECT host, l, arg_max(s, n) AS lead FROM per GROUP BY host, l HAVING count(*) > 20),
        freq AS (SELECT host, l FROM per JOIN many USING (host, l) WHERE len(list_intersect(s, lead)) < 0.8 * greatest(len(s), len(lead)) GROUP BY host, l HAVING count(*) + 1 > 20),
        gone AS (SELECT r, sum(len(string_split(l, ' '))) AS n, count(DISTINCT l) AS k FROM ln JOIN freq USING (host, l) GROUP BY r),
        base AS (SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS word_chars,
                   CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                   CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM f)
        SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
               (n_words < 10 OR 100 * coalesce(cov.n, 0) > 20 * n_words) AS base_failed,
               NOT (n_words < 10 OR 100 * coalesce(cov.n, 0) > 20 * n_words) AND n_words - coalesce(gone.n, 0) >= 10
                   AND n_words - coalesce(gone.n, 0) >= 0.3 * n_words AS kept,
               CAST(n_words - coalesce(gone.n, 0) AS BIGINT) AS words_left, CAST(coalesce(gone.k, 0) AS BIGINT) AS lines_removed
        FROM base LEFT JOIN cov USING (r) LEFT JOIN gone USING (r)""",
    "op7_arc_to_warc": """
        WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
        k AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
        FROM k""",
    "op13_filter_audit": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_words_sql("text")} AS ws FROM documents),
        firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        f AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(d.doc_id > first, false)] AS fails
            FROM d JOIN firsts USING (text) LEFT JOIN l USING (doc_id)),
        cells AS MATERIALIZED (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
        x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        steps AS MATERIALIZED (SELECT o, s.i AS step, o[s.i] AS own, o[1:s.i - 1] AS before FROM orders, x s),
        j AS MATERIALIZED (SELECT part, o, step, own, n, good, toxic, fails[own] AS hit, len(list_filter(before, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda y: y)) AS k FROM cells, steps),
        r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS removed,
                   coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (WHERE hit AND k = 1), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0) AS toxic_lost FROM j GROUP BY part, o, step, own)
        SELECT part, array_to_string(list_transform(o, lambda k: chr(CAST(64 + k AS INT))), '') AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
}
ORACLE_SQL["op1_trigram_score"] = ORACLE_SQL["op1_backoff_score"]
