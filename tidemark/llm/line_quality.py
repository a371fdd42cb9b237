"""Quality rules with cross-document line frequency. Built-in functions only.

Per text: word and symbol counts, repeated lines, words inside repeated five-word windows.
Across documents: every line is normalised (lower case, white space collapsed) and hashed with
its host; lines found in more than `max_docs` distinct documents of one host are boilerplate and
are removed; a document left with too few words is rejected.

A group of copies must not look like boilerplate to itself, or a whole family of copies would go
before near-duplicate removal can keep one. So documents are counted by family. Each carries a sketch, the `SKETCH` smallest
hashes of its five-word windows. Documents with one sketch are one family, and so are, for a given line, those whose sketch
shares `ALIKE` of its hashes with the sketch that most of the line's documents have. A line is boilerplate if more than `max_docs` families have
it: a template whose documents differ in a fifth of their words counts each of them, and one large family does not shield a line that
many others have too.

Defined results: null text is empty; a null host is a host of its own; repeated rows are one document, as are texts with equal
sketches; texts without five words have their own hash for a sketch; ties between sketches go to the smaller hash; texts of any length are
read whole; an empty table gives an empty result; extra columns are ignored by `verdicts` and kept by `apply`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sizes import BROADCAST_LONGS, sent_if_small
from tidemark.sources.shared import materialise

SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[ \x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SKETCH = 32
ALIKE = 0.8


def _bare(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def _line_key(line: Column, host: Column) -> Column:
    norm = F.regexp_replace(F.lower(_bare(line)), SPACE_CLASS, " ")
    return F.xxhash64(F.coalesce(F.concat(F.lit("h:"), host), F.lit("-")), norm)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: _bare(x) != "")


def text_features(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, the base counts, the line keys with word counts, the sketch."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select("doc_id", F.col(host_col).cast("string").alias("host"), text.alias("text"))
    split = src.select(
        "doc_id", "host", "text",
        F.when(_bare(F.col("text")) == "", F.array().cast("array<string>"))
        .otherwise(F.split(_bare(F.col("text")), SPACE_CLASS)).alias("words"),
        _lines(F.col("text")).alias("lines"),
    )
    # Each word is hashed once; windows are hashes of five hashes.
    hashed = split.select(
        "doc_id", "host", "text", "lines", F.size("words").alias("n_words"), F.transform("words", lambda x: F.xxhash64(x)).alias("w"),
    )
    w = F.col("w")
    windows = F.when(
        F.size(w) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = hashed.select("doc_id", "host", "text", "lines", "n_words", windows.alias("windows"))
    hashed = hashed.withColumn("once", F.array_distinct("windows"))

    # Neighbours in hash order tell which windows repeat; only texts that have any pay for the sort.
    ordered = F.when(
        F.size("once") < F.size("windows"),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    sorted_ = hashed.withColumn("ordered", ordered)
    o = F.col("ordered")
    repeats = F.transform(
        F.filter(o, lambda x, i: (F.get(o, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(o, i + 1)["h"].eqNullSafe(x["h"]))),
        lambda x: x["i"],
    )
    covered = F.aggregate(
        F.array_sort(repeats),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, p: F.struct((s["n"] + p + WINDOW - F.greatest(p, s["end"])).alias("n"), (p + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    line_rows = F.transform(
        "lines",
        lambda x: F.struct(
            _line_key(x, F.col("host")).alias("key"),
            F.size(F.split(_bare(x), SPACE_CLASS)).alias("n"),
        ),
    )
    return sorted_.select(
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        line_rows.alias("line_rows"),
        F.when(F.size("once") > 0, F.slice(F.sort_array("once"), 1, SKETCH)).otherwise(F.array(F.xxhash64("text"))).alias("sketch"),
    )


def frequent_lines(features: DataFrame, max_docs: int = 20) -> DataFrame:
    """Keys of boilerplate lines. Pre-aggregated twice, by (line, sketch) and then by line, so a
    line held by a third of all documents reaches the second shuffle as one row per sketch."""
    once = features.select(
        F.xxhash64("sketch").alias("family"),
        F.explode(F.array_distinct(F.transform("line_rows", lambda x: x["key"]))).alias("key"),
    )
    held = once.groupBy("key", "family").agg(F.count(F.lit(1)).alias("n"))
    lines = held.groupBy("key").agg(F.count(F.lit(1)).alias("families"), F.max(F.struct("n", F.bitwise_not("family").alias("f"))).alias("top"))
    lines = lines.where(F.col("families") > max_docs).select("key", F.bitwise_not("top.f").alias("leader"))
    lines = materialise(lines, "line-leaders")
    held = materialise(held.join(lines, "key").select("key", "family", "leader"), "line-families")
    wanted = held.select("family").union(held.select(F.col("leader").alias("family"))).distinct()
    sketches = features.select(F.xxhash64("sketch").alias("family"), "sketch").join(wanted, "family", "left_semi").dropDuplicates(["family"])
    sketches = materialise(sketches, "line-sketches")
    # Each sketch meets the leaders of its lines, once a pair.
    pairs = held.select("family", "leader").distinct()
    pairs = pairs.join(sketches, "family").join(sketches.select(F.col("family").alias("leader"), F.col("sketch").alias("other")), "leader")
    shared = F.size(F.array_intersect("sketch", "other"))
    strangers = pairs.where(shared < ALIKE * F.greatest(F.size("sketch"), F.size("other"))).select("family", "leader")
    apart = held.join(strangers, ["family", "leader"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return apart.where(F.col("n") + 1 > max_docs).select("key")


def verdicts(
    docs: DataFrame,
    host_col: str = "source",
    max_docs: int = 20,
    min_words: int = 10,
    min_left: float = 0.3,
    max_repeat: float = 0.2,
) -> DataFrame:
    """doc_id, the base columns, `words_left`, `removed` (keys of removed lines), `base_failed`, `kept`.

    The features are written once to the shared folder: texts are read once and never shuffled.
    """
    feats = materialise(text_features(docs, host_col).withColumn("row", F.monotonically_increasing_id()), "line-features")
    # As a written table its size is known when the join is planned: Spark broadcasts it only below its threshold.
    common = materialise(frequent_lines(feats, max_docs), "frequent-lines")
    hits = (
        feats.select("row", F.inline("line_rows"))
        .join(common, "key")
        .groupBy("row")
        .agg(F.sum("n").alias("gone"), F.collect_set("key").alias("removed"))
    )
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > round(100 * max_repeat) * F.col("n_words"))
    return (
        feats.drop("line_rows", "sketch")
        .join(hits, "row", "left")
        .withColumn("words_left", left.cast("bigint"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= min_words) & (left >= min_left * F.col("n_words")))
        .drop("row", "gone")
    )


def apply(docs: DataFrame, host_col: str = "source", text_col: str = "text", broadcast_longs: int = BROADCAST_LONGS, **limits) -> DataFrame:
    """The kept rows of `docs` with boilerplate lines removed and `n_chars` brought up to date.

    Rows with one doc_id share a verdict: kept if any of them is. A null doc_id is an id of its own. The list of documents that change
    (id, verdict, keys of removed lines) is written first and measured: up to BROADCAST_LONGS it goes to the texts, which then are
    not shuffled at all; a larger list meets them in a join that Spark plans, with one shuffle of the texts.
    """
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: F.col(f"c{docs.columns.index(c)}") for c in docs.columns}
    src = inner.select(at["doc_id"].alias("doc_id"), at[host_col].cast("string").alias("host"), at[text_col].alias("text"))
    lines = F.array_distinct(F.flatten(F.collect_list(F.coalesce("removed", F.array().cast("array<bigint>")))))
    found = verdicts(src, "host", **limits).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), lines.alias("removed"))
    # A rejected document needs no keys.
    found = found.where(~F.col("kept") | (F.size("removed") > 0)).withColumn("removed", F.when(F.col("kept"), F.col("removed")))
    found = materialise(found, "changed-documents")
    found = sent_if_small(found, F.lit(4) + F.size(F.coalesce("removed", F.array().cast("array<bigint>"))), broadcast_longs)
    both = inner.join(found, at["doc_id"].eqNullSafe(found["doc_id"]), "left").where(F.coalesce("kept", F.lit(True)))
    removed = F.col("removed")
    clean = F.when(F.size(F.coalesce(removed, F.array().cast("array<bigint>"))) == 0, at[text_col]).otherwise(
        F.array_join(
            F.filter(
                F.split(at[text_col], "\n"),
                lambda x: (_bare(x) == "") | ~F.array_contains(removed, _line_key(x, at[host_col].cast("string"))),
            ),
            "\n",
        )
    )
    new = {text_col: clean}
    if "n_chars" in docs.columns:
        # An untouched text keeps its count.
        size = F.length(clean).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size(F.coalesce(removed, F.array().cast("array<bigint>"))) == 0, at["n_chars"]).otherwise(size)
    return both.select(*(new.get(c, at[c]).alias(c) for c in docs.columns))
