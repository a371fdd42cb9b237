"""Near copies: groups of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two places. SimHash fingerprints of the shingles are linked at 3 bits through the vantage-point trees; a linked group is
a bucket. As two texts at a similarity of 0.8 differ in about 10 of 64 bits, a radius that catches them all would join everything, so every set of
shingles also has `BANDS` keys, each made of `ROWS` min-hashes: two sets of similarity s share one with probability
1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8, 0.22 at 0.4. Buckets with the same members are taken once.

Links: buckets that share a member are one cluster, found on ids alone. A cluster of up to `leaf_rows` texts and `leaf_words` shingles, whose product is
at most CLUSTER_WORK, is compared as one task, so its texts are moved once, however many bands they share. In a larger cluster each bucket is a task; one
above `leaf_rows` or `leaf_words` is cut into chunks by either measure, and every pair of chunks is a task of its own. Sets are compared exactly, so a shared template, passage or band never joins clean
documents. Tasks report a spanning star of each group; groups are merged by star contraction. Equal sets collapse before any of this.

Words are cut and lowered as for fingerprints; a text of fewer than five words is one shingle, and texts without words are equal.

Defined results: a null doc_id, or one that is no integer, links nothing and stays; rows that repeat an id are one document; null text is empty;
texts of any length are read whole; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lm_score import _mix, _ngrams
from tidemark.llm.simhash import _edges, components, near_links, one_of_each
from tidemark.llm.sizes import sent_if_small
from tidemark.sources.shared import materialise

SIZE = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 5
_SEEDS = tuple(np.uint64(xxhash.xxh64_intdigest(f"minhash-{i}".encode()) | 1) for i in range(BANDS * ROWS))
#: Bytes of text that are hashed at a time.
_SLICE = 2_000_000
#: Texts times shingles of a cluster that one task compares: what it would cost if no two of them were alike.
CLUSTER_WORK = 200_000_000


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    n, _, keys = _ngrams(texts, SIZE)
    out, at = [], 0
    for k in n.tolist():
        size = min(k, SIZE)
        out.append(np.unique(keys[size - 1][at + size - 1 : at + k]) if k else np.zeros(0, np.uint64))
        at += k
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys; no set is empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b, np.uint64)
        for seed in _SEEDS[b * ROWS : (b + 1) * ROWS]:
            key = _mix(key, np.minimum.reduceat(flat * seed, starts))
        keys[:, b] = key
    return keys


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set: a bit is set if more than half of its shingles have it; no set is empty."""
    flat = np.concatenate(sets).astype(">u8").view(np.uint8).reshape(-1, 8)
    starts, sizes = np.cumsum([0, *(len(s) for s in sets[:-1])]), np.array([len(s) for s in sets])
    out = np.zeros((len(sets), 8), np.uint8)
    for k in range(8):
        ones = np.add.reduceat(np.unpackbits(flat[:, k, None], axis=1), starts, axis=0, dtype=np.int64)
        out[:, k] = np.packbits(2 * ones > sizes[:, None], axis=1)[:, 0]
    return out.view(">u8").ravel().astype(np.uint64)


def _slices(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or b"")
        if size >= _SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def sketches(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, same (hash of the set of shingles), size (of the set), fp (SimHash), bands. Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            for texts in _slices(whole.column(1).cast(pa.binary()).to_pylist()):
                sets = shingle_sets(texts)
                same = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                full = np.array([len(s) > 0 for s in sets])
                some = [s for s in sets if len(s)]
                fp, keys = np.zeros(len(sets), np.uint64), np.zeros((0, BANDS), np.uint64)
                if some:
                    fp[full], keys = fingerprints_of(some), band_keys(some)
                ends = np.r_[0, np.cumsum(full * BANDS)].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                size = pa.array([len(s) for s in sets], pa.int64())
                cols = [whole.column(0).slice(at, len(sets)), pa.array(same), size, pa.array(fp.view(np.int64)), bands]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "same", "size", "fp", "bands"])
                at += len(sets)

    src = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, same bigint, size bigint, fp bigint, bands array<bigint>")


def _stars(sets: list[np.ndarray], ids: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """A spanning star of each group of similar sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sets, ids, sizes = [sets[i] for i in order], ids[order], sizes[order]
    flat, ends = np.concatenate(sets), np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(sets)), sizes)
    free = np.ones(len(sets), bool)
    edges: list[tuple[int, int]] = []
    for start in range(len(sets)):
        if not free[start]:
            continue
        free[start] = False
        group, queue = [start], [start]
        while queue:
            q = queue.pop()
            # Sets of other sizes cannot be similar.
            lo, hi = np.searchsorted(sizes, (similar * sizes[q] - 1e-9, sizes[q] / similar + 1e-9))
            if not free[lo:hi].any():
                continue
            part = flat[ends[lo] : ends[hi]]
            hit = sets[q][np.minimum(np.searchsorted(sets[q], part), sizes[q] - 1)] == part
            both = np.bincount(owner[ends[lo] : ends[hi]] - lo, hit, minlength=hi - lo)
            near = lo + np.flatnonzero(free[lo:hi] & (both >= similar * (sizes[q] + sizes[lo:hi] - both) - 1e-9))
            free[near] = False
            queue += near.tolist()
            group += near.tolist()
        if len(group) > 1:
            root = int(ids[group].min())
            edges += [(root, int(i)) for i in ids[group] if i != root]
    return edges


def _leaf(similar: float):
    def fn(table: pa.Table) -> pa.Table:
        sets = shingle_sets(table.column("text").cast(pa.binary()).to_pylist())
        return pa.Table.from_batches([_edges(_stars(sets, table.column("id").to_numpy(), similar))])

    return fn


def similar_links(docs: DataFrame, sets: DataFrame, points: DataFrame, similar: float = SIMILAR, leaf_rows: int = 1024, leaf_words: int = 4_000_000) -> DataFrame:
    """Edges (u, v) that span every group of similar texts. `docs`: doc_id, text; `sets`: sketches; `points`: same, size, fp, id."""
    prints = materialise(points.select(F.col("fp").alias("id"), "fp").distinct(), "prints")
    groups = components(near_links(prints))
    by_print = points.join(groups, points["fp"] == groups["node"], "left").select("same", "size", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("bucket"))
    placed = materialise(sets.select("same", "size", F.explode("bands").alias("bucket")).union(by_print).distinct(), "placed")
    buckets = placed.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.bit_xor(F.xxhash64("same")).alias("all"), F.min("same").alias("lo"), F.max("same").alias("hi")
    )
    once = buckets.where("n > 1").groupBy("n", "words", "all", "lo", "hi").agg(F.min("bucket").alias("bucket"))
    k = F.greatest(F.ceil(F.col("n") / leaf_rows), F.ceil(F.col("words") / leaf_words)).cast("int")
    once = materialise(once.select("bucket", "lo", k.alias("k")), "buckets")
    member = materialise(placed.join(once, "bucket").select("same", "size", "bucket", "lo", "k"), "bucket-members")

    clusters = materialise(components(member.select(F.col("same").alias("u"), F.col("lo").alias("v"))), "clusters")
    within = clusters.join(points, clusters["node"] == points["same"]).select("root", "same", "size", "id")
    sizes = within.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    large = materialise(sizes.where((F.col("n") > leaf_rows) | (F.col("words") > leaf_words) | (F.col("n") * F.col("words") > CLUSTER_WORK)).select("root"), "large-clusters")
    whole = within.join(large, "root", "left_anti").select(F.xxhash64(F.lit("cluster"), "root").alias("task"), "id")
    rest = within.join(large, "root", "left_semi").select("same", "id")
    mine = F.pmod(F.xxhash64("same"), F.col("k")).cast("int")
    # Chunk c meets every chunk: tasks (min, max) of c and each of 0..k-1.
    tasks = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.xxhash64("bucket", F.least(mine, j), F.greatest(mine, j)))
    cut = member.select("same", F.explode(tasks).alias("task")).join(rest, "same").select("task", "id")
    dealt = materialise(whole.union(cut).groupBy("id").agg(F.collect_set("task").alias("tasks")), "similar-tasks")
    # Where the list of ids may be broadcast, a text is moved once, to its task.
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    if not sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        texts = texts.distinct()
    sent = texts.join(sent_if_small(dealt, F.lit(3) + F.size("tasks")), "id").select("id", "text", F.explode("tasks").alias("task"))
    return sent.groupBy("task").applyInArrow(_leaf(similar), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", similar: float = SIMILAR, **limits) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable over links, itself included), for rows with an id."""
    src = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    sets = materialise(sketches(src), "sketches")
    points = materialise(sets.groupBy("same", "size", "fp").agg(F.min("doc_id").alias("id")), "points")
    joined = components(similar_links(src, sets, points, similar, **limits))
    classes = points.join(joined, points["id"] == joined["node"], "left").select("same", F.coalesce("root", "id").alias("component_id"))
    return sets.select("doc_id", "same").join(classes, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """`docs` with one row of each group of near copies: that of the smallest doc_id."""
    return one_of_each(docs, near_duplicates(docs, text_col, **limits), text_col)
