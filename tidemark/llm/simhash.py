"""SimHash fingerprints and exact near-duplicate groups through vantage-point shards.

Fingerprint: A-Z lowered, words without ASCII white space, three-word shingles with repeats,
XXH64 (seed 42) of each; a bit is set if more than half of the hashes have it.

Links (at most `radius` differing bits) are found exactly, by vantage-point trees. Distances between unrelated 64-bit fingerprints crowd
around 32, so the triangle bound prunes little on whole fingerprints; the trees are laid over radius // 2 + 1 projections instead (two
of 32 bits for 3), one of which holds two linked fingerprints at most one bit apart (pigeonhole). At every level of a tree a vantage
point parts the points of a node by their Hamming distance to it. A point is stored in one leaf. By the triangle inequality the ball of one
bit around it overlaps only branches whose distance differs by one at most; the point asks in each of those that its ball enters, which the flipped
bit tells (plus or minus one at each level), so boundary-overlapping shards get it too. Of two points a bit apart, the one whose bit is
clear asks. In a leaf every row is compared with the stored points by popcount, within the stretch that the triangle bound to a pivot leaves.

Depth follows the counts: the first levels from the number of distinct fingerprints, and every node above `leaf_rows` rows goes on down, `step`
levels at a time. What `max_depth` levels cannot part (points alike on a projection) is cut into chunks, and every pair of chunks is a task
of its own. Leaves report a spanning star of each group, never all pairs. Copies collapse before any of this: one row per distinct
fingerprint. Groups are merged by alternating star contraction on tables in the shared folder.

Defined results: null or wordless text has fingerprint zero, linked like any other; a null doc_id
takes part in links but is never a component id while an id is reachable (null if none is); a doc_id that is no integer becomes null;
ids are any 64-bit number; repeated rows share their fingerprint and component; texts of any length are read whole; an empty table
gives an empty result; other columns are ignored by `near_duplicates` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lm_score import _mix
from tidemark.llm.sizes import sent_if_small
from tidemark.sources.shared import materialise

SEED = 42


def fingerprint(text: bytes | None, size: int = 3) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < size:
        digests = [xxhash.xxh64_digest(b" ".join(words), seed=SEED)]
    else:
        digests = [xxhash.xxh64_digest(b" ".join(words[i : i + size]), seed=SEED) for i in range(len(words) - size + 1)]
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(raw[i : i + 65536], axis=1).sum(axis=0, dtype=np.int64) for i in range(0, len(raw), 65536))
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). Narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    src = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id bigint, fp bigint")


def _flips(width: int) -> np.ndarray:
    """The balls' other points: one flipped bit each. Of two points a bit apart one has it clear, and that one asks."""
    return np.uint64(1) << np.arange(width, dtype=np.uint64)


def _trees(radius: int) -> int:
    """Projections such that two fingerprints within `radius` bits are within one bit on one of them."""
    return radius // 2 + 1


def _project(fps: np.ndarray, tree: int, trees: int) -> np.ndarray:
    lo, hi = 64 * tree // trees, 64 * (tree + 1) // trees
    return (fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)


def _vantage(tree: int, level: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"vantage-{tree}-{level}".encode(), seed=SEED))


def _descend(node: np.ndarray, points: np.ndarray, tree: int, trees: int, levels: range) -> np.ndarray:
    """The node each projected point reaches from `node` through `levels` of its tree."""
    width = 64 * (tree + 1) // trees - 64 * tree // trees
    for level in levels:
        distance = np.bitwise_count(points ^ (_vantage(tree, level) & np.uint64((1 << width) - 1)))
        node = _mix(node, distance.astype(np.uint64) + np.uint64(1))
    return node


def _deal(trees: int, depth: int):
    """(fp, id) to one row for every branch of every tree that its ball overlaps: that of the point itself (stored there), and
    those of the points a bit away (which ask there). `flips` tells which bits lead into a branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 2048):
                b = whole.slice(at, 2048)
                fps, ids = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
                for tree in range(trees):
                    mine = _project(fps, tree, trees)
                    start = np.full(len(fps), tree, np.uint64)
                    own = _descend(start, mine, tree, trees, range(depth))
                    flips = _flips(64 * (tree + 1) // trees - 64 * tree // trees)
                    row, bit = np.nonzero((mine[:, None] & flips) == 0)
                    node = _descend(start[row], mine[row] | flips[bit], tree, trees, range(depth))
                    # The triangle bound leaves few branches near the root: bits that lead into one are one row.
                    order = np.lexsort((node, row))
                    row, node, bit = row[order], node[order], bit[order]
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (node[1:] != node[:-1])][: len(row)])
                    mask = np.bitwise_or.reduceat(np.uint64(1) << bit.astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
                    row, node = row[first], node[first]
                    yield _rows(
                        np.r_[own, node], np.r_[np.arange(len(fps)), row], fps, ids, np.full(len(fps) + len(row), tree, np.int32),
                        np.r_[np.zeros(len(fps), np.uint64), mask], np.r_[np.ones(len(fps), bool), np.zeros(len(row), bool)],
                    )

    return run


_PLACED = "node bigint, fp bigint, id bigint, tree int, flips bigint, stored boolean"


def _rows(node: np.ndarray, row: np.ndarray, fps: np.ndarray, ids: np.ndarray, tree: np.ndarray, flips: np.ndarray, stored: np.ndarray) -> pa.RecordBatch:
    cols = [node.view(np.int64), fps[row].view(np.int64), ids[row], tree, flips.view(np.int64), stored]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in _PLACED.split(", ")])


def _deepen(trees: int, levels: range):
    """Rows of nodes that hold too many, moved down by `levels`; a row that asks splits by the bits that stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                node, fps, ids, tree, flips, stored = (c.to_numpy(zero_copy_only=False) for c in whole.slice(at, 4096).columns)
                node, fps, flips = node.view(np.uint64), fps.view(np.uint64), flips.view(np.uint64)
                for t in np.unique(tree).tolist():
                    on = np.flatnonzero((tree == t) & stored)
                    below = _descend(node[on], _project(fps[on], t, trees), t, trees, levels)
                    yield _rows(below, on, fps, ids, tree[on], flips[on], stored[on])
                    ask = np.flatnonzero((tree == t) & ~stored)
                    bits = _flips(64 * (t + 1) // trees - 64 * t // trees)
                    row, bit = np.nonzero(flips[ask][:, None] & bits)
                    row = ask[row]
                    below = _descend(node[row], _project(fps[row], t, trees) | bits[bit], t, trees, levels)
                    order = np.lexsort((below, row))
                    row, below, bit = row[order], below[order], bit[order]
                    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (below[1:] != below[:-1])][: len(row)])
                    mask = np.bitwise_or.reduceat(np.uint64(1) << bit.astype(np.uint64), first) if len(first) else np.zeros(0, np.uint64)
                    yield _rows(below[first], row[first], fps, ids, tree[row[first]], mask, stored[row[first]])

    return run


def _spanning(fps: np.ndarray, ids: np.ndarray, stored: int, radius: int) -> list[tuple[int, int]]:
    """Edges that span every group linked inside one leaf; the first `stored` rows live there, the others ask.

    Stored points are in the order of their distance to a pivot, so the triangle bound names the stretch of them that a point can be near to.
    """
    pivot = np.bitwise_count(fps ^ fps[0]).astype(np.int16)
    order = np.r_[np.argsort(pivot[:stored], kind="stable"), stored + np.argsort(pivot[stored:], kind="stable")]
    fps, ids, pivot = fps[order], ids[order], pivot[order]
    label = np.arange(len(fps))
    step = max(1, (1 << 22) // max(1, stored))
    linked = False
    for a in range(0, len(fps), step):
        part = slice(a, a + step)
        lo, hi = np.searchsorted(pivot[:stored], (pivot[part].min() - radius, pivot[part].max() + radius + 1))
        i, j = np.nonzero(np.bitwise_count(fps[part, None] ^ fps[None, lo:hi]) <= radius)
        i, j = i + a, j + lo
        i, j = i[i != j], j[i != j]
        linked |= len(i) > 0
        while len(i):
            # Hook the larger root to the smaller, then let every point see its root.
            np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
            while not np.array_equal(label, label := label[label]):
                pass
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    if not linked:
        return []
    group = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
    return [(u, v) for u, v in zip(ids[label[group]].tolist(), ids[group].tolist(), strict=True) if u != v]


def _leaf_links(radius: int):
    def links(task: np.ndarray, fps: np.ndarray, ids: np.ndarray, stored: np.ndarray) -> list[tuple[int, int]]:
        edges: list[tuple[int, int]] = []
        cuts = np.flatnonzero(np.diff(task)) + 1
        many = np.add.reduceat(stored, np.r_[0, cuts], dtype=np.int64)
        for a, b, k in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(task)].tolist(), many.tolist(), strict=True):
            if k and b - a > 1:
                edges += _spanning(fps[a:b], ids[a:b], k, radius)
        return edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols, strict=True)]
            # The last leaf may go on in the next batch.
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            rest = [c[cut:] for c in cols]
            if cut:
                yield _edges(links(cols[0][:cut], cols[1][:cut].view(np.uint64), cols[2][:cut], cols[3][:cut]))
        if rest is not None and len(rest[0]):
            yield _edges(links(rest[0], rest[1].view(np.uint64), rest[2], rest[3]))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    arr = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(arr[:, 0]), pa.array(arr[:, 1])], names=["u", "v"])


def near_links(points: DataFrame, radius: int = 3, leaf_rows: int = 4096, step: int = 3, max_depth: int = 24) -> DataFrame:
    """Edges that span every group of points (fp, id) linked within `radius` bits. Ids and fingerprints are distinct."""
    trees = _trees(radius)
    # Levels for an even spread: each level of a tree tells about four ways apart.
    n = points.count()
    depth = min(max_depth, max(1, math.ceil(math.log(max(1.0, 12 * n / leaf_rows), 4))))
    placed = materialise(points.select("fp", "id").mapInArrow(_deal(trees, depth), _PLACED), "vantage-rows")
    leaves = []
    while True:
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.count_if("stored").alias("own"))
        large = materialise(sizes.where((F.col("n") > leaf_rows) & (F.col("own") > 0)), "large-nodes")
        deeper = depth < max_depth and not large.isEmpty()
        if not deeper:
            break
        leaves.append(placed.join(large, "node", "left_anti"))
        below = placed.join(large.select("node"), "node").select(*placed.columns)
        placed = materialise(below.mapInArrow(_deepen(trees, range(depth, min(max_depth, depth + step))), _PLACED), "vantage-rows")
        depth = min(max_depth, depth + step)
    # What no depth parts (many points alike on a projection) is cut into chunks: of the points stored there, each chunk meets
    # every chunk of the leaf's rows in a task of its own.
    mine = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    cut = large.select("node", F.ceil(F.col("n") / leaf_rows).cast("int").alias("k"))
    rows = placed.join(cut, "node", "left")
    each = F.sequence(F.lit(0), F.col("k") - 1)
    pairs = F.transform(each, lambda j: F.struct(F.xxhash64("node", F.least(mine, j), F.greatest(mine, j)).alias("task"), (F.col("stored")).alias("stored")))
    tasks = F.when(F.col("k").isNull(), F.array(F.struct(F.col("node").alias("task"), "stored"))).otherwise(pairs)
    last = rows.select(F.explode(tasks).alias("t"), "fp", "id").select("t.task", "fp", "id", "t.stored")
    dealt = last
    for leaf in leaves:
        dealt = dealt.unionByName(leaf.select(F.col("node").alias("task"), "fp", "id", "stored"))
    shards = dealt.repartition("task").sortWithinPartitions("task", F.desc("stored"))
    return shards.mapInArrow(_leaf_links(radius), "u bigint, v bigint").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest id of its component.

    Alternating large-star and small-star steps; each round is a table in the shared folder.
    """
    now = materialise(edges.where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, text_col: str = "text", radius: int = 3, **limits) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links, itself included)."""
    fps = materialise(fingerprints(docs, text_col), "fingerprints")
    # Fingerprints are the nodes, so ids keep their whole range; nulls are left out by min().
    points = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    joined = components(near_links(points.select("fp", F.col("fp").alias("id")), radius, **limits))
    root = points.join(joined, points["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    root = materialise(root, "roots")
    ids = root.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialise(root.join(ids, "root").select("fp", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """`docs` with one row of each near-duplicate group: that of the smallest doc_id. Rows with a null id always stay."""
    return one_of_each(docs, near_duplicates(docs, text_col, **limits).select("doc_id", "component_id"), text_col)


def one_of_each(docs: DataFrame, classes: DataFrame, text_col: str) -> DataFrame:
    """`docs` without the rows whose class has a smaller id. Of rows that repeat an id one stays: the smallest text of those the class list keeps.

    Only ids that go are joined to the texts, by a broadcast if they are few enough.
    """
    per_id = classes.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    per_id = materialise(per_id.where("n > 1 OR NOT stays"), "ids-to-settle")
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key = F.col(f"c{names.index('doc_id')}").try_cast("bigint")
    gone = materialise(per_id.where("NOT stays").select("doc_id"), "ids-gone")
    gone = sent_if_small(gone)
    left = inner.join(gone, key == gone["doc_id"], "left_anti")
    again = materialise(per_id.where("stays").select("doc_id"), "ids-repeated")
    if not again.isEmpty():
        twice = left.join(again, key == again["doc_id"], "left_semi")
        text = F.col(f"c{names.index(text_col)}")
        first = twice.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*inner.columns), F.struct(text.isNull(), text)).alias("r")).select("r.*")
        left = left.join(again, key == again["doc_id"], "left_anti").unionByName(first)
    return left.toDF(*names)
