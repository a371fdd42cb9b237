"""Approximate nearest neighbours by inner product: NN-descent builds a neighbour graph, queries walk it greedily.

1. Vectors that are equal are one node. A node has its smallest id as its number and keeps the `members` smallest ids, as more can never be
   among a query's hits; the partial limit of the window runs before the shuffle, so a vector that a third of all rows share is no hot group.
2. Inner product is turned into nearness of unit vectors: a node gets one more component, sqrt(M^2 - |x|^2) with M the greatest norm, and all are
   divided by M; a query gets zero there. The order of inner products stays as it was. The graph holds these vectors as 8-bit codes; what is returned is scored
   in double precision on the original vectors.
3. A list is one row: a node's code, its nearest nodes so far with their codes and scores, and whether each is fresh. Lists begin with the neighbours
   inside short runs of nodes, sorted by the signs of random projections, a few times over.
4. A round of NN-descent is a join of lists with the lists of their entries: v -> u -> w. Each entry of v is a row that carries v's code; it meets
   u's list and proposes to v those w that beat v's worst entry, v to u, and v to those w that are closer to it than u's worst entry is to u. Only paths with a fresh link are compared. The proposals and the lists are
   shuffled by node, sorted, and the best are kept. Rounds end when fewer than `settled` of all links change. A node that is in very many lists is a skewed
   key of the join, which AQE splits; its reverse proposals are cut to the best of each batch before they are shuffled, of which only the best can stay.
5. A search is the same step: a query is a list whose entries, while fresh, are expanded through the graph until hardly any (`settled`) of all
   queries' `breadth` best are fresh. It starts at the query's own node if it has one, and at a bounded set of entry nodes.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or with another dimension than
most have (of equally frequent dimensions, the greatest). A repeated id counts once, with its greatest vector. Ties go to the smaller id. With
fewer candidates than asked for, all are returned. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import materialise

DEGREE = 24
BREADTH = 256
ENTRIES = 64
STARTS = 4
RUN = 64
TREES = 4
PLANES = 24

_LIST = "id bigint, code binary, nbrs array<bigint>, scores array<float>, fresh array<boolean>, codes binary"
_ARROW = pa.schema([("id", pa.int64()), ("code", pa.binary()), ("nbrs", pa.list_(pa.int64())), ("scores", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_())), ("codes", pa.binary())])


class Index(NamedTuple):
    """vectors: id, v of all that take part. nodes: id, embedding, members. lists: the graph. top: greatest norm. dims: components of a vector."""

    vectors: DataFrame
    nodes: DataFrame
    lists: DataFrame
    top: float
    dims: int


# Codes: two float32, the scale and the added component as it is, then one signed byte for each other component.


def encode(vectors: np.ndarray, added: np.ndarray) -> np.ndarray:
    """Rows of bytes."""
    scale = np.maximum(np.abs(vectors).max(axis=1), 1e-30).astype(np.float32) / 127
    head = np.stack([scale, added.astype(np.float32)], axis=1)
    return np.concatenate([head.view(np.uint8), np.round(vectors / scale[:, None]).astype(np.int8).view(np.uint8)], axis=1)


def decode(codes: np.ndarray) -> np.ndarray:
    head = np.ascontiguousarray(codes[:, :8]).view(np.float32)
    return np.concatenate([codes[:, 8:].view(np.int8) * head[:, :1], head[:, 1:]], axis=1)


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """The values of a binary column without nulls as rows of `width` bytes."""
    where = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[where[0] : where[-1]].reshape(-1, width)


def _binary(rows: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive `counts` of rows as one value each."""
    where = np.concatenate([[0], np.cumsum(counts)]) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _lists(ids: np.ndarray, own: np.ndarray | None, counts: np.ndarray, nbrs: np.ndarray, scores: np.ndarray, fresh: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    where = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    code = pa.nulls(len(ids), pa.binary()) if own is None else _binary(own, np.ones(len(ids), np.int64))
    packed = [pa.ListArray.from_arrays(where, pa.array(x, t)) for x, t in ((nbrs, pa.int64()), (scores, pa.float32()), (fresh, pa.bool_()))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), code, *packed, _binary(codes, counts)], schema=_ARROW)


def _best(owner: np.ndarray, nbrs: np.ndarray, scores: np.ndarray, fresh: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner, owners in order, best first, each neighbour once. Ties go to the smaller neighbour and to what is not fresh."""
    order = np.lexsort((fresh, nbrs, owner))
    o, n = owner[order], nbrs[order]
    first = np.ones(len(order), bool)
    first[1:] = (o[1:] != o[:-1]) | (n[1:] != n[:-1])
    order = order[first]
    order = order[np.lexsort((nbrs[order], -scores[order], owner[order]))]
    o = owner[order]
    rank = np.arange(len(o)) - np.searchsorted(o, o)
    return order[rank < k]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, values) of a list column without nulls."""
    where = column.offsets.to_numpy()
    return np.diff(where), column.values.slice(where[0], where[-1] - where[0]).to_numpy(zero_copy_only=False)


def usable_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>): the vectors that take part, one an id."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # a negative zero is a zero
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & usable)
    given = materialise(given.groupBy("id").agg(F.max("v").alias("v")), "vectors")
    dims = given.groupBy(F.size("v").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    return given.where(F.size("v") == F.lit(dims))


def nodes_of(vectors: DataFrame, members: int) -> DataFrame:
    """(id, embedding, members): one row for each distinct vector."""
    hashed = vectors.withColumn("h", F.xxhash64("v"))
    kept = hashed.withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= members)
    return kept.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.element_at("members", 1).alias("id"), F.col("v").alias("embedding"), "members")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows."""
    return _flat(column)[1].reshape(len(column), -1)


def _first_lists(nodes: DataFrame, count: int, top: float, degree: int, seed: int, dims: int) -> DataFrame:
    """Lists from the neighbours inside runs of RUN nodes, sorted by the signs of random projections."""
    planes = np.random.default_rng(seed).standard_normal((PLANES, dims + 1))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            rest = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))
            at = np.concatenate([x, rest[:, None]], axis=1) @ planes.T
            key = ((at > 0) << np.arange(PLANES)[::-1]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(encode(x / top, rest / top), np.ones(len(x), np.int64)), pa.array(key, pa.int64())], names=["id", "code", "key"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, codes = b.column(0).to_numpy(), _rows(b.column(1), dims + 8)
            for a in range(0, len(ids), RUN):
                part, c = ids[a : a + RUN], codes[a : a + RUN]
                unit = decode(c)
                owner, other = np.nonzero(~np.eye(len(part), dtype=bool))
                score = (unit @ unit.T)[owner, other]
                keep = _best(owner, part[other], score, np.ones(len(owner), bool), degree)
                owner, other, score = owner[keep], other[keep], score[keep]
                yield _lists(part, c, np.bincount(owner, minlength=len(part)), part[other], score, np.ones(len(other), bool), c[other])

    width = max(1, count // 50_000)
    placed = nodes.select("id", "embedding").mapInArrow(project, "id bigint, code binary, key bigint")
    return placed.repartitionByRange(width, "key", "id").sortWithinPartitions("key", "id").select("id", "code").mapInArrow(pair, _LIST)


def _merged(rows: DataFrame, k: int, width: int) -> DataFrame:
    """Lists and proposals (lists without a code) of the same id as one list of the k best. Ids without a list of their own go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None

        def settle(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, has = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            codes = _rows(b.column(1).filter(pa.array(has)), width)
            owners, firsts = np.unique(ids[has], return_index=True)
            counts, nbrs = _flat(b.column(2))
            at = np.searchsorted(owners, np.repeat(ids, counts))
            known = (at < len(owners)) & (owners[np.minimum(at, len(owners) - 1)] == np.repeat(ids, counts)) if len(owners) else np.zeros(len(nbrs), bool)
            place = np.flatnonzero(known)
            scores, fresh = _flat(b.column(3))[1], _flat(b.column(4))[1]
            keep = place[_best(at[place], nbrs[place], scores[place], fresh[place], k)]
            return _lists(owners, codes[firsts], np.bincount(at[keep], minlength=len(owners)), nbrs[keep], scores[keep], fresh[keep], _rows(b.column(5), width)[keep])

        for b in batches:
            if left is not None:
                b = pa.concat_batches([left, b])
            if not b.num_rows:
                continue
            # The last id may go on in the next batch.
            cut = int(np.searchsorted(b.column(0).to_numpy(), b.column(0)[-1].as_py()))
            left = b.slice(cut)
            if cut:
                yield settle(b.slice(0, cut))
        if left is not None:
            yield settle(left)

    return rows.repartition("id").sortWithinPartitions("id").mapInArrow(run, _LIST)


_MEETING = "id bigint, code binary, worst float, via float, step boolean, u bigint, u_code binary, u_worst float, nbrs array<bigint>, scores array<float>, fresh array<boolean>, codes binary"


def _proposals(lists: DataFrame, graph: DataFrame, k: int, width: int, reverse: bool, only_fresh: bool) -> DataFrame:
    """What the entries' own lists propose to each list: v -> u -> w. `reverse` also proposes v to u; `only_fresh` expands fresh entries alone."""
    worst = lambda full: F.when(F.size("nbrs") < full, F.lit(-9.0)).otherwise(F.array_min("scores")).cast("float")
    sent = lists.select("id", "code", worst(k).alias("worst"), F.explode(F.arrays_zip("nbrs", "scores", "fresh")).alias("e"))
    sent = sent.select("id", "code", "worst", F.col("e.scores").alias("via"), F.col("e.fresh").alias("step"), F.col("e.nbrs").alias("u"))
    if only_fresh:
        sent = sent.where("step")
    met = sent.join(graph.select(F.col("id").alias("u"), F.col("code").alias("u_code"), worst(k).alias("u_worst"), "nbrs", "scores", "fresh", "codes"), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                yield from propose(b.slice(a, 1000))

    def propose(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, u = b.column(0).to_numpy(), b.column(5).to_numpy()
        codes = _rows(b.column(1), width)
        counts, nbrs = _flat(b.column(8))
        fresh = _flat(b.column(10))[1]
        row = np.repeat(np.arange(len(own)), counts)
        step = b.column(4).to_numpy(zero_copy_only=False)
        take = np.flatnonzero(((nbrs != own[row]) & (fresh | step[row])) | only_fresh)
        row, nbrs, theirs = row[take], nbrs[take], _rows(b.column(11), width)[take]
        score = np.einsum("ij,ij->i", decode(codes)[row], decode(theirs))
        good = np.flatnonzero(score > b.column(2).to_numpy()[row])
        yield from best_of(own[row[good]], nbrs[good], score[good], theirs[good])
        if reverse:
            # Back along both links of a path: u hears of v, and w hears of v if they are closer than u's own worst entry.
            via = b.column(3).to_numpy()
            back, near = np.flatnonzero(step & (via > b.column(7).to_numpy())), np.flatnonzero(score > b.column(7).to_numpy()[row])
            who = np.concatenate([back, row[near]])
            yield from best_of(np.concatenate([u[back], nbrs[near]]), own[who], np.concatenate([via[back], score[near]]), codes[who])

    def best_of(owner: np.ndarray, nbrs: np.ndarray, score: np.ndarray, theirs: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The best k for each list of the batch; worse ones could not stay."""
        ids, at = np.unique(owner, return_inverse=True)
        keep = _best(at, nbrs, score, np.ones(len(at), bool), k)
        if len(ids):
            yield _lists(ids, None, np.bincount(at[keep], minlength=len(ids)), nbrs[keep], score[keep], np.ones(len(keep), bool), theirs[keep])

    names = [f.split()[0] for f in _MEETING.split(", ")]
    return met.select(*names).mapInArrow(run, _LIST)


def _grow(lists: DataFrame, graph: DataFrame, k: int, width: int, reverse: bool, only_fresh: bool, name: str) -> tuple[DataFrame, int, int]:
    """(lists after one round, their fresh entries, all entries)."""
    proposed = _proposals(lists, graph, k, width, reverse, only_fresh)
    aged = F.transform("fresh", lambda _: F.lit(False)).alias("fresh")
    old = lists.select("id", "code", "nbrs", "scores", aged, "codes")
    out = materialise(_merged(old.unionByName(proposed), k, width), name)
    fresh, links = out.agg(F.sum(F.size(F.filter("fresh", lambda x: x))), F.sum(F.size("nbrs"))).first()
    return out, fresh or 0, links or 0


def build(rows: DataFrame, members: int = 21, degree: int = DEGREE, settled: float = 0.005, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """The neighbour graph of all usable vectors."""
    vectors = usable_vectors(rows, id_col, vector_col)
    nodes = materialise(nodes_of(vectors, members), "nodes")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    count, top, dims = nodes.agg(F.count(F.lit(1)), F.max(norm), F.max(F.size("embedding"))).first()
    if not count:
        return Index(vectors, nodes, nodes.sparkSession.createDataFrame([], _LIST), 1.0, 0)
    width = dims + 8
    trees = [_first_lists(nodes, count, top, degree, seed + t, dims) for t in range(TREES)]
    rows = trees[0]
    for t in trees[1:]:
        rows = rows.unionByName(t)
    lists = materialise(_merged(rows, degree, width), "nn-lists")
    while True:
        lists, fresh, links = _grow(lists, lists, degree, width, True, False, "nn-lists")
        if fresh <= settled * links:
            return Index(vectors, nodes, lists, top, dims)


def search(index: Index, queries: DataFrame, k: int, breadth: int = BREADTH, settled: float = 0.0005) -> DataFrame:
    """(query_id, rank, vec_id, score) of `queries` (query_id, embedding array<double>, node): the k ids nearest by inner product, the query's own id left out.

    `node` is the node to start from beside the entry nodes, null for a vector that is not in the index.
    """
    spark = queries.sparkSession
    if not index.dims:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, width = index.dims, index.dims + 8
    # At most twice ENTRIES rows to start from, whatever the table: a fixed sample, and the longest vectors, near which large products lie.
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    ids = index.nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).select("id").union(index.nodes.orderBy(F.desc(norm), "id").limit(ENTRIES).select("id")).distinct()
    entries = index.lists.select("id", "code").join(F.broadcast(ids), "id").orderBy("id").collect()
    entry_ids, entry_codes = np.array([e[0] for e in entries], np.int64), np.frombuffer(b"".join(bytes(e[1]) for e in entries), np.uint8).reshape(-1, width)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = decode(entry_codes)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            codes, n = encode(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300), np.zeros(len(x))), len(entry_ids)
            scores, ids = (decode(codes) @ unit.T).ravel(), b.column(0).to_numpy()
            near = scores.reshape(-1, n) >= np.sort(scores.reshape(-1, n), axis=1)[:, -min(n, STARTS) :][:, :1]  # only the nearest are expanded first
            yield _lists(ids, codes, np.full(len(ids), n), np.tile(entry_ids, len(ids)), scores, near.ravel(), np.tile(entry_codes, (len(ids), 1)))

    asked = queries.select("query_id", "embedding")
    start = asked.mapInArrow(begin, _LIST)
    # A query that is a node starts from itself: it is a path of one step from its list to its node's.
    own = queries.where("node IS NOT NULL").select(F.col("query_id").alias("id"), F.col("node").alias("u"))
    own = own.join(index.lists.select(F.col("id").alias("u"), F.col("code").alias("c")), "u")
    own = own.select("id", F.lit(None).cast("binary").alias("code"), F.array("u").alias("nbrs"), F.array(F.lit(9.0).cast("float")).alias("scores"), F.array(F.lit(True)).alias("fresh"), F.col("c").alias("codes"))
    beams = materialise(_merged(start.unionByName(own), breadth, width), "beams")
    while True:
        beams, fresh, links = _grow(beams, index.lists, breadth, width, False, True, "beams")
        if fresh <= settled * links:
            break

    hits = beams.select(F.col("id").alias("query_id"), F.explode("nbrs").alias("node")).join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    scored = hits.join(index.nodes.select(F.col("id").alias("node"), "embedding", "members"), "node")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    found = scored.select("query_id", dot.alias("score"), F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def indexed_queries(index: Index, every: int) -> DataFrame:
    """The vectors whose id is divisible by `every` as queries, each with its node."""
    asked = index.vectors.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.xxhash64("v").alias("h"))
    own = index.nodes.select(F.col("id").alias("node"), "embedding", F.xxhash64("embedding").alias("h"))
    return asked.join(own, ["h"]).where(F.col("q") == F.col("embedding")).select("query_id", "embedding", "node")


def neighbours(rows: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by `every`, among all other rows."""
    index = build(rows, k + 1, id_col=id_col, vector_col=vector_col)
    return search(index, indexed_queries(index, every), k)
