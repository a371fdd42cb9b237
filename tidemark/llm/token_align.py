"""Alignment of two tokenizers by interval coalescing.

1. Every text is encoded by tokenizer A (byte-level BPE) and B (SentencePiece). Each token becomes a byte interval; both sequences tile the
   same bytes, so the documents of a batch are laid end to end and aligned in one go: all tokens of both sides are lexsorted by start, the ends are run
   through `maximum.accumulate`, and a group breaks where a start reaches the running maximum. Within a group overlaps are expanded strip by
   strip: each distinct start opens a strip of bytes that one A and one B token share, and a pair that overlaps shares exactly one strip.
2. Tasks gather documents into blocks of bounded size. A block keeps its distinct id pairs once, with the number of its documents that link
   them; its documents point into that list. A block is several rows, one for each lot of texts encoded together, with a share of the block's pairs:
   rows of many MB would fill an executor's heap with copies of themselves. They are written once to the shared folder, so no text is encoded twice.
3. The pairs of all blocks are summed to document counts, the highest count of each A id is a window over at most one row for each B id, and the
   counts are joined back to the pairs of the blocks. What is shuffled are pairs distinct within a block, not links; a pair that every document
   holds is one row a block, and AQE splits the join if that is many.
4. Counts and rows of a block meet in one partition, sorted: first the counts in the order of the block's pairs, then the rows, one after another.

Defined results: a text that is null, empty, or that one side does not give back byte for byte (B writes U+2581 as a space) has no tokens: zeros and
an empty `groups_sha256`. Strings of special tokens are plain text. Repeated rows are documents of their own, also in the counts. Ids are
returned as given, null included. A very long text is a block by itself. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.sources.shared import materialise

#: How byte-level BPE of this vocabulary cuts a text before it merges (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts encoded at a time, in characters, and pairs that close a block; both bound memory only.
STEP_CHARS = 500_000
BLOCK_PAIRS = 1_000_000


class Aligned(NamedTuple):
    """Of a batch whose documents lie end to end. Groups and links in order; `order` sorts A's and then B's tokens by start."""

    order: np.ndarray
    group: np.ndarray  # of the tokens in that order
    link_a: np.ndarray  # A token of each link, by place
    link_b: np.ndarray


def coalesce(len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    """Groups and links of two tilings of the same bytes, given by their tokens' lengths (at least 1)."""
    end = np.concatenate([np.cumsum(len_a), np.cumsum(len_b)])
    start = end - np.concatenate([len_a, len_b])
    side = np.repeat(np.array([0, 1], np.int8), [len(len_a), len(len_b)])
    order = np.lexsort((side, start))
    start, reach, is_b = start[order], np.maximum.accumulate(end[order]), side[order] == 1
    fresh = np.ones(len(order), bool)
    fresh[1:] = start[1:] >= reach[:-1]
    closes = np.ones(len(order), bool)  # the last token to start here: from here on a strip has its A and its B token
    closes[:-1] = start[1:] != start[:-1]
    b_open = np.cumsum(is_b)
    a_open = np.arange(1, len(order) + 1) - b_open
    return Aligned(order, np.cumsum(fresh) - 1, a_open[closes] - 1, b_open[closes] - 1)


#: Characters on whose classes all Unicode tables in use agree; texts with others are cut by the encoder itself.
_SETTLED = re.compile("[\0-\u0557\u2000-\u2064\u20a0-\u20b5\u3000-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff]*").fullmatch
#: Pieces hold no space but at their front and no line feed, so merges stay inside these words.
_SPACED = re.compile("\n| *[^ \n]+| +").findall
#: Words remembered by a worker and the longest of them; beyond that they are encoded anew.
_MEMO_WORDS, _MEMO_CHARS = 400_000, 40


class Memo(dict):
    """Ids of a word as little-endian unsigned 32-bit bytes; None if they do not give the word back."""

    def __init__(self, learn: Callable[[str], bytes | None]) -> None:
        self.learn = learn

    def __missing__(self, word: str) -> bytes | None:
        ids = self.learn(word)
        if len(word) <= _MEMO_CHARS:
            if len(self) >= _MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Tokenizers:
    """Both encoders with the bytes of their tokens. A word has the same ids wherever it stands, so each is encoded once a worker."""

    def __init__(self, ranks_path: str, piece_path: str) -> None:
        import regex
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.a = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # Ids as text with what may follow them: another id of the side, the other side, another group.
        self.n_shown = max(len(self.bytes_a), len(self.bytes_b))
        self.shown = np.array([f"{i}{sign}" for sign in ",|;" for i in range(self.n_shown)], object)
        self._words_a, self._runs = regex.compile(SPLIT).findall, regex.compile(r"\s+(?!\S)|\s?\S+|\s").findall
        self._memo_a, self._memo_b = Memo(self._learn_a), Memo(self._learn_b)
        self._apart = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self._feed = len(self.b.encode("\n"))

    def _cut(self, text: str) -> list[str]:
        if _SETTLED(text):
            return self._words_a(text)
        return [w for run in self._runs(text) for w in (self._words_a(run) if _SETTLED(run) else [run])]

    def _learn_a(self, word: str) -> bytes | None:
        # White space and words already cut go in as one piece: the encoder's own rules overflow on very long runs of white space.
        ids = self.a._encode_single_piece(word) if word.isspace() or _SETTLED(word) else self.a.encode_ordinary(word)
        return np.array(ids, "<u4").tobytes() if b"".join(map(self.bytes_a.__getitem__, ids)) == word.encode() else None

    def _learn_b(self, word: str) -> bytes | None:
        # The encoder puts a space in front; a word without one is encoded behind a line feed, whose ids are cut off.
        ids = self.b.encode(word[1:]) if word[0] == " " != word else self.b.encode(f"\n{word}")[self._feed :]
        return np.array(ids, "<u4").tobytes() if b"".join(map(self.bytes_b.__getitem__, ids)) == word.encode() else None

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text, empty where there is none or a side does not give the text back."""
        out_a, out_b = [], []
        for text in texts:
            spaced = f" {text}" if text else ""
            try:
                a = b"".join(map(self._memo_a.__getitem__, self._cut(spaced)))
                b = b"".join(map(self._memo_b.__getitem__, _SPACED(spaced))) if self._apart else self._learn_b(spaced)
            except TypeError:  # a word that is not given back
                a = b = b""
            whole = a is not None and b is not None
            out_a.append(np.frombuffer(a if whole else b"", "<u4").astype(np.int64))
            out_b.append(np.frombuffer(b if whole else b"", "<u4").astype(np.int64))
        return out_a, out_b


class Batch(NamedTuple):
    """Per document: counts, digest, and its distinct pairs (A id x B vocabulary + B id) with their numbers of links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    pairs: np.ndarray
    times: np.ndarray
    n_pairs: np.ndarray


def align_texts(tok: Tokenizers, texts: list[str | None]) -> Batch:
    ids_a, ids_b = tok.encode(texts)
    n, n_a, n_b = len(texts), np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    flat_a, flat_b = np.concatenate([np.zeros(0, np.int64), *ids_a]), np.concatenate([np.zeros(0, np.int64), *ids_b])
    found = coalesce(tok.len_a[flat_a], tok.len_b[flat_b])
    doc_a = np.repeat(np.arange(n), n_a)
    ids, docs = np.concatenate([flat_a, flat_b])[found.order], np.concatenate([doc_a, np.repeat(np.arange(n), n_b)])[found.order]
    firsts = np.flatnonzero(np.diff(found.group, prepend=-1))
    n_groups = np.bincount(docs[firsts], minlength=n)

    # The groups as text: A's tokens of a group, then B's.
    part = found.group * 2 + (found.order >= len(flat_a))
    by_part = np.argsort(part, kind="stable")
    part = part[by_part]
    step = np.diff(part, append=-2)
    sign = np.where(step == 0, 0, np.where((step == 1) & (part % 2 == 0), 1, 2))
    shown = tok.shown[ids[by_part] + sign * tok.n_shown].tolist()
    ends = np.cumsum(n_a + n_b).tolist()
    digests = [hashlib.sha256("".join(shown[end - k : end])[:-1].encode()).hexdigest() if k else "" for end, k in zip(ends, (n_a + n_b).tolist(), strict=True)]

    link_doc = doc_a[found.link_a]
    size = len(tok.bytes_a) * len(tok.bytes_b)
    keys, times = np.unique(link_doc * size + flat_a[found.link_a] * len(tok.bytes_b) + flat_b[found.link_b], return_counts=True)
    return Batch(n_a, n_b, n_groups, np.bincount(link_doc, minlength=n), digests, keys % size, times, np.bincount(keys // size, minlength=n))


_loaded: dict[tuple[str, str], Tokenizers] = {}


def _tokenizers(ranks_path: str, piece_path: str) -> Tokenizers:
    if (ranks_path, piece_path) not in _loaded:
        _loaded[ranks_path, piece_path] = Tokenizers(ranks_path, piece_path)
    return _loaded[ranks_path, piece_path]


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """(ids, texts) of about STEP_CHARS, one text at least."""
    for batch in batches:
        chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        size = np.cumsum(chars, dtype=np.int64) // STEP_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                # The ids are copied, as they stay until the block is closed and would keep the batch's texts.
                yield batch.column(0).take(pa.array(range(a, b))), batch.column(1).slice(a, b - a).to_pylist()


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("at", T.IntegerType()), T.StructField("pair", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.IntegerType()))]
)
_BLOCK_ARROW = [to_arrow_type(f.dataType) for f in _BLOCK]


def _blocks(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, piece_path: str) -> DataFrame:
    """A row a step: its documents as an Arrow stream (what is known of each, its places among the block's distinct pairs and their numbers of links),
    and of those pairs the ones from place `at` on, with their document counts."""
    arrow_id = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(ranks_path, piece_path)
        part, ids, found, number = TaskContext.get().partitionId(), [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            pair, place, held = np.unique(np.concatenate([b.pairs for b in found]), return_inverse=True, return_counts=True)
            ends, share = np.cumsum([len(b.pairs) for b in found]), -(-len(pair) // len(found))
            for i, (keys, b, end) in enumerate(zip(ids, found, ends.tolist(), strict=True)):
                own = slice(min(i * share, len(pair)), (i + 1) * share)
                values = [(part << 32) + number, _stored(keys.cast(arrow_id), b, place[end - len(b.pairs) : end]), own.start, pair[own], held[own]]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCK_ARROW, strict=True)], names=_BLOCK.fieldNames())
            ids.clear(), found.clear()

        for keys, texts in _steps(batches):
            ids.append(keys), found.append(align_texts(tok, texts))
            if sum(len(b.pairs) for b in found) >= BLOCK_PAIRS:
                yield from close()
                number += 1
        if found:
            yield from close()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCK)


def _stored(ids: pa.Array, b: Batch, place: np.ndarray) -> bytes:
    starts = pa.array(np.concatenate([[0], np.cumsum(b.n_pairs)]), pa.int32())
    lists = (pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (place, b.times))
    batch = pa.RecordBatch.from_arrays([ids, *(pa.array(getattr(b, c), pa.int64()) for c in _COUNTS), pa.array(b.digests, pa.string()), *lists], names=["id", *_COUNTS, "digest", "places", "times"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def pair_counts(blocks: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): documents that hold the pair, and whether no other pair of its A id is held by more."""
    n = blocks.select(F.explode(F.arrays_zip("pair", "held")).alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.held").alias("n"))
    best = F.max("n").over(W.partitionBy(F.floor(F.col("pair") / n_b)))
    return n.select("pair", "n", (F.col("n") == best).alias("best"))


def align(docs: DataFrame, ranks_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row per document."""
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    blocks = materialise(_blocks(docs, id_col, text_col, ranks_path, piece_path), "token-blocks")
    asked = blocks.select("block", "at", F.posexplode("pair").alias("pos", "pair")).select("block", (F.col("at") + F.col("pos")).alias("pos"), "pair")
    told = asked.join(pair_counts(blocks, n_b), "pair").select("block", "pos", "n", "best")
    rows = told.unionByName(blocks.select("block", "docs"), allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("pos"))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in (*_COUNTS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    return rows.select("block", "pos", "n", "best", "docs").mapInArrow(_sums, schema).withColumnRenamed("id", id_col)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From each block's counts in the order of its pairs, and its documents after them."""
    _loaded.clear()  # a worker that has encoded before needs neither tokenizers nor words any more
    block, heard = None, []
    for batch in batches:
        number, pos, n, best, docs = batch.columns
        number, n, best, is_docs = (x.to_numpy(zero_copy_only=False) for x in (number, pc.fill_null(n, 0), pc.fill_null(best, False), pos.is_null()))
        fresh = np.ones(len(number), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (is_docs[1:] != is_docs[:-1])
        firsts = np.flatnonzero(fresh).tolist()
        for a, b in zip(firsts, [*firsts[1:], len(number)], strict=True):
            if number[a] != block:
                block, heard = number[a], [np.zeros((2, 0), np.int64)]  # None are told of where the block has no pairs.
            if not is_docs[a]:
                heard.append(np.stack([best[a:b].astype(np.int64), n[a:b]]))
                continue
            heard = [np.concatenate(heard, axis=1)]
            for i in range(a, b):
                for step in pa.ipc.open_stream(docs[i].as_buffer()):
                    ids, *counts, digests, places, times = step.columns
                    ends, at, times = places.offsets.to_numpy(), places.values.to_numpy(), times.values.to_numpy()
                    sums = (np.diff(np.concatenate([[0], np.cumsum(times * x[at])])[ends]) for x in heard[0])
                    yield pa.RecordBatch.from_arrays([ids, *counts, *(pa.array(s, pa.int64()) for s in sums), digests], names=["id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])
