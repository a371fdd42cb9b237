"""Stupid-backoff language-model scores of every document against the whole corpus.

S(w | context) = c(context w) / c(context) if the n-gram was seen `min_count` times or more, else
alpha * S(w | shorter context), down to c(w) / N. A document's score is the sum of log S.

Relations: exploded n-grams (block, n-gram, count), count tables partitioned by n-gram hash, and their
join back. One row per n-gram would be most of the cost, so rows are packed: a block of texts sends
each hash partition it has n-grams for one sorted array of its distinct n-grams with counts (the pre-aggregation before
the shuffle: a frequent n-gram leaves a block once), and gets the totals back in the same order. A block meets
its totals in a co-group and sums log S per text. Blocks and hash partitions grow in number with the
corpus, so neither side of a task does; a block cuts its arrays only at the hash partitions it has keys for, so the work is
linear. Count tables cover all documents and are never pruned, broadcast or collected.

Equal texts of a batch travel once, with the ids that have them, and are counted with that weight. The
texts of a hot copy are dealt to as many blocks as `SPREAD` blocks of rows need, by id, so no block holds them all.

N-grams are 64-bit hashes. Words are split at ASCII white space, A-Z lowered.

Defined results: null or empty text has n_words 0 and log_score 0; repeated rows count as separate
documents; a null doc_id is kept, and a doc_id that is no integer becomes null; a very long text is a block of its own;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
BLOCK_CHARS = 8_000_000
#: N-grams that a hash partition gets, about.
PARTITION_NGRAMS = 4_000_000
#: Blocks whose rows may share one block if their texts are equal.
SPREAD = 32
#: Odd multipliers of a 64-bit finaliser.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

_CHUNK = "block bigint, texts binary, sizes binary, copies binary, ids array<bigint>"
_PACKED = "bucket bigint, block bigint, size int, n bigint, width int, packed binary"
_TOTALS = "block bigint, bucket bigint, size int, n bigint, width int, totals binary"
_SCORES = "doc_id bigint, n_words bigint, log_score double"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[0] + b
    x ^= x >> np.uint64(30)
    x *= _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    return x ^ (x >> np.uint64(31))


def _ngrams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(words per text, place of each word in its text, keys of the n-grams of size 1..order that end at each word)."""
    memo: dict[bytes, int] = {}
    hashed, sizes = array("Q"), []
    for t in texts:
        words = (t or b"").lower().split()
        sizes.append(len(words))
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh64_intdigest(w)
            hashed.append(h)
    word = np.frombuffer(hashed, np.uint64) if hashed else np.zeros(0, np.uint64)
    n = np.array(sizes, np.int64)
    place = (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    keys = [word]
    for _ in range(order - 1):
        longer = np.zeros(len(word), np.uint64)
        longer[1:] = _mix(keys[-1][:-1], word[1:])
        keys.append(longer)
    return n, place, keys


def _press(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpress(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, size, codec="zstd", asbytes=True)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in the narrowest width that holds them."""
    top = int(counts.max(initial=0))
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _pack_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[int, bytes]:
    """(width of a count, bytes) of sorted keys and their counts; gaps are stored byte by byte, as their high bytes are alike."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    small = _narrow(counts)
    return small.itemsize, _press(gaps.T.tobytes() + small.tobytes())


def _unpack_keys(n: int, width: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = _unpress(raw, n * (8 + width))
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(raw, f"<u{width}", n, 8 * n).astype(np.int64)


def _chunks(blocks: int):
    """Rows to one chunk for each block that a batch has texts for; equal texts once."""
    spread = max(1, math.ceil(blocks / SPREAD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dealt: dict[int, dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
            for i, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                t = t or b""
                dealt[xxhash.xxh64_intdigest(t, seed=xxhash.xxh64_intdigest(str(i)) % spread) % blocks][t].append(i)
            rows = []
            for block, texts in dealt.items():
                sizes, copies = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (texts, texts.values()))
                rows.append((block, _press(b"".join(texts)), sizes.tobytes(), copies.tobytes(), [i for ids in texts.values() for i in ids]))
            types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            for r in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[r : r + 256], strict=True), types, strict=True)], names=["block", "texts", "sizes", "copies", "ids"])

    return run


def _block_texts(table: pa.Table) -> tuple[dict[bytes, int], list[int | None], np.ndarray]:
    """(text -> number in the block, the ids of all rows, the text number of each)."""
    number: dict[bytes, int] = {}
    ids: list[int | None] = []
    owner = []
    for raw, sizes, copies, of in zip(*(table.column(c).to_pylist() for c in ("texts", "sizes", "copies", "ids")), strict=True):
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        whole = _unpress(raw, int(ends[-1]))
        here = [number.setdefault(whole[a:b], len(number)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        owner.append(np.repeat(np.array(here, np.int64), np.frombuffer(copies, np.int64)))
        ids += of
    return number, ids, np.concatenate(owner) if owner else np.zeros(0, np.int64)


def _pack(order: int, bits: int):
    def fn(key: tuple, table: pa.Table) -> pa.Table:
        number, _, owner = _block_texts(table)
        n, place, keys = _ngrams(list(number), order)
        copies = np.bincount(owner, minlength=len(n))
        weight = np.repeat(copies, n)
        block = key[0].as_py()

        def row(bucket: int, size: int, k: np.ndarray, c: np.ndarray) -> tuple:
            width, packed = _pack_keys(k, c)
            return bucket, block, size, len(k), width, packed

        # The n-gram without words is every position: its total is the corpus size.
        rows = [row(0, 0, np.zeros(1, np.uint64), np.array([int((n * copies).sum())]))]
        for size in range(1, order + 1):
            on = place >= size - 1
            order_ = np.argsort(keys[size - 1][on])
            sorted_, w = keys[size - 1][on][order_], weight[on][order_]
            first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
            if len(first):
                uniq, counts = sorted_[first], np.add.reduceat(w, first)
                bucket = (uniq >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(uniq), np.int64)
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                rows += [row(int(b), size, k, c) for b, k, c in zip(bucket[np.r_[0, cuts]], np.split(uniq, cuts), np.split(counts, cuts), strict=True)]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "block", "size", "n", "width", "packed"])

    return fn


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    size, n, width = (table.column(c).to_numpy() for c in ("size", "n", "width"))
    packed = table.column("packed")
    totals: list[bytes] = [b""] * len(size)
    widths = np.ones(len(size), np.int32)
    for k in np.unique(size):
        rows = np.flatnonzero(size == k)
        parts, counts = zip(*(_unpack_keys(int(n[r]), int(width[r]), packed[int(r)].as_py()) for r in rows), strict=True)
        _, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)[inverse]
        for r, t in zip(rows, np.split(total, np.cumsum(n[rows])[:-1]), strict=True):
            small = _narrow(t)
            widths[r], totals[r] = small.itemsize, _press(small.tobytes())
    return pa.table(
        [table.column("block"), table.column("bucket"), table.column("size"), table.column("n"), pa.array(widths), pa.array(totals, pa.binary())],
        names=["block", "bucket", "size", "n", "width", "totals"],
    )


def _score(order: int, alpha: float, min_count: int):
    def fn(docs: pa.Table, totals: pa.Table) -> pa.Table:
        number, ids, owner = _block_texts(docs)
        n, place, keys = _ngrams(list(number), order)
        size, bucket, many, width = (totals.column(c).to_numpy() for c in ("size", "bucket", "n", "width"))
        raw = totals.column("totals")

        def counted(k: int) -> np.ndarray:
            """Corpus counts of the n-grams of size k at each word."""
            rows = np.flatnonzero(size == k)
            got = [
                np.frombuffer(_unpress(raw[int(r)].as_py(), int(many[r] * width[r])), f"<u{width[r]}").astype(np.int64)
                for r in rows[np.argsort(bucket[rows], kind="stable")]
            ]
            out = np.zeros(len(place), np.int64)
            used = place >= k - 1
            if got:
                out[used] = np.concatenate(got)[np.unique(keys[k - 1][used], return_inverse=True)[1]]
            return out

        score = np.zeros(len(n))
        if len(place):
            corpus = int(np.frombuffer(_unpress(raw[int(np.flatnonzero(size == 0)[0])].as_py(), int(width[size == 0][0])), f"<u{width[size == 0][0]}")[0])
            shorter = counted(1)
            log = np.log(shorter / corpus)
            for k in range(2, order + 1):
                seen = counted(k)
                log[place >= k - 1] += math.log(alpha)
                on = np.flatnonzero((place >= k - 1) & (seen >= min_count))
                log[on] = np.log(seen[on] / shorter[on - 1])
                shorter = seen
            score = np.bincount(np.repeat(np.arange(len(n)), n), log, minlength=len(n))
        return pa.table([pa.array(ids, pa.int64()), pa.array(n[owner]), pa.array(score[owner], pa.float64())], names=["doc_id", "n_words", "log_score"])

    return fn


def score(
    docs: DataFrame,
    text_col: str = "text",
    order: int = ORDER,
    alpha: float = ALPHA,
    min_count: int = MIN_COUNT,
    block_chars: int = BLOCK_CHARS,
    partition_ngrams: int = PARTITION_NGRAMS,
) -> DataFrame:
    """doc_id, n_words, log_score for every row."""
    src = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars))
    # Six bytes a word, about.
    bits = max(0, math.ceil(order * chars / 6 / partition_ngrams) - 1).bit_length()
    dealt = src.mapInArrow(_chunks(blocks), _CHUNK)
    packed = dealt.groupBy("block").applyInArrow(_pack(order, bits), _PACKED)
    totals = packed.groupBy("bucket").applyInArrow(_merge, _TOTALS)
    return dealt.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_score(order, alpha, min_count), _SCORES)
