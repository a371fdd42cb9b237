"""Sequence packing by non-negative least squares.

1. Tokenise (one pass, map-only). A document longer than the window is cut at multiples of the
   window, so all its pieces but the last fill a sequence each.
2. Histogram of piece lengths in classes of `grain` tokens: `window / grain` numbers, whatever the
   size of the corpus.
3. Enumerate all combinations of up to `depth` classes that fill the window exactly, solve
   min |A x - histogram| with x >= 0, and round down: each combination is a pattern with a repeat
   count. What the counts leave over is packed greedily, largest first, class by class with
   multiplicity, so the plan's length depends on the classes and not on the documents.
4. Deal pieces into the plan's slots: the rank of a piece in its class names its pattern, copy
   and slot. Ranks come from many small windows (class x salt, as many salts as the class's count needs) plus their offsets, so a class
   that holds most pieces does not land in one task. Offsets are running sums in a sequence.

Defined results: null or empty text is the end token alone; repeated rows are packed as often as
they occur; a doc_id that is no integer becomes null; a very long text is cut into pieces of the window; an empty table gives an empty
result; ties in a class are broken by a hash of the row's number; other columns of the documents are ignored, those of pieces are kept,
whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.shared import materialise

WINDOW = 4096
GRAIN = 16
DEPTH = 3
END_ID = 2
#: Words a Python worker remembers; beyond it the memory is emptied and filled anew.
_MEMO_WORDS = 800_000

#: Texts made of these only are split here; anything else goes to the tokenizer whole.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~\xa1-\u017f]*").fullmatch
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f"
_NUMERIC = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"[{_LETTERS}]+|[{_NUMERIC}]|'(?:s|t|re|ve|m|ll|d)|[^ \t-\r{_LETTERS}{_NUMERIC}]+").findall


class WordTokenizer:
    """Ids of a word-level BPE as little-endian unsigned 32-bit bytes, with a memory of words.

    The vocabulary's own rules cut a text into words before merging; the same word always gives
    the same ids, so each distinct word is encoded once per worker. Texts with characters outside
    Latin, where library and regex rules could differ, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _learn(self, words: list[str]) -> None:
        if len(self.memo) + len(words) > _MEMO_WORDS:
            self.memo.clear()
        for a in range(0, len(words), 2000):
            part = words[a : a + 2000]
            ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.closes[ids]) + 1
            if len(cuts) != len(part):  # a word the rules cut further: one by one
                for w in part:
                    self.memo[w] = self._whole(w)
                continue
            raw, start = ids.astype("<u4").tobytes(), 0
            for w, end in zip(part, (cuts * 4).tolist(), strict=True):
                self.memo[w] = raw[start:end]
                start = end

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        out, step = [], 64
        for a in range(0, len(texts), step):
            part = [x or "" for x in texts[a : a + step]]
            split = [_PIECES(t.lower()) if _PLAIN(t) and "<|" not in t else None for t in part]
            words = set(chain.from_iterable(filter(None, split)))
            fresh = words.difference(self.memo)
            if fresh:
                # A full memory starts anew; then the words it knew have to be learnt with the rest.
                self._learn(list(words if len(self.memo) + len(fresh) > _MEMO_WORDS else fresh))
            ids = self.memo.__getitem__
            out += [self._whole(t) if ws is None else b"".join(map(ids, ws)) for t, ws in zip(part, split, strict=True)]
        return out


_loaded: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    end = np.array([END_ID], "<u4").tobytes()
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer_path)
        for b in batches:
            rows = []
            for doc, raw in zip(b.column(0).to_pylist(), tok.batch(b.column(1).to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, window):
                    part = raw[4 * s : 4 * (s + window)]
                    rows.append((doc, s, len(part) // 4, zlib.crc32(part), n, *([np.frombuffer(part, "<i4")] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) or [[]] * (5 + with_ids)
            types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

    src = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, schema)


def fillings(units: int, depth: int = DEPTH) -> np.ndarray:
    """Every multiset of up to `depth` class sizes that sums to `units`, as count rows."""
    rows = []
    for d in range(1, depth + 1):
        for head in combinations_with_replacement(range(1, units + 1), d - 1):
            last = units - sum(head)
            if last >= (head[-1] if head else 1):
                row = np.zeros(units + 1, np.float64)
                np.add.at(row, [*head, last], 1)
                rows.append(row)
    return np.array(rows).T


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        grad = np.where(free, -np.inf, a.T @ (b - a @ x))
        j = int(grad.argmax())
        if grad[j] <= tol * scale:
            break
        free[j] = True
        while True:
            on = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[on] = s
                break
            bad = s <= 0
            step = float(np.min(x[on][bad] / np.maximum(x[on][bad] - s[bad], 1e-300)))
            x[on] += step * (s - x[on])
            free[on[x[on] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(classes of a sequence, largest first; copies). `histogram[c]` pieces have class c."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []

    def take(classes: tuple[int, ...], copies: int) -> None:
        if copies > 0:
            out.append((classes, int(copies)))
            np.subtract.at(left, list(classes), copies)

    if left[units]:
        take((units,), left[units])
    if left.any():
        a = fillings(units, depth)
        used = a[np.flatnonzero(left == 0)].sum(axis=0) == 0  # only classes that have pieces
        a = a[:, used]
        if a.shape[1]:
            present = np.flatnonzero(left)
            for col, times in zip(a.T, np.floor(nnls(a[present], left[present].astype(np.float64)) + 1e-9), strict=True):
                classes = tuple(int(c) for c in np.repeat(np.arange(units + 1), col.astype(int))[::-1])
                need = np.bincount(classes, minlength=units + 1)
                fits = int((left[need > 0] // need[need > 0]).min())
                take(classes, min(int(times), fits))
    while left.any():
        # The largest class, then always the largest that still fits; as many copies as all allow.
        room, need = units, np.zeros(units + 1, np.int64)
        while room:
            fits = np.flatnonzero(left[: room + 1] > need[: room + 1])
            if not len(fits):
                break
            c = int(fits[-1])
            n = min(room // c, int(left[c] - need[c]))
            need[c] += n
            room -= n * c
        classes = tuple(int(c) for c in np.repeat(np.arange(units + 1), need)[::-1])
        take(classes, int((left[need > 0] // need[need > 0]).min()))
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]], units: int) -> list[tuple[np.ndarray, ...]]:
    """For each class: where runs of ranks begin, and the first sequence and slot of each run."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(units + 1)]
    filled = [0] * (units + 1)
    first = 0
    for classes, copies in patterns:
        for slot, c in enumerate(classes):
            runs[c].append((filled[c], first, slot))
            filled[c] += copies
        first += copies
    return [tuple(np.array(col, np.int64) for col in zip(*r, strict=True)) if r else () for r in runs]


def pack(parts: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, salt_rows: int = 100_000) -> DataFrame:
    """`parts` (doc_id, start, length and more) with sequence_id and offset.

    A class of n pieces is ranked in n / salt_rows windows, about. The pieces are written once with a number each, so that rows that repeat
    are apart and every reading deals them alike.
    """
    units = window // grain
    names = parts.columns
    inner = [f"c{i}" for i in range(len(names))]
    length = F.col(inner[names.index("length")])
    rows = parts.toDF(*inner).withColumn("class", F.ceil(length / grain).cast("int")).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "pieces")
    histogram = np.zeros(units + 1, np.int64)
    for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect():  # window / grain rows
        histogram[r["class"]] = r["n"]
    salts = np.maximum(1, -(-histogram // salt_rows))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.element_at(F.lit(salts.tolist()), F.col("class") + 1)))
    before: list[np.ndarray] = [np.zeros(k, np.int64) for k in salts]
    for r in salted.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each salt_rows pieces
        before[r["class"]][r["salt"]] = r["n"]
    before = [np.cumsum(n) - n for n in before]
    slots = _slots(plan(histogram, depth), units)
    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("class", "salt").orderBy("row")) - 1).drop("row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, salt, rank = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("class", "salt", "rank"))
            seq, slot = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c):
                on = np.flatnonzero(c == k)
                at = before[k][salt[on]] + rank[on]
                begin, first, place_ = slots[k]
                run = np.searchsorted(begin, at, "right") - 1
                seq[on], slot[on] = first[run] + at - begin[run], place_[run]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in inner), pa.array(seq), pa.array(slot)], names=[*inner, "sequence", "slot"])

    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, parts.schema.fields, strict=True)) + ", sequence bigint, slot bigint"
    placed = ranked.mapInArrow(place, schema)
    run = W.partitionBy("sequence").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum(length).over(run), F.lit(0)).cast("bigint"))
    kept = [F.col(i).alias(n) for i, n in zip(inner, names, strict=True) if n not in ("sequence_id", "offset")]
    return placed.select(*kept, F.col("sequence").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", with_ids: bool = False, **shape) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset."""
    return pack(pieces(docs, tokenizer_path, shape.get("window", WINDOW), text_col, with_ids), **shape)
