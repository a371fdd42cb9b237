"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Word counts over all documents, for the words that occur in benchmark items: one pass, whatever their number
   (one more for every `_PASS_WORDS` distinct words).
2. Of every item's three-word n-grams, the rarer half (by the product of corpus word
   probabilities; ties kept) become seeds. The ranking is within the item, so it works alike at every corpus
   size, and a passage that many documents leak does not become "frequent" by being leaked.
3. Documents are joined to seeds by n-gram hash inside the task that reads them; around every hit a window of the
   document is aligned with the item (match +1, mismatch and gap -1) and scored against the
   perfect copy.

Items arrive in blocks of about `block_bytes` of text, so the seed table of a task is bounded whatever the size of the benchmark;
every block meets all documents. Map-only apart from the word counts: texts are never shuffled.

Defined results: null text or item text is empty; words are runs of letters and digits, A-Z
lowered; an item without words matches nothing; one of fewer than `min_words` words matches where all its words stand in a row, and one of
fewer than three only a document that is nothing else, with score 1; items that repeat an id and text are one, ids of any type are returned as given,
null included; of windows with equal scores
the first counts; texts of any length are read whole; repeated rows get the same hits; hits of a document are ordered by item_id;
an empty table of either kind gives no hits; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.lm_score import _mix
from tidemark.sources.arrow import append_columns
from tidemark.sources.shared import materialise

SEED_WORDS = 3
_PASS_WORDS = 8_000_000
#: Words a Python worker remembers; beyond it the memory is emptied.
_MEMO_WORDS = 300_000


class _Memo(dict):
    """Word to hash; a new word is hashed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_memo = _Memo()
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def hits_type(id_type: T.DataType) -> T.ArrayType:
    """array<struct<item_id, score, start, end>>."""
    fields = (("item_id", id_type), ("score", T.DoubleType()), ("start", T.LongType()), ("end", T.LongType()))
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def hashes_of(text: str | None) -> np.ndarray:
    """The 64-bit hash of every word in order."""
    words = words_of(text)
    if len(_memo) > _MEMO_WORDS:
        _memo.clear()
    return np.fromiter(map(_memo.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that starts at each word."""
    if len(words) < SEED_WORDS:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - SEED_WORDS + 1].copy()
    for k in range(1, SEED_WORDS):
        out = _mix(out, words[k : len(words) - SEED_WORDS + 1 + k])
    return out


def item_words(items: DataFrame) -> DataFrame:
    """(block, h): the distinct words of each block of items (block, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {(block, h) for block, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for h in hashes_of(t).view(np.int64).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["block", "h"])

    return items.select("block", "text").mapInArrow(run, "block bigint, h bigint").distinct()


def word_counts(docs: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, n): counts over all documents of `words` (h); each task sends one row per word at most."""
    passes = max(1, math.ceil(words.count() / _PASS_WORDS))
    found = None
    for p in range(passes):
        wanted = words.where(F.pmod("h", F.lit(passes)) == p).toArrow().column("h").to_numpy()
        shared = docs.sparkSession.sparkContext.broadcast(np.sort(wanted))  # _PASS_WORDS longs, about

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            total = np.zeros(len(index), np.int64)
            for b in batches:
                for t in b.column(0).to_pylist():
                    h = hashes_of(t).view(np.int64)
                    at = np.minimum(np.searchsorted(index, h), len(index) - 1)
                    np.add.at(total, at[index[at] == h], 1)
            on = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(index[on]), pa.array(total[on])], names=["h", "n"])

        if len(wanted):
            part = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
            found = part if found is None else found.union(part)
    return words.select("h", F.lit(0).cast("bigint").alias("n")) if found is None else found


def rare_seeds(items: list[tuple[int, np.ndarray]], counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, item number, place), by n-gram, for the rarer half of each item's n-grams."""
    parts = []
    for k, (_, words) in enumerate(items):
        found = grams(words)
        if len(found):
            cost = np.log1p([counts.get(w, 0) for w in words.view(np.int64).tolist()])
            cost = np.round(sum(cost[j : len(cost) - SEED_WORDS + 1 + j] for j in range(SEED_WORDS)), 9)
            on = np.flatnonzero(cost <= np.sort(cost)[(len(cost) - 1) // 2])
            parts.append((found[on], np.full(len(on), k), on))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(gram, kind="stable")
    return gram[order], item[order], place[order]


def _best(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """(score, row, column) of the best local alignment's end."""
    steps = np.arange(len(doc) + 1, dtype=np.int32)
    prev = np.zeros(len(doc) + 1, np.int32)
    best = (0, 0, 0)
    for r, w in enumerate(item):
        row = np.zeros_like(prev)
        np.maximum(prev[:-1] + np.where(doc == w, 1, -1), prev[1:] - 1, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + steps) - steps
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), r, top)
        prev = row
    return best


def align(item: np.ndarray, doc: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman over words: (share of a perfect score, start, end) in `doc`."""
    score, r, c = _best(item, doc)
    if not score:
        return 0.0, 0, 0
    _, _, back = _best(item[: r + 1][::-1], doc[:c][::-1])
    return score / len(item), c - back, c


def _matcher(items: list[tuple[int, np.ndarray]], seeds: tuple[np.ndarray, np.ndarray, np.ndarray], min_score: float, min_words: int):
    gram, item, place = seeds
    tiny = {words.tobytes(): k for k, (_, words) in reversed(list(enumerate(items))) if 0 < len(words) < SEED_WORDS}
    same_tiny = defaultdict(list)
    for k, (_, words) in enumerate(items):
        if words.tobytes() in tiny:
            same_tiny[words.tobytes()].append(k)

    def windows_of(words: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        g = grams(words)
        lo = np.searchsorted(gram, g)
        on = np.flatnonzero(gram[np.minimum(lo, len(gram) - 1)] == g) if len(gram) else lo[:0]
        for i, first, last in zip(on.tolist(), lo[on].tolist(), np.searchsorted(gram, g[on], "right").tolist(), strict=True):
            for s in range(first, last):
                k, at = int(item[s]), i - int(place[s])
                m = len(items[k][1])
                if m < min_words:
                    if at >= 0 and np.array_equal(words[at : at + m], items[k][1]):
                        windows[k].append((at, at + m))
                    continue
                pad = max(8, m // 4)
                windows[k].append((max(0, at - pad), min(len(words), at + m + pad)))
        return windows

    def match(text: str | None) -> list[dict]:
        words = hashes_of(text)
        if len(words) < SEED_WORDS:
            found = [(items[k][0], 1.0, 0, len(words)) for k in same_tiny.get(words.tobytes(), ())]
        else:
            found = []
            for k, spans in windows_of(words).items():
                merged: list[list[int]] = []
                for a, b in sorted(spans):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                score, a, b = max(((s, a + x, a + y) for a, b in merged for s, x, y in [align(items[k][1], words[a:b])]), key=lambda h: (h[0], -h[1]))
                if score >= min_score:
                    found.append((items[k][0], score, a, b))
        if not found:
            return []
        raw = text.encode()
        at = [m.span() for m in _WORD.finditer(raw.lower())]
        chars = lambda n: len(raw[:n].decode(errors="ignore"))
        return [{"item_id": i, "score": s, "start": chars(at[a][0]), "end": chars(at[b - 1][1])} for i, s, a, b in sorted(found, key=lambda h: (h[0] is None, "" if h[0] is None else h[0], *h[1:]))]

    return match


def annotate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    out: str = "hits",
    min_score: float = 0.5,
    min_words: int = 8,
    block_bytes: int = 16_000_000,
) -> DataFrame:
    """`docs` with an array of (item_id, score, start, end in code points)."""
    id_type = items.schema["item_id"].dataType
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    blocks = max(1, math.ceil((items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    items = materialise(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "benchmark-blocks")
    words = materialise(item_words(items), "benchmark-words")
    counts = materialise(words.join(word_counts(docs, words.select("h").distinct(), text_col), "h"), "benchmark-counts")
    names = [f"hits {b}" for b in range(blocks)]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    for b, name in enumerate(names):
        block = [(r["item_id"], hashes_of(r["text"])) for r in items.where(F.col("block") == b).collect()]
        seen = counts.where(F.col("block") == b).toArrow()
        seeds = rare_seeds(block, dict(zip(seen.column("h").to_pylist(), seen.column("n").to_pylist(), strict=True)))
        # One pickled copy per executor, of a size that `block_bytes` bounds.
        shared = docs.sparkSession.sparkContext.broadcast((block, seeds, min_score, min_words))
        docs = append_columns(docs, [text_col], [T.StructField(name, hits_type(id_type))], _block_fn(shared))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*names, out)]
    return docs.select(*kept, F.array_sort(F.concat(*(F.col(f"`{n}`") for n in names))).alias(out))


def _block_fn(shared):
    built: list = []

    def fn(texts: list[str | None]) -> list[list]:
        if not built:
            built.append(_matcher(*shared.value))
        return [[built[0](t) for t in texts]]

    return fn


def contaminated(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, score, start, end."""
    hits = annotate(docs.select("doc_id", "text"), items, **limits)
    return hits.select("doc_id", F.inline("hits"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **limits) -> DataFrame:
    """`docs` without those that hold a benchmark item; narrow, clean rows untouched."""
    mark = "hits"
    while mark in docs.columns:
        mark += "_"
    return annotate(docs, items, out=mark, **limits).where(F.size(mark) == 0).drop(mark)
