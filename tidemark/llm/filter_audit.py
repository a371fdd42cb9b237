"""Which filter removes what: every order of a set of filters, audited from one pass over the texts.

1. A table-driven transducer reads the UTF-8 bytes of a batch once. Its table gives for each byte the next state (inside or outside a word; whatever the
   state, a separator leaves and any other byte enters, so the states of a whole buffer are one look-up) and the outputs: code point, capital, symbol.
2. Where the state changes, word spans begin and end. The spans of each document go into an open-addressed hash table, a batch at a time: all
   spans look at their slot, free slots are taken, spans that meet an equal one are done, the rest move on. Equal means equal bytes, compared eight at a
   time; a hash alone never decides.
3. Copies are found by the texts' SHA-256: the smallest id of each digest passes. The join is on digest and id, so a digest that a third of all
   rows share is no hot key.
4. Documents are counted by part and set of failed filters: 2^k cells a part, whatever the corpus. All orders and steps are sums over these cells.

Defined results: a null text is empty, a null part the empty string. A document without an id is no copy and makes none; rows that repeat an id and its text
pass together. Labels count per id, once, if any of an id's label rows has them. An empty table gives no rows. Very long texts are read in one piece; very
long words are compared as bytes. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.sources.shared import materialise

SYMBOLS = b"#$%&*|"
SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes read in one go (a document at least) and the length from which words are compared as Python bytes. Neither decides a result.
STEP_BYTES = 1 << 19
LONG_WORD = 256

INSIDE, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8
_TABLE = np.full(256, INSIDE | POINT, np.uint8)
_TABLE[0x80:0xC0] = INSIDE  # continues a code point
_TABLE[ord("A") : ord("Z") + 1] |= CAPITAL
_TABLE[list(SYMBOLS)] |= SYMBOL
_TABLE[list(SEPARATORS)] &= ~np.uint8(INSIDE)

MEASURES = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")
_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Failure conditions over MEASURES and `is_copy`.
FILTERS: dict[str, Column | str] = {
    "A": "n_words < 200", "B": "100 * n_distinct < 50 * n_words", "C": "100 * n_capitals > 2 * n_chars", "D": "n_symbols > 0", "E": "is_copy",
}


def transduce(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """MEASURES of the documents that `offsets` cut out of the bytes."""
    base = offsets[0]
    data, offsets = data[base : offsets[-1]], offsets - base
    out = _TABLE[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = out & INSIDE
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    # Documents lie end to end: their borders cut words too.
    borders = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    begins[borders] = inside[borders + 1]
    ends[borders - 1] = inside[borders]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    count = lambda places: np.diff(np.searchsorted(places, offsets))
    n_words = count(starts)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    return [n_words, distinct_words(data, starts, stops - starts, doc, len(n_words)), *(count(np.flatnonzero(out & bit)) for bit in (CAPITAL, POINT, SYMBOL))]


def distinct_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words of each document that no earlier word of it equals."""
    short = length < LONG_WORD
    long_ones = {(d, data[s : s + n].tobytes()) for d, s, n in zip(doc[~short].tolist(), start[~short].tolist(), length[~short].tolist(), strict=True)}
    extra = np.bincount([d for d, _ in long_ones] or [0], minlength=n_docs) * bool(long_ones)
    start, length, doc = start[short], length[short], doc[short]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    def load(words: np.ndarray, at: int) -> np.ndarray:
        return eights[start[words] + at] & _KEEP[np.minimum(length[words] - at, 8)]

    every = np.arange(len(start))
    key = (doc.astype(np.uint64) << np.uint64(9)) ^ length.astype(np.uint64)
    left, at = every, 0
    while len(left):
        mixed = (key[left] ^ load(left, at)) * _MIX
        key[left] = mixed ^ (mixed >> np.uint64(31))
        at += 8
        left = left[length[left] > at]

    def equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = (key[a] == key[b]) & (doc[a] == doc[b]) & (length[a] == length[b])
        open_, at = np.flatnonzero(same), 0
        while len(open_):
            differ = load(a[open_], at) != load(b[open_], at)
            same[open_[differ]] = False
            at += 8
            open_ = open_[~differ & (length[a[open_]] > at)]
        return same

    size = 1 << max(4, int(2 * len(start)).bit_length())
    table = np.full(size, -1, np.int64)
    slot = (key & np.uint64(size - 1)).astype(np.int64)
    first = np.zeros(len(start), bool)
    waiting = every
    while len(waiting):
        at_slot = slot[waiting]
        free = table[at_slot] < 0
        table[at_slot[free]] = waiting[free]  # of several, one stays
        held = table[at_slot]
        first[waiting[held == waiting]] = True
        waiting = waiting[~equal(waiting, held)]
        slot[waiting] = (slot[waiting] + 1) & (size - 1)
    return np.bincount(doc[first], minlength=n_docs) + extra


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with MEASURES in place of the text; columns of these names are replaced."""
    kept = [c for c in docs.columns if c != text_col and c not in MEASURES]
    names = [f"c{i}" for i in range(len(kept))]
    types = [docs.schema[c].dataType for c in kept]
    schema = T.StructType([*(T.StructField(n, t) for n, t in zip(names, types, strict=True)), *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "").cast(pa.large_binary())
            _, where, data = texts.buffers()
            offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data or b"", np.uint8)
            steps = np.flatnonzero(np.diff((offsets[1:] - offsets[0]) // STEP_BYTES)) + 1
            cuts = [0, *steps.tolist(), len(texts)]
            found = [transduce(data, offsets[a : b + 1]) for a, b in zip(cuts, cuts[1:]) if b > a]
            made = [pa.array(np.concatenate(m), pa.int64()) for m in zip(*found, strict=True)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*names, *MEASURES])

    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), *(F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)))
    made = rows.mapInArrow(run, schema)
    return made.select(*(F.col(n).alias(c) for n, c in zip(names, kept, strict=True)), *MEASURES)


def failures(docs: DataFrame, filters: Mapping[str, Column | str] = FILTERS, by: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, failed): for each document the bit set of the filters it fails, the first filter being bit 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    read = materialise(measure(rows.withColumn("digest", digest)), "filter-measures")
    firsts = read.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    judged = read.join(firsts, ["digest", "id"], "left").withColumn("is_copy", F.col("is_first").isNull() & F.col("id").isNotNull())
    bits = (F.when(F.expr(c) if isinstance(c, str) else c, 1 << k).otherwise(0) for k, c in enumerate(filters.values()))
    return judged.select("id", "part", sum(bits, F.lit(0)).alias("failed"))


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column | str] = FILTERS, by: str = "source", id_col: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    Names of filters are single characters; k filters have k! orders, so k is meant to be small.
    """
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    judged = failures(docs, filters, by, id_col).join(marks, "id", "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("bigint")).alias(c)
    cells = judged.groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), n("good"), n("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))

    letters = list(filters)
    bits = F.create_map(*(F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)))
    orders = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(letters)))).alias("filter_order")
    steps = parts.select("part", "cells", orders).select("*", F.posexplode(F.split("filter_order", "")).alias("pos", "letter"))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("pos")), F.lit(0), lambda acc, c: acc.bitwiseOR(bits[c]))
    at = steps.select("part", "filter_order", (F.col("pos") + 1).alias("step"), "cells", bits[F.col("letter")].alias("own"), before.alias("before"))

    def total(field: str, where: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter("cells", lambda c: where(c["failed"])), F.lit(0).cast("bigint"), lambda acc, c: acc + c[field])

    fails = lambda f, mask: f.bitwiseAND(mask) != 0
    own, before = F.col("own"), F.col("before")
    removed = lambda f: fails(f, own) & ~fails(f, before)
    # In all orders together a filter comes first among the k that a document fails in one k-th of them.
    share = F.aggregate(F.filter("cells", lambda c: fails(c["failed"], own)), F.lit(0).cast("bigint"), lambda acc, c: acc + F.call_function("div", c["n"] * factorial(len(letters)), F.bit_count(c["failed"])))
    return at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda f: ~fails(f, own.bitwiseOR(before))).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda f: fails(f, own) & fails(f, before)).alias("redundant"), total("n", lambda f: f == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), share.alias("shapley"),
    )
