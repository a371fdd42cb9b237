"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

Every sentence gets p = sigmoid(bias + weights of its distinct features: its words, and their beginnings, which also tell compounds); a
document's score is noisy-or, 1 - prod(1 - p). Only documents carry labels; the likelihood of the noisy-or is climbed by
Adagrad, so the gradient itself decides which sentences of a toxic document are to blame, and the
trained sentence scores locate them.

A feature enters the model only if its document share differs between the classes by `min_z` standard
errors; without this the long tail of rare words fits the noise. The shares are counted on the executors over a fixed-size hash
space, and only the features that enter travel to the driver. Training uses a bounded sample (`max_train_docs`, by hash of the id) of the
labelled documents; the model has one size at any scale. Scoring is map-only over all rows.

Defined results: null text is empty; a text without words is one empty sentence and gets the bias's score;
labels that are null are not used, and of labels that differ for one id the highest counts; of texts that repeat an id the smallest is
learnt from; without labels the score is that of a fixed small bias; sentences with equal p are in the order of the text; texts
of any length are read whole; repeated rows get equal scores; an empty table gives an empty result; a column named
like one that is added is replaced, others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.arrow import append_columns
from tidemark.sources.shared import materialise

BITS = 18
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


#: Lengths, in bytes, of the beginnings that words also count as.
_STEMS = (4, 5, 6, 7, 8, 9)
#: Words a Python worker remembers; beyond it the memory is emptied.
_MEMO_WORDS = 300_000
_memo: dict[bytes, tuple[int, ...]] = {}


def _features(word: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return (crc32(word) & mask, *(crc32(word[:n], 7) & mask for n in _STEMS if len(word) >= n))


def sentence_ids(text: str | None) -> list[tuple[int, int, list[int]]]:
    """(start, end, distinct hashed features) of every sentence with a word; at least one entry."""
    out = []
    if len(_memo) > _MEMO_WORDS:
        _memo.clear()
    for m in _SENTENCE.finditer(text or ""):
        ids: set[int] = set()
        for w in set(_WORD.findall(m[0].encode().lower())):
            found = _memo.get(w)
            if found is None:
                found = _memo[w] = _features(w)
            ids.update(found)
        if ids:
            out.append((m.start(), m.end(), sorted(ids)))
    return out or [(0, len(text or ""), [])]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sentence_logits(sentences: list[tuple[int, int, list[int]]], model: Model) -> np.ndarray:
    sizes = np.fromiter((len(s[2]) for s in sentences), np.int64, len(sentences))
    ids = np.fromiter((i for s in sentences for i in s[2]), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(sentences)), sizes)
    return model.bias + np.bincount(owner, model.weights[ids], minlength=len(sentences))


def train(docs: DataFrame, labels: DataFrame, max_train_docs: int = 12_000, rounds: int = 300, rate: float = 0.6, l2: float = 0.01, min_docs: int = 3, min_z: float = 5.0) -> Model:
    """Fit on `docs` (doc_id, text) with `labels` (doc_id, toxic).

    The sample is the labelled ids whose hash is below max_train_docs / ids: about that many rows, which
    is the bound that lets them be broadcast. Texts are read in place; only those of the sample are shuffled.
    """
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    if n == 0:
        return Model(np.zeros(1 << BITS, np.float32), -3.0)
    if n > max_train_docs:
        # 53 bits of the hash, as a share.
        known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < int(2**53 * max_train_docs / n))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = materialise(rows.select("text", "toxic"), "training-texts")

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[int(y > 0), np.unique(np.concatenate([np.array(s[2], np.int64) for s in sentence_ids(t)]))] += 1
        on = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(seen[0, on]), pa.array(seen[1, on])], names=["f", "zeros", "ones"])

    counts = rows.mapInArrow(shares, "f bigint, zeros bigint, ones bigint").groupBy("f").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    table = counts.where(F.col("zeros") + F.col("ones") >= min_docs).toArrow()  # 2^18 rows at most
    classes = {r["y"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    f, zeros, ones = (table.column(c).to_numpy() for c in ("f", "zeros", "ones"))
    enters = np.zeros(1 << BITS, bool)
    enters[f[_telling(zeros, ones, classes.get(False, 0), classes.get(True, 0), min_z)]] = True

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sents = [[np.array([i for i in s[2] if enters[i]], np.int32) for s in sentence_ids(t)] for t in b.column(0).to_pylist()]
            flat = [np.concatenate(d).tobytes() for d in sents]
            sizes = [np.array([len(s) for s in d if len(s)], np.int32).tobytes() for d in sents]
            bare = [sum(not len(s) for s in d) for d in sents]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(flat, pa.binary()), pa.array(sizes, pa.binary()), pa.array(bare, pa.int64())], names=["toxic", "ids", "sizes", "bare"])

    got = rows.mapInArrow(kept, "toxic int, ids binary, sizes binary, bare bigint").toArrow()
    per_doc = [np.frombuffer(x, np.int32) for x in got.column("sizes").to_pylist()]
    ids = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in got.column("ids").to_pylist())])
    return fit(got.column("toxic").to_numpy() > 0, ids, per_doc, got.column("bare").to_numpy(), rounds, rate, l2)


def fit(y: np.ndarray, ids: np.ndarray, per_doc: list[np.ndarray], bare: np.ndarray, rounds: int = 300, rate: float = 0.6, l2: float = 0.01) -> Model:
    """The noisy-or likelihood climbed by Adagrad. `ids`: features of all sentences that have any; `per_doc`: their numbers by sentence;
    `bare`: how many sentences of a document have none."""
    sizes = np.concatenate([np.zeros(0, np.int32), *per_doc])
    doc_of = np.repeat(np.arange(len(y)), [len(s) for s in per_doc])
    sent_of = np.repeat(np.arange(len(sizes)), sizes)
    w, bias = np.zeros(1 << BITS), -4.0
    g2, b2 = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        gw, gb = gradient(w, bias, y, ids, sent_of, doc_of, bare)
        gw += l2 / len(y) * w
        g2 += gw * gw
        b2 += gb * gb
        w -= rate * gw / np.sqrt(g2)
        bias -= rate * gb / np.sqrt(b2)
    return Model(w.astype(np.float32), float(bias))


def loss(w: np.ndarray, bias: float, y: np.ndarray, ids: np.ndarray, sent_of: np.ndarray, doc_of: np.ndarray, bare: np.ndarray) -> float:
    """Mean negative log-likelihood of the labels."""
    z = bias + np.bincount(sent_of, w[ids], minlength=len(doc_of))
    clean = np.bincount(doc_of, _softplus(z), minlength=len(y)) + bare * _softplus(bias)  # -log P(no toxic sentence)
    return float(np.where(y, -np.log(-np.expm1(-np.maximum(clean, 1e-9))), clean).mean())


def gradient(w: np.ndarray, bias: float, y: np.ndarray, ids: np.ndarray, sent_of: np.ndarray, doc_of: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, float]:
    z = bias + np.bincount(sent_of, w[ids], minlength=len(doc_of))
    clean = np.bincount(doc_of, _softplus(z), minlength=len(y)) + bare * _softplus(bias)
    pull = np.where(y, -1.0 / np.expm1(np.maximum(clean, 1e-9)), 1.0) / len(y)
    gz = pull[doc_of] / (1.0 + np.exp(-z))
    return np.bincount(ids, gz[sent_of], minlength=len(w)).astype(float), float(gz.sum() + (pull * bare).sum() / (1.0 + np.exp(-bias)))


def _telling(zeros: np.ndarray, ones: np.ndarray, n_zeros: int, n_ones: int, min_z: float) -> np.ndarray:
    """Which features differ in document share between the classes by `min_z` standard errors."""
    pos, neg = max(1, n_ones), max(1, n_zeros)
    rate = (zeros + ones) / (pos + neg)
    error = np.sqrt(np.maximum(rate * (1 - rate) * (1 / pos + 1 / neg), 1e-12))
    return np.abs(ones / pos - zeros / neg) >= min_z * error


def score(docs: DataFrame, model: Model, text_col: str = "text", worst: int | None = None) -> DataFrame:
    """`docs` with `score` and `sentences`: every sentence with p > 0.5 (start, end, p), worst first; `worst` asks for that many only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one fixed-size vector
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))

    def fn(texts: list[str | None]) -> list[list]:
        scores, places = [], []
        for t in texts:
            sents = sentence_ids(t)
            z = _sentence_logits(sents, shared.value)
            scores.append(float(-np.expm1(-_softplus(z).sum())))
            top = np.argsort(-z, kind="stable")[:worst]
            places.append([{"start": sents[i][0], "end": sents[i][1], "p": float(1 / (1 + np.exp(-z[i])))} for i in top if z[i] > 0])
        return [scores, places]

    return append_columns(docs, [text_col], [T.StructField("score", T.DoubleType()), T.StructField("sentences", spans)], fn)


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
