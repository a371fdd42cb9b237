"""Blocks of op11 as they are stored and shuffled: rows of a step each, whatever the block holds."""

import pickle
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import token_align

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    """About five steps of STEP_CHARS."""
    rng = np.random.default_rng(3)
    return [" ".join(f"w{a} x{b}" for a, b in zip(rng.integers(0, 977, 5000), rng.integers(0, 31 + i, 5000), strict=True)) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_no_row_holds_a_whole_block(docs):
    rows = token_align._blocks(docs, "doc_id", "text", RANKS, PIECES).collect()
    assert len({r.block for r in rows}) == 1
    sizes = [len(pickle.dumps(r.asDict())) for r in rows]
    assert max(sizes) < sum(sizes) / 2


@pytest.mark.parametrize("block_pairs", [1_000_000, 30_000])
def test_counts_meet_the_rows_in_small_batches(spark, docs, texts, monkeypatch, block_pairs):
    monkeypatch.setattr(token_align, "BLOCK_PAIRS", block_pairs)
    b = token_align.align_texts(token_align.Tokenizers(RANKS, PIECES), texts)
    n_b = len(token_align.Tokenizers(RANKS, PIECES).bytes_b)
    held, best = Counter(b.pairs.tolist()), Counter()
    for pair, n in held.items():
        best[pair // n_b] = max(best[pair // n_b], n)
    ends = np.cumsum(b.n_pairs).tolist()
    want = {}
    for i, end in enumerate(ends):
        own = [(p, t) for p, t in zip(b.pairs[end - b.n_pairs[i] : end].tolist(), b.times[end - b.n_pairs[i] : end].tolist(), strict=True)]
        want[i] = (int(b.n_links[i]), sum(t for p, t in own if held[p] == best[p // n_b]), sum(t * held[p] for p, t in own), b.digests[i])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 60)
    try:
        out = token_align.align(docs, RANKS, PIECES).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out} == want
