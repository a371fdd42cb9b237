"""Every offending sentence is located."""

from zlib import crc32

import numpy as np

from tidemark.llm import queries, toxicity


def test_all_offending_sentences(spark, sf):
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    weights[crc32(b"awfulword") & ((1 << toxicity.BITS) - 1)] = 9.0
    text = " ".join(f"awfulword number{i}. plain number{i}." for i in range(10))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = toxicity.Model(weights, -4.0)
    found = toxicity.score(df, model).first().sentences
    assert [text[s.start : s.end].split()[0] for s in found] == ["awfulword"] * 10 and len({s.start for s in found}) == 10
    assert len(toxicity.score(df, model, worst=3).first().sentences) == 3
