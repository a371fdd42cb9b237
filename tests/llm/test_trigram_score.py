"""The registered trigram scores against brute force on the tables."""

import pytest
from test_operators import brute_lm

from tidemark.llm import queries


def test_registered_order_is_three(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.log_score for r in queries.QUERIES["op1_trigram_score"](spark, sf).collect()}
    want = dict(zip((r.doc_id for r in rows), brute_lm([r.text for r in rows], 3), strict=True))
    assert got == pytest.approx(want, abs=1e-3)
