"""Benchmark items count whatever their ids are."""

import pytest

from tidemark.llm import decontam

ITEM = "the seven brass lanterns above the harbour wall were lit before the autumn tide came in"


@pytest.mark.parametrize(("kind", "ids"), [("string", ["mmlu-1", None]), ("long", [5, None]), ("int", [3, 2])])
def test_ids_of_any_type_and_null(spark, kind, ids):
    docs = spark.createDataFrame([(1, f"start {ITEM} end"), (2, "a clean text about nothing in particular that goes on for some words"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM, "x") for i in ids], f"item_id {kind}, text string, doc_id string")
    hits = [(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(docs, items).collect()]
    assert sorted(hits, key=str) == sorted([(1, i, 1.0) for i in ids], key=str)
    assert [r.doc_id for r in decontam.drop_contaminated(docs, items).orderBy("doc_id").collect()] == [2, 3]
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
