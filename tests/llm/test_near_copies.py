"""Near copies against every pair's similarity."""

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import near_copies


def brute_groups(rows, similar=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) >= similar * max(len(x), len(y)) and len(x & y) >= similar * len(x | y):
                u, v = sorted((find(i), find(j)))
                root[v] = u
    return {i: find(i) for i in ids}


def family_rows():
    rng = np.random.default_rng(4)
    rows, shared = [], [f"shared{k}" for k in range(60)]
    for f in range(30):
        base = [f"f{f}w{k}" for k in range(120)]
        for _ in range(4):
            words = base.copy()
            for p in rng.integers(0, 120, int(rng.integers(0, 5))):
                words[p] = f"new{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(200 + i, " ".join(shared + [f"own{i}x{k}" for k in range(40)])) for i in range(20)]  # a template is no copy
    return rows + [(300, None), (301, " "), (302, "too short"), (303, "Too  short")]


@pytest.mark.parametrize("leaf_rows,leaf_words,work", [(1024, 4_000_000, 200_000_000), (2, 4_000_000, 200_000_000), (1024, 300, 200_000_000), (1024, 4_000_000, 900)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, leaf_rows, leaf_words, work):
    monkeypatch.setattr(near_copies, "CLUSTER_WORK", work)
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(df, leaf_rows=leaf_rows, leaf_words=leaf_words).collect()}
    assert got == brute_groups(rows)
    assert near_copies.near_duplicates(df.limit(0)).count() == 0


def test_stage_drops_edited_copies_and_keeps_the_rest(spark):
    rows = family_rows()
    docs = spark.createDataFrame([*rows, rows[5], (None, rows[5][1])], "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(brute_groups(rows).values())) and kept.count(None) == 1


def test_recall_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in near_copies.near_duplicates(docs).collect()}
    assert got == brute_groups(rows)
