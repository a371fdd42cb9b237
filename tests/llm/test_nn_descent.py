"""NN-descent against brute force: recall on the given vectors, whole results on awkward and small tables."""

import numpy as np
import pytest

from tidemark.llm import nn_descent, queries

NAN = float("nan")


def brute(rows, every=20, k=20):
    """The contract on (id, vector) rows."""
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i] = max(best.get(i, v), v)
    sizes = [len(v) for v in best.values()]
    dims = max(set(sizes), key=lambda d: (sizes.count(d), d)) if sizes else 0
    kept = {i: v for i, v in best.items() if len(v) == dims}
    out = set()
    for q, x in kept.items():
        if q % every == 0:
            scored = sorted((-round(sum(float(a) * float(b) for a, b in zip(x, v, strict=True)), 12), i) for i, v in kept.items() if i != q)
            out |= {(q, rank, i, round(-s, 9)) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def table(spark, rows):
    """Vectors as the operator gets them; `rows` keep what the column holds."""
    for k, (i, v) in enumerate(rows):
        rows[k] = (i, v if v is None else [x if x is None else float(np.float32(x)) for x in v])
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, rank int")


def answers(df):
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in df.collect()}


def test_recall_of_the_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = answers(queries.op12_nn_descent(spark, sf)), brute(rows)
    assert len(got) == len(want) == len({(q, rank) for q, rank, *_ in got})
    pairs, found = {(q, i): s for q, _, i, s in want}, {(q, i): s for q, _, i, s in got}
    assert len(pairs.keys() & found.keys()) >= 0.97 * len(pairs)
    assert all(found[p] == pytest.approx(pairs[p], abs=1e-8) for p in pairs.keys() & found.keys())


def test_awkward_rows_and_a_hot_vector(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(100)]
    hot = rng.standard_normal(8).astype(np.float32).tolist()
    rows += [(i, hot) for i in range(200, 300)]
    rows += [(400, None), (420, []), (440, [0.0] * 8), (460, [None] + hot[1:]), (480, [NAN] + hot[1:]), (500, [float("inf")] + hot[1:]), (None, hot), (520, hot[:5])]
    rows += [(-20, [-x for x in hot]), (40, rows[40][1]), (41, hot), (2**40, [x * 30 for x in hot])]
    assert answers(nn_descent.neighbours(table(spark, rows).repartition(5))) == brute(rows)


def test_inner_product_not_angle(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(12) * rng.gamma(1.0, 4.0)).astype(np.float32).tolist()) for i in range(600)]
    got, want = answers(nn_descent.neighbours(table(spark, rows))), brute(rows)
    assert len({x[:1] + x[2:3] for x in got} & {x[:1] + x[2:3] for x in want}) >= 0.9 * len(want) and len(got) == len(want)


@pytest.mark.parametrize("n", [0, 1, 2, 21, 30])
def test_small_tables_return_all_there_are(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(n)]
    assert answers(nn_descent.neighbours(table(spark, rows))) == brute(rows)


def test_groups_far_apart_still_fill_the_answer(spark):
    rng = np.random.default_rng(9)
    centres = np.eye(8)[:4] * 100
    rows = [(i, (centres[i % 4] + rng.standard_normal(8) * 0.01).astype(np.float32).tolist()) for i in range(60)]
    got = answers(nn_descent.neighbours(table(spark, rows)))
    assert len(got) == 3 * 20
    assert {x[:1] + x[2:3] for x in got} == {x[:1] + x[2:3] for x in brute(rows)}


def test_queries_from_outside(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist()) for i in range(300)]
    index = nn_descent.build(table(spark, rows))
    asked = spark.createDataFrame([(7000, rng.standard_normal(6).tolist(), None), (20, rows[3][1], None)], "query_id long, embedding array<double>, node long")
    got = {(r.query_id, r.vec_id) for r in nn_descent.search(index, asked, 5).collect()}
    want = set()
    for q, v, _ in asked.collect():
        score = {i: float(np.dot(v, x)) for i, x in rows if i != q}
        want |= {(q, i) for i in sorted(score, key=lambda i: (-score[i], i))[:5]}
    assert len(got & want) >= 9 and len(got) == 10
