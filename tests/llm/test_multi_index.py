"""The inverted multi-index against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseforge.llm import multi_index
from proseforge.llm.queries import op3_multi_index


def brute(rows, queries, k):
    """Exact neighbours from (id, vector) rows: largest product first, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], float)
    out = {}
    for i, v in queries:
        score = sum(points[:, d] * float(v[d]) for d in range(len(v)))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_heap_visits_cells_in_order():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(7, 3)), draw.normal(size=(5, 3))
    sizes, query = draw.integers(0, 3, 35), draw.normal(size=6)
    got = multi_index.visited(query, centres, sizes, int(sizes.sum()))
    total = (centres[0] @ query[:3])[:, None] + (centres[1] @ query[3:])[None, :]
    want = [c for c in np.argsort(-total.ravel()).tolist() if sizes[c]]
    assert got == want
    some = multi_index.visited(query, centres, sizes, 9)
    assert some == want[: len(some)] and sizes[some].sum() >= 9 > sizes[some[:-1]].sum()


def test_shards_are_bounded():
    sizes = np.array([3, 0, 50, 4, 4, 4, 9, 100, 1])
    first, many = multi_index.pack(sizes, 10)
    held = {}
    for c, n in enumerate(sizes.tolist()):
        for s in range(many[c]):
            held.setdefault(int(first[c]) + s, []).append(n / many[c])
    assert all(sum(v) <= 10 for v in held.values()) and many.tolist() == [1, 1, 5, 1, 1, 1, 1, 10, 1]


def test_all_cells_give_exact_results_on_odd_rows(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=6).round(1).tolist()) for i in range(200)]
    hot = [1.0, 0.0, 0.0, 0.5, 0.0, 2.0]
    rows += [(200 + i, hot) for i in range(150)]
    odd = [(900, None), (901, [0.0] * 6), (902, [math.nan] + [1.0] * 5), (903, [None] + [1.0] * 5), (904, [math.inf] * 6), (905, [1.0] * 3), (906, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "cell": F.lit(1)})
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    settings = multi_index.Settings(centroids=5, visit=1.0, shard=40, block=8)
    got = by_query(multi_index.search(df, F.col("vec_id") % 10 == 0, settings=settings))
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 20)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 1.0]), (5, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert by_query(multi_index.search(df, F.col("vec_id") % 20 == 0)) == {20: [(3, 0.5), (5, 0.5)]}
    assert multi_index.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.search(df, F.col("vec_id") % 20 == 1).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert multi_index.search(one, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = by_query(op3_multi_index(spark, folder))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    scores = {(q, i): s for q, v in want.items() for i, s in v}
    hits = sum((q, i) in scores for q, v in got.items() for i, _ in v)
    assert all(s == scores[q, i] for q, v in got.items() for i, s in v if (q, i) in scores)
    assert hits >= 0.9 * len(scores)
