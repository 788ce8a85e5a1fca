import math

import numpy as np
from pyspark.sql import functions as F

from kalends.llm.ann import search


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_ranks_and_scores(spark):
    rng = np.random.default_rng(4)
    vectors = {i: rng.standard_normal(24).tolist() for i in range(900)}
    for i in range(900, 960):
        vectors[i] = vectors[i % 7]  # groups of copies
    odd = [(2000, None), (2020, [0.0] * 24), (2040, [math.nan] * 24), (2060, [None] + [1.0] * 23), (None, [1.0] * 24), (2100, [math.inf] * 24)]
    rows = spark.createDataFrame([(i, v, 1) for i, v in [*vectors.items(), *odd, (5, vectors[5])]], "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in search(rows, F.col("vec_id") % 20 == 0, k=10, chunk_rows=300, query_rows=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, best in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert all(abs(s - np.dot(vectors[q], vectors[i])) < 1e-12 for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for i, _ in best})
    assert hits >= 0.9 * 10 * len(want)


def test_shorter_vectors_and_repeated_ids(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 3.0]), (1, [2.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in search(rows, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2.0), (2, 1.5), (3, 1.5)]


def test_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 4.0), (2, 2, 1.5)]
    assert search(few.limit(0), F.col("vec_id") == 0).collect() == []
