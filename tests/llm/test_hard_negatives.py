import math

import numpy as np
from pyspark.sql import functions as F

from kalends.llm import hard_negatives
from kalends.llm.hard_negatives import mine


def brute(rows):
    known = {}
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(256 * x) for x in v]
            known[i] = min(known.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(known[a][1], known[b][1], strict=False))
    out = []
    for a in (i for i in known if i % 50 == 0):
        ranked = sorted((-score(a, b), b) for b in known if b != a)
        near = [(s, b) for s, b in ranked if known[b][0] == known[a][0]][:5]
        for p, b in near:
            inside = [(s, c) for s, c in ranked if known[c][0] != known[a][0] and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(a, b, k, c, -p, -s) for k, (s, c) in enumerate(inside, 1)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>, codes string"


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = sorted(map(tuple, mine(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(rows)
    return got


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 4)), (rng.standard_normal(10) * 0.3).tolist()) for i in range(900)]
    rows += [(i, int(rng.integers(0, 3)), rows[i % 5][2]) for i in range(900, 1000)]  # copies tie
    rows += [(1000, None, [1.0] * 10), (1050, 1, None), (1100, 1, [math.nan] * 10), (1150, 1, [None] + [1.0] * 9), (None, 1, [1.0] * 10), (1200, 1, [0.0] * 10), (1250, 2, [0.4] * 7), (1300, 77, [0.1] * 10), (5, rows[5][1], rows[5][2])]
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 300)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 8)
    assert len(check(spark, rows)) > 50


def test_few_or_no_rows(spark):
    check(spark, [(0, 1, [1.0, 0.5, 0.2]), (1, 1, [0.9, 0.4, 0.1]), (2, 2, [0.5, 0.5, 0.1]), (3, 2, [-1.0, 0.0, 0.0])])
    assert check(spark, [(0, 1, [1.0])]) == []
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).collect() == []


def test_limits_hold():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.standard_normal((3000, 16)) * 40)
    books = hard_negatives.Codebooks.fit(rows[:1000])
    codes, rest = books.encode(rows)
    v = rows.astype(np.int64)
    own = hard_negatives.Block(np.arange(3000), np.zeros(3000), v, codes, rest)
    asked = hard_negatives.Block(np.arange(200), np.zeros(200), v[:200])
    for part, near, far in hard_negatives.limits(own, np.arange(3000), books, asked, np.arange(200)):
        exact = v @ v[part].T
        assert (near <= exact).all() and (exact <= far).all()
        assert ((far - near) < 0.5 * np.ptp(exact)).mean() > 0.9
