import math
import random

import numpy as np
import pytest

from gridloom.llm import topk


def brute(rows, k):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            v = [math.floor(64 * x) for x in v]
            kept[i] = min(kept.get(i, v), v)
    out = []
    for q, a in kept.items():
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in kept.items() if i != q)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "spread"), [(64, 0.3), (5, 0.05), (40, 1e6)])
def test_against_brute_force(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(topk, "CANDIDATES", (50, 100))
    monkeypatch.setattr(topk, "QUERIES", 4)
    r = random.Random(dims)
    rows = [(i, [float(r.randint(-40, 40)) / 64 * spread for _ in range(dims)]) for i in range(-100, 200)]
    rows += [(20, [0.1]), (20, rows[0][1]), (400, None), (420, [1.0, None]), (440, [math.nan] * dims), (460, [math.inf]), (480, []), (481, rows[5][1]), (482, rows[5][1]), (None, [1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(x) for x in topk.top_k(df).collect())
    assert got == brute(rows, 20)


def test_scores_beyond_64_bits_keep_their_order():
    q, x = np.array([[2**40, 0]]), np.array([[2**40, 2**41, -(2**42)], [1, 1, 1]])
    got = topk.search(q, np.array([9]), x, np.array([1, 2, 3]), 20)
    assert got[1].tolist() == [2, 1, 3] and got[2].tolist() == [2**63 - 1, 2**63 - 1, -(2**63)]


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(x) for x in topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [1.0])], schema)).collect()] == [(0, 1, 1, 4096)]
