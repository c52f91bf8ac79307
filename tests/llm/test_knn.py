import math

import numpy as np
import pytest

from wattline.llm import knn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    fine = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = min(fine.get(i, v), v)
    out = []
    for q in fine:
        if q % every:
            continue
        a = np.array(fine[q], np.float32).astype(float)
        found = []
        for i, v in fine.items():
            if i != q and len(v) == len(a):
                b = np.array(v, np.float32).astype(float)
                found.append((-float(knn.cosine(a[None], b[None])[0]), i))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def sample(n=700, dim=16):
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(n, dim)).astype(np.float32)
    vectors[100:160] = vectors[100]  # copies and ties
    vectors[200:220] = vectors[200] * np.arange(1, 21)[:, None].astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [
        (800, None, 1), (801, [], 1), (850, [0.0] * dim, 1), (803, [float("nan")] * dim, 1), (804, [None] * dim, 1),
        (805, [float("inf")] + [1.0] * (dim - 1), 1), (None, [1.0] * dim, 1), (900, [1.0, 2.0], 1), (901, [2.0, 1.0], 1),
        (950, [1e-30] * dim, 1), (951, [3e38] * dim, 1), (0, rows[0][1], 0), (1, rows[5][1], 0),
    ]
    return rows


@pytest.mark.parametrize("k", [5, 1000])
def test_equals_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(knn, "BLOCK", 64)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 4)
    rows = sample(260 if k > 5 else 700)
    vectors = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as dim", "3 as score")
    got = knn.nearest(vectors.where("vec_id % 50 = 0"), vectors, k=k).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, k, 50)


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    a, b = rnd.normal(size=(50, 64)), rnd.standard_cauchy(size=(80, 64))
    (ca, sa, na, la), (cb, sb, _, lb) = knn.quantised(a), knn.quantised(b)
    about = (ca.astype(int) @ cb.T.astype(int)) * (sa[:, None] * sb[None, :])
    true = np.array([[float(knn.cosine(x[None], y[None])[0]) for y in b] for x in a])
    assert (np.abs(true - about) <= la[:, None] + na[:, None] * lb[None, :] + 1e-12).all()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame(sample(260), SCHEMA)
    assert knn.nearest(empty, empty).collect() == []
    assert knn.nearest(some.where("vec_id = 0"), empty).collect() == []
