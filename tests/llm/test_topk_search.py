import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orgweave.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10, of=7):
    own = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in own if i % of == 0}):
        v = min(x for i, x in own if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, c)), i) for i, c in own if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def got(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in T.search(df, F.col("vec_id") % 7 == 0, **options).collect())


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + spread * rng.normal(size=8)).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(60)]  # one very common vector
    small = {"pivots": 5, "rings": 3, "block_rows": 16, "query_block": 20, "sample_rows": 50}
    assert got(spark, rows, **small) == brute(rows)


def test_norms_differ(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * rng.choice([0.01, 1, 50])).tolist(), 0) for i in range(300)]
    assert got(spark, rows, pivots=4, rings=4, block_rows=32) == brute(rows)


def test_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (7, [0.5, -0.5], None), (1, None, 1), (2, [None, 1.0], 1),
            (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (None, [1.0, 1.0], 1), (5, [1.0, 2.0], 1), (5, [1.0, 2.0], 1), (6, [], 1),
            (14, [-3.0, 0.25], 1)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[3:4]) == [] and got(spark, []) == []
    crowd = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "cell": F.lit(2), "query_id": F.lit(3)})
    assert sorted(map(tuple, T.search(crowd, F.col("vec_id") % 7 == 0).collect())) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * rng.normal(size=(500, 6)))
    reach = float(np.einsum("ij,ij->i", x, x).max())
    pivots = T.choose_pivots(T._augmented(x[:40], reach), 5)
    none = np.zeros(0)
    shape = T.Geometry(6, reach, pivots, np.tile([2000.0, 3000.0], (5, 1)), none, none, none, none)
    home, dist, cell = shape.keys(x)
    cells = np.unique(cell)
    whole = T.Geometry(6, reach, pivots, shape.borders, cells, np.array([home[cell == c][0] for c in cells]),
                       np.array([dist[cell == c].min() for c in cells]), np.array([dist[cell == c].max() for c in cells]))
    q = np.floor(1024 * rng.normal(size=(30, 6)))
    bounds, scores = whole.bounds(q), q @ x.T
    for k, c in enumerate(cells):
        assert (scores[:, cell == c].max(axis=1) <= bounds[:, k]).all()
