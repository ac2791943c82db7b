import math
import random

import pytest
from pyspark.sql import functions as F

from riskframe.llm.topk import top_inner_products

SCHEMA = "vec_id long, embedding array<float>, score long, x int"


def brute(rows, k=5, every=5):
    import numpy as np

    good = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        good.setdefault(vec_id, []).append(tuple(math.floor(256 * float(np.float32(c))) for c in v))
    points = sorted((i, v) for i, vs in good.items() for v in vs)
    out = []
    for q in sorted(i for i in good if i % every == 0):
        for query in sorted(good[q])[:1]:
            scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in points if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def table(n=300, seed=0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], 1, 2) for i in range(n)]
    hot = [0.5] * 8
    rows += [(1000 + i, hot, 1, 2) for i in range(200)]  # one vector many times
    rows += [(2000, None, 1, 2), (2005, [], 1, 2), (2010, [1.0] * 7 + [None], 1, 2)]
    rows += [(2015, [1.0] * 7 + [float("nan")], 1, 2), (2020, [float("inf")] * 8, 1, 2), (None, hot, 1, 2)]
    rows += [(3000, [0.25] * 3, 1, 2), rows[7], rows[7], rows[11], rows[20]]  # a shorter vector, repeated rows
    best = [3.0] * 8
    rows += [(25, best, 1, 2), (25, [2.5] * 8, 1, 2), (31, best, 1, 2), (31, best, 1, 2)]  # several vectors of an id
    rows += [(4000 + i // 2, [4.0] * 8, 1, 2) for i in range(30)]  # every row of two equal ones
    return rows


@pytest.mark.parametrize("block,lists", [(4096, 2), (20, 4), (4096, 1)])
def test_equals_brute_force(spark, block, lists):
    rows = table()
    out = top_inner_products(
        spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0, lists=lists, block_queries=block
    )
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))


def test_fewer_rows_than_asked_and_none(spark):
    rows = [(0, [1.0, 2.0], 0, 0), (5, [2.0, -1.0], 0, 0), (7, [1.0, 2.0], 0, 0)]
    out = top_inner_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))
    empty = spark.createDataFrame([], SCHEMA)
    assert top_inner_products(empty, F.col("vec_id") % 5 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [3e6, 1.0], 0, 0), (1, [3e6, -7.0], 0, 0), (2, [3e6, 9.0], 0, 0)]
    out = top_inner_products(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))
