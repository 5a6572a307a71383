"""Hard negatives against a plain product of all anchors and rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluo.llm import negatives, queries

from ..oracle import connect, difference

SCHEMA = "vec_id long, embedding array<double>, label int, id long, row string, g double, windows int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0.5, 3) for r in rows], SCHEMA).repartition(3)


def mined(df, **how):
    divides = lambda n: F.col("vec_id") % n == 0
    label = F.when(divides(7), (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(df, divides(10), label=label, **how)


def plain(rows, positives=5, hard=5, low=80):
    own = []
    for i, (vec, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((vec, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec is not None and vec % 7 == 0 else label, i))
    out = []
    for a in own:
        if a[0] is None or a[0] % 10:
            continue
        key = lambda s: (-s[0], s[1][0] is None, s[1][0] or 0)
        all_scores = sorted(((sum(x * y for x, y in zip(a[1], b[1], strict=False)), b) for b in own if b[3] != a[3]), key=key)
        for ps, p in [s for s in all_scores if s[1][2] == a[2]][:positives]:
            found = [s for s in all_scores if s[1][2] != a[2] and low * ps <= 100 * s[0] <= 100 * ps][:hard]
            out += [(a[0], p[0], k + 1, n[0], ps, ns) for k, (ns, n) in enumerate(found)]
    return sorted(out, key=repr)


def random_rows(seed, n, dims, copies=0):
    r = random.Random(seed)
    base = [r.gauss(0, 0.2) for _ in range(dims)]
    rows = [(i, [b + r.gauss(0, 0.3) for b in base], r.choice([0, 0, 0, 1, 2, 3, 9])) for i in range(n)]
    rows += [(n + i, list(base), i % 3) for i in range(copies)]
    nan, inf = float("nan"), float("inf")
    short, none = base[: dims // 2], [None] * dims
    return rows + [(None, base, 1), (None, base, 0), (7, base, None), (8, None, 1), (90, [nan, *base[1:]], 1), (91, [*base[1:], -inf], 1), (92, none, 2), (93, [], 1), (94, short, 1), (10, base, 4), (10, base, 4), (10, short, 0)]


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "ROWS", 9)


@pytest.mark.parametrize(("n", "dims", "copies"), [(120, 70, 40), (60, 3, 60), (40, 32, 0)])
def test_against_plain_product(spark, small_blocks, n, dims, copies):
    rows = random_rows(n, n, dims, copies)
    assert sorted((tuple(r) for r in mined(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_other_counts_and_one_block(spark):
    rows = random_rows(9, 80, 8)
    assert sorted((tuple(r) for r in mined(frame(spark, rows), positives=2, negatives=3, low=50).collect()), key=repr) == plain(rows, 2, 3, 50)


def test_empty_and_without_anchors(spark):
    assert mined(frame(spark, [])).count() == 0
    assert mined(frame(spark, [(1, [0.5], 1), (2, [0.5], 2)])).count() == 0
    assert mined(frame(spark, [(10, [0.5], 1)])).count() == 0


def test_large_components_stay_exact(spark):
    a = np.array([[2**26, 3], [-(2**26), 1]], np.int64)
    assert negatives.product(a, a).tolist() == [[2**52 + 9, -(2**52) + 3], [-(2**52) + 3, 2**52 + 1]]
    assert negatives.product(a * 4, a * 4).tolist() == [[16 * (2**52 + 9), 16 * (3 - 2**52)], [16 * (3 - 2**52), 16 * (2**52 + 1)]]
    rows = [(10, [1e300, 1.0], 1), (11, [1e300, 1.0], 1), (12, [1e300, 0.5], 2)]
    [r] = mined(frame(spark, rows)).collect()
    assert 0 < r.negative_score < r.positive_score <= negatives.MOST


def test_query_against_sql(spark, small):
    assert difference(queries.op11_hard_negatives(spark, small), connect(small), negatives.ORACLE_SQL) == ""
