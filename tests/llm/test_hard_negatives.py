import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.llm.hard_negatives import first_k, hard_negatives, strassen
from tests.llm.util import same_rows

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                       T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType())])
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every, n_pos=5, n_neg=10):
    """Python integers and full sorts."""
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    kept = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w)), i, k) for i, (k, w) in kept.items() if i != a), key=lambda s: s[:2])
        for p, pid, _ in [s for s in scores if s[2] == label][:n_pos]:
            fit = [(-s, i) for s, i, k in scores if k != label and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a, pid, r + 1, i, -p, s) for r, (s, i) in enumerate(fit[:n_neg])]
    return out


def vectors(n, width, seed, copies=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(0.3, 0.5, width).round(1 if copies else 3).tolist()  # coarse values make ties
        rows.append((i, [0.5] * width if copies and i % 3 == 0 else v, int(rng.integers(0, 4)), "extra"))
    return rows


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (40, 33, 70), (129, 64, 257), (64, 64, 64), (200, 1, 30), (17, 90, 17)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-2**28, 2**28, (m, k)), rng.integers(-2**28, 2**28, (k, n))
    assert (strassen(a, b, leaf=4) == a @ b).all()
    assert [[int(x) for x in r] for r in strassen(a, b)] == [
        [sum(int(a[i, t]) * int(b[t, j]) for t in range(k)) for j in range(n)] for i in range(m)]


def test_strassen_wraps_like_the_ring():
    """Intermediate sums may leave 64 bits; the result is exact all the same."""
    big = np.full((32, 32), 2**31, np.int64)
    b = np.eye(32, dtype=np.int64) * 2**31
    assert (strassen(big, b, leaf=4) == 2**62).all()


def test_first_k_takes_ties_by_column():
    scores = np.array([[5, 7, 7, 1, 7], [1, 1, 1, 1, 1], [9, 8, 7, 6, 5]])
    valid = np.array([[1, 1, 1, 1, 1], [0, 1, 0, 1, 1], [0, 0, 0, 0, 0]], bool)
    assert {r: list(c) for r, c in first_k(scores, valid, 2)} == {0: [1, 2], 1: [1, 3]}


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("group_bytes", [4 << 20, 1])
def test_equals_brute_force(spark, copies, group_bytes):
    """In one cell and in many (group_bytes=1: 256 rows a group); ties, and a third of the rows alike."""
    rows = vectors(700, 11, 5, copies)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, group_bytes=group_bytes)
    assert got.columns == list(COLUMNS)
    same_rows([tuple(r) for r in got.collect()], plain(rows, 10))


def test_odd_rows(spark):
    """Nulls anywhere, non-finite components, empty and shorter vectors, repeated ids, clashing columns."""
    rows = vectors(60, 4, 9)
    rows += [(None, [1.0] * 4, 1, "x"), (200, None, 1, "x"), (300, [1.0] * 4, None, "x"), (400, [1.0, None, 1.0, 1.0], 2, "x"),
             (500, [float("nan")] * 4, 2, "x"), (600, [float("inf"), 0.0, 0.0, 0.0], 2, "x"), (700, [], 2, "x"), (800, [2.0], 1, "x"),
             (10, [3.0] * 4, 0, "x"), (10, [3.0] * 4, 0, "x"), (20, [-3.0, 0.0, 0.0, 0.0], 3, "x"), (-30, [0.7] * 4, 3, "x")]
    got = hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    padded = [(i, None if v is None else [*v, *([0.0] * (4 - len(v)))], k, x) for i, v, k, x in rows]
    same_rows([tuple(r) for r in got.collect()], plain(padded, 10))


def test_empty_table_and_large_components(spark):
    empty = hard_negatives(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0)
    assert empty.columns == list(COLUMNS) and empty.count() == 0
    huge = spark.createDataFrame([(i, [1e12] * 3, i % 2, "x") for i in range(6)], SCHEMA)
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives(huge, F.col("vec_id") % 10 == 0).collect()
