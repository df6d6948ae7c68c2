"""Robust outlier rules: counts by brute force, estimates on constructed data."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallscope.llm import outlier_rules as rules
from tests.conftest import SF01
from tests.llm.util import empty_docs, odd_docs, prose, words


def counts(t):
    w, t = words(t), t or ""
    tri = Counter(zip(w, w[1:], w[2:]))
    cover = [False] * len(w)
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            cover[i : i + 3] = [True] * 3
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(cover)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def check_counts(rows, texts):
    got = Counter((r.doc_id, *(r[c] for c in rules.BASE), r.base_failed) for r in rows)
    assert got == Counter((i, *counts(t), failed(counts(t))) for i, t in texts)
    assert not any(r.kept for r in rows if r.base_failed)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang", "source")
    judged = rules.outlier_rules(docs)
    rows = judged.collect()
    check_counts(rows, [(r.doc_id, r.text) for r in docs.collect()])
    good = {r.doc_id for r in spark.read.parquet(f"{SF01}/labels.parquet").where("quality = 1").collect()}
    clean = [r for r in rows if r.doc_id in good and not r.base_failed]
    assert all(r.kept for r in clean) and len(clean) > 200
    junk = [r for r in rows if r.n_symbols > r.n_words and not r.base_failed]
    assert junk and not any(r.kept for r in junk)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_texts(spark):
    extra = ["a a a\na a a\n\n b \n b \n" + prose(30, 60), "#*$%&|<> " * 60, "one\ntwo\none\n \n \none", "x y x y x y x y"]
    docs = odd_docs(spark, extra=("kept", "n_words", "lang", "x1", "l00", "scale", "__w")).withColumn("source", F.lit(None).cast("string"))
    more = spark.createDataFrame([(900 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    rows = rules.outlier_rules(docs).collect()
    check_counts(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert all(r.distance is None and r.kept for r in rows if not r.base_failed)  # too few rows to estimate anything
    assert rows[0].lang in ("extra", None) and rules.outlier_rules(
        empty_docs(spark).withColumns({"lang": F.lit("en"), "source": F.lit("s")})).collect() == []


def vectors(spark, n, bad, seed=1):
    """n correlated vectors per cell, a third of them in one cell, and far rows in ``bad`` places."""
    rng = np.random.default_rng(seed)
    mix = np.array([[1, 0.5, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 0.5, 0, 0], [0, 0, 0.2, 0.4, 0], [0, 0, 0, 0.1, 0.4]])
    x = rng.normal(size=(n, 5)) @ mix + 3
    x[:bad] = x[:bad] * 0.1 + [9, -4, 6, 5, 5]
    return [(i, "hot" if i % 3 == 0 else f"c{i % 5}", *map(float, r)) for i, r in enumerate(x)], mix


def test_estimates_resist_a_fifth_of_outliers(spark):
    n, bad = 1500, 300
    rows, mix = vectors(spark, n, bad)
    df = spark.createDataFrame(rows, "id int, __cell string, x1 double, x2 double, x3 double, x4 double, x5 double").repartition(4)
    model = rules.estimates(df.drop("id"))
    judged = df.join(model, "__cell").select("id", "__cell", F.sqrt(rules._distance2(5) * F.col("scale")).alias("d")).collect()
    far = {r.id for r in judged if r.d > 7}
    assert set(range(bad)) <= far and len(far) < bad + 0.01 * n
    # the factor reproduces the covariance of the clean rows (floored), not of all rows
    r = model.where("__cell = 'hot'").first()
    low = np.array([[r[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    want = mix.T @ mix + np.diag(np.square(rules.FLOOR))
    assert np.allclose(low @ low.T, want, atol=0.45) and abs(r.m0 - 3) < 0.4


def test_distances_equal_numpy(spark):
    rows, _ = vectors(spark, 300, 0)
    df = spark.createDataFrame([(i, "all", *r) for i, _, *r in rows], "id int, __cell string, x1 double, x2 double, x3 double, x4 double, x5 double")
    model = rules._cholesky(rules._moments(df, ["__cell"]), rules.FLOOR)
    got = {r.id: r.d for r in df.join(model, "__cell").select("id", rules._distance2(5).alias("d")).collect()}
    x = np.array([r[2:] for r in rows])
    cov = np.cov(x.T, bias=True) + np.diag(np.square(rules.FLOOR))
    z = x - x.mean(0)
    want = np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
    assert np.allclose([got[i] for i in range(300)], want)
    assert abs(model.first().logdet - np.log(np.linalg.det(cov)) / 2) < 1e-9


@pytest.mark.parametrize("sizes,want", [([80, 80, 10, 70], {"en|a": 2, "en|b": 2, "de|c": 1, "fr|a": 2})])
def test_small_cells_are_pooled(spark, sizes, want):
    rows = [(k.split("|")[0], k.split("|")[1]) for k, n in zip(want, sizes) for _ in range(n)]
    df = rules._cells(spark.createDataFrame(rows, "lang string, source string"), ["lang", "source"])
    depth = {(r.lang, r.source): r["__cell"] for r in df.distinct().collect()}
    for k, d in want.items():
        cell = depth[tuple(k.split("|"))]
        assert cell is None if d == 1 else cell.count("=") == d  # ten German rows: no cell is large enough


def ordinary(n=400, seed=3):
    """Vectors like those of plain prose: no symbols, few repeated lines or words."""
    rng = np.random.default_rng(seed)
    few = rng.random(n) < 0.1
    x = np.column_stack([rng.normal(5.7, 0.8, n), rng.normal(5.0, 0.24, n), np.zeros(n), 0.25 * few, 0.2 * few])
    return [list(map(float, r)) for r in x]


@pytest.mark.parametrize("feature,value", list(enumerate([12.5, 8.0, 0.4**0.5, 0.97, 0.78])))
def test_a_far_value_in_one_feature_is_rejected(spark, feature, value):
    plain = [5.7, 5.0, 0.0, 0.0, 0.0]
    far = [value if i == feature else x for i, x in enumerate(plain)]
    rows = [(i, "all", *r) for i, r in enumerate([far, plain, *ordinary()])]
    df = spark.createDataFrame(rows, "id int, __cell string, x1 double, x2 double, x3 double, x4 double, x5 double")
    model = rules.estimates(df.drop("id"))
    d = {r.id: r.d for r in df.join(model, "__cell").select("id", F.sqrt(rules._distance2(5) * F.col("scale")).alias("d")).collect()}
    assert d[0] > rules.LIMIT and all(d[i] <= rules.LIMIT for i in d if i)


def test_few_symbols_are_rejected(spark):
    """A table of pipes, 0.4 symbols a word, among prose."""
    texts = [prose(i, 80 + i) for i in range(100)]
    table = "".join(w + ("| " if i % 5 < 2 else " ") for i, w in enumerate(words(prose(500, 150))))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([table, *texts])], "doc_id int, text string, lang string, source string")
    kept = {r.doc_id: (r.kept, r.base_failed) for r in rules.outlier_rules(docs).collect()}
    assert kept.pop(0) == (False, False) and set(kept.values()) == {(True, False)}
