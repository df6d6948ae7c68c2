"""Bootstrap intervals: weights, independence of partitioning, and coverage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallscope.operators import bootstrap as B, metrics
from recallscope.sources import views
from tests.conftest import SF001


def test_weights_are_poisson():
    """Mean, variance and frequencies over keys and over replicates; no dependence between the two."""
    keys = np.concatenate([np.arange(3000), np.arange(3000) * 2**33 - 7, -np.arange(1, 3000)])
    w = B.weights(keys, 100)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    for k in range(5):
        assert abs((w == k).mean() - math.exp(-1) / math.factorial(k)) < 0.003
    assert np.abs(w.mean(axis=0) - 1).max() < 0.06 and np.abs(w.mean(axis=1) - 1).max() < 0.6
    assert np.abs(np.corrcoef(w[:, :40].T) - np.eye(40)).max() < 0.06
    assert (B.weights(keys[::-1], 100)[::-1] == w).all() and (B.weights(keys, 60) == w[:, :60]).all()
    assert (B.weights(keys, 100, seed=2) != w).mean() > 0.5


def _log(spark, rows):
    return spark.createDataFrame(rows, "trial_idx long, vendor string, condition string, ground_truth string, parsed_output string")


def _simulated(rng, n, recall, precision, first=0):
    """A log of n trials with unequal classes."""
    truth = rng.random(n) < 0.3
    hit = np.where(truth, rng.random(n) < recall, rng.random(n) >= precision)
    name = lambda b: "POSITIVE" if b else "NEGATIVE"
    return [(first + i, name(t), name(h)) for i, (t, h) in enumerate(zip(truth.tolist(), hit.tolist()))]


def _f1(tp, fn, fp, tn):
    return (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2


def test_counts_by_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v, "c", t, p) for v in ("a", "b") for i, t, p in _simulated(rng, 80, 0.8, 0.9)]
    rows += [(5, "a", "c", "POSITIVE", "ERROR"), (6, "a", "c", None, "POSITIVE"), (7, None, "c", "POSITIVE", "POSITIVE"), (3, "a", "c", "POSITIVE", "POSITIVE")]
    want = {}
    for i, v, c, t, p in rows:
        if v and t and p in ("POSITIVE", "NEGATIVE"):
            cell = {"POSITIVEPOSITIVE": 0, "POSITIVENEGATIVE": 1, "NEGATIVEPOSITIVE": 2, "NEGATIVENEGATIVE": 3}[t + p]
            for r, w in enumerate(B.weights(np.array([i]), 30)[0]):
                want.setdefault((v, c, r), [0, 0, 0, 0])[cell] += int(w)
    for parts in (1, 7):
        got = B.replicate_counts(_log(spark, rows).repartition(parts), 30).collect()
        assert {(r.vendor, r.condition, r.replicate): [r.tp, r.fn, r.fp, r.tn] for r in got} == want


def test_coverage(spark):
    """120 simulated logs of one process: the 95 % interval of macro F1 holds the true value about as often
    as it says; every log is a setting of one job."""
    rng = np.random.default_rng(7)
    recall, precision, p = 0.75, 0.9, 0.3
    true = _f1(p * recall, p * (1 - recall), (1 - p) * (1 - precision), (1 - p) * precision)
    rows = [(i, f"v{k}", "c", t, h) for k in range(120) for i, t, h in _simulated(rng, 150, recall, precision, first=k * 1000)]
    got = B.bootstrap_intervals(_log(spark, rows).repartition(4), replicates=300).collect()
    assert len(got) == 120
    held = np.mean([r.f1_macro_lower <= true <= r.f1_macro_upper for r in got])
    assert 0.88 <= held <= 0.99
    assert all(r.f1_macro_lower <= r.f1_macro <= r.f1_macro_upper for r in got)
    width = np.mean([r.f1_macro_upper - r.f1_macro_lower for r in got])
    sd = np.std([r.f1_macro for r in got])
    assert 0.8 < width / (2 * 1.96 * sd) < 1.25  # as wide as the estimate really varies


def test_odd_settings(spark):
    rows = [(1, "a", "c", "POSITIVE", "ERROR"), (2, "b", "c", "POSITIVE", "POSITIVE"), (3, "b", "c", "POSITIVE", "POSITIVE")]
    got = {r.vendor: r for r in B.bootstrap_intervals(_log(spark, rows), replicates=20).collect()}
    assert got["a"].n_pairs == 0 and got["a"].f1_macro_lower is None and got["a"].accuracy_upper is None
    assert got["b"].accuracy_lower == got["b"].accuracy_upper == 1.0 and got["b"].specificity_lower is None
    assert B.bootstrap_intervals(_log(spark, [])).count() == 0
    with pytest.raises(Exception, match="trial key"):
        B.bootstrap_intervals(_log(spark, [(None, "a", "c", "POSITIVE", "POSITIVE")])).collect()
    with pytest.raises(ValueError):
        B.bootstrap_intervals(_log(spark, rows), level=1.0)


def test_one_pass_and_small_shuffle(spark):
    """A row per setting and task is shuffled, and the reference's interval is still the default."""
    p = views.preds_v(spark, SF001)
    counts = B.replicate_counts(p, 10)
    assert counts.groupBy("vendor", "condition").agg(F.countDistinct("replicate").alias("n")).where("n <> 10").count() == 0
    wald = metrics.metric_intervals(metrics.with_scores(metrics.confusion_counts(p)))
    assert "f1_macro_lower" in wald.columns
