"""Streaming metrics of a log with repeated keys equal the batch metrics of its de-duplicated rows."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from recallscope.operators import metrics, worklist
from recallscope.session import fresh_path
from recallscope.sources import io, snapshots as S
from recallscope.streaming import corrections as C, run_stream_metrics_deduped

STATUS = ["POSITIVE", "NEGATIVE", "INVALID", "ERROR", "other", None]


def _rows(rng, n, keys):
    return [(rng.choice([None, *range(keys)]), rng.choice(["openai", "gemini", None]), rng.choice(["m1", "m2", None]),
             rng.choice(["baseline", "doi_only"]), rng.choice([None, "", "a", "é"]), rng.choice(STATUS),
             rng.choice(["POSITIVE", "NEGATIVE", None])) for _ in range(n)]


def _land(spark, rows, folder):
    spark.createDataFrame(rows, io.PREDICTION_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _batch(spark, folder):
    return metrics.metrics_by_setting(worklist.dedupe_predictions(io.read_predictions(spark, folder)))


def _equal(got, want):
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(tuple, got.select(*metrics.METRIC_COLUMNS).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_equals_batch_after_every_micro_batch(spark):
    """Better and worse rows for known keys, ties, missing values, a batch that changes nothing."""
    rng = random.Random(6)
    landing, out, ckpt = (fresh_path(spark, f"d-{x}") for x in ("landing", "out", "ckpt"))
    parts = [_rows(rng, 60, 12), _rows(rng, 80, 12), None, _rows(rng, 5, 40)]
    for n, part in enumerate(parts):
        part = parts[0] if part is None else part
        _land(spark, part, landing)
        run_stream_metrics_deduped(spark, landing, out, checkpoint=ckpt)
        now = S.Snapshot(spark, out)
        assert now.info["batch"] == n
        _equal(now.table("metrics"), _batch(spark, landing))
    assert sorted(os.listdir(f"{ckpt}/counts")) == [f"batch={n}" for n in (len(parts) - 2, len(parts) - 1)]

    last = str(len(parts) - 1)  # the last micro-batch runs again: the same counts
    copy = fresh_path(spark, "d-copy")
    shutil.copytree(ckpt, copy, ignore=lambda d, names: [last, f".{last}.crc"] if d.endswith("commits") else [])
    run_stream_metrics_deduped(spark, landing, out, checkpoint=copy)
    assert os.path.exists(f"{copy}/commits/{last}")
    _equal(S.Snapshot(spark, out).table("metrics"), _batch(spark, landing))


def test_signs_cancel(spark):
    """A key that changes its model moves from one setting row to the other; an empty one goes."""
    rows = [("v", "c", "m1", "POSITIVE", "ERROR", 1), ("v", "c", "m1", "POSITIVE", "ERROR", -1),
            ("v", "c", "m2", "POSITIVE", "POSITIVE", 1)]
    delta = C.signed_counts(spark.createDataFrame(rows, C.CHANGES))
    none = delta.limit(0)
    assert [(r.model, r.n_total, r.n_error, r.tp) for r in C.added(none, delta).collect()] == [("m2", 1, 0, 1)]
    assert C.added(delta, delta.select(*C.SETTING, *[(-F.col(c)).alias(c) for c in metrics.COUNT_COLUMNS])).count() == 0


def test_preference_is_the_batch_rule(spark):
    """Pairwise: the row that the batch rule keeps is the one with the least preference."""
    rng = random.Random(2)
    rows = [(*r[:2], *r[2:]) for r in _rows(rng, 60, 1)]
    pairs = [(i, "v", a[2], "c", a[4], a[5], a[6]) for i, (a, b) in enumerate(zip(rows, rows[1:])) for a in (a, b)]
    kept = {r.trial_idx: r for r in worklist.dedupe_predictions(spark.createDataFrame(pairs, io.PREDICTION_SCHEMA)).collect()}
    for i, (a, b) in enumerate(zip(rows, rows[1:])):
        best = min(((r[2], r[4], r[6], r[5]) for r in (a, b)), key=C.preference)
        assert best == tuple(getattr(kept[i], c) for c in C.FIELDS)


def test_missing_counts_are_an_error(spark):
    batch = spark.createDataFrame([], C.CHANGES)
    with pytest.raises(ValueError, match="micro-batch 4"):
        C.publish_batch(batch, 5, fresh_path(spark, "d-x"), fresh_path(spark, "d-y"))
