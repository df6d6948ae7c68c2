"""The resume index: the same answers as the log, without opening it."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN
from recallscope.operators import scoring, worklist
from recallscope.session import fresh_path
from recallscope.sources import io, key_index as K, views
from tests.conftest import SF001
from tests.test_journal import _plain, _same

SETTINGS = {"vendors": ["openai", "gemini"], "conditions": ["title_only", "doi_only"]}


def _log_rows(spark, keys):
    return spark.createDataFrame([(k, v, "m", c, "a", "POSITIVE", "POSITIVE") for k, v, c in keys], io.PREDICTION_SCHEMA)


def _index_keys(index):
    """The keys an index holds, one by one, from its payload."""
    out = []
    for r in index.collect():
        if r.n == K.BLOCK:
            assert r.offsets is None and r.bits is None
            at = range(K.BLOCK)
        elif r.offsets is not None:
            at = r.offsets
            assert at == sorted(at) and len(at) == r.n <= K.SPARSE
        else:
            at = [i for i in range(K.BLOCK) if r.bits[i // 8] >> i % 8 & 1]
            assert len(at) == r.n > K.SPARSE
        out += [(r.block * K.BLOCK + i, r.vendor, r.condition) for i in at]
    assert len(out) == len(set(out))
    return set(out)


def _keys(rng, n, low, high):
    return [(rng.randrange(low, high), rng.choice(["openai", "gemini"]), rng.choice(["title_only", "doi_only"])) for _ in range(n)]


def test_containers_hold_any_keys(spark):
    """Negative, far apart, repeated and missing keys; every kind of container."""
    rng = random.Random(4)
    keys = _keys(rng, 300, -10**15, 10**15) + _keys(rng, 9000, -5000, 5000) + [(k, "openai", "title_only") for k in (0, 32767, 32768, -1)]
    rows = _log_rows(spark, keys + keys[:50]).unionByName(_log_rows(spark, [(None, "openai", "title_only"), (3, None, "title_only")]))
    full = spark.range(5 * K.BLOCK, 6 * K.BLOCK).select(
        F.col("id").alias("trial_idx"), F.lit("openai").alias("vendor"), F.lit("doi_only").alias("condition"))
    index = K.containers(rows.select("trial_idx", "vendor", "condition").unionByName(full))
    kinds = {("full" if r.n == K.BLOCK else "sparse" if r.offsets else "bitmap") for r in index.collect()}
    assert kinds == {"full", "sparse", "bitmap"}
    assert _index_keys(index) == set(keys) | {(k, "openai", "doi_only") for k in range(5 * K.BLOCK, 6 * K.BLOCK)}


@pytest.mark.parametrize("steps", [[40, 2000, 3], [3000, 10, 5000], [1, 1, 1]])
def test_refresh_merges_only_new_files(spark, steps):
    """After every append the index holds the log's keys; the files it knows are never opened again (they
    are overwritten with something unreadable)."""
    rng, path, seen = random.Random(len(steps)), fresh_path(spark, "k-log"), set()
    for step, n in enumerate(steps):
        keys = _keys(rng, n, 30000, 36000) + list(seen)[:2]
        io.append_predictions(_log_rows(spark, keys), path)
        seen |= set(keys)
        assert _index_keys(K.refresh(spark, path)) == seen
        for f in glob.glob(f"{path}/**/*.parquet", recursive=True):
            with open(f, "wb") as out:
                out.write(b"not read")
        assert _index_keys(K.refresh(spark, path)) == seen  # nothing new: the same version
    assert len(glob.glob(f"{K.index_path(path)}/v*")) <= K.KEPT_VERSIONS


def test_blocks_become_full(spark):
    path = fresh_path(spark, "k-full")
    for part in range(3):
        rows = spark.range(K.BLOCK).where(f"id % 3 = {part}").select(
            F.col("id").alias("trial_idx"), F.lit("openai").alias("vendor"), F.lit("m").alias("model"),
            F.lit("title_only").alias("condition"), *[F.lit("x").alias(c) for c in ("raw_output", "parsed_output", "ground_truth")])
        io.append_predictions(rows, path)
        index = K.refresh(spark, path).collect()
        assert [(r.n, r.offsets is None, r.bits is None) for r in index] == [
            (len(range(0, K.BLOCK)) if part == 2 else sum(i % 3 <= part for i in range(K.BLOCK)), True, part == 2)]


@pytest.mark.parametrize("density", [30, 40000])
def test_pending_and_remaining_equal_the_log(spark, density):
    """W8 and W9 by the index equal the anti join and the count over the log, keys outside the work included."""
    rng = random.Random(density)
    trials = spark.range(0, 40000, 7).select(F.col("id").alias("trial_idx"), F.lit("t").alias("title"))
    keys = _keys(rng, density, -100, 50000)
    log = _log_rows(spark, keys)
    index = K.containers(log.select("trial_idx", "vendor", "condition"))
    work = worklist.build_worklist(trials, **SETTINGS)
    _same(K.pending_by_index(work, index), worklist.pending_work(work, log).select(*work.columns))
    got, want = K.remaining_by_index(trials, index, **SETTINGS), worklist.remaining_count(work, log)
    assert got.columns == want.columns and got.dtypes == want.dtypes and got.collect() == want.collect()
    missing = work.limit(3).withColumn("trial_idx", F.lit(None).cast("long"))
    assert K.pending_by_index(missing, index).count() == 3  # a missing key matches nothing
    empty = spark.createDataFrame([], K.CONTAINERS)
    assert K.pending_by_index(work, empty).count() == work.count()
    assert K.remaining_by_index(trials, empty).first().remaining == 15 * trials.count()


def test_job_resumes_by_index(spark):
    """A run with the index after a run without one, a lost refresh and a rewritten log: every key once."""
    t = worklist.limit_trials(views.trials_v(spark, SF001), 25)
    path = fresh_path(spark, "k-job")
    run = lambda **k: scoring.run_scoring(spark, t, path, scoring.byte_length_scorer, **k)
    run(vendors=["openai"], conditions=["title_only"])
    run(key_index=True, **SETTINGS)
    run(vendors=["gemini"], conditions=["counterfactual"])  # the index has not seen this
    run(key_index=True, journal=f"{path}-journal")
    run(key_index=True)
    log = io.read_predictions(spark, path)
    n = 25 * len(DEFAULT_DESIGN.vendors) * len(DEFAULT_DESIGN.conditions)
    assert log.count() == log.select(*worklist.KEYS).distinct().count() == n
    _same(log.where("vendor in ('openai', 'gemini') and condition in ('title_only', 'doi_only')"), _plain(spark, t))
    assert _index_keys(K.refresh(spark, path)) == {(r.trial_idx, r.vendor, r.condition) for r in log.collect()}
    kept = log.where("vendor = 'openai'").collect()
    spark.createDataFrame(kept, io.PREDICTION_SCHEMA).write.mode("overwrite").partitionBy("vendor", "condition").parquet(path)
    assert {k[1] for k in _index_keys(K.refresh(spark, path))} == {"openai"}
