"""The keyed state of the streams is read and written by groups of keys, not key by key."""

import glob

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recallscope.operators import metrics, scoring, worklist
from recallscope.plans import catalog
from recallscope.session import fresh_path
from recallscope.sources import io
from recallscope.streaming import corrections as C, groups, resume


class Value:
    def __init__(self):
        self.row, self.gets, self.updates = None, 0, 0

    def get(self):
        self.gets += 1
        return self.row

    def update(self, row):
        self.updates += 1
        self.row = row


class Handle:
    def __init__(self):
        self.value = Value()

    def getValueState(self, name, schema):
        return self.value


def test_kept_rows_of_many_keys_are_one_state_value(spark):
    """Two micro-batches of one group: a get and an update each, and the right net changes."""
    fields = ["trial_idx", "vendor", "condition", *C.FIELDS]
    good = [(str(2**60 + i), "v", "c", "m", "é", "POSITIVE", "NEGATIVE") for i in range(500)]
    failed = [(*r[:4], None, "POSITIVE", "ERROR") for r in good] + [(None, "v", "c", "m", None, None, "ERROR")]
    handle = Handle()
    out = []
    for part in (failed + failed, good[:300] + failed):
        p = C.KeptRows()
        p.init(handle)
        out.append([tuple(r) for t in p.handleInputRows((5,), iter([pd.DataFrame(part, columns=fields)]), None)
                    for r in t.itertuples(index=False)])
    assert (handle.value.gets, handle.value.updates) == (2, 2)
    assert sorted(out[0], key=str) == sorted([("v", "c", "m", "POSITIVE", "ERROR", 500), ("v", "c", "m", None, "ERROR", 1)], key=str)
    assert sorted(out[1], key=str) == sorted([("v", "c", "m", "POSITIVE", "ERROR", -300), ("v", "c", "m", "POSITIVE", "NEGATIVE", 300)], key=str)
    counts = C.added(*(C.signed_counts(spark.createDataFrame(rows, C.CHANGES)) for rows in out)).collect()
    assert [tuple(r[c] for c in metrics.COUNT_COLUMNS) for r in counts] == [(501, 300, 0, 201, 0, 300, 0, 0)]


def test_handed_out_settings_of_many_keys_are_one_state_value():
    handle = Handle()
    cells = [("c1", "v1"), ("c2", "v1")]
    trials = [resume.Row(**{c: i if c == "trial_idx" else "x" for c in resume.FIELDS}) for i in range(200)]
    p = resume.HandedOut(cells)
    p.init(handle)
    p.handleInitialState((5,), {"trials": [resume.Row(trial_idx=0, settings=["c1\x1fv1", "c2\x1fv1"]),
                                           resume.Row(trial_idx=1, settings=["c2\x1fv1"])]}, None)
    first = list(p.handleInputRows((5,), iter(trials + trials), None))
    assert sorted((r.trial_idx, len(r["_cells"])) for r in first) == [(1, 1), *((i, 2) for i in range(2, 200))]
    assert list(p.handleInputRows((5,), iter(trials), None)) == []
    assert (handle.value.gets, handle.value.updates) == (2, 2)


def test_groups_are_bounded_whatever_the_keys(spark):
    n = spark.range(40000).select((F.col("id") * 1000003).alias("trial_idx")).select(groups.key_group()).distinct().count()
    assert 4000 < n <= groups.KEY_GROUPS


def test_tasks_and_landed_files_grow_with_the_texts(spark):
    """No fixed number of tasks or files shares a growing table; a number that is given is kept."""
    least = spark.sparkContext.defaultParallelism
    big = spark.range(50).select(F.col("id").alias("trial_idx"), F.repeat(F.lit("é"), 10).alias("title"))
    assert worklist.text_bytes(big) == 50 * 28 and worklist.text_bytes(big.where("false")) == 0
    assert worklist.tasks_for(big) == least and worklist.tasks_for(big, 3, task_bytes=1) == 3
    assert worklist.tasks_for(big, task_bytes=10) == max(least, 140)
    for limit, files in ((1 << 20, 1), (100, 7)):
        path = fresh_path(spark, "g-landing")
        with pytest.MonkeyPatch.context() as m:
            m.setattr(catalog, "LANDED_BYTES", limit)
            assert catalog._land(big, path, 2, times=2) == files
        assert len(glob.glob(f"{path}/*.parquet")) == 4 * files and spark.read.parquet(path).count() == 100


def test_journal_shuffles_trials_not_prompts(spark):
    """Dealing the rows to the scorer by key moves a trial's texts once, not once per setting."""
    trials = spark.createDataFrame([(i, "t", "a" * 50) for i in range(20)], "trial_idx long, title string, abstract string")
    for f in io.TRIAL_SCHEMA.fields[3:]:
        trials = trials.withColumn(f.name, F.lit(None).cast(f.dataType))
    todo = scoring.pending_prompts(spark, trials, None, parallelism=4, by_key=True)
    parts = todo.select("trial_idx", F.spark_partition_id().alias("p")).distinct().collect()
    assert todo.rdd.getNumPartitions() == 4 and len(parts) == 20 and len({r.p for r in parts}) > 1
    plan = todo._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")  # the expansion lies above the shuffle
