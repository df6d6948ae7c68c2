"""Result sets change all at once, and what repeated publishing leaves behind stays bounded."""

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from recallscope.operators import metrics, worklist
from recallscope.session import fresh_path, materialize, scratch, shared_dir
from recallscope.sources import io, snapshots as S, views
from recallscope.streaming import run_stream_analysis
from tests.conftest import SF001


def _tables(spark, tag, n=2):
    return {f"t{i}": spark.range(5).select(F.lit(tag).alias("tag"), "id") for i in range(n)}


def _tags(snapshot):
    return {snapshot.table(n).first().tag for n in snapshot.names}


def test_reader_sees_one_version(spark):
    """While a publication is being written, and after, a reader has all its tables of one version."""
    out = fresh_path(spark, "snap")
    with pytest.raises(FileNotFoundError):
        S.Snapshot(spark, out)
    S.publish_tables(spark, _tables(spark, "a"), out)
    held = S.Snapshot(spark, out)
    seen = []
    with S.publishing(spark, out) as folder:
        tables = _tables(spark, "b")
        io.write_tables({"t0": tables["t0"]}, folder)
        seen.append(_tags(S.Snapshot(spark, out)))  # half written
        io.write_tables({"t1": tables["t1"]}, folder)
        seen.append(_tags(S.Snapshot(spark, out)))
    assert seen == [{"a"}, {"a"}] and _tags(S.Snapshot(spark, out)) == {"b"}
    assert _tags(held) == {"a"} and held.names == ["t0", "t1"]  # a version in use is kept


def test_failed_publication_changes_nothing(spark):
    out = fresh_path(spark, "snap-fail")
    S.publish_tables(spark, _tables(spark, "a"), out)
    with pytest.raises(RuntimeError):
        with S.publishing(spark, out) as folder:
            io.write_tables(_tables(spark, "b"), folder)
            raise RuntimeError("driver stopped")
    assert _tags(S.Snapshot(spark, out)) == {"a"} and S.manifests(spark, out) == [1]
    assert len([n for n in os.listdir(f"{out}/_versions") if "-" in n and n[0] != "."]) == 1


def test_two_writers_and_no_lost_version(spark):
    """Both began after version 1; each becomes a version, the later one is current."""
    out = fresh_path(spark, "snap-two")
    S.publish_tables(spark, _tables(spark, "a"), out)
    with S.publishing(spark, out, keep=5) as first:
        io.write_tables(_tables(spark, "b"), first)
        with S.publishing(spark, out, keep=5) as second:
            io.write_tables(_tables(spark, "c"), second)
    assert S.manifests(spark, out) == [1, 2, 3] and _tags(S.Snapshot(spark, out)) == {"b"}
    assert [_tags(S.Snapshot(spark, out, v)) for v in (1, 2, 3)] == [{"a"}, {"c"}, {"b"}]
    draft, target = f"{out}/x.json", f"{out}/_versions/{3:012d}.json"
    io.write_text(spark, draft, "{}")
    assert S._claim(spark, draft, target) is False and _tags(S.Snapshot(spark, out)) == {"b"}


def test_many_publications_stay_bounded(spark):
    """Old versions, and folders of writers that died, are deleted."""
    out = fresh_path(spark, "snap-many")
    small = {"t": spark.range(1).select(F.lit("x").alias("tag"))}
    S.publish_tables(spark, small, out)
    io.write_text(spark, f"{out}/_versions/{1:012d}-deadbeef/part", "left by a writer that died")
    for _ in range(12):
        S.publish_tables(spark, small, out, keep=2)
    names = [n for n in os.listdir(f"{out}/_versions") if n[0] != "."]
    assert sorted(n for n in names if n.endswith(".json")) == [f"{v:012d}.json" for v in (12, 13)]
    assert len(names) == 4
    with pytest.raises(FileNotFoundError):
        S.Snapshot(spark, out, 1)
    with pytest.raises(ValueError):
        S.publish_tables(spark, small, out, keep=0)


def test_scratch_is_deleted(spark):
    with scratch(spark) as folder:
        df = materialize(spark.range(10))
        assert df.count() == 10 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.isdir(folder.removeprefix("file:"))
    assert "Scan ExistingRDD" in materialize(spark.range(3))._jdf.queryExecution().executedPlan().toString()


def test_stream_publishes_whole_versions(spark):
    """Micro-batch by micro-batch: every version is of one log, the folder and the shared store stay
    bounded, and the last version equals the batch analysis."""
    from recallscope.plans import analysis

    landing, out = fresh_path(spark, "snap-landing"), fresh_path(spark, "snap-stream")
    p = worklist.assemble_predictions(views.preds_v(spark, SF001).withColumn("raw_output", F.lit(None).cast("string")))
    p.repartition(6).write.parquet(landing)
    totals, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            try:
                now = S.Snapshot(spark, out)
                n = {r.n for r in (now.table("metrics").agg(F.sum("n_total").alias("n")).collect())}
                m = {int(x) for x in [now.table("table_manuscript").count()]}
                totals.append((now.version, n, m))
            except FileNotFoundError:
                pass
            stop.wait(0.2)

    def left():
        return len(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/*"))

    before = left()
    reader = threading.Thread(target=watch)
    reader.start()
    try:
        run_stream_analysis(spark, landing, out, max_files_per_trigger=1, snapshots=True)
    finally:
        stop.set()
        reader.join()
    assert totals == sorted(totals, key=lambda t: t[0]) and len(S.manifests(spark, out)) == S.KEEP
    assert left() - before <= 2  # the checkpoint and the output, not a folder per micro-batch
    last = S.Snapshot(spark, out)
    assert last.info["batch"] == 5
    want = metrics.metrics_by_setting(p)
    got = last.table("metrics")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    batch = fresh_path(spark, "snap-batch")
    analysis.analyze(spark, p, batch, snapshot=True)
    assert S.Snapshot(spark, batch).names == last.names
    assert S.Snapshot(spark, batch).text("table_manuscript.txt") == last.text("table_manuscript.txt")
