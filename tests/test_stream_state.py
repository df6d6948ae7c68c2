"""Streaming scoring with keyed state: nothing of the log is read, nothing is scored twice."""

import glob
import os
import shutil
import tempfile

import pytest

from recallscope.operators import scoring, worklist
from recallscope.session import fresh_path
from recallscope.sources import io, journal as J, views
from recallscope.streaming import resume, stream_scoring
from tests.conftest import SF001
from tests.test_journal import Counting, _calls, _plain, _same

SETTINGS = {"vendors": ["openai", "gemini"], "conditions": ["title_only", "doi_only"]}
KEYS = list(worklist.KEYS)


def _trials(spark, low, high):
    return views.trials_v(spark, SF001).where(f"trial_idx >= {low} and trial_idx < {high}")


def _land(trials, folder):
    trials.coalesce(1).write.mode("append").parquet(folder)


def _once(log, n):
    assert log.count() == log.select(*KEYS).distinct().count() == n


@pytest.fixture
def log_reads(monkeypatch):
    """How often the log's keys were asked for."""
    seen = []
    real = scoring.logged_keys
    monkeypatch.setattr(scoring, "logged_keys", lambda *a, **k: seen.append(a) or real(*a, **k))
    return seen


def test_batches_read_nothing_of_the_log(spark, log_reads):
    """Every later micro-batch works although the log's data files have become unreadable, and its
    work is right: trials that arrive again add nothing, new ones are scored."""
    landing, target, ckpt = (fresh_path(spark, f"s-{x}") for x in ("landing", "log", "ckpt"))
    run = lambda: stream_scoring(spark, landing, target, scoring.byte_length_scorer, checkpoint=ckpt, max_files_per_trigger=1,
                                 seen="state", key_buckets=2, **SETTINGS)
    _land(_trials(spark, 0, 10), landing)
    run()
    old = glob.glob(f"{target}/**/*.parquet", recursive=True)
    kept = {f: open(f, "rb").read() for f in old}
    for f in old:
        with open(f, "wb") as out:
            out.write(b"no parquet")
        if os.path.exists(crc := os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")):
            os.truncate(crc, 0)
    _land(_trials(spark, 0, 10), landing)
    _land(_trials(spark, 5, 15).unionByName(_trials(spark, 12, 14)), landing)
    run()
    assert log_reads == []
    for f, body in kept.items():
        with open(f, "wb") as out:
            out.write(body)
        os.replace(f, f + ".tmp"), os.replace(f + ".tmp", f)
    for crc in glob.glob(f"{target}/**/.*.crc", recursive=True):
        os.unlink(crc)
    log = io.read_predictions(spark, target)
    _once(log, 4 * 15)
    _same(log, _plain(spark, _trials(spark, 0, 15)))


@pytest.mark.parametrize("with_journal", [False, True])
def test_replayed_batch_adds_nothing_twice(spark, log_reads, with_journal):
    landing, target, ckpt = (fresh_path(spark, f"s-{x}") for x in ("r-landing", "r-log", "r-ckpt"))
    options = {"seen": "state", "max_files_per_trigger": 1, **SETTINGS}
    if with_journal:
        options["journal"] = f"{target}-journal"
    _land(_trials(spark, 0, 6), landing)
    _land(_trials(spark, 4, 12), landing)
    stream_scoring(spark, landing, target, scoring.byte_length_scorer, checkpoint=ckpt, **options)
    assert log_reads == []
    last = max(int(n) for n in os.listdir(f"{ckpt}/commits") if n.isdigit())
    copy = fresh_path(spark, "s-copy")  # the checkpoint as a crash before the last commit marker leaves it
    shutil.copytree(ckpt, copy, ignore=lambda d, names: [str(last), f".{last}.crc"] if d.endswith("commits") else [])
    folder = tempfile.mkdtemp(prefix="calls-", dir="/tmp")
    stream_scoring(spark, landing, target, Counting(folder), checkpoint=copy, **options)
    assert len(log_reads) >= 1 and not _calls(folder)
    reads = len(log_reads)
    _land(_trials(spark, 10, 14), landing)
    stream_scoring(spark, landing, target, Counting(folder), checkpoint=copy, **options)
    assert len(log_reads) == reads and sum(_calls(folder).values()) == 2 * 4  # 12 and 13 are new
    log = io.read_predictions(spark, target)
    _once(log, 4 * 14)
    _same(log, _plain(spark, _trials(spark, 0, 14)))


def test_batch_lost_midway_pays_once(spark):
    """A worker dies inside a micro-batch: the restarted stream takes its answers from the journal."""
    landing, target, ckpt = (fresh_path(spark, f"s-{x}") for x in ("c-landing", "c-log", "c-ckpt"))
    folder = tempfile.mkdtemp(prefix="calls-", dir="/tmp")
    options = {"seen": "state", "journal": f"{target}-journal", "checkpoint": ckpt, "flush_answers": 1, **SETTINGS}
    _land(_trials(spark, 0, 20), landing)
    with pytest.raises(Exception):
        stream_scoring(spark, landing, target, Counting(folder, crash_after=8), parallelism=4, **options)
    paid = sum(_calls(folder).values())
    saved = J.read_journal(spark, J.journal_runs(spark, f"{target}-journal")).count()
    assert 0 < saved <= paid
    stream_scoring(spark, landing, target, Counting(folder), **options)
    assert sum(_calls(folder).values()) - paid == 80 - saved
    _once(io.read_predictions(spark, target), 80)


def test_initial_state_is_the_log(spark, log_reads):
    """A new stream on a log that a batch job began hands out only the rest."""
    landing, target = fresh_path(spark, "s-i-landing"), fresh_path(spark, "s-i-log")
    scoring.run_scoring(spark, _trials(spark, 0, 8), target, scoring.byte_length_scorer, vendors=["openai"],
                        conditions=["doi_only"])
    log_reads.clear()
    folder = tempfile.mkdtemp(prefix="calls-", dir="/tmp")
    _land(_trials(spark, 3, 12), landing)
    stream_scoring(spark, landing, target, Counting(folder), seen="state", **SETTINGS)
    assert sum(_calls(folder).values()) == 4 * 9 - 5 and log_reads == []
    _once(io.read_predictions(spark, target), 8 + 4 * 9 - 5)


def test_keys_repeated_and_missing(spark):
    """Of rows that repeat a key the least counts, as in the batch job; a missing key is an error."""
    landing, target = fresh_path(spark, "s-k-landing"), fresh_path(spark, "s-k-log")
    one = _trials(spark, 0, 1)
    other = [one.withColumn("title", v) for v in (resume.F.lit("zz"), resume.F.lit("Aa"), resume.F.lit(None).cast("string"))]
    rows = one.unionByName(other[0]).unionByName(other[1])
    _land(rows, landing)
    stream_scoring(spark, landing, target, scoring.byte_length_scorer, seen="state", **SETTINGS)
    _same(io.read_predictions(spark, target), _plain(spark, worklist.one_per_key(rows)))
    assert resume._rank((None, "b")) < resume._rank(("", "a")) < resume._rank(("a", None)) < resume._rank(("é", ""))
    _land(other[2].withColumn("trial_idx", resume.F.lit(None).cast("long")), landing)
    with pytest.raises(Exception, match="NULL"):
        stream_scoring(spark, landing, target, scoring.byte_length_scorer, seen="state", **SETTINGS)


def test_state_survives_another_order_of_settings():
    """Settings are kept by name."""
    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    class Handle:
        value = Value()

        def getValueState(self, name, schema):
            return self.value

    row = resume.Row(**{c: 5 if c == "trial_idx" else "x" for c in resume.FIELDS})
    out = []
    for cells in ([("c1", "v1"), ("c2", "v1")], [("c2", "v1"), ("c3", "v1"), ("c1", "v1")], [("c3", "v1")]):
        p = resume.HandedOut(cells)
        p.init(Handle())
        out.append([x.asDict() for r in p.handleInputRows((5,), iter([row]), None) for x in r["_cells"]])
    assert out == [[{"condition": "c1", "vendor": "v1"}, {"condition": "c2", "vendor": "v1"}], [{"condition": "c3", "vendor": "v1"}], []]


def test_options(spark):
    with pytest.raises(ValueError, match="seen"):
        stream_scoring(spark, "/tmp/x", "/tmp/y", scoring.byte_length_scorer, seen="memory")
    with pytest.raises(ValueError, match="journal"):
        stream_scoring(spark, "/tmp/x", "/tmp/y", scoring.byte_length_scorer, journal="/tmp/z")
    before = spark.conf.get(resume.PROVIDER, None)
    resume.start_with_state(spark, lambda: None)
    assert spark.conf.get(resume.PROVIDER, None) == before
