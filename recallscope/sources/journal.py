"""The answer journal: every paid answer is saved while its task still runs.

A scoring job that only writes its result table loses all answers when it fails. With a
journal the calls are made by the tasks of a Python data source *writer*: a task keeps at
most ``flush_answers`` answers, and none longer than about ``flush_seconds``, before it
closes a small Parquet segment on shared storage. Nothing that happens later (a failed
task, a lost executor, a killed driver) removes a segment:

* a second attempt of a task reads the segments of the first and asks only for the rest;
* the next run first moves what the journal holds into the log, so its resume check sees it;
* moving is idempotent per key (anti join against the log), and segments are deleted
  only after the log has them, so a crash between the two adds nothing twice.

What can be lost are calls still running and the answers of one open segment per task.

Layout: ``<journal>/run-<id>/p<task>/<attempt>-<n>.parquet``. A segment appears whole: it is
written under a hidden name and renamed where the store has renames; object stores show
a file only once it is closed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from recallscope.sources.io import delete

KEY_FIELDS = ("trial_idx", "vendor", "condition")
ANSWER_FIELDS = ("trial_idx", "vendor", "model", "condition", "ground_truth", "raw_output", "error")
ANSWER_SCHEMA = "trial_idx long, vendor string, model string, condition string, ground_truth string, raw_output string, error string"
_ARROW = pa.schema([("trial_idx", pa.int64()), *((c, pa.string()) for c in ANSWER_FIELDS[1:])])
FORMAT = "answer_journal"
FLUSH_ANSWERS = 16
FLUSH_SECONDS = 2.0


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Spark would resolve it, in the form that Python opens;
    an error (before any call) where Python has no access to that store."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jfs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = jfs.makeQualified(jpath).toString()
    uri = "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file:///") else uri
    try:
        pafs.FileSystem.from_uri(uri)
    except Exception as e:
        raise ValueError(f"a journal needs a store that Python tasks can write to; {uri} is none ({e})") from e
    return uri


class Segments:
    """The segments of one task, on any store that Arrow opens."""

    def __init__(self, run: str, task: int, attempt: int):
        self.fs, base = pafs.FileSystem.from_uri(run)
        self.folder, self.prefix, self.n = f"{base}/p{task:06d}", f"{attempt}-{uuid.uuid4().hex[:8]}", 0
        self.renames = self.fs.type_name in ("local", "hdfs")

    def answered(self) -> set[tuple]:
        """Keys that earlier attempts of this task have saved."""
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        keys: set[tuple] = set()
        for f in found:
            if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")):
                table = pq.read_table(f.path, columns=list(KEY_FIELDS), filesystem=self.fs, partitioning=None)
                keys.update(zip(*(table.column(c).to_pylist() for c in KEY_FIELDS)))
        return keys

    def save(self, rows: list[tuple]) -> None:
        if not rows:
            return
        if self.n == 0:
            self.fs.create_dir(self.folder, recursive=True)
        name = f"{self.prefix}-{self.n:06d}.parquet"
        self.n += 1
        columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)]
        target = f"{self.folder}/{name}"
        draft = f"{self.folder}/_{name}" if self.renames else target
        with self.fs.open_output_stream(draft) as out:
            pq.write_table(pa.Table.from_arrays(columns, schema=_ARROW), out)
        if draft != target:
            self.fs.move(draft, target)


@dataclass
class Saved(WriterCommitMessage):
    """What a finished task reports: answers saved and failed calls by exception class."""

    answers: int = 0
    failed: dict = field(default_factory=dict)


def _ask(call: Callable, vendor, model, system_prompt, prompt):
    try:
        return call(vendor, model, system_prompt, prompt), None
    except Exception as e:  # a failed call is recorded, not retried
        return None, type(e).__name__


def save_answers(rows: Iterator[dict], segments: Segments, factory: Callable, system_prompt: str, in_flight: int = 1,
                 flush_answers: int = FLUSH_ANSWERS, flush_seconds: float = FLUSH_SECONDS) -> Saved:
    """Call the scorer for every row without an answer in ``segments`` and save the answers as
    calls return, in whatever order they do. An error outside a call (an unknown
    vendor, a broken input) ends the task, but not before all answers that were paid
    for, those of calls still running included, are saved."""
    done, client, saved = segments.answered(), factory(), Saved()
    ready: list[tuple] = []
    oldest = 0.0
    running: dict = {}

    def collect(futures) -> None:
        nonlocal oldest
        for f in futures:
            row, (answer, error) = running.pop(f), f.result()
            oldest = oldest if ready else time.monotonic()
            ready.append((row["trial_idx"], row["vendor"], row["model"], row["condition"], row["ground_truth"], answer, error))
            saved.answers += 1
            if error:
                saved.failed[error] = saved.failed.get(error, 0) + 1

    def flush(force: bool = False) -> None:
        if ready and (force or len(ready) >= flush_answers or time.monotonic() - oldest >= flush_seconds):
            segments.save(ready)
            ready.clear()

    with ThreadPoolExecutor(max(1, in_flight)) as pool:
        try:
            for row in rows:
                if tuple(row[c] for c in KEY_FIELDS) in done:
                    continue
                call = client[row["vendor"]] if isinstance(client, Mapping) else client
                while len(running) >= max(1, in_flight):
                    collect(wait(running, timeout=flush_seconds, return_when=FIRST_COMPLETED).done)
                    flush()
                running[pool.submit(_ask, call, row["vendor"], row["model"], system_prompt, row["prompt"])] = row
        finally:
            while running:
                collect(wait(running, timeout=flush_seconds, return_when=FIRST_COMPLETED).done)
                flush()
            flush(force=True)
    return saved


def _sink(factory: Callable, system_prompt: str, in_flight: int, flush_answers: int, flush_seconds: float) -> type[DataSource]:
    """A data source class that carries the scorer to the tasks."""

    class JournalWriter(DataSourceArrowWriter):
        def __init__(self, run: str, fields: list[str]):
            self.run, self.fields = run, fields

        def write(self, iterator):
            context = TaskContext.get()
            segments = Segments(self.run, context.partitionId(), context.taskAttemptId())
            rows = (r for batch in iterator for r in batch.to_pylist())
            return save_answers(rows, segments, factory, system_prompt, in_flight, flush_answers, flush_seconds)

        def commit(self, messages):
            """A summary beside the segments (hidden from readers)."""
            failed: dict = {}
            for m in messages:
                for name, n in (m.failed if m else {}).items():
                    failed[name] = failed.get(name, 0) + n
            store, base = pafs.FileSystem.from_uri(self.run)
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/_summary.json") as out:
                out.write(json.dumps({"answers": sum(m.answers for m in messages if m), "failed": failed}).encode())

        def abort(self, messages):
            """Paid answers stay."""

    class AnswerJournal(DataSource):
        @classmethod
        def name(cls):
            return FORMAT

        def writer(self, schema, overwrite):
            return JournalWriter(self.options["path"], schema.names)

    return AnswerJournal


def write_journal(prompts: DataFrame, journal: str, factory: Callable, system_prompt: str, in_flight: int = 1,
                  flush_answers: int = FLUSH_ANSWERS, flush_seconds: float = FLUSH_SECONDS) -> str:
    """Ask for every prompt and save the answers below ``journal``; returns the run's folder.

    The rows are dealt to tasks by their key, so that a second attempt of a task gets
    the same rows and finds its earlier answers.
    """
    spark = prompts.sparkSession
    run = f"{qualified(spark, journal).rstrip('/')}/run-{uuid.uuid4().hex[:12]}"
    spark.dataSource.register(_sink(factory, system_prompt, in_flight, flush_answers, flush_seconds))
    prompts.write.format(FORMAT).mode("append").option("path", run).save()
    return run


def journal_runs(spark: SparkSession, journal: str) -> list[str]:
    """Folders of runs below ``journal`` (one listing of a folder with an entry per run)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(journal)
    jfs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not jfs.exists(jpath):
        return []
    return sorted(s.getPath().toString() for s in jfs.listStatus(jpath) if s.getPath().getName().startswith("run-"))


def read_journal(spark: SparkSession, runs: list[str]) -> DataFrame:
    """All saved answers of some runs, as they were saved."""
    return spark.read.schema(ANSWER_SCHEMA).option("recursiveFileLookup", "true").parquet(*runs)


def drop_runs(spark: SparkSession, runs: list[str]) -> None:
    for run in runs:
        delete(spark, run)
