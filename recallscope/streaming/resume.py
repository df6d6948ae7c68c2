"""Streaming scoring that knows what it has scored.

Which settings of a trial have been handed out is keyed state of the stream (RocksDB
behind ``transformWithState``), so a micro-batch reads the state of its own trial keys (by
groups of keys, :mod:`recallscope.streaming.groups`) and nothing of the log, however long that
has grown. The log is read at two moments only:

* when a stream starts with a new checkpoint, its keys become the initial state;
* when a micro-batch runs *again* (a restart after a failure, a checkpoint restored from
  a copy), its work is held against the log, since the first run may have appended
  some of it. A small record beside the log names, per stream, the last micro-batch that
  began to append; a batch beyond it cannot have appended anything.

The state belongs to one checkpoint: a log to which other jobs append while the stream
exists needs :func:`recallscope.streaming.stream_scoring` in its default form, which
asks the log in every micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from recallscope.design import DEFAULT_DESIGN, Design
from recallscope.operators import scoring, worklist
from recallscope.session import path_exists
from recallscope.sources import io, journal as journals
from recallscope.sources.io import TRIAL_SCHEMA
from recallscope.streaming.groups import GROUP, key_group

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CELLS = T.ArrayType(T.StructType([T.StructField("condition", T.StringType()), T.StructField("vendor", T.StringType())]))
PENDING = T.StructType([*TRIAL_SCHEMA.fields, T.StructField("_cells", CELLS)])
FIELDS = tuple(f.name for f in TRIAL_SCHEMA.fields)
TEXTS = tuple(c for c in FIELDS if c != "trial_idx")
PAIR, CELL = "\x1f", "\x1e"  # in the stored text: between condition and vendor, between settings


def _rank(row: tuple) -> tuple:
    """Order of rows as Spark orders structs: missing values first, strings by their bytes."""
    return tuple((v is not None, (v or "").encode("utf-8", "surrogatepass")) for v in row)


class HandedOut(StatefulProcessor):
    """State per group of trials: the settings of each that have been handed out so far (names, so a
    later design may list them in another order), stored as the trials of each set of
    settings. Emits the least row of a key with the settings that are new."""

    def __init__(self, cells: list[tuple[str, str]]):
        self.cells = cells

    def init(self, handle) -> None:
        self.seen = handle.getValueState("handed_out", "trials string")

    def _save(self, known: dict[int, str]) -> None:
        trials: dict[str, list[int]] = {}
        for trial, settings in known.items():
            trials.setdefault(settings, []).append(trial)
        self.seen.update((json.dumps(trials, ensure_ascii=False, separators=(",", ":")),))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._save({t["trial_idx"]: CELL.join(sorted(t["settings"])) for t in initialState["trials"]})

    def handleInputRows(self, key, rows, timerValues):
        stored = self.seen.get()  # None where the group is new
        known = {} if stored is None else {t: settings for settings, trials in json.loads(stored[0]).items() for t in trials}
        names = [c + PAIR + v for c, v in self.cells]
        new: dict[str | None, list[int]] = {}  # by what was handed out: positions of the settings that were not
        least: dict[int, tuple] = {}
        for row in rows:
            trial = row["trial_idx"]
            if trial is None:
                raise ValueError("trials without a key (trial_idx is NULL) cannot be scored or resumed")
            had = known.get(trial)
            if had not in new:
                seen = set() if had is None else set(had.split(CELL))
                new[had] = [i for i, name in enumerate(names) if name not in seen]
            if new[had]:
                texts = tuple(row[c] for c in TEXTS)
                least[trial] = min(least[trial], texts, key=_rank) if trial in least else texts
        if not least:
            return
        for trial, texts in least.items():
            had = known.get(trial)
            known[trial] = CELL.join(sorted({*(had.split(CELL) if had is not None else ()), *(names[i] for i in new[had])}))
            values = dict(zip(TEXTS, texts), trial_idx=trial)
            yield Row(**{c: values[c] for c in FIELDS},
                      _cells=[Row(condition=self.cells[i][0], vendor=self.cells[i][1]) for i in new[had]])
        self._save(known)

    def close(self) -> None:
        pass


def logged_settings(spark: SparkSession, preds_path: str) -> DataFrame:
    """Per trial key the settings in the log; no rows where there is no log."""
    schema = "trial_idx long, settings array<string>"
    if not path_exists(spark, preds_path):
        return spark.createDataFrame([], schema)
    keys = io.read_log_keys(spark, preds_path).select(*worklist.KEYS).where("trial_idx is not null")
    return keys.groupBy("trial_idx").agg(F.collect_set(F.concat("condition", F.lit(PAIR), "vendor")).alias("settings"))


def pending_stream(trials: DataFrame, initial: DataFrame, design: Design = DEFAULT_DESIGN, vendors=None,
                   conditions=None) -> DataFrame:
    """A stream of trials as (trial, new settings) rows, one per key and micro-batch."""
    processor = HandedOut(worklist.settings(design, vendors, conditions))
    groups = initial.groupBy(key_group()).agg(F.collect_list(F.struct("trial_idx", "settings")).alias("trials"))
    return trials.select(key_group(), *FIELDS).groupBy(GROUP).transformWithState(
        processor, PENDING, "append", "None", groups.groupBy(GROUP))


class Started:
    """Beside the log: the last micro-batch of each stream that began to append."""

    def __init__(self, spark: SparkSession, preds_path: str, stream: str):
        self.spark, self.path = spark, f"{preds_path.rstrip('/')}-streams/{stream}.json"

    def ran_before(self, batch_id: int) -> bool:
        text = io.read_text(self.spark, self.path)
        return text is not None and json.loads(text)["started"] >= batch_id

    def note(self, batch_id: int) -> None:
        io.write_text(self.spark, self.path, json.dumps({"started": batch_id}))


def score_pending(batch: DataFrame, batch_id: int, preds_path: str, factory: Callable, design: Design = DEFAULT_DESIGN,
                  key_buckets: int | None = None, parallelism: int | None = None, in_flight: int = 1,
                  journal: str | None = None, vendors=None, conditions=None,
                  flush_answers: int = journals.FLUSH_ANSWERS) -> None:
    """One micro-batch of :func:`pending_stream`: prompts, calls, one append."""
    spark = batch.sparkSession
    started = Started(spark, preds_path, spark.sparkContext.getLocalProperty("sql.streaming.queryId"))
    again = started.ran_before(batch_id)
    # the batch is evaluated once, so its size is not known: as many tasks as the session shuffles to
    tasks = parallelism or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["trial_idx"] if journal is not None else []
    work = (batch if again else batch.repartition(tasks, *keys)).select(*FIELDS, F.inline("_cells"))
    if again:
        if journal is not None:
            scoring.merge_journal(spark, journal, preds_path, design, key_buckets=key_buckets)
        if path_exists(spark, preds_path):
            work = worklist.pending_work(work, scoring.logged_keys(spark, preds_path, design, vendors, conditions))
    else:
        started.note(batch_id)
    prompts = scoring.prompts_for(work, design)
    if again:  # the join has dealt the rows by key, whatever the number of tasks asked for
        prompts = prompts.repartition(tasks, *keys)
    if journal is not None:
        journals.write_journal(prompts, journal, factory, design.system_prompt, in_flight, flush_answers)
        scoring.merge_journal(spark, journal, preds_path, design, key_buckets=key_buckets, check_log=again)
        return
    scored = scoring.score(prompts, factory, design, in_flight)
    io.append_predictions(worklist.assemble_predictions(scored), preds_path, key_buckets=key_buckets)


def start_with_state(spark: SparkSession, writer: Callable):
    """Start a query with RocksDB state; the session's own setting comes back afterwards
    (a query keeps the settings it was started with)."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer()
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)
