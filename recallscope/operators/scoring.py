"""Scoring: pluggable scorer, answer parsing and the resumable job.

A scorer is any picklable zero-argument factory returning a callable
``(vendor, model, system_prompt, user_prompt) -> str | None``, or a mapping from
vendor to such callables. The factory runs once per task on the executor
(clients are built there, not on the driver); calls run inside ``mapInPandas``
over Arrow batches, up to ``in_flight`` at once per task. An exception of the
call itself becomes a NULL answer, hence an ERROR row, its class is reported,
and the job finishes; a factory that fails or a vendor without a callable fails
the job.

Exactly-once notes: a scored DataFrame is written once and never evaluated
twice (no count before the write); resume skips keys already in the target.
Without a journal the unit of loss is the job; with one (``journal=``, see
:mod:`recallscope.sources.journal`) answers are saved while tasks run, a retried task
or a new run asks only for what was not saved, and the unit of loss is a call.
Keep speculative execution off for paid scorers. Prompts can be large: Spark bounds
batches by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``, 64 MB by default).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, Design
from recallscope.functions import parse_output
from recallscope.operators.worklist import (
    KEYS,
    assemble_predictions,
    build_prompt,
    build_worklist,
    dedupe_predictions,
    limit_trials,
    model_expr,
    one_per_key,
    pending_work,
    route_fields,
    tasks_for,
)
from recallscope.sources import key_index as key_index_of
from recallscope.sources.io import append_predictions, check_layout, key_bucket, log_layout, read_log_keys
from recallscope.sources.journal import (FLUSH_ANSWERS, FLUSH_SECONDS, KEY_FIELDS, drop_runs, journal_runs, qualified,
                                         read_journal, write_journal)

SCORED_SCHEMA = ("trial_idx long, vendor string, model string, condition string, "
                 "ground_truth string, raw_output string, error string")


class ByteLengthScorer:
    """Deterministic scorer for tests and benchmarks (no network).

    The answer depends only on the UTF-8 length of the prompt, so a SQL
    engine can recompute it: remainder 0 of 16 fails the call, 1 answers
    off-label, 2 answers a padded lower-case label, otherwise even lengths
    answer POSITIVE and odd ones NEGATIVE.
    """

    def __call__(self, vendor: str, model: str, system_prompt: str, user_prompt: str) -> str | None:
        r = len(user_prompt.encode("utf-8")) % 16
        if r == 0:
            raise RuntimeError("simulated failed call")
        if r == 1:
            return "I cannot tell"
        if r == 2:
            return " positive\n"
        return "POSITIVE" if r % 2 == 0 else "NEGATIVE"


def byte_length_scorer() -> ByteLengthScorer:
    return ByteLengthScorer()


def _call_batches(factory: Callable, system_prompt: str, in_flight: int):
    def run(batches):
        client = factory()

        def ask(call, vendor, model, prompt):
            try:
                return call(vendor, model, system_prompt, prompt), None
            except Exception as e:  # a failed call is recorded, not retried
                return None, type(e).__name__

        with ThreadPoolExecutor(max(1, in_flight)) as pool:
            for pdf in batches:
                # dispatch outside the guarded call: an unknown vendor is an error of the job
                calls = [client[v] if isinstance(client, Mapping) else client for v in pdf["vendor"]]
                answers = list(pool.map(ask, calls, pdf["vendor"], pdf["model"], pdf["prompt"]))
                out = pdf[["trial_idx", "vendor", "model", "condition", "ground_truth"]].copy()
                out["raw_output"] = pd.Series([a for a, _ in answers], index=out.index, dtype=object)
                out["error"] = pd.Series([e for _, e in answers], index=out.index, dtype=object)
                yield out
    return run


def score(work: DataFrame, factory: Callable, design: Design = DEFAULT_DESIGN, in_flight: int = 1) -> DataFrame:
    """W11 + W12: call the scorer on every prompt, then parse the answers.

    ``work`` needs trial_idx, vendor, model, condition, prompt, ground_truth.
    Parsing runs JVM-side after the Python step; ``error`` names the exception
    class of a failed call.
    """
    cols = work.select("trial_idx", "vendor", "model", "condition", "prompt", "ground_truth")
    raw = cols.mapInPandas(_call_batches(factory, design.system_prompt, in_flight), SCORED_SCHEMA)
    return raw.withColumn("parsed_output", parse_output("raw_output"))


def failures(seen: Observation) -> dict:
    """What :func:`with_failures` saw, after the write. A write that had nothing to do
    has no metrics (the plan was replaced by an empty one)."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return {"failed": 0, "reasons": []}


def with_failures(scored: DataFrame) -> tuple[DataFrame, Observation]:
    """``scored`` observed while it is written: how many calls failed, and of which
    exception classes (no second evaluation)."""
    seen = Observation()
    return scored.observe(seen, F.count_if(F.col("error").isNotNull()).alias("failed"),
                          F.collect_set("error").alias("reasons")), seen


def parse_outputs(raw: DataFrame) -> DataFrame:
    """W12 on a table with ``raw_output``."""
    return raw.withColumn("parsed_output", parse_output("raw_output"))


def prompts_for(work: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """W5 + W6 + W10 on worklist rows."""
    return build_prompt(route_fields(work, design)).withColumn("model", model_expr(design))


def pending_prompts(spark: SparkSession, trials: DataFrame, preds_path: str | None,
                    design: Design = DEFAULT_DESIGN, max_trials: int | None = None,
                    vendors=None, conditions=None, dense: bool = False,
                    parallelism: int | None = None, key_index: bool = False, by_key: bool = False) -> DataFrame:
    """Prompts still to score, spread over ``parallelism`` tasks (:func:`tasks_for`), with ``by_key``
    by a hash of the trial key, so that a second attempt of a task gets the same rows.

    One trial per key (:func:`one_per_key`), log or no log. The resume check runs
    on narrow keys: (trial key x settings) anti join the log's key columns; the
    pending settings of a trial are gathered (at most one per setting), joined to
    the trials, and only then expanded to prompts, so texts are shuffled per trial
    and not per (trial, setting), and calls run in as many tasks as asked for, even
    when the trials are one unsplittable file. With ``key_index`` the narrow keys are
    probed against the log's resume index instead, which is brought up to date first
    (:mod:`recallscope.sources.key_index`): of the log only files new since then are opened.
    """
    trials = limit_trials(trials, max_trials, dense)
    if not (dense or max_trials):
        trials = one_per_key(trials)
    deal = (tasks_for(trials, parallelism), *(["trial_idx"] if by_key else []))
    layout = log_layout(spark, preds_path) if preds_path is not None else None
    if layout is None:
        return prompts_for(build_worklist(trials.repartition(*deal), design, vendors, conditions), design)
    trial_range = (0, max_trials - 1) if dense and max_trials else None  # dense keys: the limit is this key range
    narrow = trials.select("trial_idx")
    work = build_worklist(narrow, design, vendors, conditions)
    if key_index:
        pending = key_index_of.pending_by_index(work, key_index_of.refresh(spark, preds_path))
    else:
        buckets = None
        if layout["key_buckets"]:  # at most that many values
            buckets = [r[0] for r in narrow.select(key_bucket(layout["key_buckets"])).distinct().collect()]
        pending = pending_work(work, logged_keys(spark, preds_path, design, vendors, conditions, trial_range, buckets))
    cells = pending.groupBy("trial_idx").agg(F.collect_list(F.struct("condition", "vendor")).alias("_cells"))
    spread = trials.join(cells, "trial_idx").repartition(*deal)
    return prompts_for(spread.select(*trials.columns, F.inline("_cells")), design)


def logged_keys(spark: SparkSession, preds_path: str, design: Design = DEFAULT_DESIGN, vendors=None,
                conditions=None, trial_range: tuple | None = None, buckets=None) -> DataFrame:
    """Key columns of the log that can matter for a run.

    The chosen vendors and conditions, and the keys' buckets of a bucketed log, are
    partition filters, so other directories are not read; a ``(low, high)`` trial
    range is a pushed-down Parquet filter, so files and row groups whose key
    statistics lie outside it are skipped unread.
    """
    log = read_log_keys(spark, preds_path, buckets)
    cond = F.col("vendor").isin(*design.check_vendors(vendors)) & \
        F.col("condition").isin(*design.check_conditions(conditions))
    if trial_range is not None:
        cond = cond & F.col("trial_idx").between(F.lit(trial_range[0]), F.lit(trial_range[1]))
    return log.where(cond).select(*KEYS)


def merge_journal(spark: SparkSession, journal: str, preds_path: str, design: Design = DEFAULT_DESIGN,
                  partition_by=("vendor", "condition"), key_buckets: int | None = None, check_log: bool = True) -> dict:
    """Move the answers that a journal holds into the log; returns failed calls as
    :func:`run_scoring` does.

    Idempotent per key: of answers to one key (a call repeated because its first answer
    was not seen in time) one stays by the rule of :func:`dedupe_predictions`, keys
    that the log has are left out, and the runs read here are deleted only after the
    append has been committed. Repeated after a crash at any point it adds nothing twice.
    ``check_log=False`` is for answers whose keys are known to be new: the log is not read.
    """
    runs = journal_runs(spark, journal)
    if not runs:
        return {"failed": 0, "reasons": []}
    answers = read_journal(spark, runs).withColumn("parsed_output", parse_output("raw_output"))
    # a key's answers travel as one row; an error class beside the columns of the log
    kept = dedupe_predictions(answers)
    errors = answers.groupBy(*KEY_FIELDS).agg(F.max("error").alias("error"))
    kept = kept.join(errors, list(KEY_FIELDS)).withColumn(
        "error", F.when(F.col("raw_output").isNull(), F.col("error")))
    layout = log_layout(spark, preds_path) if check_log else None
    if layout is not None:
        buckets = None
        if layout["key_buckets"]:  # at most that many values
            buckets = [r[0] for r in answers.select(key_bucket(layout["key_buckets"])).distinct().collect()]
        kept = pending_work(kept, logged_keys(spark, preds_path, design, buckets=buckets))
    scored, seen = with_failures(kept)
    append_predictions(assemble_predictions(scored), preds_path, partition_by, key_buckets)
    drop_runs(spark, runs)
    return failures(seen)


def run_scoring(spark: SparkSession, trials: DataFrame, preds_path: str, factory: Callable,
                design: Design = DEFAULT_DESIGN, max_trials: int | None = None, vendors=None,
                conditions=None, parallelism: int | None = None, dense: bool = False,
                partition_by=("vendor", "condition"), key_buckets: int | None = None,
                in_flight: int = 1, journal: str | None = None, flush_answers: int = FLUSH_ANSWERS,
                flush_seconds: float = FLUSH_SECONDS, key_index: bool = False) -> dict:
    """Score everything not yet in ``preds_path`` and append it.

    One lazy plan up to one write: rerunning adds no key twice, and a failed
    call is written as ERROR (not retried), as in the reference. Returns the number
    of failed calls and their exception classes. A log of another layout is refused
    before any call.

    With ``journal`` (a folder on a store that Python tasks can write to) answers
    are saved as they are paid for, at most ``flush_answers`` and about ``flush_seconds``
    behind: what an earlier, failed run left there is moved into the log first, then
    only the rest is asked for, and at the end the journal is moved into the log.
    ``key_index`` keeps a resume index beside the log, so that a run opens only log files
    that the index has not seen.

    ``parallelism`` is the number of scorer tasks (if unset, the session's default parallelism,
    or more where the texts are large) and ``in_flight`` the calls at once in each; set them to what the
    API's rate limits allow.
    """
    check_layout(spark, preds_path, partition_by, key_buckets)
    if journal is not None:
        journal = qualified(spark, journal)
        if journal.startswith(qualified(spark, preds_path).rstrip("/") + "/"):
            raise ValueError("the journal must not lie below the log")
        merge_journal(spark, journal, preds_path, design, partition_by, key_buckets)
    todo = pending_prompts(spark, trials, preds_path, design, max_trials, vendors, conditions, dense, parallelism,
                           key_index, by_key=journal is not None)
    if journal is not None:
        write_journal(todo, journal, factory, design.system_prompt, in_flight, flush_answers, flush_seconds)
        return merge_journal(spark, journal, preds_path, design, partition_by, key_buckets)
    scored, seen = with_failures(score(todo, factory, design, in_flight))
    append_predictions(assemble_predictions(scored), preds_path, partition_by, key_buckets)
    return failures(seen)
