"""Structured Streaming jobs.

Both read a folder of Parquet files as a file stream and keep their progress
in a checkpoint below the shared checkpoint folder, named after the target unless
given, so a restarted job (or a lost executor) resumes where the last committed
micro-batch ended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallscope.design import DEFAULT_DESIGN, Design
from recallscope.operators import metrics, scoring, worklist
from recallscope.session import materialize, scratch, shared_dir
from recallscope.sources.io import PREDICTION_SCHEMA, TRIAL_SCHEMA, append_predictions, check_layout
from recallscope.sources.journal import FLUSH_ANSWERS, qualified
from recallscope.sources.snapshots import publishing
from recallscope.streaming import resume


def _progress(spark: SparkSession, kind: str, target: str, checkpoint: str | None) -> str:
    """Where a stream keeps its progress: by default a folder derived from its
    target, so the same job started again continues."""
    if checkpoint:
        return checkpoint
    name = hashlib.sha256(target.rstrip("/").encode()).hexdigest()[:20]
    return f"{shared_dir(spark)}/ckpt-{kind}-{name}"


def stream_scoring(spark: SparkSession, trials_dir: str, preds_path: str, factory: Callable,
                   design: Design = DEFAULT_DESIGN, checkpoint: str | None = None,
                   max_files_per_trigger: int | None = None, available_now: bool = True,
                   vendors=None, conditions=None, key_buckets: int | None = None,
                   parallelism: int | None = None, in_flight: int = 1, seen: str = "log", journal: str | None = None,
                   flush_answers: int = FLUSH_ANSWERS):
    """Score trials as their files arrive.

    Each micro-batch is the batch job (:func:`pending_prompts`) on the arrived
    trials: the same rule for repeated and NULL keys, the same anti join against
    the keys already in the target (re-read every batch, so a replayed batch after
    a failure adds nothing twice), the same spreading of the calls. With
    ``key_buckets`` the target is partitioned by a hash of the key and a batch reads
    only the buckets of its own keys, in whatever order keys arrive.
    ``available_now`` processes what is there and stops.

    ``seen="state"`` keeps what was handed out as keyed state of the stream instead, so a
    micro-batch reads nothing of the log (:mod:`recallscope.streaming.resume`); for a
    log that only this stream appends to. With it, ``journal`` saves answers while
    tasks run (at most ``flush_answers`` behind), as in the batch job.
    """
    if seen not in ("log", "state"):
        raise ValueError('seen must be "log" or "state"')
    if journal is not None:
        if seen != "state":
            raise ValueError('a journal needs seen="state"')
        journal = qualified(spark, journal)
    check_layout(spark, preds_path, key_buckets=key_buckets)
    checkpoint = _progress(spark, "stream-scoring", preds_path, checkpoint)
    reader = spark.readStream.schema(TRIAL_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    trials = reader.parquet(trials_dir)

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        todo = scoring.pending_prompts(spark, batch, preds_path, design, vendors=vendors, conditions=conditions,
                                       parallelism=parallelism)
        scored = scoring.score(todo, factory, design, in_flight)
        append_predictions(worklist.assemble_predictions(scored), preds_path, key_buckets=key_buckets)

    def score_new(batch: DataFrame, batch_id: int) -> None:
        resume.score_pending(batch, batch_id, preds_path, factory, design, key_buckets, parallelism, in_flight, journal,
                             vendors, conditions, flush_answers)

    if seen == "state":
        pending = resume.pending_stream(trials, resume.logged_settings(spark, preds_path), design, vendors, conditions)
        writer = pending.writeStream.foreachBatch(score_new)
    else:
        writer = trials.writeStream.foreachBatch(score_batch)
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = resume.start_with_state(spark, writer.start) if seen == "state" else writer.start()
    if available_now:
        query.awaitTermination()
    return query


def stream_counts(stream: DataFrame) -> DataFrame:
    """Running counts per (vendor, condition, model) of a prediction
    stream. State is one row per setting; no watermark is needed because
    the groups are few and never close."""
    return metrics.keyed(stream).groupBy("vendor", "condition", "model").agg(*metrics.count_aggregates())


def run_stream_metrics(spark: SparkSession, preds_dir: str, out_path: str, checkpoint: str | None = None,
                       max_files_per_trigger: int | None = None, available_now: bool = True):
    """Keep a metrics table current as prediction files arrive.

    Complete output mode hands every micro-batch the full (tiny) count
    table; it is turned into metrics and the target is overwritten.
    """
    checkpoint = _progress(spark, "stream-metrics", out_path, checkpoint)
    reader = spark.readStream.schema(PREDICTION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = stream_counts(reader.parquet(preds_dir))

    def publish(batch: DataFrame, batch_id: int) -> None:
        metrics.metrics_from_counts(batch).write.mode("overwrite").parquet(out_path)

    writer = (counts.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query


def run_stream_analysis(spark: SparkSession, preds_dir: str, out_dir: str, trials: DataFrame | None = None,
                        design: Design = DEFAULT_DESIGN, charts: bool = False, checkpoint: str | None = None,
                        max_files_per_trigger: int | None = None, available_now: bool = True, snapshots: bool = False):
    """Keep every result table and both text reports current as prediction
    files arrive (the reference re-runs its whole analysis over the grown log).

    The streaming state is the count table per (vendor, condition, model),
    one row per setting plus at most a few NULL-key groups; complete output
    mode hands each micro-batch that whole table, which is materialized and
    given to the analysis, which derives every table from it and overwrites
    the outputs. No micro-batch re-reads the log. With ``snapshots`` each micro-batch
    publishes a new version instead (:mod:`recallscope.sources.snapshots`): readers
    see all tables of one micro-batch, never a mixture. What a micro-batch
    materializes on the way is deleted when it ends.
    """
    from recallscope.plans import analysis

    checkpoint = _progress(spark, "stream-analysis", out_dir, checkpoint)
    reader = spark.readStream.schema(PREDICTION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = metrics.model_counts(reader.parquet(preds_dir))

    def publish(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            counted = materialize(batch)
            if not snapshots:
                analysis.analyze_counts(spark, counted, out_dir, trials, design, charts)
                return
            with publishing(spark, out_dir, info={"batch": batch_id}) as folder:
                analysis.analyze_counts(spark, counted, folder, trials, design, charts)

    writer = (counts.writeStream.outputMode("complete").foreachBatch(publish)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return query
