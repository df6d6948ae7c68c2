"""Streaming metrics over a log whose keys may repeat (M14 with T12).

A rerun of failed calls, a replayed job or a second run appends rows for keys that are there
already. The batch rule keeps one row per (trial, vendor, condition)
(:func:`recallscope.operators.worklist.dedupe_predictions`); counting a stream row by row
would count them all. Here the row that counts for a key is keyed state (RocksDB behind
``transformWithState``); when a better one arrives the stream says what changes: the old
row with sign -1, the new one with +1 (equal rows of one group as one row with their net
sign). Sums of those signs per setting, added to the counts so far (a row per setting), are
the counts of the de-duplicated log after every micro-batch.

A state call is a round trip between Python and the JVM, which costs more than a row's
comparison. So the keys are grouped by a hash of the trial (:mod:`recallscope.streaming.groups`),
and a group's rows are one state value.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from recallscope.design import LABELS, STATUS_ERROR, STATUS_INVALID
from recallscope.operators import metrics
from recallscope.operators.worklist import KEYS
from recallscope.session import path_exists, scratch
from recallscope.sources import io
from recallscope.sources.snapshots import publishing
from recallscope.streaming.groups import GROUP, key_group

FIELDS = ("model", "raw_output", "ground_truth", "parsed_output")  # also the order in which ties are settled
CHANGES = "vendor string, condition string, model string, ground_truth string, parsed_output string, sign long"
SETTING = ("vendor", "condition", "model")


def preference(row: tuple) -> tuple:
    """The batch rule as a sort key (least is kept): a label, then INVALID, then ERROR, then anything else;
    ties by model, raw answer, truth and status, compared by bytes, missing values last."""
    status = row[FIELDS.index("parsed_output")]
    rank = 0 if status in LABELS else 1 if status == STATUS_INVALID else 2 if status == STATUS_ERROR else 3
    return (rank, *((v is None, (v or "").encode("utf-8", "surrogatepass")) for v in row))


class KeptRows(StatefulProcessor):
    """State per group of trials: the row that counts for each of its keys. Emits what changes where
    those become other ones."""

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "rows string")

    def handleInputRows(self, key, rows, timerValues):
        stored = self.kept.get()  # None where the group is new
        kept = {} if stored is None else {tuple(k): tuple(row) for k, row in json.loads(stored[0])}
        old: dict = {}  # of the keys that changed
        for table in rows:
            columns = [table[c].tolist() for c in (*KEYS, *FIELDS)]
            for name, new in zip(zip(*columns[:len(KEYS)]), zip(*columns[len(KEYS):])):
                had = kept.get(name)
                if had == new or had is not None and preference(had) <= preference(new):
                    continue
                old.setdefault(name, had)
                kept[name] = new
        if not old:
            return
        self.kept.update((json.dumps(list(kept.items()), ensure_ascii=False, separators=(",", ":")),))
        signs: Counter = Counter()
        for name, had in old.items():
            for row, sign in ((had, -1), (kept[name], 1)):
                if row is not None:
                    signs[name[1], name[2], row[0], row[2], row[3]] += sign
        out = [(vendor, condition, *rest, sign) for (vendor, condition, *rest), sign in signs.items() if sign]
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """A prediction stream as signed rows."""
    # the key as text: pandas has no integer column with missing values
    return stream.select(key_group(), F.col("trial_idx").cast("string").alias("trial_idx"), *KEYS[1:], *FIELDS).groupBy(GROUP) \
        .transformWithStateInPandas(KeptRows(), CHANGES, "append", "None")


def signed_counts(rows: DataFrame) -> DataFrame:
    """Counts per (vendor, condition, model) of signed rows: combined map-side, a row per setting and task."""
    both = rows.groupBy(*SETTING, "sign").agg(*metrics.count_aggregates())
    return both.groupBy(*SETTING).agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in metrics.COUNT_COLUMNS])


def added(counts: DataFrame, more: DataFrame) -> DataFrame:
    """Two count tables as one; settings without rows left go."""
    total = counts.unionByName(more).groupBy(*SETTING).agg(*[F.sum(c).alias(c) for c in metrics.COUNT_COLUMNS])
    return total.where("n_total > 0")


def publish_batch(batch: DataFrame, batch_id: int, out_path: str, checkpoint: str) -> None:
    """Counts after this micro-batch, from those after the one before, kept with the stream's own
    progress: a micro-batch that runs again starts from the same counts and writes the same ones."""
    spark = batch.sparkSession
    of = lambda n: f"{checkpoint.rstrip('/')}/counts/batch={n}"
    delta = signed_counts(batch)
    if batch_id and not path_exists(spark, of(batch_id - 1)):
        raise ValueError(f"the counts of micro-batch {batch_id - 1} are missing below {checkpoint}")
    if batch_id:
        delta = added(spark.read.parquet(of(batch_id - 1)), delta)
    delta.coalesce(1).write.mode("overwrite").parquet(of(batch_id))
    io.delete(spark, of(batch_id - 2))
    with scratch(spark), publishing(spark, out_path, info={"batch": batch_id}) as folder:
        io.write_tables({"metrics": metrics.metrics_from_counts(spark.read.parquet(of(batch_id)))}, folder)


def run_stream_metrics_deduped(spark: SparkSession, preds_dir: str, out_path: str, checkpoint: str | None = None,
                               max_files_per_trigger: int | None = None, available_now: bool = True):
    """Keep the metrics of the de-duplicated log current as prediction files arrive.

    After every micro-batch the published table equals the batch metrics of
    :func:`dedupe_predictions` over all rows that arrived. State is one row per key, read and written
    by groups of keys; no micro-batch reads earlier files again. The table is published in versions
    (:class:`recallscope.sources.snapshots.Snapshot`).
    """
    from recallscope.streaming.jobs import _progress
    from recallscope.streaming.resume import start_with_state

    checkpoint = _progress(spark, "stream-metrics-deduped", out_path, checkpoint)
    reader = spark.readStream.schema(io.PREDICTION_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = (changes(reader.parquet(preds_dir)).writeStream
              .foreachBatch(lambda batch, n: publish_batch(batch, n, out_path, checkpoint))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = start_with_state(spark, writer.start)
    if available_now:
        query.awaitTermination()
    return query
