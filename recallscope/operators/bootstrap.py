"""Bootstrap intervals for the classification metrics.

The reference's interval for macro F1 treats it as a proportion, which it is not; that
interval stays the default (:func:`recallscope.operators.metrics.metric_intervals`). This
one resamples trials: in every replicate a trial counts Poisson(1) times, a weight that
depends only on the trial's key and the replicate's number, so

* one pass over the log suffices: a task keeps, per setting, the four confusion counts of
  every replicate (a vector of 4 x ``replicates`` numbers) and hands on one row;
* a rerun, another partitioning or a retried task gives the same weights and result;
* a trial has the same weight under every setting, so replicates of two settings are paired.

The bounds are order statistics of the replicates' values (no interpolation).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallscope.design import LABELS
from recallscope.operators import metrics

REPLICATES = 200
SEED = 1
CELLS = ("tp", "fn", "fp", "tn")
SCORES = ("accuracy", "f1_macro", "sensitivity", "specificity")
ROWS = 4096  # rows whose weights are made at once: rows x replicates numbers
MERGE = 256  # partial rows of a setting are merged by so many tasks first
# P(Poisson(1) <= k) for k = 0, 1, ..., as 32-bit fractions.
POISSON = (1580030169, 3160060337, 3950075422, 4213413783, 4279248374, 4292415292, 4294609778, 4294923276, 4294962463, 4294966817)
PARTIAL = "vendor string, condition string, part int, counts array<long>"


def mixed(x: np.ndarray) -> np.ndarray:
    """Scrambling of 32-bit values (held in 64 bits)."""
    low = np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    x = x * np.uint64(0x21F0AAAD) & low
    x = x ^ (x >> np.uint64(15))
    x = x * np.uint64(0x735A2D97) & low
    return x ^ (x >> np.uint64(15))


def weights(keys: np.ndarray, replicates: int = REPLICATES, seed: int = SEED) -> np.ndarray:
    """Poisson(1) weights, a row per key and a column per replicate."""
    bits, low = keys.astype(np.int64).view(np.uint64), np.uint64(0xFFFFFFFF)
    own = mixed(mixed((bits & low) ^ np.uint64(seed)) ^ (bits >> np.uint64(32)))
    step = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B9) & low
    drawn = mixed((own[:, None] + step[None, :]) & low)
    return np.searchsorted(np.array(POISSON, np.uint64), drawn, "right")


def _partial(replicates: int, seed: int):
    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            cell = batch.column(3).to_numpy()
            keys = batch.column(0).to_numpy()
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            known = {s: i for i, s in enumerate(dict.fromkeys(names))}
            place = np.fromiter((known[s] for s in names), np.int64, len(names)) * 4 + cell
            total = np.zeros((len(known) * 4, replicates), np.int64)
            for low in range(0, len(keys), ROWS):
                w = weights(keys[low : low + ROWS], replicates, seed)
                part = place[low : low + ROWS]
                order = np.argsort(part, kind="stable")
                first = np.flatnonzero(np.diff(part[order], prepend=-1))
                total[part[order][first]] += np.add.reduceat(w[order], first, axis=0)
            for s, i in known.items():
                own = total[i * 4 : i * 4 + 4]
                sums[s] = sums[s] + own if s in sums else own
        part = TaskContext.get().partitionId() % MERGE
        yield _rows([(v, c, part, t.ravel()) for (v, c), t in sums.items()])
    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    counts = pa.array([r[3] for r in rows], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                       pa.array([r[2] for r in rows], pa.int32()), counts], ["vendor", "condition", "part", "counts"])


def _merged(table: pa.Table) -> pa.Table:
    """The sum of a group's vectors."""
    vectors = table.column("counts").combine_chunks()
    total = vectors.flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0)
    first = table.slice(0, 1).to_pylist()[0]
    return pa.Table.from_batches([_rows([(first["vendor"], first["condition"], first["part"], total)])])


def replicate_counts(preds: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Confusion counts of every replicate: vendor, condition, replicate, tp, fn, fp, tn.

    Rows without a trial key cannot be resampled and fail the job; rows that are no valid
    pair count nowhere. A setting without valid pairs has no rows.
    """
    pos, neg = LABELS
    cell = F.when(F.col("ground_truth") == pos, F.when(F.col("parsed_output") == pos, 0).otherwise(1)).otherwise(
        F.when(F.col("parsed_output") == pos, 2).otherwise(3))
    key = F.coalesce(F.col("trial_idx").cast("long"), F.raise_error(F.lit("rows without a trial key cannot be resampled")).cast("long"))
    rows = metrics.valid_pairs(preds).select(key.alias("trial_idx"), "vendor", "condition", cell.cast("long").alias("cell"))
    partial = rows.mapInArrow(_partial(replicates, seed), PARTIAL)
    some = partial.groupBy("vendor", "condition", "part").applyInArrow(_merged, PARTIAL)
    whole = some.groupBy("vendor", "condition").applyInArrow(_merged, PARTIAL)
    at = F.sequence(F.lit(0), F.lit(replicates - 1))
    exploded = whole.select("vendor", "condition", "counts", F.explode(at).alias("replicate"))
    return exploded.select("vendor", "condition", "replicate", *[
        F.element_at("counts", F.col("replicate") + F.lit(i * replicates + 1)).alias(c) for i, c in enumerate(CELLS)])


def _order_statistic(values: Column, share: float) -> Column:
    """The smallest value with at least ``share`` of all values at or below it."""
    sorted_values = F.sort_array(F.filter(values, lambda v: v.isNotNull()))
    place = F.greatest(F.lit(1), F.ceil(F.size(sorted_values) * F.lit(share))).cast("int")
    return F.try_element_at(sorted_values, place)


def bootstrap_intervals(preds: DataFrame, replicates: int = REPLICATES, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """Per setting: number of valid pairs, and each metric with its percentile bounds. Undefined
    values of replicates (a class that was not drawn) are left out; a metric that is undefined in
    all of them has NULL bounds."""
    if not 0 < level < 1 or replicates < 1:
        raise ValueError("the level lies between 0 and 1, and there is at least one replicate")
    scored = metrics.with_scores(replicate_counts(preds, replicates, seed))
    low, high = (1 - level) / 2, (1 + level) / 2
    bounds = scored.groupBy("vendor", "condition").agg(*[F.collect_list(m).alias(m) for m in SCORES]).select(
        "vendor", "condition", *[b for m in SCORES for b in (_order_statistic(F.col(m), low).alias(f"{m}_lower"),
                                                             _order_statistic(F.col(m), high).alias(f"{m}_upper"))])
    point = metrics.with_scores(metrics.confusion_counts(preds)).select("vendor", "condition", "n_pairs", *SCORES)
    return point.join(bounds, ["vendor", "condition"], "left").select(
        "vendor", "condition", "n_pairs", *[c for m in SCORES for c in (m, f"{m}_lower", f"{m}_upper")])
