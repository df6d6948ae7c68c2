"""Classification metrics per setting.

Plan shape for any input size: one scan of the prediction log (three or
four columns after pruning), a partial HashAggregate per task, one shuffle of
at most (#settings x #tasks) rows, a final aggregate, then tiny per-setting
arithmetic. Skewed settings cost nothing extra because the map-side combine
happens before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallscope.design import LABELS, STATUS_ERROR, STATUS_INVALID
from recallscope.functions import accuracy, f1_macro, sensitivity, specificity, wald_ci

POS, NEG = LABELS
COUNT_COLUMNS = ("n_total", "n_valid", "n_invalid", "n_error", "tp", "fn", "fp", "tn")
METRIC_COLUMNS = ("vendor", "model", "condition", "accuracy", "f1_macro",
                  "n_total", "n_valid", "n_invalid", "n_error", "pct_valid")


def _pred() -> Column:
    return F.col("parsed_output")


def _truth() -> Column:
    return F.col("ground_truth")


def valid_prediction() -> Column:
    return _pred().isin(*LABELS)


def valid_pair() -> Column:
    """Both prediction and truth are one of the two labels (M4)."""
    return _pred().isin(*LABELS) & _truth().isin(*LABELS)


def count_aggregates() -> list[Column]:
    """M2 + M5 as conditional counts: all computed in one aggregation."""
    def both(t, p):
        return F.count_if((_truth() == t) & (_pred() == p))
    return [
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(valid_prediction()).alias("n_valid"),
        F.count_if(_pred() == STATUS_INVALID).alias("n_invalid"),
        F.count_if(_pred() == STATUS_ERROR).alias("n_error"),
        both(POS, POS).alias("tp"),
        both(POS, NEG).alias("fn"),
        both(NEG, POS).alias("fp"),
        both(NEG, NEG).alias("tn"),
    ]


def keyed(preds: DataFrame) -> DataFrame:
    """Rows with a vendor and a condition: NULL keys never match a setting."""
    return preds.where(F.col("vendor").isNotNull() & F.col("condition").isNotNull())


def distinct_settings(preds: DataFrame) -> DataFrame:
    """M1: distinct (vendor, model, condition)."""
    return preds.select("vendor", "model", "condition").distinct()


def setting_counts(preds: DataFrame, by=("vendor", "condition")) -> DataFrame:
    """M2 + M5: status and confusion counts per group, one pass."""
    return keyed(preds).groupBy(*by).agg(*count_aggregates())


def status_counts(preds: DataFrame) -> DataFrame:
    return setting_counts(preds).select("vendor", "condition", "n_total", "n_valid", "n_invalid", "n_error")


def valid_rate(counts: DataFrame) -> DataFrame:
    """M3: percent of rows with a label answer (truth not checked)."""
    return counts.select("vendor", "condition", pct_valid().alias("pct_valid"))


def pct_valid() -> Column:
    return F.col("n_valid").cast("double") / F.col("n_total").cast("double") * F.lit(100.0)


def valid_pairs(preds: DataFrame) -> DataFrame:
    return keyed(preds).where(valid_pair())


def confusion_counts(preds: DataFrame, by=("vendor", "condition")) -> DataFrame:
    """M5: tp, fn, fp, tn with POSITIVE as the positive class."""
    return setting_counts(preds, by).select(*by, "tp", "fn", "fp", "tn")


def with_scores(counts: DataFrame) -> DataFrame:
    """M6-M9 from confusion counts."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return counts.withColumns({
        "n_pairs": tp + fn + fp + tn,
        "accuracy": accuracy(tp, fn, fp, tn),
        "f1_macro": f1_macro(tp, fn, fp, tn),
        "sensitivity": sensitivity(tp, fn),
        "specificity": specificity(tn, fp),
    })


def model_counts(preds: DataFrame) -> DataFrame:
    """M2 + M5 per (vendor, condition, model), NULL keys kept as groups.

    The one aggregate of the log that every result table derives from: a
    row per setting (plus at most a few NULL-key groups), combined map-side.
    Filters on its keys are pushed below it by the optimizer.
    """
    return preds.groupBy("vendor", "condition", "model").agg(*count_aggregates())


def sum_models(counts: DataFrame) -> DataFrame:
    """Counts per (vendor, condition) from :func:`model_counts` rows that
    have a vendor and a condition."""
    return keyed(counts).groupBy("vendor", "condition").agg(*[F.sum(c).alias(c) for c in COUNT_COLUMNS])


def stats_from_counts(counts: DataFrame) -> DataFrame:
    """All counts and scores, one row per (vendor, model, condition).

    Counts are taken over *all* rows of the (vendor, condition), whatever the
    model, as the reference masks on vendor and condition only. The window
    runs over the aggregate (a handful of rows per setting), not the log.
    """
    w = Window.partitionBy("vendor", "condition")
    summed = keyed(counts).select("vendor", "model", "condition",
                                  *[F.sum(c).over(w).alias(c) for c in COUNT_COLUMNS])
    return with_scores(summed).withColumn("pct_valid", pct_valid())


def setting_stats(preds: DataFrame) -> DataFrame:
    return stats_from_counts(model_counts(preds))


def metrics_from_counts(counts: DataFrame) -> DataFrame:
    """M10 from :func:`model_counts`."""
    return stats_from_counts(counts).select(*METRIC_COLUMNS)


def metrics_by_setting(preds: DataFrame) -> DataFrame:
    """The metrics table."""
    return metrics_from_counts(model_counts(preds))


def metric_intervals(stats: DataFrame, z: float = 1.96) -> DataFrame:
    """Wald intervals, each with its own n.

    Accuracy and macro F1 use all valid pairs (F1 treated as a proportion,
    as in the reference: a rough interval), sensitivity tp+fn, specificity
    tn+fp.
    """
    n = F.col("n_pairs")
    specs = {
        "accuracy": n,
        "sensitivity": F.col("tp") + F.col("fn"),
        "specificity": F.col("tn") + F.col("fp"),
        "f1_macro": n,
    }
    cols = []
    for name, size in specs.items():
        ci = wald_ci(F.col(name), size, z)
        cols += [F.col(name), ci["lower"].alias(f"{name}_lower"), ci["upper"].alias(f"{name}_upper")]
    return stats.select("vendor", "condition", *cols)
