"""Pivots, rankings and comparisons over the metrics table.

All inputs here are the metrics table (one row per setting). Rows that share
(vendor, condition) carry identical numbers, because metrics are computed
over vendor + condition; so the reference's "first row" equals any row and
``max`` (which skips NULLs) stands in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, Design
from recallscope.session import materialize


def _present(metrics: DataFrame, column: str, known) -> list[str]:
    """Known values of ``column`` having some defined F1, in design order.

    Bounded by the length of ``known``: the filter runs before the collect.
    """
    rows = (metrics.where(F.col("f1_macro").isNotNull() & F.col(column).isin(*known))
            .select(column).distinct().collect())
    have = {r[0] for r in rows}
    return [k for k in known if k in have]


def f1_pivot(metrics: DataFrame, design: Design = DEFAULT_DESIGN, materialized: bool = False) -> DataFrame:
    """R1 + R2: vendors x conditions of macro F1.

    Only known conditions that have a defined F1 become columns, in design
    order; only known vendors with some defined F1 become rows. Cells are the
    F1 of the setting (first non-null), NULL when absent.
    """
    if not materialized:
        metrics = materialize(metrics)  # read three times below; one row per setting
    defined = metrics.where(F.col("f1_macro").isNotNull())
    conditions = _present(metrics, "condition", design.conditions)
    vendors_with_f1 = defined.select("vendor").distinct()
    cells = (metrics.where(F.col("vendor").isin(*design.vendors))
             .join(vendors_with_f1, "vendor", "left_semi"))
    if not conditions:
        return cells.select("vendor").distinct()
    return (cells.groupBy("vendor")
            .pivot("condition", conditions)
            .agg(F.max("f1_macro")))


def f1_pivot_mean(metrics: DataFrame, materialized: bool = False) -> DataFrame:
    """Summary pivot, mean per cell, all present values, no reordering."""
    if not materialized:
        metrics = materialize(metrics)  # read for the columns, then for the cells; one row per setting
    defined = metrics.where(F.col("f1_macro").isNotNull())
    conditions = sorted(r[0] for r in defined.select("condition").distinct().collect())
    if not conditions:
        return defined.select("vendor").distinct()
    return defined.groupBy("vendor").pivot("condition", conditions).agg(F.avg("f1_macro"))


def top_f1(metrics: DataFrame, k: int = 5, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """K best settings by F1; undefined ones come last, and only when fewer
    than k are defined.

    Ties keep the first setting in design order (condition, then vendor, then
    model). ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: a top-k
    per task, then one merge of k rows per task.
    """
    return (metrics
            .orderBy(F.desc_nulls_last("f1_macro"),
                     design.condition_ord().asc_nulls_last(), design.vendor_ord().asc_nulls_last(),
                     F.col("condition").asc_nulls_last(), F.col("vendor").asc_nulls_last(),
                     F.col("model").asc_nulls_last())
            .limit(k)
            .select("vendor", "condition", "f1_macro", "accuracy", "pct_valid"))


def degradation(metrics: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """F1 drop of every setting against its vendor's baseline.

    Vendors without a baseline row are skipped. ``rel_degradation_pct`` is 0
    when the baseline F1 is not above 0 (or undefined). Negative values mean
    better than baseline.
    """
    w = Window.partitionBy("vendor")
    is_base = F.col("condition") == design.baseline
    with_base = metrics.select(
        "vendor", "condition", "f1_macro",
        F.max(F.when(is_base, F.col("f1_macro"))).over(w).alias("baseline_f1"),
        F.max(is_base.cast("int")).over(w).alias("_has_base"),
    ).where(F.col("_has_base") == 1)
    abs_drop = F.col("baseline_f1") - F.col("f1_macro")
    return with_base.select(
        "vendor", "condition", "f1_macro", "baseline_f1",
        abs_drop.alias("abs_degradation"),
        F.when(F.col("baseline_f1") > 0, abs_drop / F.col("baseline_f1") * F.lit(100.0))
        .otherwise(F.lit(0.0)).alias("rel_degradation_pct"),
    )


def counterfactual_metrics(metrics: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """Metrics rows of the rewritten-text condition (not the +DOI one)."""
    return metrics.where(F.col("condition") == design.counterfactual)


def compare_conditions(metrics: DataFrame, first: str, second: str,
                       names=("baseline_f1", "counterfactual_f1", "f1_difference")) -> DataFrame:
    """Per vendor having both conditions, both F1s and first minus second.

    One conditional aggregation per vendor; no self-join.
    """
    c = F.col("condition")
    per_vendor = metrics.where(c.isin(first, second)).groupBy("vendor").agg(
        F.max(F.when(c == first, F.col("f1_macro"))).alias(names[0]),
        F.max(F.when(c == second, F.col("f1_macro"))).alias(names[1]),
        F.count_if(c == first).alias("_n_first"),
        F.count_if(c == second).alias("_n_second"),
    )
    return (per_vendor.where((F.col("_n_first") > 0) & (F.col("_n_second") > 0))
            .select("vendor", names[0], names[1], (F.col(names[0]) - F.col(names[1])).alias(names[2])))


def baseline_vs_counterfactual(metrics: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    return compare_conditions(metrics, design.baseline, design.counterfactual)
