"""Data behind the reference's charts (V1-V9); drawing is left to the caller.

Each chart reads a fixed vendor x condition grid. The grid is a literal
table of a size set by the design (not by the data); the data side is an
aggregate of the metrics or prediction table, joined on (vendor, condition)
with a left join so every grid cell survives. AQE broadcasts the aggregate
once its runtime size is known, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, Design, literal_map
from recallscope.operators.compare import f1_pivot
from recallscope.operators.metrics import model_counts, setting_counts, sum_models, with_scores
from recallscope.session import materialize


def vendor_display(design: Design = DEFAULT_DESIGN, col: str = "vendor") -> Column:
    """Vendor label, falling back to the upper-cased name."""
    return F.coalesce(literal_map(design.vendor_labels)[F.col(col)], F.upper(F.col(col)))


def condition_display(design: Design = DEFAULT_DESIGN, col: str = "condition", labels=None) -> Column:
    """Condition label, falling back to the name itself."""
    labels = design.plot_condition_labels if labels is None else labels
    return F.coalesce(literal_map(labels)[F.col(col)], F.col(col))


def display_names(df: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """V1: add ``vendor_display`` and ``condition_display``."""
    return df.withColumns({"vendor_display": vendor_display(design),
                           "condition_display": condition_display(design)})


def grid(spark: SparkSession, vendors, conditions) -> DataFrame:
    """Literal vendor x condition grid with order columns (no join needed)."""
    cells = F.array(*[
        F.struct(F.lit(v).alias("vendor"), F.lit(c).alias("condition"),
                 F.lit(vi).alias("vendor_ord"), F.lit(ci).alias("condition_ord"))
        for ci, c in enumerate(conditions) for vi, v in enumerate(vendors)
    ])
    return spark.range(1).select(F.inline(cells))


def fill_grid(metrics: DataFrame, value: str, fill: float | None, vendors=None, conditions=None,
              design: Design = DEFAULT_DESIGN) -> DataFrame:
    """V2/V3/V5/V7: one value per grid cell from the first metrics row.

    A cell without a metrics row gets ``fill``; a row whose value is
    undefined keeps NULL (no fill), as in the charts.
    """
    vendors = design.vendors if vendors is None else vendors
    conditions = design.conditions if conditions is None else conditions
    cells = (metrics.where(F.col("vendor").isin(*vendors) & F.col("condition").isin(*conditions))
             .groupBy("vendor", "condition")
             .agg(F.max(value).alias("_v"), F.count(F.lit(1)).alias("_rows")))
    g = grid(metrics.sparkSession, vendors, conditions)
    filled = F.when(F.col("_rows").isNull(), F.lit(fill).cast("double")).otherwise(F.col("_v"))
    return (g.join(cells, ["vendor", "condition"], "left")
            .select("vendor", "condition", "vendor_ord", "condition_ord",
                    vendor_display(design).alias("vendor_display"),
                    filled.alias(value)))


def grid_f1(metrics: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    return fill_grid(metrics, "f1_macro", 0.0, design=design)


def series_degradation(metrics: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    return fill_grid(metrics, "f1_macro", None, conditions=design.degradation_series, design=design)


def grid_valid_rate(metrics: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    return fill_grid(metrics, "pct_valid", 0.0, design=design)


def heatmap_pivot(metrics: DataFrame, design: Design = DEFAULT_DESIGN, materialized: bool = False) -> DataFrame:
    """V4: the F1 pivot with display names on both axes."""
    pivot = f1_pivot(metrics, design, materialized)
    renamed = [vendor_display(design).alias("vendor")]
    for c in pivot.columns:
        if c != "vendor":
            renamed.append(F.col(f"`{c}`").alias(design.heatmap_condition_labels.get(c, c)))
    return pivot.select(*renamed)


def _has_condition(df: DataFrame, condition: str) -> Column:
    """Uncorrelated EXISTS over materialized rows (a few per setting)."""
    return df.where(F.col("condition") == condition).select("condition").exists()


def _counterfactual_grid(metrics: DataFrame, conditions, design: Design, materialized: bool) -> DataFrame:
    if not materialized:
        metrics = materialize(metrics)  # read for the cells and for the existence test; one row per setting
    g = fill_grid(metrics, "f1_macro", 0.0, conditions=conditions, design=design)
    show = F.coalesce(F.col("f1_macro") > 0, F.lit(False))
    return (g.withColumn("show_label", show)
            .where(_has_condition(metrics, design.counterfactual)))


def grid_counterfactual(metrics: DataFrame, design: Design = DEFAULT_DESIGN, materialized: bool = False) -> DataFrame:
    """V7: baseline vs the rewritten conditions; empty without rewritten rows."""
    return _counterfactual_grid(metrics, design.counterfactual_series, design, materialized)


def grid_counterfactual_only(metrics: DataFrame, design: Design = DEFAULT_DESIGN,
                             materialized: bool = False) -> DataFrame:
    """V9: the rewritten conditions only."""
    return _counterfactual_grid(metrics, design.rewritten_conditions, design, materialized)


def confusion_panels(preds: DataFrame, conditions=None, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """V6/V8: per grid cell tp, fn, fp, tn and F1, or a no-valid flag."""
    conditions = design.conditions if conditions is None else conditions
    counts = setting_counts(
        preds.where(F.col("vendor").isin(*design.vendors) & F.col("condition").isin(*conditions)))
    return panels_from_counts(counts, conditions, design)


def panels_from_counts(counts: DataFrame, conditions=None, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """V6/V8 from (vendor, condition) count rows."""
    conditions = design.conditions if conditions is None else conditions
    cells = counts.where(F.col("vendor").isin(*design.vendors) & F.col("condition").isin(*conditions))
    scored = with_scores(cells).select("vendor", "condition", "tp", "fn", "fp", "tn", "f1_macro")
    g = grid(counts.sparkSession, design.vendors, conditions)
    j = g.join(scored, ["vendor", "condition"], "left")
    n = F.coalesce(F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn"), F.lit(0))
    return j.select(
        "condition", "vendor", "condition_ord", "vendor_ord",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "fn", "fp", "tn")],
        F.when(n > 0, F.col("f1_macro")).alias("f1_macro"),
        (n > 0).alias("has_valid"),
    )


def panels_confusion(preds: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    return confusion_panels(preds, design.conditions, design)


def panels_confusion_cf(preds: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """V8: rewritten conditions; empty when there is no rewritten prediction."""
    return panels_cf_from_counts(materialize(model_counts(preds)), design)


def panels_cf_from_counts(model_counts: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """V8 from :func:`recallscope.operators.metrics.model_counts` (whose NULL-key
    groups still tell whether any rewritten prediction exists)."""
    return (panels_from_counts(sum_models(model_counts), design.rewritten_conditions, design)
            .where(_has_condition(model_counts, design.counterfactual)))
