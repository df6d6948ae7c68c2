"""The whole analysis as one job: predictions (+ trials) -> every result table.

The prediction log is scanned once: its counts per (vendor, condition,
model) are materialized (a row per setting), and the metrics table, the
report, the pivot, ranking, degradation and comparison tables and the chart
data all derive from those rows. The section tables derive from one pattern
table of the trials (one pass over their section column). All outputs are
small and written as one file each, but for the pattern table, whose rows come
from the data and are written in parallel. :func:`analyze_counts` starts from the
counts themselves, which is how the streaming analysis publishes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, Design
from recallscope.operators import compare, metrics, plotdata, report, sections
from recallscope.session import materialize
from recallscope.sources.io import write_tables, write_text
from recallscope.sources.snapshots import publishing


# key of the section report's lines among the result tables (written as text)
SECTION_LINES = "_section_report_lines"


def log_counts(preds: DataFrame) -> DataFrame:
    """The one pass over the prediction log: counts per (vendor, condition,
    model), materialized in the shared folder. Every table below derives from
    these few rows."""
    return materialize(metrics.model_counts(preds))


def result_tables(preds: DataFrame | None, trials: DataFrame | None = None,
                  design: Design = DEFAULT_DESIGN, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every result table of the analysis, keyed by its output name
    (``preds`` is not read when ``counts`` are given)."""
    counts = log_counts(preds) if counts is None else counts
    m = materialize(metrics.metrics_from_counts(counts))
    per_setting = report.scores_from_counts(metrics.sum_models(counts))
    tables = {
        "metrics": m,
        "table_f1_by_condition": compare.f1_pivot(m, design, materialized=True),
        "table_degradation": compare.degradation(m, design),
        # read twice (CSV and text): one row per setting, computed once
        "table_manuscript": materialize(report.report_from_scores(per_setting, design, with_order=True)),
        "summary_f1_mean": compare.f1_pivot_mean(m, materialized=True),
        "summary_top_f1": compare.top_f1(m, 5, design),
    }
    cf = compare.counterfactual_metrics(m, design)
    if cf.take(1):  # as the reference, skip counterfactual tables without such rows
        tables["table_counterfactual_metrics"] = cf
        tables["table_baseline_vs_counterfactual"] = compare.baseline_vs_counterfactual(m, design)
        if trials is not None and "sections_modified" in trials.columns:
            sec = sections.section_tables(trials)  # one pass over the trials' section column
            tables["table_counterfactual_sections"] = sec["sections"]
            tables["table_counterfactual_patterns"] = sec["patterns"]
            tables["table_counterfactual_section_modifications"] = sec["modifications"]
            tables["table_sections_per_trial"] = sec["per_trial"]
            tables[SECTION_LINES] = sec["report_lines"]  # text, not a table: analyze writes it
    return tables


def chart_tables(preds: DataFrame | None, design: Design = DEFAULT_DESIGN, m: DataFrame | None = None,
                 counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The data behind the eight charts (``counts``: :func:`log_counts`
    already taken; ``m``: the metrics table already computed from them)."""
    counts = log_counts(preds) if counts is None else counts
    m = materialize(metrics.metrics_from_counts(counts)) if m is None else m
    return {
        "f1_by_condition": plotdata.grid_f1(m, design),
        "performance_degradation": plotdata.series_degradation(m, design),
        "f1_heatmap": plotdata.heatmap_pivot(m, design, materialized=True),
        "valid_rates": plotdata.grid_valid_rate(m, design),
        "confusion_matrices_combined": plotdata.panels_from_counts(metrics.sum_models(counts),
                                                                   design.conditions, design),
        "counterfactual_f1_comparison": plotdata.grid_counterfactual(m, design, materialized=True),
        "counterfactual_confusion_matrices": plotdata.panels_cf_from_counts(counts, design),
        "counterfactual_performance": plotdata.grid_counterfactual_only(m, design, materialized=True),
    }


def analyze(spark: SparkSession, preds: DataFrame, out_dir: str, trials: DataFrame | None = None,
            design: Design = DEFAULT_DESIGN, charts: bool = False, snapshot: bool = False) -> dict[str, DataFrame]:
    """Write every result table (and optionally the chart data) to ``out_dir``; as a new version that
    becomes current at once (:mod:`recallscope.sources.snapshots`) with ``snapshot``."""
    if not snapshot:
        return analyze_counts(spark, log_counts(preds), out_dir, trials, design, charts)
    with publishing(spark, out_dir) as folder:
        return analyze_counts(spark, log_counts(preds), folder, trials, design, charts)


def analyze_counts(spark: SparkSession, counts: DataFrame, out_dir: str, trials: DataFrame | None = None,
                   design: Design = DEFAULT_DESIGN, charts: bool = False) -> dict[str, DataFrame]:
    """:func:`analyze` from counts per (vendor, condition, model) already
    taken (:func:`log_counts`, or a streaming aggregate's complete output)."""
    tables = result_tables(None, trials, design, counts)
    section_lines = tables.pop(SECTION_LINES, None)
    if charts:
        charted = chart_tables(None, design, tables["metrics"], counts)
        tables.update({f"plot_{k}": v for k, v in charted.items()})
    order = {
        "metrics": [design.condition_ord().asc_nulls_last(), design.vendor_ord().asc_nulls_last(),
                    F.col("condition"), F.col("vendor"), F.col("model")],
        "table_degradation": [design.vendor_ord().asc_nulls_last(), F.col("vendor"),
                              design.condition_ord().asc_nulls_last(), F.col("condition")],
        "table_manuscript": ["condition_ord", "vendor_ord"],
        "table_f1_by_condition": [design.vendor_ord()],
        "table_counterfactual_patterns": [F.desc("n_trials"), F.col("pattern")],
    }
    write_tables({k: v for k, v in tables.items() if k != "table_manuscript"}, out_dir, order_by=order,
                 parallel=("table_counterfactual_patterns",))
    manuscript = tables["table_manuscript"].coalesce(1).sortWithinPartitions("condition_ord", "vendor_ord")
    write_tables({"table_manuscript": manuscript.select(*report.REPORT_COLUMNS)}, out_dir)
    # the text renderings: a handful of lines each, joined on the driver
    out = out_dir.rstrip("/")
    write_text(spark, f"{out}/table_manuscript.txt", report.lines_text(report.render_lines(tables["table_manuscript"])))
    if section_lines is not None:
        write_text(spark, f"{out}/table_counterfactual_section_modifications.txt",
                   report.lines_text(section_lines, order=("block", "pos"), trailing_newline=True))
    return tables
