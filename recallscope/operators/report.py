"""The formatted report table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, Design, literal_map
from recallscope.functions import format_ci, format_fixed, wald_ci
from recallscope.operators.metrics import pct_valid, setting_counts, with_scores

REPORT_COLUMNS = ("Condition", "Model", "Valid predictions (%)", "Accuracy (95% CI)",
                  "Sensitivity (95% CI)", "Specificity (95% CI)", "F1 Score (95% CI)")

# metric -> (report column, size of the interval's sample)
_INTERVALS = {
    "accuracy": ("Accuracy (95% CI)", lambda: F.col("n_pairs")),
    "sensitivity": ("Sensitivity (95% CI)", lambda: F.col("tp") + F.col("fn")),
    "specificity": ("Specificity (95% CI)", lambda: F.col("tn") + F.col("fp")),
    "f1_macro": ("F1 Score (95% CI)", lambda: F.col("n_pairs")),
}


def scores_from_counts(counts: DataFrame) -> DataFrame:
    """Scores of (vendor, condition) count rows."""
    return with_scores(counts).withColumn("pct_valid", pct_valid())


def setting_scores(preds: DataFrame) -> DataFrame:
    """Counts and scores per (vendor, condition), model ignored."""
    return scores_from_counts(setting_counts(preds, ("vendor", "condition")))


def report_table(preds: DataFrame, design: Design = DEFAULT_DESIGN, with_order: bool = False,
                 z: float = 1.96) -> DataFrame:
    """One string row per known (condition, vendor) present.

    Labels come from literal maps, so unknown vendors or conditions drop out
    without a join. ``with_order`` adds the two order columns for the sink.
    """
    return report_from_scores(setting_scores(preds), design, with_order, z)


def report_from_scores(scores: DataFrame, design: Design = DEFAULT_DESIGN, with_order: bool = False,
                       z: float = 1.96) -> DataFrame:
    """R8 from per-(vendor, condition) scores (see :func:`report_table`)."""
    known = scores.where(design.condition_ord().isNotNull() & design.vendor_ord().isNotNull())
    cols = [
        literal_map(design.report_condition_labels)[F.col("condition")].alias("Condition"),
        literal_map(design.vendor_labels)[F.col("vendor")].alias("Model"),
        format_fixed(F.col("pct_valid"), 1).alias("Valid predictions (%)"),
    ]
    for metric, (title, size) in _INTERVALS.items():
        ci = wald_ci(F.col(metric), size(), z)
        cols.append(format_ci(F.col(metric), ci["lower"], ci["upper"]).alias(title))
    if with_order:
        cols += [design.condition_ord().alias("condition_ord"), design.vendor_ord().alias("vendor_ord")]
    return known.select(*cols)


def format_ci_table(preds: DataFrame, z: float = 1.96) -> DataFrame:
    """M13 on every (vendor, condition): the four formatted intervals."""
    stats = setting_scores(preds)
    cols = ["vendor", "condition"]
    for metric, (title, size) in _INTERVALS.items():
        ci = wald_ci(F.col(metric), size(), z)
        cols.append(format_ci(F.col(metric), ci["lower"], ci["upper"]).alias(f"{metric}_ci"))
    return stats.select(*cols)


# pandas prints a frame without rows this way (the reference's text file
# then holds just these lines)
EMPTY_FRAME_TEXT = "Empty DataFrame\nColumns: []\nIndex: []"


def render_lines(report: DataFrame, columns=REPORT_COLUMNS) -> DataFrame:
    """Fixed-width text of a report table (with ``condition_ord`` and
    ``vendor_ord``) as ``(line_no, line)`` rows: the layout of pandas'
    ``to_string(index=False)`` for string cells, every column right-justified
    to its widest cell or title and one space apart, titles on line 0.

    The titles enter as one more row, so a single window over the report
    yields every width. The report has at most |conditions| x |vendors|
    rows (it is an aggregate), so the window's one partition stays that small.
    """
    titles = report.sparkSession.range(1).select(
        *[F.lit(c).alias(c) for c in columns],
        F.lit(-1).alias("condition_ord"), F.lit(-1).alias("vendor_ord"))
    cells = report.select(*[F.col(f"`{c}`") for c in columns], "condition_ord", "vendor_ord").unionByName(titles)
    whole = Window.partitionBy()
    padded = [F.lpad(F.col(f"`{c}`"), F.greatest(F.lit(len(c)), F.max(F.length(F.col(f"`{c}`"))).over(whole)), " ")
              for c in columns]
    line = F.when(F.count(F.lit(1)).over(whole) == 1, F.lit(EMPTY_FRAME_TEXT)).otherwise(F.concat_ws(" ", *padded))
    order = Window.orderBy("condition_ord", "vendor_ord")
    return cells.select((F.row_number().over(order) - 1).cast("bigint").alias("line_no"), line.alias("line"))


def report_lines(preds: DataFrame, design: Design = DEFAULT_DESIGN, z: float = 1.96) -> DataFrame:
    """R8 as text lines (the reference's ``table_manuscript.txt``)."""
    return render_lines(report_table(preds, design, with_order=True, z=z))


def lines_text(lines: DataFrame, order=("line_no",), trailing_newline: bool = False) -> str:
    """Join a small table of text lines on the driver (a rendered report has
    a handful of lines, bounded by the design)."""
    text = "\n".join(r[0] for r in lines.orderBy(*order).select("line").collect())
    return text + "\n" if trailing_newline else text
