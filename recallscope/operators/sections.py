"""Which sections of the rewritten texts were changed.

The per-trial value is a JSON array of section names stored as a string.
Known-section counts are one global aggregation (partial per task, one row
per task to merge); totals enter as scalar subqueries over the materialized
pattern rows, so no join or unpartitioned window is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallscope.design import SECTION_REPORT_ROWS, SECTIONS
from recallscope.session import materialize

SECTIONS_TYPE = "array<string>"
_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_GAP = r"[ \t\n\r]*+"
STRING_ARRAY = rf"\A{_GAP}\[{_GAP}(?:{_STRING}{_GAP}(?:,{_GAP}{_STRING}{_GAP})*+)?\]{_GAP}\z"


def parse_sections(col: Column | str = "sections_modified", on_error: str = "raise") -> Column:
    """JSON string -> array<string>.

    Malformed JSON (single quotes, text after the array), anything but an array of
    strings, or a missing value fails the job; ``on_error="null"`` returns NULL
    instead. Spark's own parser is more lenient, so the text must first match the
    JSON grammar of a string array.
    """
    col = F.col(col) if isinstance(col, str) else col
    parsed = F.when(col.rlike(STRING_ARRAY), F.from_json(col, SECTIONS_TYPE))
    if on_error == "null":
        return parsed
    return F.when(parsed.isNull(),
                  F.raise_error(F.concat(F.lit("sections_modified is not a JSON array of strings: "),
                                         F.coalesce(col, F.lit("NULL"))))
                  ).otherwise(parsed)


def with_sections(trials: DataFrame, on_error: str = "raise") -> DataFrame:
    return trials.select("trial_idx", "sections_modified",
                         parse_sections("sections_modified", on_error).alias("sections"))


def pattern_table(trials: DataFrame) -> DataFrame:
    """Trials per raw ``sections_modified`` string, each string parsed once.

    One pass over the trials' section column, combined map-side (the usual
    case, one pattern for most trials, collapses inside each task); the JSON
    of every distinct string is then parsed once instead of once per trial.
    Every section table (S2-S6) derives from these rows. A malformed or
    missing value fails the job when its pattern is parsed, as in S1.
    """
    return (trials.groupBy(F.col("sections_modified").alias("pattern"))
            .agg(F.count(F.lit(1)).alias("n_trials"))
            .select("pattern", "n_trials", parse_sections("pattern").alias("sections")))


def pattern_total(patterns: DataFrame) -> Column:
    """Number of trials from a (materialized) pattern table."""
    return patterns.select(F.coalesce(F.sum("n_trials"), F.lit(0)).cast("bigint")).scalar()


def _pct(n: str, total: Column) -> Column:
    return F.col(n).cast("double") / total.cast("double") * F.lit(100.0)


def raw_counts_from(patterns: DataFrame) -> DataFrame:
    return (patterns.select(F.explode("sections").alias("section"), "n_trials")
            .groupBy("section").agg(F.sum("n_trials").alias("n_modified")))


def section_counts_raw(trials: DataFrame) -> DataFrame:
    """Occurrences of every section name (repeats within a trial count)."""
    return raw_counts_from(pattern_table(trials))


def _known_counts(patterns: DataFrame, sections, labels) -> DataFrame:
    """(total, ord, section, n_modified) for a fixed section list, one global
    aggregate over the pattern rows."""
    def occurrences_of(name):
        return F.col("n_trials") * F.size(F.filter("sections", lambda s: s == F.lit(name)))

    occurrences = [F.sum(occurrences_of(name)).alias(f"c{i}") for i, name in enumerate(sections)]
    agg = patterns.agg(F.coalesce(F.sum("n_trials"), F.lit(0)).cast("bigint").alias("total"), *occurrences)
    rows = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("section"),
                 F.coalesce(F.col(f"c{i}"), F.lit(0)).cast("bigint").alias("n_modified"))
        for i, label in enumerate(labels)
    ])
    return agg.select("total", F.inline(rows))


def section_counts_from(patterns: DataFrame, sections=SECTIONS) -> DataFrame:
    t = _known_counts(patterns, sections, sections)
    return t.select("section", "n_modified", _pct("n_modified", F.col("total")).alias("pct_modified"))


def section_counts(trials: DataFrame, sections=SECTIONS) -> DataFrame:
    """S3: fixed section list, count (0 if absent) and percent of all trials."""
    return section_counts_from(pattern_table(trials), sections)


def section_modifications_from(patterns: DataFrame, sections=SECTION_REPORT_ROWS) -> DataFrame:
    t = _known_counts(patterns, [s.lower() for s in sections], sections)
    return t.select(F.col("section").alias("Section"),
                    F.col("n_modified").alias("Trials Modified"),
                    _pct("n_modified", F.col("total")).alias("Percentage (%)"))


def section_modifications(trials: DataFrame, sections=SECTION_REPORT_ROWS) -> DataFrame:
    """The report form: title-cased labels, Introduction included."""
    return section_modifications_from(pattern_table(trials), sections)


def pattern_counts_from(patterns: DataFrame, total: Column) -> DataFrame:
    # the key is the raw string, but only once it has parsed (else the job fails)
    return patterns.select(F.when(F.col("sections").isNotNull(), F.col("pattern")).alias("pattern"),
                           "n_trials", _pct("n_trials", total).alias("pct_trials"))


def pattern_counts(trials: DataFrame) -> DataFrame:
    """Trials per raw JSON string (``["a","b"]`` and ``["a", "b"]`` differ).

    The percent is of all trials. Every value must parse (as in S1).
    """
    patterns = materialize(pattern_table(trials))
    return pattern_counts_from(patterns, pattern_total(patterns))


def sections_per_trial_from(patterns: DataFrame, total: Column) -> DataFrame:
    return (patterns.groupBy(F.size("sections").cast("bigint").alias("n_sections"))
            .agg(F.sum("n_trials").alias("n_trials"))
            .select("n_sections", "n_trials", _pct("n_trials", total).alias("pct_trials")))


def sections_per_trial(trials: DataFrame) -> DataFrame:
    """Distribution of the number of sections changed per trial."""
    patterns = materialize(pattern_table(trials))
    return sections_per_trial_from(patterns, pattern_total(patterns))


def summary_from(patterns: DataFrame) -> DataFrame:
    size = F.size("sections")
    n = F.col("n_trials")
    return patterns.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_trials"),
        (F.sum(size * n).cast("double") / F.sum(n).cast("double")).alias("mean_sections"),
        F.percentile(size, 0.5, n).cast("double").alias("median_sections"))


def sections_per_trial_summary(trials: DataFrame) -> DataFrame:
    """Mean and median number of sections per trial. The median is exact:
    a percentile over the pattern rows weighted by their trial counts."""
    return summary_from(pattern_table(trials))


# Fixed layout of the section report text (read off the published file):
# title, rules of 60 "=" and 40 "-", column widths 16/15/13 and 18/13/13.
SECTION_REPORT_TITLE = ("Counterfactual Abstract Section Modifications (N=", " trials)")
RULE_WIDE, RULE = "=" * 60, "-" * 40
FREQUENCY_HEADING = "Section Modification Frequency"
PER_TRIAL_HEADING = "Number of Sections Modified per Trial"


def _left(c: Column, width: int) -> Column:
    """``f"{c:<width}"``: pad on the right, never cut."""
    return F.rpad(c, F.greatest(F.lit(width), F.length(c)), " ")


def _right(c: Column, width: int) -> Column:
    """``f"{c:>width}"``: pad on the left, never cut."""
    return F.lpad(c, F.greatest(F.lit(width), F.length(c)), " ")


def _pct_cell(pct: Column) -> Column:
    return F.concat(_right(F.coalesce(F.format_number(pct, 1), F.lit("nan")), 12), F.lit("%"))


def section_report_lines(trials: DataFrame, sections=SECTION_REPORT_ROWS) -> DataFrame:
    """S5 + S6 as the text report, ``(block, pos, line)`` rows in order.

    Blocks 1 and 3 hold the data rows (one per report section, one per
    distinct number of sections); blocks 0, 2 and 4 the title, rules,
    headings and the mean / median lines. Every part is an aggregate of the
    pattern table (materialized once for the three branches); nothing but the
    finished lines is small enough to gather.
    """
    patterns = materialize(pattern_table(trials))
    return section_report_lines_from(patterns, pattern_total(patterns), sections)


def section_report_lines_from(patterns: DataFrame, total: Column, sections=SECTION_REPORT_ROWS) -> DataFrame:
    known = _known_counts(patterns, [s.lower() for s in sections], sections)
    per_section = known.select(
        F.lit(1).alias("block"), F.col("ord").cast("bigint").alias("pos"),
        F.concat(_left(F.col("section"), 16), _right(F.col("n_modified").cast("string"), 15),
                 _pct_cell(_pct("n_modified", F.col("total")))).alias("line"))
    per_trial = sections_per_trial_from(patterns, total).select(
        F.lit(3).alias("block"), F.col("n_sections").alias("pos"),
        F.concat(_left(F.col("n_sections").cast("string"), 18), _right(F.col("n_trials").cast("string"), 13),
                 _pct_cell(F.col("pct_trials"))).alias("line"))
    summary = summary_from(patterns)

    def fixed(block, pos, text):
        return F.struct(F.lit(block).alias("block"), F.lit(pos).cast("bigint").alias("pos"),
                        (F.lit(text) if isinstance(text, str) else text).alias("line"))

    title = F.concat(F.lit(SECTION_REPORT_TITLE[0]), F.col("n_trials").cast("string"), F.lit(SECTION_REPORT_TITLE[1]))
    header_1 = "Section".ljust(16) + "Trials Modified".rjust(15) + "Percentage".rjust(13)
    header_2 = "Sections Modified".ljust(18) + "Trials".rjust(13) + "Percentage".rjust(13)
    mean = F.concat(F.lit("Mean: "), F.coalesce(F.format_number("mean_sections", 2), F.lit("nan")), F.lit(" sections"))
    median = F.concat(F.lit("Median: "), F.coalesce(F.format_number("median_sections", 1), F.lit("nan")),
                      F.lit(" sections"))
    frame = summary.select(F.inline(F.array(
        fixed(0, 0, title), fixed(0, 1, RULE_WIDE), fixed(0, 2, ""), fixed(0, 3, FREQUENCY_HEADING),
        fixed(0, 4, RULE), fixed(0, 5, header_1), fixed(0, 6, RULE),
        fixed(2, 0, RULE), fixed(2, 1, ""), fixed(2, 2, PER_TRIAL_HEADING), fixed(2, 3, RULE),
        fixed(2, 4, header_2), fixed(2, 5, RULE),
        fixed(4, 0, RULE), fixed(4, 1, ""), fixed(4, 2, mean), fixed(4, 3, median),
    )))
    return frame.unionByName(per_section).unionByName(per_trial)


def section_tables(trials: DataFrame) -> dict[str, DataFrame]:
    """S3-S6 and the report lines from one materialized pattern table (the
    analysis job's single pass over the trials)."""
    patterns = materialize(pattern_table(trials))
    total = pattern_total(patterns)
    return {
        "sections": section_counts_from(patterns),
        "patterns": pattern_counts_from(patterns, total),
        "modifications": section_modifications_from(patterns),
        "per_trial": sections_per_trial_from(patterns, total),
        "report_lines": section_report_lines_from(patterns, total),
    }
