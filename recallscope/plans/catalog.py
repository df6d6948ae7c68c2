"""Registered queries: one per operator of the inventory, each with its SQL twin.

Inputs are the driver's tables through the FIXTURES views:
``preds_v`` (lineitem x orders; flags play vendors, priorities play
conditions) for the metrics family, ``trials_v`` (documents x labels) for the
worklist and sections, and ``raw_v`` parsed (trials x the 15-cell grid) for
parsing, the report and the chart data. Queries that exercise sinks or
streams first land Spark-derived data below the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, FLAG_DESIGN, SECTION_REPORT_ROWS, SECTIONS, Design
from recallscope.functions import wald_ci
from recallscope.operators import bootstrap, compare, metrics, plotdata, report, scoring, sections, worklist
from recallscope.plans import oracle as O
from recallscope.session import fresh_path
from recallscope.sources import io, key_index, snapshots, views
from recallscope.sources.journal import write_journal

Query = Callable[[SparkSession, str], DataFrame]

# The log was interrupted after the third condition (the reference runs
# condition by condition), so resume has real work left.
DONE_CONDITIONS = DEFAULT_DESIGN.conditions[:3]
TOP_K = 5
BOOTSTRAP_REPLICATES = 50
# the streamed log is partitioned into this many key buckets
STREAM_KEY_BUCKETS = 4
LIMIT_N = 100
SUBSET_VENDORS = ("gemini", "anthropic")
SUBSET_CONDITIONS = ("title_only",)
# A design that lists fewer conditions in another order: the pivot keeps only
# these, in this order.
REORDER_DESIGN = Design(vendors=("R", "A"), conditions=("5-LOW", "1-URGENT", "3-MEDIUM"),
                        models=FLAG_DESIGN.models, baseline="1-URGENT", counterfactual="4-NOT SPECIFIED")


# --- inputs --------------------------------------------------------------------

def _preds(spark, sf):
    return views.preds_v(spark, sf)


def _metrics(spark, sf):
    return metrics.metrics_by_setting(_preds(spark, sf))


def _parsed(spark, sf):
    return scoring.parse_outputs(views.raw_v(spark, sf))


def _raw_metrics(spark, sf):
    return metrics.metrics_by_setting(_parsed(spark, sf))


def _trials(spark, sf):
    return views.trials_v(spark, sf)


def _log(spark, sf):
    """A prediction log holding the first three conditions."""
    return _parsed(spark, sf).where(F.col("condition").isin(*DONE_CONDITIONS))


def _work(spark, sf):
    return worklist.build_worklist(_trials(spark, sf))


LANDED_BYTES = 64 * 1024 * 1024  # of a landed file, uncompressed


def _land(df: DataFrame, path: str, batches: int, *by: str, times: int = 1) -> int:
    """Land ``df`` as files for a stream, ``times`` times over; returns the files per trigger that make ``batches``
    micro-batches of a landing. The number of files grows with the data, so that each stays small."""
    files = max(1, -(-worklist.text_bytes(df) // (batches * LANDED_BYTES)))
    for _ in range(times):
        df.repartition(batches * files, *by).write.mode("append").parquet(path)
    return files


# --- sources and sinks ---------------------------------------------------------

REFERENCE_TRIAL_COLUMNS = ("title", "abstract", "doi", "Annotation_accept", "counterfactual_title",
                           "counterfactual_abstract", "target_label", "sections_modified")


def q_scan_trials(spark, sf):
    """A trials CSV in the reference's dialect, keyed by row position.

    The sorted write range-partitions the trials, so part files follow key
    order and positions read back (files in path order) follow it too. Some
    identifiers are written as markers of a missing value.
    """
    path = fresh_path(spark, "trials-csv")
    marker = F.col("trial_idx") % 50
    t = _trials(spark, sf).withColumnRenamed("annotation_accept", "Annotation_accept").withColumn(
        "doi", F.when(marker == 7, "NA").when(marker == 8, "N/A").when(marker == 9, "").otherwise(F.col("doi")))
    (t.orderBy("trial_idx").select(*REFERENCE_TRIAL_COLUMNS)
     .write.options(**io.CSV_WRITE_OPTIONS).csv(path))
    return io.read_trials(spark, path, fmt="csv")


def q_scan_predictions(spark, sf):
    path = fresh_path(spark, "preds-csv")
    p = worklist.assemble_predictions(_parsed(spark, sf))
    p.write.options(**io.CSV_WRITE_OPTIONS).csv(path)
    return io.read_predictions(spark, path, fmt="csv")


def q_scan_metrics(spark, sf):
    path = fresh_path(spark, "metrics")
    _metrics(spark, sf).write.parquet(path)
    return io.read_metrics(spark, path)


def q_append_predictions(spark, sf):
    """C4: two appends (the first three conditions, then the rest)."""
    path = fresh_path(spark, "preds-log")
    p = worklist.assemble_predictions(_parsed(spark, sf))
    done = F.col("condition").isin(*DONE_CONDITIONS)
    io.append_predictions(p.where(done), path)
    io.append_predictions(p.where(~done), path)
    return io.read_predictions(spark, path)


def q_write_tables(spark, sf):
    path = fresh_path(spark, "tables")
    m = _metrics(spark, sf)
    io.write_tables({"metrics": m, "degradation": compare.degradation(m, FLAG_DESIGN)}, path,
                    order_by={"metrics": [FLAG_DESIGN.condition_ord(), FLAG_DESIGN.vendor_ord()]})
    return io.read_metrics(spark, f"{path}/metrics", fmt="csv")


def q_write_tables_snapshot(spark, sf):
    """C5 as versions: an earlier result set (of a part of the log), then the whole one; what is current is read."""
    path = fresh_path(spark, "snapshots")
    p = _preds(spark, sf)
    for log in (p.where("trial_idx % 2 = 0"), p):
        m = metrics.metrics_by_setting(log)
        now = snapshots.publish_tables(spark, {"metrics": m, "degradation": compare.degradation(m, FLAG_DESIGN)}, path,
                                       order_by={"metrics": [FLAG_DESIGN.condition_ord(), FLAG_DESIGN.vendor_ord()]})
    return now.table("metrics")


# --- worklist and scoring ------------------------------------------------------

def q_limit_trials(spark, sf):
    return worklist.limit_trials(_trials(spark, sf), LIMIT_N).select("trial_idx", "title", "annotation_accept")


def q_select_settings(spark, sf):
    w = worklist.build_worklist(_trials(spark, sf), vendors=SUBSET_VENDORS, conditions=SUBSET_CONDITIONS)
    return w.select("trial_idx", "condition", "vendor")


def q_build_worklist(spark, sf):
    return _work(spark, sf).select("trial_idx", "condition", "vendor", "doi")


def q_count_worklist(spark, sf):
    return worklist.count_worklist(_trials(spark, sf))


def q_route_fields(spark, sf):
    return worklist.route_fields(_work(spark, sf))


def q_build_prompt(spark, sf):
    return worklist.build_prompt(worklist.route_fields(_work(spark, sf)))


def q_completed_keys(spark, sf):
    return worklist.completed_keys(_log(spark, sf))


def q_pending_work(spark, sf):
    return worklist.pending_work(_work(spark, sf), _log(spark, sf)).select("trial_idx", "condition", "vendor")


def q_remaining_count(spark, sf):
    return worklist.remaining_count(_work(spark, sf), _log(spark, sf))


def _indexed_log(spark, sf):
    """The same log written in two appends, its index brought up to date after each."""
    path = fresh_path(spark, "indexed-log")
    log = worklist.assemble_predictions(_log(spark, sf))
    for part in (F.col("trial_idx") % 3 == 0, F.col("trial_idx") % 3 != 0):
        io.append_predictions(log.where(part), path)
        index = key_index.refresh(spark, path)
    return index


def q_pending_work_index(spark, sf):
    """W8 from the resume index: no log file is opened for it."""
    return key_index.pending_by_index(_work(spark, sf), _indexed_log(spark, sf)).select("trial_idx", "condition", "vendor")


def q_remaining_count_index(spark, sf):
    """W9 from the index's cardinalities."""
    return key_index.remaining_by_index(_trials(spark, sf), _indexed_log(spark, sf))


def q_attach_model(spark, sf):
    return worklist.attach_model(_work(spark, sf).select("trial_idx", "condition", "vendor"))


def _rerun_log(spark, sf):
    """The parsed log plus a second, failed run of the first three
    conditions (every call of it an ERROR row): keys now repeat."""
    p = worklist.assemble_predictions(_parsed(spark, sf))
    failed = (p.where(F.col("condition").isin(*DONE_CONDITIONS))
              .withColumn("raw_output", F.lit(None).cast("string"))
              .withColumn("parsed_output", F.lit("ERROR")))
    return p.unionByName(failed)


def q_dedupe_predictions(spark, sf):
    return worklist.dedupe_predictions(_rerun_log(spark, sf))


def q_score_batch(spark, sf):
    todo = scoring.prompts_for(_work(spark, sf))
    return worklist.assemble_predictions(scoring.score(todo, scoring.byte_length_scorer))


def q_parse_output(spark, sf):
    return _parsed(spark, sf)


def q_assemble_predictions(spark, sf):
    return worklist.assemble_predictions(_parsed(spark, sf))


def q_run_scoring(spark, sf):
    """W14 three times on one target: three conditions, then all (resume),
    then all again (no-op). The table must hold every key exactly once."""
    path = fresh_path(spark, "scoring")
    t = _trials(spark, sf)
    scoring.run_scoring(spark, t, path, scoring.byte_length_scorer, conditions=DONE_CONDITIONS)
    scoring.run_scoring(spark, t, path, scoring.byte_length_scorer)
    scoring.run_scoring(spark, t, path, scoring.byte_length_scorer)
    return io.read_predictions(spark, path)


def q_run_scoring_journal(spark, sf):
    """W14 after a job that was lost before its log was written: the journal holds the answers to
    three conditions; the run moves them into the log and asks for the rest."""
    path = fresh_path(spark, "scoring-journal")
    t = _trials(spark, sf)
    work = worklist.build_worklist(t, conditions=DONE_CONDITIONS)
    write_journal(scoring.prompts_for(work), f"{path}-journal", scoring.byte_length_scorer,
                  DEFAULT_DESIGN.system_prompt, flush_answers=1000)
    scoring.run_scoring(spark, t, path, scoring.byte_length_scorer, journal=f"{path}-journal", flush_answers=1000)
    return io.read_predictions(spark, path)


def q_stream_scoring(spark, sf):
    from recallscope.streaming import stream_scoring

    landing = fresh_path(spark, "trials-landing")
    files = _land(_trials(spark, sf), landing, 3)
    target = fresh_path(spark, "stream-scoring")
    stream_scoring(spark, landing, target, scoring.byte_length_scorer, max_files_per_trigger=files,
                   key_buckets=STREAM_KEY_BUCKETS)
    return io.read_predictions(spark, target)


def q_stream_scoring_state(spark, sf):
    """W15 with keyed state: a log that a batch job began is the initial state; the stream adds the rest
    (every trial file arrives twice, in a later micro-batch, and adds nothing)."""
    from recallscope.streaming import stream_scoring

    landing = fresh_path(spark, "trials-landing-state")
    t = _trials(spark, sf)
    files = _land(t, landing, 2, "trial_idx", times=2)
    target = fresh_path(spark, "stream-scoring-state")
    scoring.run_scoring(spark, t, target, scoring.byte_length_scorer, conditions=DONE_CONDITIONS,
                        key_buckets=STREAM_KEY_BUCKETS)
    stream_scoring(spark, landing, target, scoring.byte_length_scorer, max_files_per_trigger=2 * files,
                   key_buckets=STREAM_KEY_BUCKETS, seen="state")
    return io.read_predictions(spark, target)


# --- metrics -------------------------------------------------------------------

def q_distinct_settings(spark, sf):
    return metrics.distinct_settings(_preds(spark, sf))


def q_status_counts(spark, sf):
    return metrics.status_counts(_preds(spark, sf))


def q_valid_rate(spark, sf):
    return metrics.valid_rate(metrics.status_counts(_preds(spark, sf)))


def q_valid_pairs(spark, sf):
    return metrics.valid_pairs(_preds(spark, sf))


def q_confusion_counts(spark, sf):
    return metrics.confusion_counts(_preds(spark, sf))


def _score_col(name):
    def run(spark, sf):
        s = metrics.with_scores(metrics.confusion_counts(_preds(spark, sf)))
        return s.select("vendor", "condition", name)
    return run


def q_metrics_by_setting(spark, sf):
    return _metrics(spark, sf)


def q_wald_ci(spark, sf):
    s = metrics.with_scores(metrics.confusion_counts(_preds(spark, sf)))
    ci = wald_ci(F.col("accuracy"), F.col("n_pairs"))
    return s.select("vendor", "condition", "accuracy", ci["lower"].alias("lower"), ci["upper"].alias("upper"))


def q_metric_intervals(spark, sf):
    return metrics.metric_intervals(metrics.with_scores(metrics.confusion_counts(_preds(spark, sf))))


def q_bootstrap_intervals(spark, sf):
    """M12 by resampling trials: 50 replicates, whose weights are a hash of the trial key."""
    return bootstrap.bootstrap_intervals(_preds(spark, sf), replicates=BOOTSTRAP_REPLICATES)


def q_format_ci(spark, sf):
    return report.format_ci_table(_preds(spark, sf))


def q_stream_metrics(spark, sf):
    from recallscope.streaming import run_stream_metrics

    landing = fresh_path(spark, "preds-landing")
    files = _land(worklist.assemble_predictions(
        _preds(spark, sf).withColumn("raw_output", F.lit(None).cast("string"))), landing, 4)
    out = fresh_path(spark, "stream-metrics")
    run_stream_metrics(spark, landing, out, max_files_per_trigger=2 * files)
    return io.read_metrics(spark, out)


def q_stream_metrics_deduped(spark, sf):
    """M14 over a log with repeated keys: the failed rerun of three conditions lies in the landing files
    before, between and after the good answers."""
    from recallscope.streaming import run_stream_metrics_deduped

    landing = fresh_path(spark, "preds-landing-deduped")
    files = _land(_rerun_log(spark, sf), landing, 4)
    out = fresh_path(spark, "stream-metrics-deduped")
    run_stream_metrics_deduped(spark, landing, out, max_files_per_trigger=2 * files)
    return snapshots.Snapshot(spark, out).table("metrics")


def q_stream_report(spark, sf):
    """The whole analysis kept current by a stream over landing prediction
    files; the report table it wrote is read back."""
    from recallscope.streaming import run_stream_analysis

    landing = fresh_path(spark, "preds-landing-analysis")
    files = _land(worklist.assemble_predictions(
        _preds(spark, sf).withColumn("raw_output", F.lit(None).cast("string"))), landing, 4)
    out = fresh_path(spark, "stream-analysis")
    run_stream_analysis(spark, landing, out, design=FLAG_DESIGN, max_files_per_trigger=2 * files)
    schema = ", ".join(f"`{c}` string" for c in report.REPORT_COLUMNS)
    return spark.read.schema(schema).options(**io.CSV_WRITE_OPTIONS).csv(f"{out}/table_manuscript")


# --- comparisons ---------------------------------------------------------------

def q_f1_pivot(spark, sf):
    return compare.f1_pivot(_metrics(spark, sf), FLAG_DESIGN)


def q_pivot_reorder(spark, sf):
    return compare.f1_pivot(_metrics(spark, sf), REORDER_DESIGN)


def q_f1_pivot_mean(spark, sf):
    return compare.f1_pivot_mean(_metrics(spark, sf))


def q_top_f1(spark, sf):
    return compare.top_f1(_metrics(spark, sf), TOP_K, FLAG_DESIGN)


def q_top_f1_undefined(spark, sf):
    """R4 with more places than settings, two of which have no valid answer."""
    p = _preds(spark, sf)
    dead = (F.col("condition") == FLAG_DESIGN.conditions[1]) & F.col("vendor").isin("A", "R")
    p = p.withColumn("parsed_output", F.when(dead, "INVALID").otherwise(F.col("parsed_output")))
    return compare.top_f1(metrics.metrics_by_setting(p), 20, FLAG_DESIGN)


def q_degradation(spark, sf):
    return compare.degradation(_metrics(spark, sf), FLAG_DESIGN)


def q_counterfactual_metrics(spark, sf):
    return compare.counterfactual_metrics(_metrics(spark, sf), FLAG_DESIGN)


def q_baseline_vs_counterfactual(spark, sf):
    return compare.baseline_vs_counterfactual(_metrics(spark, sf), FLAG_DESIGN)


def q_report_table(spark, sf):
    return report.report_table(_parsed(spark, sf), DEFAULT_DESIGN)


def q_report_table_log(spark, sf):
    return report.report_table(_preds(spark, sf), FLAG_DESIGN)


def q_report_text(spark, sf):
    """R8 rendered as the reference's fixed-width text (one row per line)."""
    return report.report_lines(_parsed(spark, sf), DEFAULT_DESIGN)


# --- sections ------------------------------------------------------------------

def q_parse_sections(spark, sf):
    s = sections.with_sections(_trials(spark, sf))
    return s.select("trial_idx", F.size("sections").cast("bigint").alias("n_sections"),
                    F.array_join("sections", "|").alias("sections_text"))


def q_section_counts_raw(spark, sf):
    return sections.section_counts_raw(_trials(spark, sf))


def q_section_counts(spark, sf):
    return sections.section_counts(_trials(spark, sf))


def q_pattern_counts(spark, sf):
    return sections.pattern_counts(_trials(spark, sf))


def q_section_modifications(spark, sf):
    return sections.section_modifications(_trials(spark, sf))


def q_sections_per_trial(spark, sf):
    return sections.sections_per_trial(_trials(spark, sf))


def q_sections_per_trial_summary(spark, sf):
    return sections.sections_per_trial_summary(_trials(spark, sf))


def q_section_report_text(spark, sf):
    """S5 + S6 rendered as the section report text (one row per line)."""
    return sections.section_report_lines(_trials(spark, sf))


# --- chart data ----------------------------------------------------------------

def q_display_names(spark, sf):
    return plotdata.display_names(_raw_metrics(spark, sf))


def q_grid_f1(spark, sf):
    return plotdata.grid_f1(_raw_metrics(spark, sf))


def q_series_degradation(spark, sf):
    return plotdata.series_degradation(_raw_metrics(spark, sf))


def q_heatmap_pivot(spark, sf):
    return plotdata.heatmap_pivot(_raw_metrics(spark, sf))


def q_grid_valid_rate(spark, sf):
    return plotdata.grid_valid_rate(_raw_metrics(spark, sf))


def q_panels_confusion(spark, sf):
    return plotdata.panels_confusion(_parsed(spark, sf))


def q_grid_counterfactual(spark, sf):
    return plotdata.grid_counterfactual(_raw_metrics(spark, sf))


def q_panels_confusion_cf(spark, sf):
    return plotdata.panels_confusion_cf(_parsed(spark, sf))


def q_grid_counterfactual_only(spark, sf):
    return plotdata.grid_counterfactual_only(_raw_metrics(spark, sf))


# ===============================================================================
# SQL twins
# ===============================================================================

def _sql_metrics_base(src_ctes, src_name):
    return O.with_(*src_ctes, O.metrics_cte(src_name))


def _sql_preds_metrics():
    return _sql_metrics_base(O.BASE_PREDS, "preds_v")


def _sql_raw_metrics():
    return _sql_metrics_base(O.BASE_RAW, "parsed_v")


PRED_COLS = "trial_idx, vendor, model, condition, raw_output, parsed_output, ground_truth"


def _sql_scored_counts(src_ctes, src_name):
    return O.with_(*src_ctes, O.counts_cte(src_name), O.scored_cte())


def _interval_cols():
    cols = []
    for m, size in O.INTERVAL_SIZES.items():
        lo, hi = O.wald_sql(m, size)
        cols += [m, f"{lo} as {m}_lower", f"{hi} as {m}_upper"]
    return ", ".join(cols)


def _format_cols():
    return ", ".join(f"{O.format_ci_sql(m, size)} as {m}_ci" for m, size in O.INTERVAL_SIZES.items())


def _pivot_sql(design: Design, present) -> str:
    return _sql_preds_metrics() + O.f1_pivot_sql(design, present)


def _sections_sql(known, labels, names=("section", "n_modified", "pct_modified")) -> str:
    lst = O.sections_list_sql()
    parts = []
    for i, (name, label) in enumerate(zip(known, labels)):
        parts.append(f"""select {i} as ord, {O.q(label)} as {O.ident(names[0])},
  cast(coalesce(sum(len(list_filter({lst}, lambda x: x = {O.q(name)}))), 0) as bigint) as {O.ident(names[1])},
  cast(coalesce(sum(len(list_filter({lst}, lambda x: x = {O.q(name)}))), 0) as double) / cast(count(*) as double)
    * cast(100.0 as double) as {O.ident(names[2])}
from trials_v""")
    return (O.with_(*O.BASE_TRIALS) + "select " + ", ".join(O.ident(n) for n in names)
            + " from (\n" + "\nunion all\n".join(parts) + ")")


def _grid_sql(value, fill, conditions=None, design=DEFAULT_DESIGN):
    return _sql_raw_metrics() + O.fill_grid_sql(design, value, fill, conditions=conditions)


def _cf_grid_sql(conditions, design=DEFAULT_DESIGN):
    return (_sql_raw_metrics() + "select *, coalesce(f1_macro > 0, false) as show_label from (\n"
            + O.fill_grid_sql(design, "f1_macro", 0.0, conditions=conditions)
            + f"\n) where exists (select 1 from metrics where condition = {O.q(design.counterfactual)})")


def _panels_sql(conditions, only_if_cf=False, design=DEFAULT_DESIGN):
    s = _sql_scored_counts(O.BASE_RAW, "parsed_v") + O.panels_sql(design, conditions, "parsed_v")
    if only_if_cf:
        s = (_sql_scored_counts(O.BASE_RAW, "parsed_v") + "select * from (\n"
             + O.panels_sql(design, conditions, "parsed_v")
             + f"\n) where exists (select 1 from parsed_v where condition = {O.q(design.counterfactual)})")
    return s


def _heatmap_sql(design=DEFAULT_DESIGN):
    cols = ", ".join(
        f"max(case when condition = {O.q(c)} then f1_macro end) as {O.ident(design.heatmap_condition_labels.get(c, c))}"
        for c in design.conditions)
    return (_sql_raw_metrics() + f"select {O.vendor_display_sql(design)} as vendor, {cols} from metrics "
            f"where vendor in {O.in_list(design.vendors)} "
            f"and vendor in (select vendor from metrics where f1_macro is not null) group by vendor")


def _pending_sql():
    return (O.with_(*O.BASE_RAW, O.work_cte(), _log_cte())
            + "select trial_idx, condition, vendor from work w where not exists (select 1 from log l "
              "where l.trial_idx = w.trial_idx and l.vendor = w.vendor and l.condition = w.condition)")


def _scan_trials_sql():
    return (O.with_(*O.BASE_TRIALS)
            + """select cast(row_number() over (order by trial_idx) - 1 as bigint) as trial_idx, nullif(title, '') as title,
  nullif(abstract, '') as abstract, annotation_accept,
  case when trial_idx % 50 not in (7, 8, 9) then doi end as doi, counterfactual_title, counterfactual_abstract, target_label, sections_modified
from trials_v""")


def _work_sql(select: str, design=DEFAULT_DESIGN, vendors=None, conditions=None) -> str:
    return O.with_(*O.BASE_TRIALS, O.work_cte(design, vendors, conditions)) + select


def _log_cte():
    return f"log as (select * from parsed_v where condition in {O.in_list(DONE_CONDITIONS)})"


def _remaining_sql():
    return (O.with_(*O.BASE_RAW, O.work_cte(), _log_cte())
            + """select (select count(*) from work) as total_calls,
  (select count(*) from (select distinct trial_idx, vendor, condition from log)) as n_completed,
  (select count(*) from work w where not exists (select 1 from log l where l.trial_idx = w.trial_idx
     and l.vendor = w.vendor and l.condition = w.condition)) as remaining,
  (select count(*) from work) - (select count(*) from (select distinct trial_idx, vendor, condition from log))
     as remaining_naive""")


def _bootstrap_sql(replicates: int = BOOTSTRAP_REPLICATES, seed: int = bootstrap.SEED, level: float = 0.95):
    """The weights written out: a 32-bit scrambling of the key, then of key and replicate, held against
    the cumulated Poisson probabilities."""
    def mixed(name, source, value):
        return (f"{name}_a as (select *, xor({value}, ({value}) >> 16) as a1 from {source}),\n"
                f"{name}_b as (select * exclude a1, (a1 * 569420461) % 4294967296 as b1 from {name}_a),\n"
                f"{name}_c as (select * exclude b1, (xor(b1, b1 >> 15) * 1935289751) % 4294967296 as c1 from {name}_b),\n"
                f"{name} as (select * exclude c1, xor(c1, c1 >> 15) as {name}_h from {name}_c)")

    cumulated = bootstrap.POISSON
    weight = " + ".join(f"case when drawn_h >= {p} then 1 else 0 end" for p in cumulated)
    cells = {"tp": ("POSITIVE", "POSITIVE"), "fn": ("POSITIVE", "NEGATIVE"), "fp": ("NEGATIVE", "POSITIVE"),
             "tn": ("NEGATIVE", "NEGATIVE")}
    sums = ", ".join(f"cast(sum(case when ground_truth = '{t}' and parsed_output = '{p}' then w else 0 end) as bigint) as {c}"
                     for c, (t, p) in cells.items())
    names = ("accuracy", "f1_macro", "sensitivity", "specificity")
    low, high = (1 - level) / 2, (1 + level) / 2
    at = lambda m, share: (f"list_sort(list({m}) filter (where {m} is not null))"  # noqa: E731
                           f"[greatest(1, cast(ceil(count({m}) * cast({share!r} as double)) as bigint))]")
    bounds = ", ".join(f"{at(m, low)} as {m}_lower, {at(m, high)} as {m}_upper" for m in names)
    return (O.with_(*O.BASE_PREDS, O.counts_cte("preds_v"), O.scored_cte(),
                    "pairs as (select trial_idx, vendor, condition, ground_truth, parsed_output, trial_idx & 4294967295 as lo, "
                    "(trial_idx >> 32) & 4294967295 as hi from preds_v where vendor is not null and condition is not null "
                    "and parsed_output in ('POSITIVE','NEGATIVE') and ground_truth in ('POSITIVE','NEGATIVE'))",
                    mixed("one", "pairs", f"xor(lo, cast({seed} as bigint))"), mixed("own", "one", "xor(one_h, hi)"),
                    f"resampled as (select vendor, condition, ground_truth, parsed_output, r, "
                    f"(own_h + (r + 1) * 2654435769 % 4294967296) % 4294967296 as x "
                    f"from own, (select unnest(range({replicates})) as r))",
                    mixed("drawn", "resampled", "x"),
                    f"draws as (select vendor, condition, r, {sums} from (select *, {weight} as w from drawn) group by vendor, condition, r)",
                    f"replicates as (select vendor, condition, {', '.join(names)} from (select *, {O.score_exprs()} from "
                    f"(select *, 1 as n_valid, 1 as n_total from draws)))",
                    f"bounds as (select vendor, condition, {bounds} from replicates group by vendor, condition)")
            + "select s.vendor, s.condition, s.n_pairs, " + ", ".join(f"s.{m}, b.{m}_lower, b.{m}_upper" for m in names)
            + " from scored s left join bounds b on b.vendor = s.vendor and b.condition = s.condition")


def _dedupe_parts():
    """The rerun log as a CTE, and the select of the rows it keeps."""
    rank = ("case when parsed_output in ('POSITIVE','NEGATIVE') then 0 when parsed_output = 'INVALID' then 1 "
            "when parsed_output = 'ERROR' then 2 else 3 end")
    ties = ", ".join(f"{c} is null, {c}" for c in ("model", "raw_output", "ground_truth", "parsed_output"))
    log = (f"log as (select {PRED_COLS} from parsed_v union all select trial_idx, vendor, model, condition, "
           f"cast(null as varchar) as raw_output, 'ERROR' as parsed_output, ground_truth from parsed_v "
           f"where condition in {O.in_list(DONE_CONDITIONS)})")
    return log, f"""select {PRED_COLS} from (
  select *, row_number() over (partition by trial_idx, vendor, condition order by {rank}, {ties}) as rn from log)
where rn = 1"""


def _dedupe_sql():
    log, kept = _dedupe_parts()
    return O.with_(*O.BASE_RAW, log) + kept


def _deduped_metrics_sql():
    """Metrics of the de-duplicated rerun log."""
    log, kept = _dedupe_parts()
    return O.with_(*O.BASE_RAW, log, f"kept as ({kept})", O.metrics_cte("kept")) + f"select {O.METRIC_SELECT} from metrics"


def _prompt_select():
    return f"select trial_idx, vendor, condition, {O.prompt_sql()} as prompt, ground_truth from ({O.routed_sql()})"


def _stream_metrics_sql():
    return _sql_preds_metrics() + f"select {O.METRIC_SELECT} from metrics"


_MODEL_CASE = O.case_map("vendor", DEFAULT_DESIGN.models)

REGISTRY: dict[str, tuple[Query, str | None]] = {
    # sources / sinks
    "scan_trials": (q_scan_trials, _scan_trials_sql()),
    "scan_predictions": (q_scan_predictions, O.with_(*O.BASE_RAW) + "select trial_idx, vendor, model, condition, "
                         "nullif(raw_output, '') as raw_output, parsed_output, ground_truth from parsed_v"),
    "scan_metrics": (q_scan_metrics, _sql_preds_metrics() + f"select {O.METRIC_SELECT} from metrics"),
    "append_predictions": (q_append_predictions, O.with_(*O.BASE_RAW) + f"select {PRED_COLS} from parsed_v"),
    "write_tables": (q_write_tables, _sql_preds_metrics() + f"select {O.METRIC_SELECT} from metrics"),
    "write_tables_snapshot": (q_write_tables_snapshot, _sql_preds_metrics() + f"select {O.METRIC_SELECT} from metrics"),
    # worklist / scoring
    "limit_trials": (q_limit_trials, O.with_(*O.BASE_TRIALS)
                     + f"select trial_idx, title, annotation_accept from trials_v order by trial_idx limit {LIMIT_N}"),
    "select_settings": (q_select_settings, _work_sql("select trial_idx, condition, vendor from work",
                                                     vendors=SUBSET_VENDORS, conditions=SUBSET_CONDITIONS)),
    "build_worklist": (q_build_worklist, _work_sql("select trial_idx, condition, vendor, doi from work")),
    "count_worklist": (q_count_worklist, O.with_(*O.BASE_TRIALS)
                       + "select count(*) as n_trials, cast(3 as bigint) as n_vendors, cast(5 as bigint) as n_conditions, "
                         "count(*) * 15 as total_calls from trials_v"),
    "route_fields": (q_route_fields, _work_sql(O.routed_sql())),
    "build_prompt": (q_build_prompt, _work_sql(_prompt_select())),
    "completed_keys": (q_completed_keys, O.with_(*O.BASE_RAW, _log_cte())
                       + "select distinct trial_idx, vendor, condition from log"),
    "pending_work": (q_pending_work, _pending_sql()),
    "pending_work_index": (q_pending_work_index, _pending_sql()),
    "remaining_count": (q_remaining_count, _remaining_sql()),
    "remaining_count_index": (q_remaining_count_index, _remaining_sql()),
    "attach_model": (q_attach_model, _work_sql(f"select trial_idx, condition, vendor, {_MODEL_CASE} as model from work")),
    "dedupe_predictions": (q_dedupe_predictions, _dedupe_sql()),
    "score_batch": (q_score_batch, O.scored_predictions_sql()),
    "parse_output": (q_parse_output, O.with_(*O.BASE_RAW)
                     + "select trial_idx, vendor, model, condition, ground_truth, raw_output, parsed_output from parsed_v"),
    "assemble_predictions": (q_assemble_predictions, O.with_(*O.BASE_RAW) + f"select {PRED_COLS} from parsed_v"),
    "run_scoring": (q_run_scoring, O.scored_predictions_sql()),
    "stream_scoring_state": (q_stream_scoring_state, O.scored_predictions_sql()),
    "run_scoring_journal": (q_run_scoring_journal, O.scored_predictions_sql()),
    "stream_scoring": (q_stream_scoring, O.scored_predictions_sql()),
    # metrics
    "distinct_settings": (q_distinct_settings, O.with_(*O.BASE_PREDS)
                          + "select distinct vendor, model, condition from preds_v"),
    "status_counts": (q_status_counts, _sql_scored_counts(O.BASE_PREDS, "preds_v")
                      + "select vendor, condition, n_total, n_valid, n_invalid, n_error from counts"),
    "valid_rate": (q_valid_rate, _sql_scored_counts(O.BASE_PREDS, "preds_v")
                   + "select vendor, condition, pct_valid from scored"),
    "valid_pairs": (q_valid_pairs, O.with_(*O.BASE_PREDS)
                    + "select * from preds_v where vendor is not null and condition is not null "
                      "and parsed_output in ('POSITIVE','NEGATIVE') and ground_truth in ('POSITIVE','NEGATIVE')"),
    "confusion_counts": (q_confusion_counts, _sql_scored_counts(O.BASE_PREDS, "preds_v")
                         + "select vendor, condition, tp, fn, fp, tn from counts"),
    "accuracy": (_score_col("accuracy"), _sql_scored_counts(O.BASE_PREDS, "preds_v")
                 + "select vendor, condition, accuracy from scored"),
    "f1_macro": (_score_col("f1_macro"), _sql_scored_counts(O.BASE_PREDS, "preds_v")
                 + "select vendor, condition, f1_macro from scored"),
    "sensitivity": (_score_col("sensitivity"), _sql_scored_counts(O.BASE_PREDS, "preds_v")
                    + "select vendor, condition, sensitivity from scored"),
    "specificity": (_score_col("specificity"), _sql_scored_counts(O.BASE_PREDS, "preds_v")
                    + "select vendor, condition, specificity from scored"),
    "metrics_by_setting": (q_metrics_by_setting, _sql_preds_metrics() + f"select {O.METRIC_SELECT} from metrics"),
    "wald_ci": (q_wald_ci, _sql_scored_counts(O.BASE_PREDS, "preds_v")
                + "select vendor, condition, accuracy, {} as lower, {} as upper from scored".format(
                    *O.wald_sql("accuracy", "n_pairs"))),
    "metric_intervals": (q_metric_intervals, _sql_scored_counts(O.BASE_PREDS, "preds_v")
                         + f"select vendor, condition, {_interval_cols()} from scored"),
    "bootstrap_intervals": (q_bootstrap_intervals, _bootstrap_sql()),
    "format_ci": (q_format_ci, _sql_scored_counts(O.BASE_PREDS, "preds_v")
                  + f"select vendor, condition, {_format_cols()} from scored"),
    "stream_metrics": (q_stream_metrics, _stream_metrics_sql()),
    "stream_metrics_deduped": (q_stream_metrics_deduped, _deduped_metrics_sql()),
    "stream_report": (q_stream_report, O.report_sql(FLAG_DESIGN, O.BASE_PREDS)),
    # comparisons
    "f1_pivot": (q_f1_pivot, _pivot_sql(FLAG_DESIGN, FLAG_DESIGN.conditions)),
    "pivot_reorder": (q_pivot_reorder, _pivot_sql(REORDER_DESIGN, REORDER_DESIGN.conditions)),
    "f1_pivot_mean": (q_f1_pivot_mean, _sql_preds_metrics() + "select vendor, " + ", ".join(
        f"avg(case when condition = {O.q(c)} then f1_macro end) as {O.ident(c)}" for c in sorted(FLAG_DESIGN.conditions))
        + " from metrics where f1_macro is not null group by vendor"),
    "top_f1": (q_top_f1, _sql_preds_metrics() + O.top_f1_sql(FLAG_DESIGN, TOP_K)),
    "top_f1_undefined": (q_top_f1_undefined, O.with_(O.PREDS_V, """dead_v as (
  select * replace (case when condition = '2-HIGH' and vendor in ('A', 'R') then 'INVALID' else parsed_output end
    as parsed_output) from preds_v)""", O.metrics_cte("dead_v")) + O.top_f1_sql(FLAG_DESIGN, 20)),
    "degradation": (q_degradation, _sql_preds_metrics() + O.degradation_sql(FLAG_DESIGN)),
    "counterfactual_metrics": (q_counterfactual_metrics, _sql_preds_metrics()
                               + f"select {O.METRIC_SELECT} from metrics where condition = "
                                 f"{O.q(FLAG_DESIGN.counterfactual)}"),
    "baseline_vs_counterfactual": (q_baseline_vs_counterfactual, _sql_preds_metrics()
                                   + O.compare_sql(FLAG_DESIGN.baseline, FLAG_DESIGN.counterfactual)),
    "report_table": (q_report_table, O.report_sql(DEFAULT_DESIGN, O.BASE_RAW)),
    "report_table_log": (q_report_table_log, O.report_sql(FLAG_DESIGN, O.BASE_PREDS)),
    "report_text": (q_report_text, O.report_lines_sql(DEFAULT_DESIGN, O.BASE_RAW)),
    # sections
    "parse_sections": (q_parse_sections, O.with_(*O.BASE_TRIALS)
                       + f"select trial_idx, len({O.sections_list_sql()}) as n_sections, "
                         f"array_to_string({O.sections_list_sql()}, '|') as sections_text from trials_v"),
    "section_counts_raw": (q_section_counts_raw, O.with_(*O.BASE_TRIALS)
                           + f"select section, count(*) as n_modified from (select unnest({O.sections_list_sql()}) "
                             "as section from trials_v) group by section"),
    "section_counts": (q_section_counts, _sections_sql(SECTIONS, SECTIONS)),
    "pattern_counts": (q_pattern_counts, O.with_(*O.BASE_TRIALS)
                       + "select sections_modified as pattern, count(*) as n_trials, cast(count(*) as double) / "
                         "cast((select count(*) from trials_v) as double) * cast(100.0 as double) as pct_trials "
                         "from trials_v group by sections_modified"),
    "section_modifications": (q_section_modifications, _sections_sql(
        [s.lower() for s in SECTION_REPORT_ROWS], SECTION_REPORT_ROWS,
        ("Section", "Trials Modified", "Percentage (%)"))),
    "sections_per_trial": (q_sections_per_trial, O.with_(*O.BASE_TRIALS)
                           + f"select n_sections, count(*) as n_trials, cast(count(*) as double) / "
                             "cast((select count(*) from trials_v) as double) * cast(100.0 as double) as pct_trials "
                             f"from (select cast(len({O.sections_list_sql()}) as bigint) as n_sections from trials_v) "
                             "group by n_sections"),
    "sections_per_trial_summary": (q_sections_per_trial_summary, O.with_(*O.BASE_TRIALS)
                                   + "select count(*) as n_trials, avg(n) as mean_sections, "
                                     "cast(median(n) as double) as median_sections from "
                                     f"(select len({O.sections_list_sql()}) as n from trials_v)"),
    "section_report_text": (q_section_report_text, O.section_report_lines_sql(SECTION_REPORT_ROWS)),
    # chart data
    "display_names": (q_display_names, _sql_raw_metrics() + f"select {O.METRIC_SELECT}, "
                      f"{O.vendor_display_sql(DEFAULT_DESIGN)} as vendor_display, "
                      f"coalesce({O.case_map('condition', DEFAULT_DESIGN.plot_condition_labels)}, condition) "
                      "as condition_display from metrics"),
    "grid_f1": (q_grid_f1, _grid_sql("f1_macro", 0.0)),
    "series_degradation": (q_series_degradation, _grid_sql("f1_macro", None, DEFAULT_DESIGN.degradation_series)),
    "heatmap_pivot": (q_heatmap_pivot, _heatmap_sql()),
    "grid_valid_rate": (q_grid_valid_rate, _grid_sql("pct_valid", 0.0)),
    "panels_confusion": (q_panels_confusion, _panels_sql(DEFAULT_DESIGN.conditions)),
    "grid_counterfactual": (q_grid_counterfactual, _cf_grid_sql(DEFAULT_DESIGN.counterfactual_series)),
    "panels_confusion_cf": (q_panels_confusion_cf, _panels_sql(DEFAULT_DESIGN.rewritten_conditions, only_if_cf=True)),
    "grid_counterfactual_only": (q_grid_counterfactual_only, _cf_grid_sql(DEFAULT_DESIGN.rewritten_conditions)),
}


def queries() -> dict[str, Query]:
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql is not None}
