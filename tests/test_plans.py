"""Plan shapes behind the scale claims: no pair-producing joins, no per-row
Python, pruned scans, map-side combine before every shuffle of the log."""

import pytest
from pyspark.sql import functions as F

from recallscope.operators import compare, metrics, plotdata, sections, worklist
from recallscope.plans import catalog
from recallscope.session import fresh_path
from recallscope.sources import io, views
from tests.conftest import SF001

QUERIES = catalog.queries()
PAIR_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")
ROW_PYTHON = ("BatchEvalPython",)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def relations(df) -> int:
    """Base tables in the optimized plan."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.fixture
def no_broadcast(spark):
    """Plan as for tables too large to broadcast (what a cluster sees)."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pair_joins_or_row_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF001))
    assert not [p for p in PAIR_JOINS + ROW_PYTHON if p in plan], plan


def test_metrics_scan_is_pruned_and_combined_map_side(spark, no_broadcast):
    plan = plan_of(metrics.metrics_by_setting(views.preds_v(spark, SF001)))
    assert ("ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double,"
            "l_returnflag:string>") in plan
    lines = plan.splitlines()
    partial = [i for i, ln in enumerate(lines) if "partial_count" in ln]
    exchanges = [i for i, ln in enumerate(lines) if "Exchange hashpartitioning(vendor" in ln]
    # the settings shuffle sits above a partial aggregate (tree lines grow downwards)
    assert partial and exchanges and min(exchanges) < min(partial)


def test_resume_dedupes_log_keys_before_the_shuffle(spark, no_broadcast):
    path = fresh_path(spark, "t-plan-log")
    io.append_predictions(worklist.assemble_predictions(views.raw_v(spark, SF001).withColumn(
        "parsed_output", F.lit("POSITIVE"))).where(F.col("condition") == "baseline"), path)
    work = worklist.build_worklist(views.trials_v(spark, SF001))
    plan = plan_of(worklist.pending_work(work, io.read_predictions(spark, path)))
    assert "LeftAnti" in plan
    lines = plan.splitlines()
    scan = next(i for i, ln in enumerate(lines) if "FileScan parquet" in ln and "t-plan-log" in ln)
    above = lines[:scan]
    agg = max(i for i, ln in enumerate(above) if "HashAggregate(keys=[trial_idx" in ln)
    exch = max(i for i, ln in enumerate(above) if "Exchange hashpartitioning(trial_idx" in ln)
    assert exch < agg < scan  # scan -> partial distinct -> exchange -> final distinct -> join


def test_worklist_is_a_generator_not_a_join(spark):
    plan = plan_of(worklist.build_worklist(views.trials_v(spark, SF001)))
    assert "Generate inline" in plan
    assert plan.count("Join") == 1  # only documents x labels of the view itself


def test_top_k_is_take_ordered(spark):
    m = metrics.metrics_by_setting(views.preds_v(spark, SF001))
    assert "TakeOrderedAndProject" in plan_of(compare.top_f1(m, 5))


def test_positions_stay_in_the_jvm(spark):
    path = fresh_path(spark, "t-plan-csv")
    views.trials_v(spark, SF001).drop("trial_idx").write.options(**io.CSV_WRITE_OPTIONS).csv(path)
    t = io.read_trials(spark, path, fmt="csv")
    plan = plan_of(t)
    assert "Python" not in plan
    assert t.select("trial_idx").distinct().count() == t.count()


@pytest.mark.parametrize("build", [plotdata.grid_counterfactual, plotdata.panels_confusion_cf, plotdata.grid_counterfactual_only,
                                   compare.f1_pivot_mean, sections.pattern_counts, sections.sections_per_trial,
                                   sections.section_report_lines, "remaining"])
def test_base_tables_are_planned_once(spark, build, monkeypatch):
    """Every execution of such a query, its inner ones included, reads a base table once
    at most: what is needed twice is materialized."""
    import recallscope.session as session

    seen = []
    for module in (compare, plotdata, sections):
        monkeypatch.setattr(module, "materialize", lambda df: seen.append(df) or session.materialize(df))
    trials, preds = views.trials_v(spark, SF001), views.preds_v(spark, SF001)
    if build == "remaining":
        out = worklist.remaining_count(worklist.build_worklist(trials), views.raw_v(spark, SF001))
        assert relations(out) == 4  # trials and log, each documents and labels
        return
    source = trials if build.__module__.endswith("sections") else (
        preds if build is plotdata.panels_confusion_cf else metrics.metrics_by_setting(preds))
    out = build(source)
    assert len(seen) == 1 and relations(seen[0]) <= 2
    assert relations(out) == 0
