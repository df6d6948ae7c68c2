"""Edge cases of FIXTURES §4: one per semantic trap."""

import pytest
from pyspark.sql import functions as F

from recallscope.design import Design
from recallscope.functions import format_ci, format_fixed, parse_output, wald_ci
from recallscope.operators import compare, metrics, plotdata, report, sections

PRED_DDL = ("trial_idx long, vendor string, model string, condition string, raw_output string, "
            "parsed_output string, ground_truth string")


def preds_df(spark, rows):
    return spark.createDataFrame(rows, PRED_DDL)


def test_parse_output_whitespace_and_case(spark):
    raws = [None, "", "  ", " positive\n", "Positive.", "poſitıve", " NEGATIVE　",
            " negative\u0085", "\x1cPOSITIVE\x1f", "NEG ATIVE", "positive negative"]
    expected = ["ERROR", "INVALID", "INVALID", "POSITIVE", "INVALID", "POSITIVE", "NEGATIVE",
                "NEGATIVE", "POSITIVE", "INVALID", "INVALID"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = [r.p for r in df.select("i", parse_output("raw").alias("p")).orderBy("i").collect()]
    assert got == expected


def test_parse_matches_python_strip_upper(spark):
    # every whitespace character Python strips is stripped here too
    from recallscope.functions.text import WHITESPACE

    assert len(WHITESPACE) == 29
    samples = [ch + "negative" + ch for ch in WHITESPACE]
    df = spark.createDataFrame([(s,) for s in samples], "raw string")
    got = {r.p for r in df.select(parse_output("raw").alias("p")).collect()}
    assert got == {"NEGATIVE"}


def test_two_models_one_vendor(spark):
    rows = [(1, "v", "m1", "c", None, "POSITIVE", "POSITIVE"),
            (2, "v", "m2", "c", None, "NEGATIVE", "POSITIVE"),
            (3, "v", "m2", "c", None, "INVALID", "NEGATIVE")]
    m = metrics.metrics_by_setting(preds_df(spark, rows)).orderBy("model").collect()
    assert [(r.model, r.n_total, r.n_valid, r.n_invalid, r.accuracy) for r in m] == [
        ("m1", 3, 2, 1, 0.5), ("m2", 3, 2, 1, 0.5)]


def test_only_invalid_or_error(spark):
    rows = [(1, "v", "m", "c", None, "INVALID", "POSITIVE"), (2, "v", "m", "c", None, "ERROR", "NEGATIVE")]
    (r,) = metrics.metrics_by_setting(preds_df(spark, rows)).collect()
    assert (r.accuracy, r.f1_macro, r.n_total, r.n_valid, r.n_invalid, r.n_error, r.pct_valid) == (
        None, None, 2, 0, 1, 1, 0.0)


def test_single_class(spark):
    rows = [(i, "openai", "m", "baseline", None, "POSITIVE", "POSITIVE") for i in range(4)]
    p = preds_df(spark, rows)
    (r,) = metrics.metrics_by_setting(p).collect()
    assert (r.accuracy, r.f1_macro) == (1.0, 0.5)
    (rep,) = report.report_table(p).collect()
    assert rep["Specificity (95% CI)"] == "N/A"
    assert rep["Sensitivity (95% CI)"] == "1.00 (1.00-1.00)"


def test_null_truth_not_scored_but_counted(spark):
    rows = [(1, "v", "m", "c", None, "POSITIVE", None), (2, "v", "m", "c", None, "POSITIVE", "POSITIVE")]
    (r,) = metrics.metrics_by_setting(preds_df(spark, rows)).collect()
    assert (r.n_valid, r.accuracy, r.pct_valid) == (2, 1.0, 100.0)


def test_null_keys_drop_out_null_model_stays(spark):
    rows = [(1, None, "m", "c", None, "POSITIVE", "POSITIVE"), (2, "v", None, "c", None, "POSITIVE", "POSITIVE"),
            (3, "v", "m", None, None, "POSITIVE", "POSITIVE")]
    m = metrics.metrics_by_setting(preds_df(spark, rows)).collect()
    assert [(r.vendor, r.model, r.condition, r.n_total) for r in m] == [("v", None, "c", 1)]


def test_duplicates_count_twice(spark):
    row = (1, "v", "m", "c", None, "POSITIVE", "NEGATIVE")
    (r,) = metrics.metrics_by_setting(preds_df(spark, [row, row])).collect()
    assert r.n_total == 2 and r.accuracy == 0.0


def _metrics_rows(spark, rows):
    ddl = "vendor string, model string, condition string, accuracy double, f1_macro double, " \
          "n_total long, n_valid long, n_invalid long, n_error long, pct_valid double"
    return spark.createDataFrame(rows, ddl)


def test_degradation_without_baseline_and_zero_baseline(spark):
    m = _metrics_rows(spark, [
        ("a", "m", "title_only", 0.5, 0.5, 1, 1, 0, 0, 100.0),            # no baseline: dropped
        ("b", "m", "baseline", 0.0, 0.0, 1, 1, 0, 0, 100.0),              # baseline F1 = 0
        ("b", "m", "title_only", 0.5, 0.4, 1, 1, 0, 0, 100.0),
        ("c", "m", "baseline", None, None, 1, 0, 1, 0, 0.0),               # undefined baseline
        ("c", "m", "doi_only", 0.5, 0.5, 1, 1, 0, 0, 100.0),
    ])
    got = {(r.vendor, r.condition): (r.abs_degradation, r.rel_degradation_pct)
           for r in compare.degradation(m).collect()}
    assert got == {("b", "baseline"): (0.0, 0.0), ("b", "title_only"): (-0.4, 0.0),
                   ("c", "baseline"): (None, 0.0), ("c", "doi_only"): (None, 0.0)}


def test_unknown_vendor_in_metrics_not_in_pivot_or_report(spark):
    rows = [(1, "openai", "m", "baseline", None, "POSITIVE", "POSITIVE"),
            (2, "mystery", "m", "baseline", None, "POSITIVE", "POSITIVE"),
            (3, "openai", "m", "odd_condition", None, "POSITIVE", "POSITIVE")]
    p = preds_df(spark, rows)
    m = metrics.metrics_by_setting(p)
    assert m.count() == 3
    assert {r.vendor for r in compare.degradation(m).collect()} == {"openai", "mystery"}
    piv = compare.f1_pivot(m)
    assert piv.columns == ["vendor", "baseline"]
    assert [r.vendor for r in piv.collect()] == ["openai"]
    assert [r.Model for r in report.report_table(p).collect()] == ["GPT-5.2"]


def test_pivot_drops_all_undefined(spark):
    m = _metrics_rows(spark, [
        ("openai", "m", "baseline", 1.0, 0.9, 1, 1, 0, 0, 100.0),
        ("openai", "m", "title_only", None, None, 1, 0, 1, 0, 0.0),
        ("gemini", "m", "title_only", None, None, 1, 0, 1, 0, 0.0),
    ])
    piv = compare.f1_pivot(m)
    assert piv.columns == ["vendor", "baseline"]
    assert [tuple(r) for r in piv.collect()] == [("openai", 0.9)]


def test_top_f1_ties_keep_design_order(spark):
    m = _metrics_rows(spark, [
        ("anthropic", "m", "baseline", 1.0, 0.9, 1, 1, 0, 0, 100.0),
        ("openai", "m", "title_only", 1.0, 0.9, 1, 1, 0, 0, 100.0),
        ("openai", "m", "baseline", 1.0, 0.9, 1, 1, 0, 0, 100.0),
        ("gemini", "m", "doi_only", None, None, 1, 0, 1, 0, 0.0),
    ])
    got = [(r.vendor, r.condition) for r in compare.top_f1(m, 2).collect()]
    assert got == [("openai", "baseline"), ("anthropic", "baseline")]
    # undefined settings fill the places that defined ones leave
    assert [(r.vendor, r.f1_macro) for r in compare.top_f1(m, 5).collect()][-1] == ("gemini", None)
    assert compare.top_f1(m, 5).count() == 4


@pytest.mark.parametrize("good,n", [('["a"]', 1), (' [ "a" , "b\\u00e9\\n" ] ', 2), ("[]", 0), ('["\\"]"]', 1)])
def test_section_arrays_that_parse(spark, good, n):
    t = spark.createDataFrame([(1, good)], "trial_idx long, sections_modified string")
    assert [len(r.sections) for r in sections.with_sections(t).collect()] == [n]


def test_sections_repeats_unknown_and_spacing(spark):
    t = spark.createDataFrame([(1, '["title", "title"]'), (2, '["abstract"]'), (3, '["a","b"]'),
                               (4, '["a", "b"]')], "trial_idx long, sections_modified string")
    counts = {r.section: r.n_modified for r in sections.section_counts(t).collect()}
    assert counts == {"title": 2, "methods": 0, "results": 0, "conclusion": 0}
    pats = {r.pattern for r in sections.pattern_counts(t).collect()}
    assert {'["a","b"]', '["a", "b"]'} <= pats
    raw = {r.section: r.n_modified for r in sections.section_counts_raw(t).collect()}
    assert raw == {"title": 2, "abstract": 1, "a": 2, "b": 2}


@pytest.mark.parametrize("bad", ["not json", None, '{"a": 1}', "['results','conclusion']", '["a"] junk', '["a"] ["b"]',
                                 "[NaN]", "[1]", '["a", null]', '["a"', '["a",]', '["\\x"]'])
def test_malformed_sections_fail(spark, bad):
    t = spark.createDataFrame([(1, '["title"]'), (2, bad)], "trial_idx long, sections_modified string")
    with pytest.raises(Exception):
        sections.section_counts(t).collect()


def test_format_rounding_half_even_on_binary_value(spark):
    df = spark.createDataFrame([(0.125,), (0.145,), (0.165,), (1.0,), (0.0,)], "x double")
    got = [r.s for r in df.select(format_fixed(F.col("x"), 2).alias("s")).collect()]
    assert got == [f"{x:.2f}" for x in (0.125, 0.145, 0.165, 1.0, 0.0)] == ["0.12", "0.14", "0.17", "1.00", "0.00"]


def test_wald_clipping_and_undefined(spark):
    df = spark.createDataFrame([(1.0, 5), (0.0, 5), (None, 5), (0.5, 0), (0.99, 10)], "p double, n long")
    ci = wald_ci(F.col("p"), F.col("n"))
    rows = df.select(ci["lower"].alias("lo"), ci["upper"].alias("hi"),
                     format_ci(F.col("p"), ci["lower"], ci["upper"]).alias("s")).collect()
    assert (rows[0].lo, rows[0].hi) == (1.0, 1.0)
    assert (rows[1].lo, rows[1].hi) == (0.0, 0.0)
    assert (rows[2].lo, rows[2].hi, rows[2].s) == (None, None, "N/A")
    assert (rows[3].lo, rows[3].hi) == (None, None)
    assert rows[4].hi == 1.0 and rows[4].lo == max(0, 0.99 - 1.96 * (0.99 * 0.01 / 10) ** 0.5)


def test_grid_fill_and_undefined(spark):
    m = _metrics_rows(spark, [
        ("openai", "m", "baseline", 1.0, 0.9, 1, 1, 0, 0, 100.0),
        ("gemini", "m", "baseline", None, None, 1, 0, 1, 0, 0.0),
    ])
    g = {(r.vendor, r.condition): r.f1_macro for r in plotdata.grid_f1(m).collect()}
    assert len(g) == 15
    assert g[("openai", "baseline")] == 0.9
    assert g[("gemini", "baseline")] is None          # undefined stays undefined
    assert g[("anthropic", "doi_only")] == 0.0        # missing setting -> 0
    s = {(r.vendor, r.condition): r.f1_macro for r in plotdata.series_degradation(m).collect()}
    assert len(s) == 9 and s[("anthropic", "baseline")] is None
    # no counterfactual rows: those charts are empty
    assert plotdata.grid_counterfactual(m).count() == 0


def test_display_names_fallback(spark):
    m = _metrics_rows(spark, [("openai", "m", "baseline", 1.0, 1.0, 1, 1, 0, 0, 100.0),
                              ("mistral", "m", "weird", 1.0, 1.0, 1, 1, 0, 0, 100.0)])
    got = {(r.vendor_display, r.condition_display) for r in plotdata.display_names(m).collect()}
    assert got == {("GPT-5.2", "Baseline\n(Title + Abstract)"), ("MISTRAL", "weird")}


def test_unknown_settings_rejected_before_running():
    from recallscope.operators.worklist import settings

    with pytest.raises(ValueError):
        settings(Design(), vendors=["nobody"])
    with pytest.raises(ValueError):
        settings(Design(), conditions=["abstract_only"])
    assert settings(Design(), vendors="gemini", conditions="doi_only") == [("doi_only", "gemini")]


def test_dedupe_keeps_labelled_copy_and_combines_map_side(spark):
    from recallscope.operators import worklist

    cols = "trial_idx long, vendor string, model string, condition string, raw_output string, " \
           "parsed_output string, ground_truth string"
    hot = [(1, "openai", "m", "baseline", None, "ERROR", "POSITIVE")] * 3000       # a third of the log
    rows = hot + [(1, "openai", "m", "baseline", "x", "INVALID", "POSITIVE"),
                  (1, "openai", "m", "baseline", "NEGATIVE", "NEGATIVE", "POSITIVE")] + \
        [(i, "gemini", "m", "baseline", "POSITIVE", "POSITIVE", "NEGATIVE") for i in range(6000)]
    preds = spark.createDataFrame(rows, cols).repartition(8)
    out = worklist.dedupe_predictions(preds)
    kept = out.where("trial_idx = 1 and vendor = 'openai'").collect()
    assert [(r.raw_output, r.parsed_output) for r in kept] == [("NEGATIVE", "NEGATIVE")]
    assert out.count() == 6001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan
