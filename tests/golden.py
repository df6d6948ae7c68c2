"""The published run, reconstructed as prediction rows (FIXTURES §2).

Each setting is given by its confusion counts plus invalid / error rows and
the truth of those unscored rows; expected values are the published tables.
"""

from recallscope.design import MODELS

# Fixed values from here on: the published counts, tables and texts, which results must equal.

# vendor, condition, tp, fn, fp, tn, n_invalid, n_error, unscored_pos, unscored_neg
SETTINGS = [
    ("openai", "baseline", 141, 5, 4, 100, 0, 0, 0, 0),
    ("gemini", "baseline", 139, 6, 3, 100, 2, 0, 1, 1),
    ("anthropic", "baseline", 141, 5, 2, 102, 0, 0, 0, 0),
    ("openai", "title_only", 119, 27, 17, 87, 0, 0, 0, 0),
    ("gemini", "title_only", 127, 17, 13, 91, 2, 0, 2, 0),
    ("anthropic", "title_only", 116, 30, 23, 81, 0, 0, 0, 0),
    ("openai", "doi_only", 111, 35, 47, 57, 0, 0, 0, 0),
    ("gemini", "doi_only", 78, 64, 25, 76, 7, 0, 4, 3),
    ("anthropic", "doi_only", 91, 54, 38, 66, 1, 0, 1, 0),
    ("openai", "counterfactual", 103, 1, 1, 143, 0, 2, 0, 2),
    ("gemini", "counterfactual", 98, 4, 1, 141, 3, 3, 2, 4),
    ("anthropic", "counterfactual", 96, 8, 1, 143, 0, 2, 0, 2),
    ("openai", "counterfactual_with_doi", 103, 1, 2, 144, 0, 0, 0, 0),
    ("gemini", "counterfactual_with_doi", 95, 8, 0, 141, 5, 1, 1, 5),
    ("anthropic", "counterfactual_with_doi", 92, 10, 3, 143, 2, 0, 2, 0),
]

# published metrics: vendor, condition, accuracy, f1_macro, n_total, n_valid, n_invalid, n_error, pct_valid
METRICS = [
    ("openai", "baseline", 0.964, 0.9630049819957579, 250, 250, 0, 0, 100.0),
    ("gemini", "baseline", 0.9637096774193549, 0.9627894570128204, 250, 248, 2, 0, 99.2),
    ("anthropic", "baseline", 0.972, 0.9713015956312829, 250, 250, 0, 0, 100.0),
    ("openai", "title_only", 0.824, 0.8210683844101763, 250, 250, 0, 0, 100.0),
    ("gemini", "title_only", 0.8790322580645161, 0.8764283816104173, 250, 248, 2, 0, 99.2),
    ("anthropic", "title_only", 0.788, 0.7837617299061608, 250, 250, 0, 0, 100.0),
    ("openai", "doi_only", 0.672, 0.6559479054779807, 250, 250, 0, 0, 100.0),
    ("gemini", "doi_only", 0.6337448559670782, 0.6337200440342112, 250, 243, 7, 0, 97.2),
    ("anthropic", "doi_only", 0.6305220883534136, 0.626759645464025, 250, 249, 1, 0, 99.6),
    ("openai", "counterfactual", 0.9919354838709677, 0.9917200854700855, 250, 248, 0, 2, 99.2),
    ("gemini", "counterfactual", 0.9795081967213115, 0.9788513876609981, 250, 244, 3, 3, 97.6),
    ("anthropic", "counterfactual", 0.9637096774193549, 0.9623577030103718, 250, 248, 0, 2, 99.2),
    ("openai", "counterfactual_with_doi", 0.988, 0.9876683273319193, 250, 250, 0, 0, 100.0),
    ("gemini", "counterfactual_with_doi", 0.9672131147540983, 0.9660048763497039, 250, 244, 5, 1, 97.6),
    ("anthropic", "counterfactual_with_doi", 0.9475806451612904, 0.9452659457073493, 250, 248, 2, 0, 99.2),
]

DEGRADATION_REL = {
    ("openai", "title_only"): 14.73892661400654, ("gemini", "title_only"): 8.969881709169272,
    ("anthropic", "title_only"): 19.30809818172217,
    ("openai", "doi_only"): 31.885305087562866, ("gemini", "doi_only"): 34.17875118819745,
    ("anthropic", "doi_only"): 35.472190277143326,
    ("openai", "counterfactual"): -2.981822940813622, ("gemini", "counterfactual"): -1.6682703088598378,
    ("anthropic", "counterfactual"): 0.920815188726027,
    ("openai", "counterfactual_with_doi"): -2.5610818009527265,
    ("gemini", "counterfactual_with_doi"): -0.3339691054428219,
    ("anthropic", "counterfactual_with_doi"): 2.6804908013161564,
}
DEGRADATION_ABS = {
    ("openai", "title_only"): 0.14193659758558164, ("openai", "doi_only"): 0.30705707651777725,
    ("openai", "counterfactual"): -0.028715103474327597, ("openai", "counterfactual_with_doi"): -0.024663345336161435,
    ("gemini", "title_only"): 0.08636107540240312, ("gemini", "doi_only"): 0.32906941297860914,
    ("gemini", "counterfactual"): -0.016061930648177736, ("gemini", "counterfactual_with_doi"): -0.0032154193368835182,
    ("anthropic", "title_only"): 0.18753986572512216, ("anthropic", "doi_only"): 0.34454195016725797,
    ("anthropic", "counterfactual"): 0.00894389262091111, ("anthropic", "counterfactual_with_doi"): 0.02603564992393359,
}
BASELINE_VS_CF = [
    ("openai", 0.9630049819957579, 0.9917200854700855, -0.028715103474327597),
    ("gemini", 0.9627894570128204, 0.9788513876609981, -0.016061930648177736),
    ("anthropic", 0.9713015956312829, 0.9623577030103718, 0.00894389262091111),
]

REPORT = [
    ("Baseline", "GPT-5.2", "100.0", "0.96 (0.94-0.99)", "0.97 (0.94-1.00)", "0.96 (0.92-1.00)", "0.96 (0.94-0.99)"),
    ("Baseline", "Gemini 3 Flash", "99.2", "0.96 (0.94-0.99)", "0.96 (0.93-0.99)", "0.97 (0.94-1.00)", "0.96 (0.94-0.99)"),
    ("Baseline", "Claude Opus 4.5", "100.0", "0.97 (0.95-0.99)", "0.97 (0.94-1.00)", "0.98 (0.95-1.00)", "0.97 (0.95-0.99)"),
    ("Title only", "GPT-5.2", "100.0", "0.82 (0.78-0.87)", "0.82 (0.75-0.88)", "0.84 (0.77-0.91)", "0.82 (0.77-0.87)"),
    ("Title only", "Gemini 3 Flash", "99.2", "0.88 (0.84-0.92)", "0.88 (0.83-0.93)", "0.88 (0.81-0.94)", "0.88 (0.84-0.92)"),
    ("Title only", "Claude Opus 4.5", "100.0", "0.79 (0.74-0.84)", "0.79 (0.73-0.86)", "0.78 (0.70-0.86)", "0.78 (0.73-0.83)"),
    ("DOI only", "GPT-5.2", "100.0", "0.67 (0.61-0.73)", "0.76 (0.69-0.83)", "0.55 (0.45-0.64)", "0.66 (0.60-0.71)"),
    ("DOI only", "Gemini 3 Flash", "97.2", "0.63 (0.57-0.69)", "0.55 (0.47-0.63)", "0.75 (0.67-0.84)", "0.63 (0.57-0.69)"),
    ("DOI only", "Claude Opus 4.5", "99.6", "0.63 (0.57-0.69)", "0.63 (0.55-0.71)", "0.63 (0.54-0.73)", "0.63 (0.57-0.69)"),
    ("Counterfactual", "GPT-5.2", "99.2", "0.99 (0.98-1.00)", "0.99 (0.97-1.00)", "0.99 (0.98-1.00)", "0.99 (0.98-1.00)"),
    ("Counterfactual", "Gemini 3 Flash", "97.6", "0.98 (0.96-1.00)", "0.96 (0.92-1.00)", "0.99 (0.98-1.00)", "0.98 (0.96-1.00)"),
    ("Counterfactual", "Claude Opus 4.5", "99.2", "0.96 (0.94-0.99)", "0.92 (0.87-0.97)", "0.99 (0.98-1.00)", "0.96 (0.94-0.99)"),
    ("Counterfactual + DOI", "GPT-5.2", "100.0", "0.99 (0.97-1.00)", "0.99 (0.97-1.00)", "0.99 (0.97-1.00)", "0.99 (0.97-1.00)"),
    ("Counterfactual + DOI", "Gemini 3 Flash", "97.6", "0.97 (0.94-0.99)", "0.92 (0.87-0.97)", "1.00 (1.00-1.00)", "0.97 (0.94-0.99)"),
    ("Counterfactual + DOI", "Claude Opus 4.5", "99.2", "0.95 (0.92-0.98)", "0.90 (0.84-0.96)", "0.98 (0.96-1.00)", "0.95 (0.92-0.97)"),
]

SECTION_PATTERNS = [('["results", "conclusion"]', 233), ('["title", "results", "conclusion"]', 13),
                    ('["methods", "results", "conclusion"]', 4)]


# published text renderings, verbatim (the report file ends without a newline)
REPORT_TEXT = "\n".join([
    '           Condition           Model Valid predictions (%) Accuracy (95% CI) Sensitivity (95% CI) Specificity (95% CI) F1 Score (95% CI)',
    '            Baseline         GPT-5.2                 100.0  0.96 (0.94-0.99)     0.97 (0.94-1.00)     0.96 (0.92-1.00)  0.96 (0.94-0.99)',
    '            Baseline  Gemini 3 Flash                  99.2  0.96 (0.94-0.99)     0.96 (0.93-0.99)     0.97 (0.94-1.00)  0.96 (0.94-0.99)',
    '            Baseline Claude Opus 4.5                 100.0  0.97 (0.95-0.99)     0.97 (0.94-1.00)     0.98 (0.95-1.00)  0.97 (0.95-0.99)',
    '          Title only         GPT-5.2                 100.0  0.82 (0.78-0.87)     0.82 (0.75-0.88)     0.84 (0.77-0.91)  0.82 (0.77-0.87)',
    '          Title only  Gemini 3 Flash                  99.2  0.88 (0.84-0.92)     0.88 (0.83-0.93)     0.88 (0.81-0.94)  0.88 (0.84-0.92)',
    '          Title only Claude Opus 4.5                 100.0  0.79 (0.74-0.84)     0.79 (0.73-0.86)     0.78 (0.70-0.86)  0.78 (0.73-0.83)',
    '            DOI only         GPT-5.2                 100.0  0.67 (0.61-0.73)     0.76 (0.69-0.83)     0.55 (0.45-0.64)  0.66 (0.60-0.71)',
    '            DOI only  Gemini 3 Flash                  97.2  0.63 (0.57-0.69)     0.55 (0.47-0.63)     0.75 (0.67-0.84)  0.63 (0.57-0.69)',
    '            DOI only Claude Opus 4.5                  99.6  0.63 (0.57-0.69)     0.63 (0.55-0.71)     0.63 (0.54-0.73)  0.63 (0.57-0.69)',
    '      Counterfactual         GPT-5.2                  99.2  0.99 (0.98-1.00)     0.99 (0.97-1.00)     0.99 (0.98-1.00)  0.99 (0.98-1.00)',
    '      Counterfactual  Gemini 3 Flash                  97.6  0.98 (0.96-1.00)     0.96 (0.92-1.00)     0.99 (0.98-1.00)  0.98 (0.96-1.00)',
    '      Counterfactual Claude Opus 4.5                  99.2  0.96 (0.94-0.99)     0.92 (0.87-0.97)     0.99 (0.98-1.00)  0.96 (0.94-0.99)',
    'Counterfactual + DOI         GPT-5.2                 100.0  0.99 (0.97-1.00)     0.99 (0.97-1.00)     0.99 (0.97-1.00)  0.99 (0.97-1.00)',
    'Counterfactual + DOI  Gemini 3 Flash                  97.6  0.97 (0.94-0.99)     0.92 (0.87-0.97)     1.00 (1.00-1.00)  0.97 (0.94-0.99)',
    'Counterfactual + DOI Claude Opus 4.5                  99.2  0.95 (0.92-0.98)     0.90 (0.84-0.96)     0.98 (0.96-1.00)  0.95 (0.92-0.97)',
])
SECTION_REPORT_TEXT = "\n".join([
    'Counterfactual Abstract Section Modifications (N=250 trials)',
    '============================================================',
    '',
    'Section Modification Frequency',
    '----------------------------------------',
    'Section         Trials Modified   Percentage',
    '----------------------------------------',
    'Title                        13         5.2%',
    'Introduction                  0         0.0%',
    'Methods                       4         1.6%',
    'Results                     250       100.0%',
    'Conclusion                  250       100.0%',
    '----------------------------------------',
    '',
    'Number of Sections Modified per Trial',
    '----------------------------------------',
    'Sections Modified        Trials   Percentage',
    '----------------------------------------',
    '2                           233        93.2%',
    '3                            17         6.8%',
    '----------------------------------------',
    '',
    'Mean: 2.07 sections',
    'Median: 2.0 sections',
    '',
])


def golden_predictions(spark):
    """Expand the 15 settings into 3,750 prediction rows with Spark."""
    from pyspark.sql import functions as F

    cells = []
    for v, c, tp, fn, fp, tn, n_inv, n_err, up, un in SETTINGS:
        kinds = [("POSITIVE", "POSITIVE", tp), ("POSITIVE", "NEGATIVE", fn), ("NEGATIVE", "POSITIVE", fp),
                 ("NEGATIVE", "NEGATIVE", tn)]
        # unscored rows: invalid first, then errors; their truths are given as counts
        statuses = ["INVALID"] * n_inv + ["ERROR"] * n_err
        truths = ["POSITIVE"] * up + ["NEGATIVE"] * un
        for t, p, n in kinds:
            cells.append((v, MODELS[v], c, t, p, n))
        for s, t in zip(statuses, truths):
            cells.append((v, MODELS[v], c, t, s, 1))
    df = spark.createDataFrame(cells, "vendor string, model string, condition string, ground_truth string, "
                                      "parsed_output string, n int")
    return (df.where(F.col("n") > 0)
            .select("vendor", "model", "condition", "ground_truth", "parsed_output",
                    F.explode(F.sequence(F.lit(1), F.col("n"))).alias("rep"))
            .select(F.monotonically_increasing_id().alias("trial_idx"), "vendor", "model", "condition",
                    F.lit(None).cast("string").alias("raw_output"), "parsed_output", "ground_truth"))


def golden_trials(spark):
    rows = []
    i = 0
    for pattern, n in SECTION_PATTERNS:
        for _ in range(n):
            rows.append((i, pattern))
            i += 1
    return spark.createDataFrame(rows, "trial_idx long, sections_modified string")
