"""Scoring worklist and prompts.

The worklist is trials x settings. The settings list is a design parameter
(at most |vendors| x |conditions| cells), so it is expanded with a generator
over a literal array: a map-side ``Generate`` per trial row, no join and no
shuffle. Resume is a left anti join on the narrow key columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, Design, literal_map
from recallscope.session import materialize

KEYS = ("trial_idx", "vendor", "condition")


KEYS_PER_TASK = 1_000_000  # keys one task sorts when the n-th is looked for


def one_per_key(trials: DataFrame) -> DataFrame:
    """The rule for trial keys, used wherever trials are limited or scored: a NULL
    key is an error, and of rows that repeat a key the least one (by all columns)
    stays, whatever is in the log. The check reads the key column only; texts are
    shuffled only when a key does repeat."""
    counts = trials.groupBy("trial_idx").agg(F.count(F.lit(1)).alias("n"))
    nulls, repeated = counts.agg(F.count_if(F.col("trial_idx").isNull()), F.count_if(F.col("n") > 1)).first()
    if nulls:
        raise ValueError("trials without a key (trial_idx is NULL) cannot be scored or resumed")
    if not repeated:
        return trials
    rest = [c for c in trials.columns if c != "trial_idx"]
    least = trials.groupBy("trial_idx").agg(F.min(F.struct(*rest)).alias("_row"))
    return least.select(*[F.col("_row")[c].alias(c) if c != "trial_idx" else F.col(c) for c in trials.columns])


def limit_trials(trials: DataFrame, n: int | None, dense: bool = False, keys_per_task: int = KEYS_PER_TASK) -> DataFrame:
    """The first ``n`` trials by key, one per key (:func:`one_per_key`); 0 or None means all.

    With a dense 0-based key (row positions, as :func:`read_trials` assigns)
    this is a pushed-down filter. Otherwise the n-th key is found exactly over the
    key column alone: the keys are range-partitioned (about ``keys_per_task``
    each) and counted per partition, and the partition that holds rank n is
    ordered; the rows are then a range filter on the scan.
    """
    if not n:
        return trials
    if dense:
        return trials.where(F.col("trial_idx") < F.lit(n))
    trials = one_per_key(trials)
    keys = trials.select("trial_idx")
    total = keys.count()
    if n >= total:
        return trials
    parts = -(-total // keys_per_task)
    ranged = materialize(keys.repartitionByRange(parts, "trial_idx").withColumn("_part", F.spark_partition_id()))
    left = n
    for part, size in sorted(tuple(r) for r in ranged.groupBy("_part").count().collect()):  # a row per partition
        if left <= size:
            break
        left -= size
    last = ranged.where(F.col("_part") == part).orderBy("trial_idx").limit(left).agg(F.max("trial_idx")).first()[0]
    return trials.where(F.col("trial_idx") <= F.lit(last))


TASK_BYTES = 64 * 1024 * 1024  # text bytes of the trials one task gets, unless the number of tasks is given


def text_bytes(df: DataFrame) -> int:
    """Bytes of all rows: texts as UTF-8, 8 for any other value. One pass, a number per task."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.typeName() == "string" else F.lit(8)
             for f in df.schema.fields]
    return int(df.agg(F.sum(sum(sizes, F.lit(0)).cast("long"))).first()[0] or 0)


def tasks_for(trials: DataFrame, parallelism: int | None = None, task_bytes: int = TASK_BYTES) -> int:
    """Tasks that share the trials: ``parallelism`` where given, else the session's default parallelism, or
    as many more as keep a task's texts near ``task_bytes``."""
    return parallelism or max(trials.sparkSession.sparkContext.defaultParallelism, -(-text_bytes(trials) // task_bytes))


def settings(design: Design = DEFAULT_DESIGN, vendors=None, conditions=None) -> list[tuple[str, str]]:
    """Validated (condition, vendor) cells in run order; unknown names fail
    before any job starts."""
    vs = design.check_vendors(vendors)
    cs = design.check_conditions(conditions)
    return [(c, v) for c in cs for v in vs]


def _cells_array(cells) -> Column:
    return F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(v).alias("vendor")) for c, v in cells])


def build_worklist(trials: DataFrame, design: Design = DEFAULT_DESIGN, vendors=None, conditions=None) -> DataFrame:
    """Every trial under every chosen (condition, vendor)."""
    cells = settings(design, vendors, conditions)
    return trials.select("*", F.inline(_cells_array(cells)))


def count_worklist(trials: DataFrame, design: Design = DEFAULT_DESIGN, vendors=None, conditions=None) -> DataFrame:
    """Number of calls without building the worklist (dry run)."""
    vs = design.check_vendors(vendors)
    cs = design.check_conditions(conditions)
    n = F.count(F.lit(1))
    return trials.agg(
        n.alias("n_trials"),
        F.lit(len(vs)).cast("bigint").alias("n_vendors"),
        F.lit(len(cs)).cast("bigint").alias("n_conditions"),
        (n * F.lit(len(vs) * len(cs))).alias("total_calls"),
    )


def route_fields(work: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    """Rewritten conditions read the rewritten title, text and target label."""
    rw = F.col("condition").isin(*design.rewritten_conditions)
    return work.select(
        "trial_idx", "vendor", "condition",
        F.when(rw, F.col("counterfactual_title")).otherwise(F.col("title")).alias("title"),
        F.when(rw, F.col("counterfactual_abstract")).otherwise(F.col("abstract")).alias("abstract"),
        F.col("doi"),
        F.when(rw, F.col("target_label")).otherwise(F.col("annotation_accept")).alias("ground_truth"),
    )


# Fixed prompt layouts per condition; the parts are field names or literal text.
PROMPT_LAYOUTS = {
    "baseline": ("Title: ", "title", "\n\nAbstract: ", "abstract"),
    "title_only": ("Title: ", "title"),
    "doi_only": ("DOI: ", "doi"),
    "counterfactual": ("Title: ", "title", "\n\nAbstract: ", "abstract"),
    "counterfactual_with_doi": ("DOI: ", "doi", "\n\nTitle: ", "title", "\n\nAbstract: ", "abstract"),
}
PROMPT_FIELDS = ("title", "abstract", "doi")


def prompt_expr(layouts: dict = PROMPT_LAYOUTS, missing_text: str = "nan") -> Column:
    """The user prompt as one CASE over the condition.

    A missing field prints as ``missing_text`` (the reference formats a
    missing CSV value as ``nan``); an unknown condition fails the job.
    """
    def part(p):
        return F.coalesce(F.col(p), F.lit(missing_text)) if p in PROMPT_FIELDS else F.lit(p)

    out = None
    for cond, parts in layouts.items():
        text = F.concat(*[part(p) for p in parts])
        out = F.when(F.col("condition") == cond, text) if out is None else out.when(F.col("condition") == cond, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("Unknown condition: "), F.coalesce(F.col("condition"), F.lit("NULL")))))


def build_prompt(routed: DataFrame, missing_text: str = "nan") -> DataFrame:
    return routed.select("trial_idx", "vendor", "condition",
                         prompt_expr(missing_text=missing_text).alias("prompt"), "ground_truth")


def completed_keys(preds: DataFrame) -> DataFrame:
    """Keys already in the log (any status counts as done; model is not
    part of the key)."""
    return preds.select(*KEYS).distinct()


def _keep_order() -> Column:
    """Which copy of a key to keep: a labelled answer, then INVALID, then
    ERROR, then anything else; ties by model, raw answer, truth and label
    (missing values last), so the choice never depends on file order."""
    status = F.col("parsed_output")
    rank = (F.when(status.isin("POSITIVE", "NEGATIVE"), 0).when(status == "INVALID", 1)
            .when(status == "ERROR", 2).otherwise(3))
    parts = [rank.alias("rank")]
    for c in ("model", "raw_output", "ground_truth", "parsed_output"):
        parts += [F.col(c).isNull().alias(f"{c}_missing"), F.col(c).alias(c)]
    return F.struct(*parts)


def dedupe_predictions(preds: DataFrame) -> DataFrame:
    """One row per (trial_idx, vendor, condition), an optional clean-up step
    (the analysis counts repeated rows, as the reference does).

    ``min_by`` under ``groupBy`` is combined map-side: copies of one key
    collapse inside each task, so a key copied into a third of the log never
    meets in one task (a window would gather all its copies).
    """
    row = F.struct(*[F.col(c) for c in PREDICTION_ORDER])
    return (preds.groupBy(*KEYS).agg(F.min_by(row, _keep_order()).alias("_row"))
            .select(*[F.col(f"_row.{c}").alias(c) for c in PREDICTION_ORDER]))


def pending_work(work: DataFrame, preds: DataFrame) -> DataFrame:
    """Work items with no row in the log.

    Reads only the key columns of the log and de-duplicates them first: the
    partial aggregate collapses repeated keys inside each task, so a key
    copied into a third of the log ships one row per task, not its copies
    (AQE's skew split cannot help here, as it splits only the left side of
    an anti join). The distinct's hash partitioning on the key is the one the
    join needs, so the log side shuffles once. Small logs are broadcast by
    AQE; a hot key on the work side is split by AQE's skew handling.
    """
    return work.join(completed_keys(preds), list(KEYS), "left_anti")


def remaining_count(work: DataFrame, preds: DataFrame) -> DataFrame:
    """Total, completed, remaining (true count) and the reference's naive
    ``total - completed`` (which counts completed keys outside the work).

    One pass over either side: work and log keys are stacked with a flag and
    counted per key (combined map-side), and all four numbers are sums over that.
    A key with a NULL part matches nothing, so such work stays to be done.
    """
    items = work.select(*KEYS, F.lit(1).alias("_work"), F.lit(0).alias("_done"))
    logged = preds.select(*KEYS, F.lit(0).alias("_work"), F.lit(1).alias("_done"))
    per_key = items.unionByName(logged).groupBy(*KEYS).agg(F.sum("_work").alias("w"), F.max("_done").alias("d"))
    whole = F.lit(True)
    for k in KEYS:
        whole = whole & F.col(k).isNotNull()
    zero = F.lit(0).cast("bigint")
    sums = per_key.agg(F.coalesce(F.sum("w"), zero).alias("total_calls"), F.count_if(F.col("d") == 1).alias("n_completed"),
                       F.coalesce(F.sum(F.when((F.col("d") == 0) | ~whole, F.col("w"))), zero).alias("remaining"))
    return sums.select("total_calls", "n_completed", "remaining",
                       (F.col("total_calls") - F.col("n_completed")).alias("remaining_naive"))


def model_expr(design: Design = DEFAULT_DESIGN) -> Column:
    """Vendor -> model id via a literal map; unknown vendor fails."""
    m = literal_map(design.models)[F.col("vendor")]
    return F.when(m.isNotNull(), m).otherwise(
        F.raise_error(F.concat(F.lit("Unknown vendor: "), F.coalesce(F.col("vendor"), F.lit("NULL")))))


def attach_model(work: DataFrame, design: Design = DEFAULT_DESIGN) -> DataFrame:
    return work.withColumn("model", model_expr(design))


PREDICTION_ORDER = ("trial_idx", "vendor", "model", "condition", "raw_output", "parsed_output", "ground_truth")


def assemble_predictions(scored: DataFrame) -> DataFrame:
    """The seven prediction columns in log order."""
    return scored.select(*PREDICTION_ORDER)
