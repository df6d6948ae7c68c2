"""The driver-table views of FIXTURES §3, as DataFrames.

``trials_v`` maps documents + labels onto the trials schema, ``raw_v``
derives raw answers for every (trial, vendor, condition) and ``preds_v``
derives a large prediction log from lineitem + orders. Their SQL twins live
in :mod:`recallscope.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the synthetic answer grid (vendor index, condition index, skill %).
GRID_VENDORS = (("openai", 0), ("gemini", 1), ("anthropic", 2))
GRID_CONDITIONS = (
    ("baseline", 0, 95),
    ("title_only", 1, 80),
    ("doi_only", 2, 60),
    ("counterfactual", 3, 98),
    ("counterfactual_with_doi", 4, 96),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trials_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    positive = F.col("quality") == 1
    known = F.col("quality").isNotNull()  # most documents have no label: their truth is missing
    m20 = F.col("doc_id") % 20
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("trial_idx"),
        title.alias("title"),
        F.col("text").alias("abstract"),
        F.concat(F.lit("10.5555/"), F.col("source"), F.lit("."), F.col("doc_id").cast("string")).alias("doi"),
        F.when(positive, "POSITIVE").when(known, "NEGATIVE").alias("annotation_accept"),
        F.concat(F.lit("Revised: "), title).alias("counterfactual_title"),
        F.concat(F.lit("Revised. "), F.col("text")).alias("counterfactual_abstract"),
        F.when(positive, "NEGATIVE").when(known, "POSITIVE").alias("target_label"),
        F.when(m20 == 0, '["title", "results", "conclusion"]')
        .when(m20 == 1, '["methods", "results", "conclusion"]')
        .when(m20 == 2, "[]")
        .otherwise('["results", "conclusion"]').alias("sections_modified"),
    )


def grid_cells():
    """The 15 literal grid cells as (vendor, v_ix, condition, c_ix, skill)."""
    return [(v, vi, c, ci, sk) for v, vi in GRID_VENDORS for c, ci, sk in GRID_CONDITIONS]


def _grid_array():
    return F.array(*[
        F.struct(F.lit(v).alias("vendor"), F.lit(vi).alias("v_ix"), F.lit(c).alias("condition"),
                 F.lit(ci).alias("c_ix"), F.lit(sk).alias("skill"))
        for v, vi, c, ci, sk in grid_cells()
    ])


def raw_v(spark: SparkSession, sf_dir: str, rewritten=("counterfactual", "counterfactual_with_doi")) -> DataFrame:
    t = trials_v(spark, sf_dir).select("trial_idx", "annotation_accept", "target_label")
    a = t.select("trial_idx", "annotation_accept", "target_label", F.inline(_grid_array()))
    idx = F.col("trial_idx")
    h = (idx * 37 + F.col("v_ix") * 53 + F.col("c_ix") * 71 + idx * idx) % 9973
    gt = F.when(F.col("condition").isin(*rewritten), F.col("target_label")).otherwise(F.col("annotation_accept"))
    a = a.select("trial_idx", "vendor", "condition", "skill", h.alias("h"), gt.alias("gt"))
    ans = (F.when(F.col("gt").isNull(), F.when(F.col("h") % 2 == 0, "POSITIVE").otherwise("NEGATIVE"))
           .when((F.col("h") % 100) < F.col("skill"), F.col("gt"))
           .when(F.col("gt") == "POSITIVE", "NEGATIVE").otherwise("POSITIVE"))
    b = a.withColumn("ans", ans)
    h = F.col("h")
    raw = (F.when(h % 50 == 0, F.lit("I cannot tell"))
           .when(h % 61 == 0, F.lit(None).cast("string"))
           .when(h % 67 == 0, F.lit(""))
           .when(h % 7 == 0, F.concat(F.lit("  "), F.lower("ans"), F.lit("\n")))
           .when(h % 11 == 0, F.concat(F.lit("\u00a0"), F.col("ans"), F.lit("\t")))
           .otherwise(F.col("ans")))
    return b.select(
        "trial_idx", "vendor", F.concat(F.col("vendor"), F.lit("-v1")).alias("model"), "condition",
        F.col("gt").alias("ground_truth"), raw.alias("raw_output"),
    )


def preds_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """600k-row prediction log at sf0.1: lineitem x orders (sort-merge join on
    the order key; AQE splits a skewed key)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    status_f = F.col("o_orderstatus") == "F"
    parsed = (F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 50 == 0, F.lit("INVALID"))
              .when((F.col("l_partkey") + F.col("l_linenumber")) % 40 == 0, F.lit("ERROR"))
              .when((F.col("l_quantity") <= F.ascii("o_orderpriority") - 20) == status_f, F.lit("POSITIVE"))
              .otherwise(F.lit("NEGATIVE")))
    return j.select(
        F.col("l_returnflag").alias("vendor"),
        F.concat(F.lit("m-"), F.col("l_returnflag")).alias("model"),
        F.col("o_orderpriority").alias("condition"),
        F.col("l_orderkey").alias("trial_idx"),
        F.col("l_linenumber").alias("rep"),
        F.when(status_f, "POSITIVE").when(F.col("o_orderstatus") == "O", "NEGATIVE").alias("ground_truth"),
        parsed.alias("parsed_output"),
    )
