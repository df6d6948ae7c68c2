"""A resume index: which keys a prediction log holds, without reading the log.

Beside the log lies one row per (vendor, condition) and block of 32,768 trial keys, with
the block's keys in the smallest of three containers:

* ``full``: no payload, every key of the block is there (the usual end state);
* ``sparse``: the sorted offsets, for up to ``SPARSE`` keys;
* ``bitmap``: 4,096 bytes, one bit a key (Spark's ``bitmap_*`` functions).

A row holds at most 4 KB, so dense keys cost a bit each and scattered ones four bytes. The index
also names the log files it has seen: :func:`refresh` reads the key columns of the other
files only, merges them into the blocks they touch and publishes a new version. A log whose
files are all known is never opened, whatever its size; a file that was appended by another
job, or by a run that died before it could refresh the index, is simply one not seen yet.

The work to do is found by probing (an equi-join on the block, then a test of one bit), and
the remaining count from cardinalities alone: |trials and done| = |trials| + |done| - |either|.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallscope.design import DEFAULT_DESIGN, Design
from recallscope.session import path_exists
from recallscope.sources import io

BITS = 15
BLOCK = 1 << BITS
SPARSE = 1024  # offsets kept as a list; more become a bitmap
KEYS = ("vendor", "condition", "block")
CONTAINERS = "vendor string, condition string, block long, n int, offsets array<int>, bits binary"
KEPT_VERSIONS = 2  # the current one and the one that readers may still hold


def index_path(preds_path: str) -> str:
    return f"{preds_path.rstrip('/')}-keys"


def block(key: Column) -> Column:
    return F.shiftright(key.cast("long"), BITS)


def offset(key: Column) -> Column:
    return key.cast("long").bitwiseAND(F.lit(BLOCK - 1)).cast("int")


def _contained(n: Column, offsets: Column, bits: Column) -> list[Column]:
    """The smallest container for ``n`` keys."""
    return [n.cast("int").alias("n"), F.when(n <= SPARSE, F.sort_array(offsets)).alias("offsets"),
            F.when((n > SPARSE) & (n < BLOCK), bits).alias("bits")]


def containers(keys: DataFrame) -> DataFrame:
    """Containers of (trial_idx, vendor, condition) rows; repeated keys count once, rows with a
    missing part not at all. Offsets of a block are at most 32,768, combined per task first."""
    cells = keys.where("trial_idx is not null and vendor is not null and condition is not null").select(
        "vendor", "condition", block(F.col("trial_idx")).alias("block"), offset(F.col("trial_idx")).alias("at")).distinct()
    made = cells.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.collect_list("at").alias("offsets"),
                                    F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))
    return made.select(*KEYS, *_contained(F.col("n"), F.col("offsets"), F.col("bits")))


def _keys(sparse: DataFrame) -> DataFrame:
    """The keys of sparse containers, as rows."""
    at = F.explode("offsets").alias("at")
    rows = sparse.where("offsets is not null").select("vendor", "condition", "block", at)
    return rows.select((F.shiftleft("block", BITS) + F.col("at")).alias("trial_idx"), "vendor", "condition")


def merged(old: DataFrame, new_keys: DataFrame) -> DataFrame:
    """``old`` containers with more keys: blocks that get none stay as they are; of the others sparse
    ones are dealt with as keys, bitmaps by OR; full ones are full."""
    fresh = containers(new_keys)
    touched = fresh.select(*KEYS)
    hit = old.join(touched, list(KEYS), "left_semi")
    keys = new_keys.select("trial_idx", "vendor", "condition").unionByName(_keys(hit))
    cells = keys.where("trial_idx is not null and vendor is not null and condition is not null").select(
        "vendor", "condition", block(F.col("trial_idx")).alias("block"), offset(F.col("trial_idx")).alias("at")).distinct()
    lists = cells.groupBy(*KEYS).agg(F.collect_list("at").alias("offsets"),
                                     F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))
    whole = F.unhex(F.repeat(F.lit("FF"), BLOCK // 8))
    dense = hit.where("offsets is null").select(*KEYS, F.lit(None).cast("array<int>").alias("offsets"),
                                                F.when(F.col("n") == BLOCK, whole).otherwise(F.col("bits")).alias("bits"))
    either = lists.unionByName(dense).groupBy(*KEYS).agg(
        F.bitmap_or_agg("bits").alias("bits"), F.max("offsets").alias("offsets"))
    n = F.bitmap_count("bits")
    return old.join(touched, list(KEYS), "left_anti").unionByName(
        either.withColumn("n", n).select(*KEYS, *_contained(F.col("n"), F.col("offsets"), F.col("bits"))))


def _current(spark: SparkSession, path: str) -> dict | None:
    text = io.read_text(spark, f"{path}/_current.json")
    return json.loads(text) if text is not None else None


def read_index(spark: SparkSession, preds_path: str) -> DataFrame:
    """The containers of the current version; none where there is no index yet."""
    path = index_path(preds_path)
    now = _current(spark, path)
    if now is None:
        return spark.createDataFrame([], CONTAINERS)
    return spark.read.schema(CONTAINERS).parquet(f"{path}/v{now['version']}/containers")


def log_files(spark: SparkSession, preds_path: str) -> list[str]:
    """The data files of the log: one listing, nothing is opened."""
    return sorted(io.read_log_keys(spark, preds_path).inputFiles()) if path_exists(spark, preds_path) else []


def refresh(spark: SparkSession, preds_path: str) -> DataFrame:
    """Bring the index up to the log and return its containers.

    Only files it has not seen are read, and of those only the key columns. Versions are
    complete before ``_current.json`` names them, so a crash leaves the last one; the files
    of older versions but one are deleted. A log file that has vanished (a log that was
    rewritten) makes the index start anew.
    """
    path = index_path(preds_path)
    now = _current(spark, path)
    files = log_files(spark, preds_path)
    # the file list is a table of the version: a row per log file
    seen = set() if now is None else {r[0] for r in spark.read.parquet(f"{path}/v{now['version']}/files").collect()}
    if now is not None and not seen <= set(files):
        now, seen = None, set()
    new = [f for f in files if f not in seen]
    if now is not None and not new:
        return read_index(spark, preds_path)
    version = (_current(spark, path) or {"version": 0})["version"] + 1
    old = read_index(spark, preds_path) if now is not None else spark.createDataFrame([], CONTAINERS)
    if new:
        schema = io.log_schema(spark, preds_path)
        rows = spark.read.schema(schema).option("basePath", preds_path).parquet(*new).select("trial_idx", "vendor", "condition")
        merged(old, rows).write.mode("overwrite").parquet(f"{path}/v{version}/containers")
    else:
        old.write.mode("overwrite").parquet(f"{path}/v{version}/containers")
    spark.createDataFrame([(f,) for f in files], "file string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/v{version}/files")
    io.write_text(spark, f"{path}/_current.json", json.dumps({"version": version}))
    io.delete(spark, f"{path}/v{version - KEPT_VERSIONS}")
    return read_index(spark, preds_path)


def _has(key: Column) -> Column:
    """Is the key in the container of its block (all columns null: no container)?"""
    at = offset(key)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, 1)), 16, 10).cast("int")
    bit = F.getbit(byte, at.bitwiseAND(F.lit(7)))
    return (F.when(F.col("n") == BLOCK, True).when(F.col("offsets").isNotNull(), F.array_contains("offsets", at))
            .when(F.col("bits").isNotNull(), bit == 1).otherwise(False))


def pending_by_index(work: DataFrame, index: DataFrame) -> DataFrame:
    """W8 by probing: the work items whose key the index does not hold. An equi-join on (vendor,
    condition, block); a row with a missing key part matches nothing and stays."""
    probe = index.select(F.col("vendor").alias("_vendor"), F.col("condition").alias("_condition"),
                         F.col("block").alias("_block"), "n", "offsets", "bits")
    joined = work.withColumn("_key", block(F.col("trial_idx"))).join(
        probe, (F.col("vendor") == F.col("_vendor")) & (F.col("condition") == F.col("_condition")) &
        (F.col("_key") == F.col("_block")), "left")
    return joined.where(~_has(F.col("trial_idx"))).select(*work.columns)


def remaining_by_index(trials: DataFrame, index: DataFrame, design: Design = DEFAULT_DESIGN, vendors=None,
                       conditions=None) -> DataFrame:
    """W9 from cardinalities: the same four numbers as :func:`remaining_count` for trials with one row
    per key. Trials become bitmaps once; every setting's done keys are held against them."""
    from recallscope.operators.worklist import settings

    cells = settings(design, vendors, conditions)
    keys = trials.where("trial_idx is not null").select(block(F.col("trial_idx")).alias("block"),
                                                        offset(F.col("trial_idx")).cast("long").alias("at"))
    own = keys.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))
    own = own.select("block", "bits", F.bitmap_count("bits").alias("n_trials"))
    grid = F.inline(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(v).alias("vendor")) for c, v in cells]))
    listed = index.where("offsets is not null").select(*KEYS, F.explode("offsets").alias("at")).groupBy(*KEYS).agg(
        F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))
    dense = index.where("offsets is null").select(
        *KEYS, F.when(F.col("n") == BLOCK, F.unhex(F.repeat(F.lit("FF"), BLOCK // 8))).otherwise(F.col("bits")).alias("bits"))
    done = listed.unionByName(dense)
    sides = own.select("block", "bits", grid).select(*KEYS, "bits", F.lit(True).alias("work")).unionByName(
        done.withColumn("work", F.lit(False)))
    both = sides.groupBy(*KEYS).agg(F.bitmap_or_agg("bits").alias("either"), F.sum(F.bitmap_count("bits")).alias("n"),
                                    F.bool_or("work").alias("work"))
    shared = both.where("work").agg(F.coalesce(F.sum(F.col("n") - F.bitmap_count("either")), F.lit(0)).alias("shared"))
    completed = index.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_completed"))
    total = trials.agg((F.count(F.lit(1)) * F.lit(len(cells))).cast("bigint").alias("total_calls"))
    row = total.select("total_calls", completed.scalar().alias("n_completed"), shared.scalar().alias("shared"))
    return row.select("total_calls", "n_completed", (F.col("total_calls") - F.col("shared")).cast("bigint").alias("remaining"),
                      (F.col("total_calls") - F.col("n_completed")).alias("remaining_naive"))
