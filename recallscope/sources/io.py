"""Readers and writers.

CSV input follows the reference's dialect (doubled quotes, raw newlines in
fields). Spark's own reader takes one task per file for it; trials and prediction
logs go through :mod:`recallscope.sources.records`, which reads ranges of one file in many
tasks. Converting a file once (:func:`csv_to_parquet`) spares later jobs the parsing.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.session import fresh_path, materialize, path_exists
from recallscope.sources.records import read_csv

TRIAL_SCHEMA = T.StructType([
    T.StructField("trial_idx", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstract", T.StringType()),
    T.StructField("annotation_accept", T.StringType()),
    T.StructField("doi", T.StringType()),
    T.StructField("counterfactual_title", T.StringType()),
    T.StructField("counterfactual_abstract", T.StringType()),
    T.StructField("target_label", T.StringType()),
    T.StructField("sections_modified", T.StringType()),
])

PREDICTION_COLUMNS = ("trial_idx", "vendor", "model", "condition", "raw_output", "parsed_output", "ground_truth")
PREDICTION_SCHEMA = T.StructType([
    T.StructField("trial_idx", T.LongType()),
    T.StructField("vendor", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("raw_output", T.StringType()),
    T.StructField("parsed_output", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
])

METRIC_SCHEMA = T.StructType([
    T.StructField("vendor", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()),
    T.StructField("n_total", T.LongType()),
    T.StructField("n_valid", T.LongType()),
    T.StructField("n_invalid", T.LongType()),
    T.StructField("n_error", T.LongType()),
    T.StructField("pct_valid", T.DoubleType()),
])

# An unquoted empty field is a missing value; a quoted one ("") an empty string.
# The NUL marker never occurs in text, so only unquoted empties become NULL.
_CSV_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"', "nullValue": "\u0000"}
# Spark's CSV writer trims values unless told otherwise; answers keep their padding.
CSV_WRITE_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false",
                     "ignoreTrailingWhiteSpace": "false"}


def _reader(spark: SparkSession, fmt: str, schema: T.StructType | None):
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.options(**_CSV_OPTIONS)
    return r.format(fmt)


POSITION = "__position"
# Largest file table (one row per input file) sent whole to every task.
POSITION_BROADCAST_LIMIT = 64 * 1024 * 1024


def with_positions(scan: DataFrame, fmt: str, name: str = "trial_idx",
                   broadcast_limit: int = POSITION_BROADCAST_LIMIT) -> DataFrame:
    """Add the 0-based row position of a file scan: files in path order
    (part files of one write sort in write order), rows in file order.

    Positions come from facts of the files, never from how a scan happens to be
    split, which may change between two executions: a Parquet row knows its index
    in its file; any other format is read once, numbered in that one execution
    (its files are not split) and copied to the shared folder, and everything
    else derives from the copy. A row count per file and a running sum over the
    files (one row each) give each file its first position. That table is
    materialized and measured: it is broadcast when its size is within
    ``broadcast_limit`` and joined by a shuffle otherwise. A row whose file has no
    entry fails the job.
    """
    spark = scan.sparkSession
    cols = [F.col(f"`{c}`") for c in scan.columns]
    file = F.col("_metadata.file_path").alias("_file")
    if fmt == "parquet":
        tagged = scan.select(file, F.col("_metadata.row_index").alias("_rid"), *cols)
    else:
        path = fresh_path(spark, "positions")
        scan.select(file, F.monotonically_increasing_id().alias("_rid"), *cols).write.parquet(path)
        tagged = spark.read.parquet(path)
    files = tagged.groupBy("_file").agg(F.min("_rid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    order = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = materialize(files.select("_file", (F.sum("_n").over(order) - F.col("_n") - F.col("_first")).alias("_base")))
    n_files, path_bytes = bases.agg(F.count(F.lit(1)), F.sum(F.length("_file"))).first()
    if (path_bytes or 0) + 24 * n_files <= broadcast_limit:
        bases = F.broadcast(bases)
    base = F.coalesce("_base", F.raise_error(F.concat(F.lit("no position for rows of "), F.col("_file"))).cast("long"))
    return tagged.join(bases, "_file", "left").select((F.col("_rid") + base).alias(name), *cols)


# The texts a CSV reader of the reference's kind takes for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
           "NULL", "NaN", "None", "n/a", "nan", "null")


def read_trials(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Trials table keyed by ``trial_idx``.

    A CSV in the reference's layout has no key column: the 0-based row
    position is the key (:func:`with_positions`, JVM-side; across several
    files, files count in path order). The label column is read
    case-insensitively as ``annotation_accept``. In a CSV the usual markers of
    a missing value, and a quoted empty field, are missing values.
    """
    if fmt == "csv":
        df = _marked(read_csv(spark, path, _CSV_OPTIONS, position=POSITION))
        if any(c.lower() == "trial_idx" for c in df.columns):
            df = df.drop(POSITION)
        else:
            df = df.withColumnRenamed(POSITION, "trial_idx")
    else:
        df = _reader(spark, fmt, None).load(path)
        if not any(c.lower() == "trial_idx" for c in df.columns):
            df = with_positions(df, fmt)
    rename = {c: c.lower() for c in df.columns if c.lower() in TRIAL_SCHEMA.names}
    df = df.select([F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns])
    if "sections_modified" not in df.columns:
        df = df.withColumn("sections_modified", F.lit(None).cast("string"))
    return df.select([F.col(f.name).cast(f.dataType) for f in TRIAL_SCHEMA.fields])


def _marked(df: DataFrame) -> DataFrame:
    """A CSV's markers of a missing value as NULL, in every text column."""
    return df.select([F.when(~F.col(f"`{f.name}`").isin(*MISSING), F.col(f"`{f.name}`")).alias(f.name)
                      if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Prediction log; an explicit schema keeps partition columns as strings. In a CSV the usual
    markers of a missing value, and a quoted empty field, are missing values, as in
    :func:`read_trials`; columns are found by name, one that is not there is missing."""
    if fmt == "csv":
        df = _marked(read_csv(spark, path, _CSV_OPTIONS))
        have = set(df.columns)
        return df.select([(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in PREDICTION_SCHEMA.fields])
    return _reader(spark, fmt, PREDICTION_SCHEMA).load(path).select(*PREDICTION_COLUMNS)


def read_metrics(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _reader(spark, fmt, METRIC_SCHEMA).load(path).select(*METRIC_SCHEMA.names)


def csv_to_parquet(spark: SparkSession, csv_path: str, out_path: str, kind: str = "predictions") -> None:
    """One-off conversion of a reference-dialect CSV to Parquet."""
    if kind == "trials":
        df = read_trials(spark, csv_path, fmt="csv")
    else:
        df = read_predictions(spark, csv_path, fmt="csv")
    df.write.mode("overwrite").parquet(out_path)


KEY_BUCKET = "key_bucket"
LAYOUT_FILE = "_layout.json"  # a hidden file of the log: Spark's readers skip it


def key_bucket(key_buckets: int) -> Column:
    """The bucket of a trial key: a hash, so any keys spread evenly."""
    return F.pmod(F.xxhash64("trial_idx"), F.lit(int(key_buckets))).cast("int").alias(KEY_BUCKET)


def log_layout(spark: SparkSession, path: str) -> dict | None:
    """How the log at ``path`` is partitioned; ``None`` when there is no log. A log
    without a record has the plain layout."""
    if not path_exists(spark, path):
        return None
    text = read_text(spark, f"{path.rstrip('/')}/{LAYOUT_FILE}")
    return json.loads(text) if text is not None else {"partition_by": ["vendor", "condition"], "key_buckets": None}


def check_layout(spark: SparkSession, path: str, partition_by=("vendor", "condition"), key_buckets: int | None = None) -> dict:
    """The layout asked for; an existing log of another layout is refused (its keys
    would be missed and scored again, or the log could no longer be read)."""
    wanted = {"partition_by": list(partition_by or ()), "key_buckets": int(key_buckets) if key_buckets else None}
    found = log_layout(spark, path)
    if found is not None and found != wanted:
        raise ValueError(f"the log at {path} has the layout {found}; asked for was {wanted}")
    return wanted


def append_predictions(df: DataFrame, path: str, partition_by=("vendor", "condition"),
                       key_buckets: int | None = None) -> None:
    """Append scored rows in one write per job or micro-batch.

    Partitioning by (vendor, condition) lets subset reruns, condition filters
    and the completed-key lookup prune whole directories; with ``key_buckets``
    the log is also partitioned by a hash of the trial key, so a resume check for
    some keys reads only their buckets. The layout is stored with the log and must
    stay the same. Rows are rebalanced by partition before the write (answers
    only, no texts), so a write makes files of the advisory partition size rather
    than one per task and partition, and sorted by trial key, so that a range
    filter skips row groups.
    """
    spark = df.sparkSession
    layout = check_layout(spark, path, partition_by, key_buckets)
    rows = df.select(*PREDICTION_COLUMNS)
    parts = list(partition_by or ())
    if key_buckets:
        rows = rows.withColumn(KEY_BUCKET, key_bucket(key_buckets))
        parts.append(KEY_BUCKET)
    if parts:
        rows = rows.hint("rebalance", *parts).sortWithinPartitions(*parts, "trial_idx")
    w = rows.write.mode("append")
    if parts:
        w = w.partitionBy(*parts)
    w.parquet(path)
    record = f"{path.rstrip('/')}/{LAYOUT_FILE}"
    if read_text(spark, record) is None:
        write_text(spark, record, json.dumps(layout))


def log_schema(spark: SparkSession, path: str) -> T.StructType:
    """The columns of the log, with the bucket column where it has one."""
    if not log_layout(spark, path)["key_buckets"]:
        return PREDICTION_SCHEMA
    return T.StructType([*PREDICTION_SCHEMA.fields, T.StructField(KEY_BUCKET, T.IntegerType())])


def read_log_keys(spark: SparkSession, path: str, buckets=None) -> DataFrame:
    """The log's rows, with the bucket column where it has one; ``buckets`` (of a
    bucketed log) is a partition filter, so other directories are not read."""
    layout = log_layout(spark, path)
    if not layout["key_buckets"]:
        return read_predictions(spark, path)
    log = spark.read.schema(log_schema(spark, path)).parquet(path)
    return log if buckets is None else log.where(F.col(KEY_BUCKET).isin(*buckets))


def write_tables(tables: dict[str, DataFrame], out_dir: str, fmt: str = "csv",
                 order_by: dict[str, list] | None = None, parallel: tuple[str, ...] = ()) -> None:
    """Overwrite each (small) result table as one file with a header.

    Result tables hold one row per setting, so a single output partition is
    cheap; the sort happens within that one partition only. Tables named in
    ``parallel`` have rows per value found in the data: they are range-sorted
    and written by many tasks, in file order.
    """
    order_by = order_by or {}
    for name, df in tables.items():
        if name in parallel:
            out = df.orderBy(*order_by[name]) if name in order_by else df
        else:
            out = df.coalesce(1)
            if name in order_by:
                out = out.sortWithinPartitions(*order_by[name])
        w = out.write.mode("overwrite")
        if fmt == "csv":
            w = w.options(**CSV_WRITE_OPTIONS)
        w.format(fmt).save(f"{out_dir.rstrip('/')}/{name}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file through Hadoop's FileSystem; ``None`` when there is none."""
    if not path_exists(spark, path):
        return None
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(jpath)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file (a rendered report) through Hadoop's
    FileSystem, so it lands as exactly these bytes on any shared store."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
