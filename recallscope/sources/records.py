"""Parallel reading of CSV files whose quoted fields hold raw newlines.

Whether a line break ends a record depends on all quotes before it, which is why Spark
reads such files (``multiLine``) with one task per file. Here any number of tasks
read ranges of one file:

1. The file is scanned as plain lines, which Spark splits anywhere. A line begins either
   outside quotes (a record starts) or inside; for both cases a range notes how it
   ends and how many records start in it. That pair is the range's transition
   function.
2. The functions of a file's ranges, composed in file order (a row per range), give
   every range its true beginning and the number of records before it.
3. The second scan joins lines to records. Only the record that is open where a range
   ends, and its continuations at the head of the next ranges, are put together by a
   shuffle. The records are written once to the shared folder, numbered in file order.
4. Spark's own CSV parser (``from_csv``) splits the records into fields.

The dialect is that of the reference's files: comma, double quote, quotes in quoted
fields doubled, lines ending in ``\\n`` or ``\\r\\n``, a header in each file. A quote inside
an unquoted field is text. Lines without any character outside quotes are no records.
"""

from __future__ import annotations

import csv
import io
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallscope.session import fresh_path, materialize

RANGE = ("_file", "_start", "_length")
RANGE_SCHEMA = "_file string, _start long, _length long"
BOM = "\ufeff"
SPLITS = "spark.sql.files.minPartitionNum"
# A row per range is sent to every task of the second scan: 24 bytes and the path.
RANGES_BROADCAST_LIMIT = 64 * 1024 * 1024


def ends_inside(line: str, inside: bool) -> bool:
    """Does a line that begins inside (or outside) quotes end inside them?"""
    if '"' not in line:
        return inside
    at, n = 0, len(line)
    while True:
        if not inside:  # at the start of a field
            if at < n and line[at] == '"':
                at, inside = at + 1, True
            else:
                at = line.find(",", at) + 1
                if at == 0:
                    return False
                continue
        close = line.find('"', at)
        if close < 0:
            return True
        if close + 1 < n and line[close + 1] == '"':  # a doubled quote is text
            at = close + 2
            continue
        at, inside = line.find(",", close + 1) + 1, False  # text between the quote and the comma belongs to the field
        if at == 0:
            return False


def _blank(line: str) -> bool:
    return line in ("", "\r", BOM)


def _ranges(batches):
    """(range, lines) runs of consecutive lines of one range, in order; a run may continue the one before."""
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        lines = batch.column(3).to_pylist()
        low = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[low]:
                yield keys[low], lines[low:i]
                low = i


def _functions(batches):
    """Of every range, for a beginning outside and inside quotes: the end, and the records that start."""
    found: dict[tuple, list] = {}
    for key, lines in _ranges(batches):
        f = found.setdefault(key, [False, 0, True, 0])
        for line in lines:
            for s in (0, 2):
                if not f[s] and not _blank(line):
                    f[s + 1] += 1
                f[s] = ends_inside(line, f[s])
    rows = [(*k, *f) for k, f in found.items()]
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                     [*RANGE, "out_end", "out_n", "in_end", "in_n"])


def _composed(ranges: pd.DataFrame) -> pd.DataFrame:
    """One file's ranges in order, each with its beginning and the records of the file before it."""
    ranges = ranges.sort_values("_start")
    inside, before, rows = False, 0, []
    for file, start, length, out_end, out_n, in_end, in_n in ranges.itertuples(index=False, name=None):
        rows.append((file, start, length, bool(inside), before))
        inside, before = (in_end, before + int(in_n)) if inside else (out_end, before + int(out_n))
    return pd.DataFrame(rows, columns=[*RANGE, "inside", "before"])


PIECE_SCHEMA = "_file string, record long, start long, whole boolean, text string"


def _pieces(batches):
    """Records by number. ``whole`` is false for the record that is open at the end of a range, and for
    what continues a record of an earlier range (``start`` orders its pieces)."""
    def flush(state, whole):
        if state["lines"] is not None:
            out.append((state["key"][0], state["record"], state["key"][1], whole, "\n".join(state["lines"])))
        state["lines"] = None

    state = {"key": None, "lines": None}
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for file, start, length, line, inside, before in zip(*columns):
            if state["key"] != (file, start, length):
                flush(state, False)
                state = {"key": (file, start, length), "inside": inside, "record": before - 1, "whole": not inside,
                         "lines": [] if inside else None}
            if start == 0 and state["record"] == -1 and line.startswith(BOM):
                line = line[1:]
            if not state["inside"]:
                flush(state, state["whole"])
                if not _blank(line):
                    state["record"] += 1
                    state["lines"], state["whole"] = [], True
            after = ends_inside(line, state["inside"])
            if state["lines"] is not None:
                state["lines"].append(line if after else line.removesuffix("\r"))
            state["inside"] = after
        yield _piece_batch(out)
    out = []
    flush(state, False)
    yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                      ["_file", "record", "start", "whole", "text"])


@contextmanager
def _pinned_splits(spark: SparkSession):
    """Both scans must cut the files alike: the number of splits must not follow the number of
    cores, which may change between them."""
    old = spark.conf.get(SPLITS, None)
    spark.conf.set(SPLITS, old or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(SPLITS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files, headers included: ``_file``, ``record`` (0-based in the file), ``text``."""
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        meta.getField("file_path").alias("_file"), meta.getField("file_block_start").alias("_start"),
        meta.getField("file_block_length").alias("_length"), "value")
    with _pinned_splits(spark):
        ranges = lines.mapInArrow(_functions, f"{RANGE_SCHEMA}, out_end boolean, out_n long, in_end boolean, in_n long")
        starts = materialize(ranges.groupBy("_file").applyInPandas(_composed, f"{RANGE_SCHEMA}, inside boolean, before long"))
        count, size = starts.agg(F.count(F.lit(1)), F.sum(F.length("_file") + 24)).first()
        if (size or 0) > RANGES_BROADCAST_LIMIT:
            raise ValueError(f"{count} file ranges are too many to send to every task; raise spark.sql.files.maxPartitionBytes")
        known = F.broadcast(starts.withColumnRenamed("before", "_before"))
        tagged = lines.join(known, list(RANGE), "left")
        before = F.coalesce("_before", F.raise_error(F.lit("the files or their splits changed between two scans")).cast("long"))
        pieces = tagged.select(*RANGE, "value", "inside", before.alias("_before")).mapInArrow(_pieces, PIECE_SCHEMA)
        copy = fresh_path(spark, "csv-records")
        pieces.write.parquet(copy)
    pieces = spark.read.schema(PIECE_SCHEMA).parquet(copy)
    joined = pieces.where("not whole").groupBy("_file", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p.getField("text")),
                     "\n").alias("text"))
    return pieces.where("whole").select("_file", "record", "text").unionByName(joined)


def read_csv(spark: SparkSession, path: str, options: dict, position: str | None = None) -> DataFrame:
    """CSV files as string columns named by the first file's header, as ``spark.read.csv`` with ``header``
    and ``multiLine`` gives them, but read by many tasks. With ``position`` that column holds
    the 0-based row position: files in path order, rows in file order."""
    records = read_records(spark, path)
    first = records.where("record = 0").orderBy("_file").select("text").first()
    if first is None:
        raise ValueError(f"{path} holds no header")
    names = next(csv.reader(io.StringIO(first.text, newline="")))
    schema = T.StructType([T.StructField(n or f"_c{i}", T.StringType()) for i, n in enumerate(names)])
    parser = {k: v for k, v in options.items() if k not in ("header", "multiLine")}
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
    rows = records.where("record > 0").select("_file", "record", F.from_csv("text", ddl, parser).alias("r"))
    columns = [F.col("r").getField(n).alias(n) for n in schema.names]
    if position is None:
        return rows.select(*columns)
    files = records.groupBy("_file").agg((F.count(F.lit(1)) - 1).alias("_n"))
    order = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = materialize(files.select("_file", (F.sum("_n").over(order) - F.col("_n") - 1).alias("_base")))
    return rows.join(bases, "_file").select((F.col("record") + F.col("_base")).alias(position), *columns)

