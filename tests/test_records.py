"""CSV files with raw newlines read by many tasks: the same records as Spark's one task per file."""

import csv
import io as stdio
import os
import random
import tempfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from recallscope.sources import io
from recallscope.sources.records import _composed, _functions, ends_inside, read_csv, read_records
from tests.test_journal import _same

OPTIONS = io._CSV_OPTIONS


@pytest.fixture
def small_splits(spark):
    """Ranges of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1",
             "spark.sql.files.minPartitionNum": "64"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _write(text, name="a.csv", folder=None):
    folder = folder or tempfile.mkdtemp(prefix="records-", dir="/tmp")
    with open(f"{folder}/{name}", "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return folder


def _states(line, inside):
    """The automaton one character at a time: F field start, U unquoted, Q quoted, E quote seen in quotes."""
    state = "Q" if inside else "F"
    for c in line:
        if state == "F":
            state = {'"': "Q", ",": "F"}.get(c, "U")
        elif state == "U":
            state = "F" if c == "," else "U"
        elif state == "Q":
            state = "E" if c == '"' else "Q"
        else:
            state = {'"': "Q", ",": "F"}.get(c, "U")
    return state == "Q"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet='",ab \r', max_size=14), st.booleans())
def test_transition_of_a_line(line, inside):
    assert ends_inside(line, inside) == _states(line, inside)


def test_equals_multiline_reader(spark, small_splits):
    """Any fields, both line ends, quoted or not, ranges that begin and end anywhere: 25 files at once."""
    rng, folder, want = random.Random(8), tempfile.mkdtemp(prefix="records-", dir="/tmp"), []
    field = lambda: "".join(rng.choices('",\nab é', k=rng.randrange(9)))
    for i in range(25):
        rows = [("k" + field(), field(), field()) for _ in range(rng.randrange(1, 40))]
        out = stdio.StringIO()
        w = csv.writer(out, lineterminator=["\n", "\r\n"][i % 2], quoting=csv.QUOTE_ALL if i % 3 else csv.QUOTE_MINIMAL)
        w.writerows([("x", "y", "z"), *rows])
        _write(out.getvalue(), f"{i:02d}.csv", folder)
        want += [tuple(v or (None if not i % 3 else "") for v in r) for r in rows]
    got = read_csv(spark, folder, OPTIONS, position="n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(want))) and [tuple(r)[1:] for r in got] == want
    _same(read_csv(spark, folder, OPTIONS), spark.read.options(**OPTIONS).csv(folder))


def test_one_record_over_many_ranges(spark, small_splits):
    """A quoted field far longer than a range, full of line breaks, commas and quotes."""
    long = '\n'.join(f'line {i}, "quoted, text" {i}' for i in range(300))
    rows = [("a", "1"), ("b", long), ("c", "2"), ("d", long[::-1].replace('"', "'")), ("e", "")]
    out = stdio.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("k", "v"), *rows])
    path = _write(out.getvalue())
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 20
    records = read_records(spark, path)
    assert [r.record for r in records.orderBy("record").collect()] == list(range(6))
    got = read_csv(spark, path, OPTIONS, position="n").orderBy("n").collect()
    assert [(r.k, r.v) for r in got] == [(k, v or None) for k, v in rows]


def test_many_files_blank_lines_and_marks(spark, small_splits):
    """Files in path order, a header in each, blank lines and a byte order mark are no records; a
    quote inside an unquoted field is text; short rows are padded."""
    folder = _write('\ufeffa,b\n\n1,5" pipe\r\n\r\n2,"x\n\ny"\n3\n', "1.csv")
    _write('a,b\n"4","say ""hi"", ok"\n\n\n5,no end', "2.csv", folder)
    _write("a,b\n", "3.csv", folder)
    got = [tuple(r) for r in read_csv(spark, folder, OPTIONS, position="n").orderBy("n").collect()]
    assert got == [(0, "1", '5" pipe'), (1, "2", "x\n\ny"), (2, "3", None), (3, "4", 'say "hi", ok'), (4, "5", "no end")]
    with pytest.raises(ValueError, match="header"):
        read_csv(spark, _write(""), OPTIONS)


def test_composition_needs_no_other_range(spark):
    """The functions of ranges compose to what one pass over the whole file finds."""
    import pyarrow as pa

    text = 'h,i\n' + ''.join(f'{i},"a{"" if i % 3 else chr(10)}b""{i}"\n' for i in range(50)) + '"open\nend'
    lines = text.split("\n")
    whole = sum(1 for k, line in enumerate(lines) if line and not _inside(lines[:k]))
    for size in (1, 2, 7):
        batches = [pa.RecordBatch.from_arrays([pa.array(["f"] * size)[: len(part)], pa.array([k] * len(part), pa.int64()),
                                               pa.array([1] * len(part), pa.int64()), pa.array(part)], ["a", "b", "c", "d"])
                   for k in range(0, len(lines), size) for part in [lines[k : k + size]]]
        table = pa.Table.from_batches([b for batch in batches for b in _functions([batch])]).to_pandas()
        composed = _composed(table.sample(frac=1, random_state=1))
        assert list(composed["inside"]) == [_inside(lines[:k]) for k in range(0, len(lines), size)]
        last = table.sort_values("_start").iloc[-1]
        assert composed["before"].iloc[-1] + (last.in_n if composed["inside"].iloc[-1] else last.out_n) == whole


def _inside(lines):
    state = False
    for line in lines:
        state = _states(line, state)
    return state


def test_markers_in_predictions(spark):
    """NA, nan, None and quoted empties are missing in a predictions CSV as in a trials CSV."""
    rows = [("0", "openai", "m", "c", "NA", "ERROR", "POSITIVE"), ("1", "NA", "m", "nan", "", "INVALID", "None"),
            ("2", "gemini", "m", "c", " positive\n", "POSITIVE", "null")]
    out = stdio.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([io.PREDICTION_COLUMNS, *rows])
    got = [tuple(r) for r in io.read_predictions(spark, _write(out.getvalue()), fmt="csv").orderBy("trial_idx").collect()]
    assert got == [(0, "openai", "m", "c", None, "ERROR", "POSITIVE"), (1, None, "m", None, None, "INVALID", None),
                   (2, "gemini", "m", "c", " positive\n", "POSITIVE", None)]


def test_a_large_file_is_read_by_many_tasks(spark):
    """40 MB in one file, records of many lines: as many tasks as splits, equal to the multiLine read."""
    folder = tempfile.mkdtemp(prefix="records-", dir="/tmp")
    with open(f"{folder}/t.csv", "w", newline="") as f:
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["title", "abstract", "doi"])
        body = 'Background, "methods":\n results, and\n"conclusions" ' * 40
        for i in range(20000):
            w.writerow([f"T{i}", f"{i} {body[: 100 + i % 1900]}", f"10.1/{i}"])
    assert os.path.getsize(f"{folder}/t.csv") > 20_000_000
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert spark.read.text(folder).rdd.getNumPartitions() > 20
        got = read_csv(spark, folder, OPTIONS, position="n")
        assert got.where(F.col("doi") == F.concat(F.lit("10.1/"), F.col("n").cast("string"))).count() == 20000
        _same(got.drop("n"), spark.read.options(**OPTIONS).csv(folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
