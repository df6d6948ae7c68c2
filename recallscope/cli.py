"""Command line over the library, for ``spark-submit`` or ``python -m recallscope.cli``.

    score    score the pending (trial, vendor, condition) items and append them
    analyze  write every result table (and optionally the chart data)
    convert  turn a CSV in the reference's dialect into Parquet, once

The session comes from ``SparkSession.builder.getOrCreate()``: on a cluster
the submit command brings master and configuration; run as plain Python it
is a local session.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from recallscope.design import DEFAULT_DESIGN
from recallscope.operators import scoring, worklist
from recallscope.plans import analysis
from recallscope.sources import io
from recallscope.sources.journal import FLUSH_ANSWERS


def _fmt(path: str, given: str | None) -> str:
    if given:
        return given
    return "csv" if path.rstrip("/").lower().endswith(".csv") else "parquet"


def _factory(spec: str):
    """``module:callable`` naming a scorer factory."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recallscope")
    sub = p.add_subparsers(dest="command", required=True)

    s = sub.add_parser("score", help="score pending items and append them to the prediction log")
    s.add_argument("--trials", required=True, help="trials table (CSV in the reference's layout, or Parquet)")
    s.add_argument("--trials-format", choices=("csv", "parquet"))
    s.add_argument("--predictions", required=True, help="prediction log (Parquet, appended)")
    s.add_argument("--max-trials", type=int, default=None, help="first N trials only")
    s.add_argument("--condition", choices=DEFAULT_DESIGN.conditions, default=None)
    s.add_argument("--vendor", choices=DEFAULT_DESIGN.vendors, default=None)
    s.add_argument("--dry-run", action="store_true", help="print the number of calls and stop")
    s.add_argument("--parallelism", type=int, default=None, help="concurrent scorer tasks")
    s.add_argument("--in-flight", type=int, default=1, help="calls at once in one task")
    s.add_argument("--scorer", default=None, help="module:factory of the scorer (not needed for --dry-run)")
    s.add_argument("--journal", default=None,
                   help="folder where answers are saved while tasks run (default: beside the log, with -journal at the end "
                        "of its name); it must lie on a store that Python tasks can write to")
    s.add_argument("--no-journal", action="store_true", help="save answers only when the job ends")
    s.add_argument("--key-index", action="store_true",
                   help="keep an index of the log's keys beside it and resume from that: only new log files are opened")
    s.add_argument("--flush-answers", type=int, default=FLUSH_ANSWERS, help="answers a task may hold unsaved")
    s.add_argument("--key-buckets", type=int, default=None,
                   help="also partition the log by a hash of the trial key (resume checks read only the buckets of "
                        "their keys); recorded with the log, another value is refused later")

    a = sub.add_parser("analyze", help="write every result table")
    a.add_argument("--predictions", required=True)
    a.add_argument("--predictions-format", choices=("csv", "parquet"))
    a.add_argument("--trials", default=None, help="trials table, for the section tables")
    a.add_argument("--trials-format", choices=("csv", "parquet"))
    a.add_argument("--output-dir", required=True)
    a.add_argument("--snapshot", action="store_true", help="publish all tables at once as a new version below _versions")
    a.add_argument("--charts", action="store_true", help="also write the data behind the charts")

    c = sub.add_parser("convert", help="reference-dialect CSV to Parquet")
    c.add_argument("--kind", choices=("trials", "predictions"), required=True)
    c.add_argument("--csv", required=True)
    c.add_argument("--out", required=True)
    return p


def _score(spark: SparkSession, args) -> None:
    trials = io.read_trials(spark, args.trials, _fmt(args.trials, args.trials_format))
    # positions from a key-less file are dense, so the limit is a pushed-down filter
    dense = _fmt(args.trials, args.trials_format) == "csv"
    vendors = [args.vendor] if args.vendor else None
    conditions = [args.condition] if args.condition else None
    if args.dry_run:
        limited = worklist.limit_trials(trials, args.max_trials, dense)
        row = worklist.count_worklist(limited, vendors=vendors, conditions=conditions).first()
        print(f"{row.n_trials} trials x {row.n_conditions} conditions x {row.n_vendors} vendors = {row.total_calls} calls")
        return
    if not args.scorer:
        raise SystemExit("--scorer module:factory is needed to make calls")
    failures = scoring.run_scoring(spark, trials, args.predictions, _factory(args.scorer),
                                   max_trials=args.max_trials, vendors=vendors, conditions=conditions,
                                   parallelism=args.parallelism, dense=dense, key_buckets=args.key_buckets,
                                   in_flight=args.in_flight, flush_answers=args.flush_answers,
                                   key_index=args.key_index,
                                   journal=None if args.no_journal else
                                   args.journal or f"{args.predictions.rstrip('/')}-journal")
    if failures.get("failed"):
        print(f"{failures['failed']} calls failed: {', '.join(sorted(failures['reasons']))}", file=sys.stderr)


def _analyze(spark: SparkSession, args) -> None:
    preds = io.read_predictions(spark, args.predictions, _fmt(args.predictions, args.predictions_format))
    trials = None
    if args.trials:
        trials = io.read_trials(spark, args.trials, _fmt(args.trials, args.trials_format))
    tables = analysis.analyze(spark, preds, args.output_dir, trials, charts=args.charts, snapshot=args.snapshot)
    print(f"Wrote {len(tables)} tables to {args.output_dir}")


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"recallscope-{args.command}").getOrCreate()
    if args.command == "score":
        _score(spark, args)
    elif args.command == "analyze":
        _analyze(spark, args)
    else:
        io.csv_to_parquet(spark, args.csv, args.out, kind=args.kind)
    return 0


if __name__ == "__main__":
    sys.exit(main())
