"""Sources and sinks: trials, predictions, metrics, result tables."""

from recallscope.sources.io import (
    PREDICTION_COLUMNS,
    PREDICTION_SCHEMA,
    TRIAL_SCHEMA,
    append_predictions,
    csv_to_parquet,
    read_metrics,
    read_predictions,
    read_trials,
    with_positions,
    write_tables,
    write_text,
)

__all__ = [
    "PREDICTION_COLUMNS",
    "PREDICTION_SCHEMA",
    "TRIAL_SCHEMA",
    "append_predictions",
    "csv_to_parquet",
    "read_metrics",
    "read_predictions",
    "read_trials",
    "with_positions",
    "write_tables",
    "write_text",
]
