"""Incremental versions of the scoring job and the metrics table."""

from recallscope.streaming.corrections import run_stream_metrics_deduped
from recallscope.streaming.jobs import run_stream_analysis, run_stream_metrics, stream_counts, stream_scoring

__all__ = ["run_stream_analysis", "run_stream_metrics", "run_stream_metrics_deduped", "stream_counts", "stream_scoring"]
