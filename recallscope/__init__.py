"""recallscope: audit labelled predictions at scale with PySpark.

Builds the scoring worklist and prompts for a set of input conditions,
runs a pluggable scorer as a resumable batch or streaming job, normalises
raw answers, and computes classification metrics, comparison tables,
section statistics and report tables as Spark aggregations.
"""

from recallscope.design import Design, DEFAULT_DESIGN

__all__ = ["Design", "DEFAULT_DESIGN"]
