"""Groups of trial keys that share a state value.

A Python state processor pays a few milliseconds for every grouping key (round trips to the
JVM), and some microseconds for a row. A hash deals the trial keys, whatever they look like, to a
fixed number of groups (a group must stay the same for as long as a stream's checkpoint does):
the round trips of a micro-batch are bounded, and a group of a log with millions of
trials holds some hundreds or thousands of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = "_group"
KEY_GROUPS = 1 << 12


def key_group(groups: int = KEY_GROUPS) -> Column:
    return F.pmod(F.xxhash64("trial_idx"), F.lit(groups)).cast("int").alias(GROUP)
