"""String expressions with the exact semantics of the reference's Python."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from recallscope.design import LABELS, STATUS_ERROR, STATUS_INVALID

# Python's str.strip() removes every character for which str.isspace() holds;
# Spark's trim() removes only U+0020. Derive the set by that rule.
WHITESPACE = "".join(ch for ch in map(chr, range(sys.maxunicode + 1)) if ch.isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def python_strip(c) -> Column:
    """``str.strip()`` as a Spark expression."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def parse_output(raw) -> Column:
    """Raw answer -> POSITIVE / NEGATIVE / INVALID / ERROR.

    NULL (no answer) is ERROR; otherwise strip + upper-case must equal one
    of the two labels exactly, else INVALID.
    """
    raw = _col(raw)
    norm = F.upper(python_strip(raw))
    out = F.when(raw.isNull(), F.lit(STATUS_ERROR))
    for label in LABELS:
        out = out.when(norm == F.lit(label), F.lit(label))
    return out.otherwise(F.lit(STATUS_INVALID))


def format_fixed(x, digits: int) -> Column:
    """``f"{x:.Nf}"`` for 0 <= x < 1000.

    ``format_number`` rounds the exact binary value half-to-even, as Python's
    formatting does; ``format_string('%.2f')`` does not.
    """
    return F.format_number(_col(x), digits)


def format_ci(value, lower, upper, digits: int = 2) -> Column:
    """``0.96 (0.94-0.99)``; ``N/A`` when the value is undefined."""
    value = _col(value)
    text = F.concat(
        format_fixed(value, digits), F.lit(" ("), format_fixed(lower, digits),
        F.lit("-"), format_fixed(upper, digits), F.lit(")"),
    )
    return F.when(value.isNull(), F.lit("N/A")).otherwise(text)
