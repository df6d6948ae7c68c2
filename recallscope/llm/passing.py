"""Columns that only pass through an operator.

They travel as one struct, so none of them can clash with a column the operator
makes for itself, whatever it is called.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW = "__row"


def packed(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast("boolean").alias("__end")).alias(ROW)


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(ROW).getField(c).alias(c) for c in columns]
