"""Classification statistics over confusion counts.

Undefined values are NULL (never NaN): ``try_divide`` gives NULL on a zero
denominator, and NULL sorts and compares the way the reference's NaN-guards
intend. Operation order follows the reference so results are bit-equal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(c) -> Column:
    return _col(c).cast("double")


def accuracy(tp, fn, fp, tn) -> Column:
    n = _col(tp) + _col(fn) + _col(fp) + _col(tn)
    return F.try_divide(_d(_col(tp) + _col(tn)), _d(n))


def _class_f1(hit, miss_a, miss_b) -> Column:
    # 2tp / (2tp + fp + fn); 0 when the class never occurs (scikit-learn default)
    two = _col(hit) * 2
    return F.coalesce(F.try_divide(_d(two), _d(two + _col(miss_a) + _col(miss_b))), F.lit(0.0))


def f1_macro(tp, fn, fp, tn) -> Column:
    """Mean of the POSITIVE and NEGATIVE class F1; NULL when no valid pair."""
    n = _col(tp) + _col(fn) + _col(fp) + _col(tn)
    mean = (_class_f1(tp, fp, fn) + _class_f1(tn, fn, fp)) / F.lit(2.0)
    return F.when(n > 0, mean)


def sensitivity(tp, fn) -> Column:
    return F.try_divide(_d(tp), _d(_col(tp) + _col(fn)))


def specificity(tn, fp) -> Column:
    return F.try_divide(_d(tn), _d(_col(tn) + _col(fp)))


def wald_ci(p, n, z: float = 1.96) -> Column:
    """Normal-approximation interval as struct(lower, upper), clipped to [0, 1].

    NULL bounds when n is 0 or p is undefined; the guard comes first because
    greatest/least skip NULLs.
    """
    p, n = _col(p), _col(n)
    se = F.sqrt(p * (F.lit(1.0) - p) / _d(n))
    undefined = p.isNull() | n.isNull() | (n == 0)
    lower = F.when(~undefined, F.greatest(F.lit(0.0), p - F.lit(z) * se))
    upper = F.when(~undefined, F.least(F.lit(1.0), p + F.lit(z) * se))
    return F.struct(lower.alias("lower"), upper.alias("upper"))
