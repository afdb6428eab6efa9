"""Column expressions that state how missing values count.

Everything here stays inside Spark's own expressions, so the aggregates keep
their map-side partial step and the projections stay in generated code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c) -> Column:
    """Group sum that is NULL as soon as one value is NULL."""
    c = _col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sum_or_zero(c) -> Column:
    """Group sum over the values present; 0 when there are none."""
    return F.coalesce(F.sum(_col(c)), F.lit(0))


def null_count(c) -> Column:
    return F.count_if(_col(c).isNull())


def row_sum(*cols) -> Column:
    """Sum across columns; NULL when any is NULL."""
    return reduce(lambda a, b: a + b, [_col(c) for c in cols])


def row_sum_present(*cols) -> Column:
    """Sum across columns over the values present."""
    return reduce(lambda a, b: a + b, [F.coalesce(_col(c), F.lit(0)) for c in cols])


def ratio(num, den) -> Column:
    """``num / den``, NULL instead of an error or infinity on a zero base."""
    return _col(num) / F.nullif(_col(den), F.lit(0))


def relative_change(observed, base) -> Column:
    """``(observed - base) / base``."""
    return ratio(_col(observed) - _col(base), base)


def weighted_mean(value, weight) -> Column:
    """Group mean of ``value``; rows of weight 0 do not count, a NULL does."""
    value, weight = _col(value), _col(weight)
    unknown = weight.isNull() | ((weight != 0) & value.isNull())
    total = F.sum(F.when(weight != 0, value * weight))
    return F.when(F.count_if(unknown) == 0, ratio(total, F.sum(weight)))


def rounded(c, digits: int = 0) -> Column:
    """Round half up, once, on the shortest decimal that names the double: 1.005 gives 1.01."""
    return F.round(_col(c).cast("double"), digits)


def excluded(c, values) -> Column:
    """True unless the value is in the list; a NULL is not in the list."""
    return ~F.coalesce(_col(c).isin(list(values)), F.lit(False))


def null_above(c, cap) -> Column:
    c = _col(c)
    return F.when(c > cap, F.lit(None)).otherwise(c)


def null_below(c, least) -> Column:
    c = _col(c)
    return F.when(c >= least, c)


def finite(c) -> Column:
    """NULL for NaN and the infinities."""
    c = _col(c)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
