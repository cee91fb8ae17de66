"""Division with a stated result where Spark's ANSI mode would stop the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def over(a: Column | float, b: Column | float) -> Column:
    """``a / b``, null where b is zero: a statistic without spread has no value. Plain numbers are divided as ever."""
    if not isinstance(a, Column) and not isinstance(b, Column):
        return a / b
    return F.try_divide(*(x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b)))
