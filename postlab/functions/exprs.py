"""Column expressions shared by operators. All JVM-side (no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlab.schema import MONTH_NAMES

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and +/-inf become null (the null rule of the whole library)."""
    c = col_(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def safe_div(a, b) -> Column:
    """a / b as double; x/0 and 0/0 give null (ANSI '/' would throw)."""
    return finite(F.try_divide(col_(a).cast("double"), col_(b).cast("double")))


def month_number(c) -> Column:
    """English month name -> 1..12; unknown or null -> 1."""
    pairs = []
    for i, name in enumerate(MONTH_NAMES, start=1):
        pairs += [F.lit(name), F.lit(i)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col_(c)), F.lit(1))


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, INTEGRAL_TYPES)


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after checking it holds at most ``max_rows`` rows.

    The check is a bounded ``limit(max_rows + 1).count()``; beyond the bound the frame is returned
    unhinted and the join stays a shuffle (sort-merge) join chosen by Catalyst/AQE.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def safe_corr(a, b) -> Column:
    """Pairwise-complete Pearson correlation; a constant side gives null instead of an ANSI error."""
    a, b = col_(a).cast("double"), col_(b).cast("double")
    a2 = F.when(b.isNotNull(), a)
    b2 = F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a2, b2), F.stddev_pop(a2) * F.stddev_pop(b2))
