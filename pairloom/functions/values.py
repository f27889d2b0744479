"""Equality of cells under a numeric tolerance."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: what counts as a number: no blanks, no hexadecimal, no type suffix
NUMBER = r"^[+-]?(?:(?i:inf|infinity|nan)|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"


def number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def values_equal(a: Column, b: Column, tolerance: float) -> Column:
    """Equal as strings, or both numbers within the tolerance, absolute or relative to
    the larger; null counts as the empty string."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    x, y = number(a), number(b)
    gap, top = F.abs(x - y), F.greatest(F.abs(x), F.abs(y))
    near = (gap <= tolerance) | ((top > 0) & (F.try_divide(gap, top) <= tolerance))
    # NaN is greater than all else in Spark, yet near to nothing
    near = near & ~F.isnan(gap)
    return (a == b) | F.coalesce(near, F.lit(False))


def values_equal_sql(a: str, b: str, tolerance: float) -> str:
    """The same for DuckDB."""
    guard = NUMBER.replace("'", "''")
    def num(c: str) -> str:
        return f"CASE WHEN regexp_matches({c}, '{guard}') THEN TRY_CAST({c} AS DOUBLE) END"
    a, b = f"coalesce({a}, '')", f"coalesce({b}, '')"
    x, y = num(a), num(b)
    gap, top = f"abs(({x}) - ({y}))", f"greatest(abs({x}), abs({y}))"
    return f"({a} = {b} OR coalesce(NOT isnan({gap}) AND ({gap} <= {tolerance} OR ({top} > 0 AND {gap} / nullif({top}, 0) <= {tolerance})), false))"
