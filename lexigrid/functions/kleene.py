"""Three-valued logic: TRUE, FALSE and NULL for what the data don't settle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def and3(values: Column) -> Column:
    """Over an array; TRUE if it is empty. FALSE wins over NULL."""
    return F.forall(values, lambda v: v)


def or3(values: Column) -> Column:
    """Over an array; FALSE if it is empty. TRUE wins over NULL."""
    return F.exists(values, lambda v: v)


def and3_rows(value: Column) -> Column:
    """The same as an aggregate. bool_and would skip NULLs."""
    return F.when(F.count_if(~value) > 0, F.lit(False)).when(F.count_if(value.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def or3_rows(value: Column) -> Column:
    return F.when(F.count_if(value) > 0, F.lit(True)).when(F.count_if(value.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(False))


def compare_units(op: Column | str, n: Column, low: Column, high: Column) -> Column:
    """An interval of units against n: NULL if it straddles n. A NULL high is open: it never proves at most n."""
    op = F.lit(op) if isinstance(op, str) else op
    most = F.when(high <= n, True).when(low > n, False)
    same = F.when(low == high, low == n).when((low > n) | (high < n), False)
    least = F.when(low >= n, True).when(high < n, False)
    return F.when(low.isNull(), F.lit(None).cast("boolean")).when(op == "<=", most).when(op == "==", same).when(op == ">=", least)


def built(op: Column, cutoff_year: Column, year: Column) -> Column:
    """Built before or after a date of which the year decides; NULL in the year itself."""
    before = F.lower(op).isin("before", "on or before")
    return F.when(year.isNull() | (year == cutoff_year), F.lit(None).cast("boolean")).when(before, year < cutoff_year).otherwise(year > cutoff_year)
