"""Row filters in disjunctive normal form, and the filters of incremental reads."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS = {"==": operator.eq, "=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
#: The filter id that lets every row pass.
NO_FILTER = "_"


def term(column: str, op: str, value=None) -> Column:
    if op in COMPARISONS:
        return COMPARISONS[op](F.col(column), value)
    if op == "in":
        return F.col(column).isin(list(value))
    if op == "not in":
        return ~F.col(column).isin(list(value))
    if op == "~":
        return ~F.col(column)
    raise ValueError(f"unknown operator {op!r} in a filter on {column!r}")


def normal_form(filters) -> list[list[tuple]]:
    """A list of lists of terms; a plain list of terms is one conjunction."""
    filters = list(filters)
    if filters and all(isinstance(x, tuple) for x in filters):
        return [filters]
    if not filters or not all(isinstance(x, list) and x for x in filters):
        raise ValueError("filters are a list (any) of lists (all) of (column, operator, value)")
    return filters


def dnf(filters: list[list[tuple]]) -> Column:
    """The condition of a list (any) of lists (all) of terms."""
    if not filters or not all(isinstance(x, list) for x in filters):
        raise ValueError("filters are a list (any) of lists (all) of (column, operator, value)")
    return reduce(operator.or_, (reduce(operator.and_, (term(*t) for t in conjunction)) for conjunction in filters))


def keep(df: DataFrame, filters) -> DataFrame:
    return df.filter(dnf(normal_form(filters)))


def fan_out(df: DataFrame, filters: dict[str, list | None]) -> dict[str, DataFrame]:
    """A branch for each filter id; '_' has no filter."""
    return {name: df if own is None or name == NO_FILTER else keep(df, own) for name, own in filters.items()}


def tagged(df: DataFrame, filters: dict[str, list | None], out: str = "filter_id") -> DataFrame:
    """All branches in one scan: a row once for each filter that it passes."""
    ids = [F.when(F.lit(True) if own is None or name == NO_FILTER else dnf(normal_form(own)), F.lit(name)) for name, own in filters.items()]
    return df.withColumn(out, F.explode(F.array_compact(F.array(*ids))))


def trim_start(df: DataFrame, ordered_on: str, restart) -> DataFrame:
    """Rows at or after the restart index; all where there is none."""
    return df if restart is None else df.filter(F.col(ordered_on) >= F.lit(restart))


def discard_last(df: DataFrame, ordered_on: str) -> DataFrame:
    """All rows but those at the greatest value: that group may still grow."""
    last = df.agg(F.max(ordered_on).alias("__last"))
    return df.join(F.broadcast(last), F.col(ordered_on) < F.col("__last")).drop("__last")  # one row


def in_range(df: DataFrame, ordered_on: str, start=None, end_excl=None) -> DataFrame:
    """Rows in [start, end_excl); None is no bound."""
    if start is not None:
        df = df.filter(F.col(ordered_on) >= F.lit(start))
    return df if end_excl is None else df.filter(F.col(ordered_on) < F.lit(end_excl))


def checked_order(df: DataFrame, ordered_on: str) -> DataFrame:
    """The frame; a null in the ordering column fails the job."""
    message = F.lit(f"null in the ordering column {ordered_on}")
    return df.withColumn(ordered_on, F.when(F.col(ordered_on).isNull(), F.raise_error(message).cast(df.schema[ordered_on].dataType)).otherwise(F.col(ordered_on)))


