"""The ordering axis: integers, doubles and timestamps as numbers, without a session time zone for NTZ values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


class Axis:
    """How values of an ordering column become numbers (microseconds for timestamps) and back."""

    def __init__(self, kind: T.DataType):
        self.kind = kind
        self.is_time = isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if not (self.is_time or isinstance(kind, T.NumericType)):
            raise TypeError(f"cannot order on a column of type {kind.simpleString()}")

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Axis:
        return cls(df.schema[column].dataType)

    def number(self, value: Column) -> Column:
        if not self.is_time:
            return value
        if isinstance(self.kind, T.TimestampType):
            return F.unix_micros(value)
        return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), value.cast("timestamp_ntz"))

    def value(self, number: Column) -> Column:
        if not self.is_time:
            return number.cast(self.kind)
        if isinstance(self.kind, T.TimestampType):
            return F.timestamp_micros(number)
        return F.timestamp_add("MICROSECOND", number, F.expr(_EPOCH)).cast(self.kind)


def ntz(micros: Column) -> Column:
    """Microseconds since 1970 as a timestamp without time zone."""
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def ntz_micros(value: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), value)
