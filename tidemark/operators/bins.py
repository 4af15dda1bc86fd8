"""Binners: which contiguous bin of ordered rows a row belongs to.

A binner adds `bin_id` (orderable), `bin_start`, `bin_end` and `bin_label` to rows. Time bins and edges are intervals of the
binning column: closed on the left (start <= x < end) or right (start < x <= end), labelled by their start or end. Row bins
count rows; flag bins begin where a condition holds; grouped bins take a user function over all rows of a group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.functions.axis import Axis
from tidemark.functions.frequency import DAY, Frequency
from tidemark.operators.ordering import default_order, next_of, numbered, running_count
from tidemark.sources.scratch import settled

BIN_COLUMNS = ("bin_id", "bin_start", "bin_end", "bin_label")
#: Up to so many edges given as a list are searched within the row; more go through an ordered union.
INLINE_EDGES = 64
#: Rows of a batch that a user function's worker gives back.
PANDAS_ROWS = 10_000
NAMED_ORIGINS = ("start", "end", "start_day", "end_day", "epoch")


def check_side(name: str, side: str | None) -> None:
    if side not in ("left", "right"):
        raise ValueError(f"{name} must be 'left' or 'right', not {side!r}")


@dataclass(frozen=True)
class TimeBins:
    """A grid of a frequency. The origin of fixed steps is midnight of the first row's day ("start_day"), unless one is given: a
    time, or "epoch", "start", "end" (the first and last row's time) or "end_day" (midnight after the last row's day). `offset`
    moves the grid, that of weeks and calendar units too."""

    freq: str
    closed: str | None = None
    label: str | None = None
    origin: object = None
    offset: str | None = None

    def __post_init__(self):
        side = self.frequency.default_side
        object.__setattr__(self, "closed", self.closed or side)
        object.__setattr__(self, "label", self.label or side)
        check_side("closed", self.closed)
        check_side("label", self.label)

    @property
    def frequency(self) -> Frequency:
        return Frequency.parse(self.freq)

    def prepare(self, df: DataFrame, column: str) -> DataFrame:
        """Adds __origin, the grid's origin in microseconds (null for calendar grids)."""
        axis = Axis.of(df, column)
        if not axis.is_time:
            raise TypeError(f"time bins need a timestamp column, {column} is {axis.kind.simpleString()}")
        if self.frequency.is_calendar or self.frequency.unit == "W":
            return df.withColumn("__origin", F.lit(None).cast("long"))
        if self.origin is not None and self.origin not in NAMED_ORIGINS:
            given = F.lit(self.origin) if isinstance(self.origin, int) else axis.number(F.lit(self.origin).cast(axis.kind))
            return df.withColumn("__origin", given + self._shift)
        low, high = axis.number(F.col("__first")), axis.number(F.col("__last"))
        own = {"start": low, "end": high, "epoch": F.lit(0).cast("long"), "end_day": high + F.pmod(-high, F.lit(DAY))}.get(self.origin, low - F.pmod(low, F.lit(DAY)))
        ends = df.agg(F.min(column).alias("__first"), F.max(column).alias("__last"))
        return df.join(F.broadcast(ends.select((own + self._shift).alias("__origin"))))  # one row

    @property
    def _shift(self) -> int:
        return Frequency.parse(self.offset).step if self.offset else 0

    @property
    def _moved(self) -> int:
        """What moves anchors that have no origin."""
        return self._shift if self.frequency.is_calendar or self.frequency.unit == "W" else 0

    def _origin(self) -> Column | None:
        return None if self.frequency.is_calendar or self.frequency.unit == "W" else F.col("__origin")

    def index(self, micros: Column) -> Column:
        """The bin of a time in microseconds."""
        micros = micros - self._moved
        if self.closed == "left":
            return self.frequency.index(micros, self._origin())
        if self.frequency.ends:  # whole days belong to the period that their day ends
            micros = micros - F.pmod(micros, F.lit(DAY))
        return self.frequency.index(micros - 1, self._origin())

    def start(self, i: Column) -> Column:
        return self.frequency.anchor(i, self._origin()) + self._moved

    def assign(self, df: DataFrame, column: str, ordered_on: str | None = None, seq: list[str] | None = None) -> DataFrame:
        axis = Axis.of(df, column)
        df = self.prepare(df, column).withColumn("bin_id", self.index(axis.number(F.col(column))).cast("long"))
        df = df.withColumn("bin_start", axis.value(self.start(F.col("bin_id")))).withColumn("bin_end", axis.value(self.start(F.col("bin_id") + 1)))
        return df.withColumn("bin_label", F.col("bin_start" if self.label == "left" else "bin_end"))

    def all_bins(self, bins: DataFrame, axis: Axis) -> DataFrame:
        """Every bin from the first to the last one of `bins` (which has bin_id and __origin)."""
        ends = bins.agg(F.min("bin_id").alias("__low"), F.max("bin_id").alias("__high"), F.first("__origin").alias("__origin"))
        rows = spread(ends.filter("__low is not null"), "__low", "__high", "bin_id")
        rows = rows.withColumn("bin_start", axis.value(self.start(F.col("bin_id")))).withColumn("bin_end", axis.value(self.start(F.col("bin_id") + 1)))
        return rows.withColumn("bin_label", F.col("bin_start" if self.label == "left" else "bin_end")).select(*BIN_COLUMNS, "__origin")


def spread(df: DataFrame, low: str, high: str, out: str, block: int = 1 << 12) -> DataFrame:
    """Each row with all integers from `low` to `high`, made in two steps so that no row holds the whole range."""
    blocks = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col(high) - F.col(low), F.lit(block)))
    df = df.withColumn("__block", F.explode(blocks))
    first = F.col(low) + F.col("__block") * block
    return df.withColumn(out, F.explode(F.sequence(first, F.least(first + (block - 1), F.col(high))))).drop("__block", low, high)


@dataclass(frozen=True)
class EdgeBins:
    """Bins between given ends: a list, or a frame with the ends in its first column (and labels in the second one)."""

    ends: object
    closed: str = "left"
    labels: list | None = None

    def __post_init__(self):
        check_side("closed", self.closed)
        if not isinstance(self.ends, DataFrame):
            ends = list(self.ends)
            if any(a >= b for a, b in zip(ends, ends[1:], strict=False)):
                raise ValueError("ends must rise strictly")
            if self.labels is not None and len(self.labels) != len(ends):
                raise ValueError("there must be a label for each end")

    def _marks(self, df: DataFrame, column: str) -> DataFrame:
        kind = df.schema[column].dataType
        if isinstance(self.ends, DataFrame):
            names = self.ends.columns
            marks = self.ends.select(F.col(names[0]).cast(kind).alias("__end"), F.col(names[1] if len(names) > 1 else names[0]).alias("__label"))
            marks = numbered(marks, ["__end"], "__n")
            before = marks.select((F.col("__n") + 1).alias("__n"), F.col("__end").alias("__start"))
            return marks.join(before, "__n", "left").drop("__n")
        else:
            labels = self.labels or list(self.ends)
            starts = [None, *list(self.ends)[:-1]]
            rows = [F.struct(F.lit(e).cast(kind).alias("__end"), (F.lit(x) if self.labels else F.lit(x).cast(kind)).alias("__label"), F.lit(s).cast(kind).alias("__start")) for e, x, s in zip(self.ends, labels, starts, strict=True)]
            return df.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("m")).select("m.*")

    def assign(self, df: DataFrame, column: str, ordered_on: str | None = None, seq: list[str] | None = None) -> DataFrame:
        """Rows after the last end are in no bin and are left out."""
        kind = df.schema[column].dataType
        axis = Axis(kind)
        if not isinstance(self.ends, DataFrame) and len(self.ends) <= INLINE_EDGES:
            ends = F.array(*(F.lit(e).cast(kind) for e in self.ends))
            before = F.filter(ends, lambda e: (e <= F.col(column)) if self.closed == "left" else (e < F.col(column)))
            df = df.withColumn("__i", F.size(before)).filter(F.col("__i") < len(self.ends))
            labels = ends if self.labels is None else F.array(*(F.lit(x) for x in self.labels))
            df = df.withColumn("bin_start", F.get(ends, F.col("__i") - 1)).withColumn("bin_end", F.get(ends, F.col("__i"))).withColumn("bin_label", F.get(labels, F.col("__i")))
        else:
            df = next_of(df, column, self._marks(df, column), "__end", inclusive=self.closed == "right", out="bin_end", payload=["__start", "__label"])
            df = df.filter("bin_end is not null").withColumnsRenamed({"__start": "bin_start", "__label": "bin_label"})
        return df.withColumn("bin_id", axis.number(F.col("bin_end"))).drop("__i")

    def all_bins(self, bins: DataFrame, axis: Axis) -> DataFrame:
        marks = self._marks(bins.withColumn("__kind", F.col("bin_end")), "__kind")
        ends = bins.agg(F.min("bin_end").alias("__low"), F.max("bin_end").alias("__high"))
        marks = marks.join(F.broadcast(ends), F.col("__end").between(F.col("__low"), F.col("__high")))  # one row
        return marks.select(axis.number(F.col("__end")).alias("bin_id"), F.col("__start").alias("bin_start"), F.col("__end").alias("bin_end"), F.col("__label").alias("bin_label"))


@dataclass(frozen=True)
class RowBins:
    """Bins of n rows in order; the label is the first row's value of the ordering column.

    Left-closed, a bin ends where the next one begins (the last one's end isn't known: null); right-closed at its last value.
    `first_row` continues a count: the number of rows that earlier runs put in the bin still open.
    """

    n: int = 4
    closed: str = "left"
    first_row: int = 0

    def __post_init__(self):
        check_side("closed", self.closed)
        if self.n < 1:
            raise ValueError("a bin needs at least one row")

    def assign(self, df: DataFrame, column: str, ordered_on: str | None = None, seq: list[str] | None = None) -> DataFrame:
        order = default_order(df, ordered_on or column, seq)
        rows = numbered(df, order, "__rn")
        rows = rows.withColumn("bin_id", F.call_function("div", F.col("__rn") + self.first_row, F.lit(self.n))).drop("__rn")
        return _ends_from_rows(rows, column, self.closed)

    all_bins = None


def _ends_from_rows(rows: DataFrame, column: str, closed: str) -> DataFrame:
    """Start, end and label of bins made of rows, whose numbers follow each other: from each bin's first and last value. The
    rows are read twice."""
    ends = rows.groupBy("bin_id").agg(F.min(column).alias("bin_start"), F.max(column).alias("__last"))
    after = ends.select((F.col("bin_id") - 1).alias("bin_id"), F.col("bin_start").alias("__next"))
    ends = ends.join(after, "bin_id", "left")
    ends = ends.select("bin_id", "bin_start", F.col("__next" if closed == "left" else "__last").alias("bin_end"), F.col("bin_start").alias("bin_label"))
    return rows.join(ends, "bin_id")


@dataclass(frozen=True)
class FlagBins:
    """A bin begins at each row where the condition holds; rows before the first such row are the bin 0."""

    starts: Column = field(compare=False)
    closed: str = "left"

    def assign(self, df: DataFrame, column: str, ordered_on: str | None = None, seq: list[str] | None = None) -> DataFrame:
        order = default_order(df, ordered_on or column, seq)
        return _ends_from_rows(settled(running_count(df, F.coalesce(self.starts, F.lit(False)), order, "bin_id"), "bins"), column, self.closed)

    all_bins = None


@dataclass(frozen=True)
class GroupedBins:
    """Bins by a user function over the pandas rows of each group, in order; it returns a bin number for each row.

    The function sees one group at a time in one task, so a group must fit a worker's memory: the group column is the
    caller's, and is part of the bin's identity. A worker holds a group's columns once, with the numbers; nulls come last.
    """

    function: Callable = field(compare=False)
    group: str = ""
    closed: str = "left"

    def assign(self, df: DataFrame, column: str, ordered_on: str | None = None, seq: list[str] | None = None) -> DataFrame:
        order, run, names = default_order(df, ordered_on or column, seq), self.function, df.columns

        # Within the function, so that it goes to workers with it.
        class Grown:
            """An array that grows in place, so that a group's batches and the whole group are never held together."""

            def __init__(self):
                self._held, self._n = None, 0

            def add(self, more: np.ndarray) -> None:
                if self._held is None:
                    self._held = np.empty(len(more), more.dtype)
                if self._held.dtype != more.dtype:  # numbers with and without nulls
                    self._held = self._held.astype(np.result_type(self._held.dtype, more.dtype))
                end = self._n + len(more)
                if end > len(self._held):
                    self._held.resize(max(end, len(self._held) * 5 // 4), refcheck=False)
                self._held[self._n : end] = more
                self._n = end

            def values(self) -> np.ndarray:
                self._held.resize(self._n, refcheck=False)
                return self._held

        def numbered_group(held):
            pdf = pd.DataFrame({c: held.pop(c).values() for c in names}, copy=False)
            found = run(pdf)
            if len(found) != len(pdf):
                raise ValueError("the binner must return a number for each row")
            found = np.fromiter(map(int, found), "int64", len(pdf))
            if (found[1:] < found[:-1]).any():
                raise ValueError("bin numbers must not fall")
            for at in range(0, len(pdf), PANDAS_ROWS):
                yield pdf[at : at + PANDAS_ROWS][names].assign(__local=found[at : at + PANDAS_ROWS])

        def numbers(batches):
            held = {}
            for batch in batches:
                starts = np.flatnonzero(batch.pop("__starts").to_numpy(dtype=bool))
                for a, b in zip([0, *starts], [*starts, len(batch)], strict=True):
                    if held and a in starts:
                        yield from numbered_group(held)
                    if a < b:
                        for c in names:
                            held.setdefault(c, Grown()).add(batch[c].to_numpy()[a:b])
            if held:
                yield from numbered_group(held)

        schema = StructType([*df.schema.fields, StructField("__local", LongType())])
        within = Window.partitionBy(self.group).orderBy(*(F.col(f"`{c}`").asc_nulls_last() for c in order))
        rows = settled(df.withColumn("__starts", F.row_number().over(within) == 1).mapInPandas(numbers, schema), "grouped")
        firsts = rows.groupBy(self.group, "__local").agg(F.min(column).alias("__first"))
        firsts = numbered(firsts, ["__first", self.group, "__local"], "bin_id")
        same = F.col(f"r.`{self.group}`").eqNullSafe(F.col(f"f.`{self.group}`")) & (F.col("r.__local") == F.col("f.__local"))
        rows = rows.alias("r").join(firsts.alias("f"), same).select(*(F.col(f"r.`{c}`") for c in names), "bin_id")
        return _ends_from_rows(settled(rows, "bins"), column, self.closed)

    all_bins = None


def binner(by) -> object:
    """A binner from a binner, a frequency, a number of rows or a list of ends."""
    if isinstance(by, str):
        return TimeBins(by)
    if isinstance(by, int):
        return RowBins(by)
    if isinstance(by, (list, tuple, DataFrame)):
        return EdgeBins(by)
    if hasattr(by, "assign"):
        return by
    raise TypeError(f"not a binner: {by!r}")
