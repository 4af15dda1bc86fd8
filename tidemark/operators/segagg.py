"""Segmented aggregation: first, last, min, max and sum by bin, and snapshots of the bin in progress.

Rows have an order (the ordering column, then tie-breaks); first and last follow it and don't depend on partitions. Bins are
one hash aggregate. Snapshots are made from partial aggregates by bin and slot (the stretch between two instants), laid on
the spine of instants and accumulated by a window within each bin, whose rows are instants, not data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.axis import Axis
from tidemark.operators.bins import BIN_COLUMNS, EdgeBins, TimeBins, binner, spread
from tidemark.operators.ordering import default_order, next_of, numbered

FUNCTIONS = ("first", "last", "min", "max", "sum")
Spec = dict[str, tuple[str, str]]


def check_spec(df: DataFrame, spec: Spec) -> None:
    for out, (column, function) in spec.items():
        if function not in FUNCTIONS:
            raise ValueError(f"unknown aggregation function {function!r} for {out!r}; there are {', '.join(FUNCTIONS)}")
        if column not in df.columns:
            raise ValueError(f"no column {column!r} to aggregate as {out!r}")


def _value(df: DataFrame, column: str, nan_is_null: bool) -> Column:
    value = F.col(column)
    if nan_is_null and df.schema[column].dataType.typeName() in ("double", "float"):
        return F.when(F.isnan(value), F.lit(None)).otherwise(value)
    return value


def _aggregate(function: str, value: Column, order: Column) -> Column:
    if function == "first":
        return F.min_by(value, order)
    if function == "last":
        return F.max_by(value, order)
    return {"min": F.min, "max": F.max, "sum": F.sum}[function](value)


def aggregates(df: DataFrame, spec: Spec, order: list[str], nan_is_null: bool = True) -> list[Column]:
    by = F.struct(*(F.col(f"`{c}`") for c in order))
    return [_aggregate(f, _value(df, c, nan_is_null), by).alias(out) for out, (c, f) in spec.items()]


def bins(df: DataFrame, spec: Spec, bin_by, ordered_on: str, bin_on: str | None = None, seq: list[str] | None = None, empty: bool = True, nan_is_null: bool = True, error_on_0: bool = False) -> DataFrame:
    """A row for each bin: bin_label, bin_start, bin_end and the aggregates.

    Empty bins between the first and the last one have nulls (with `empty`, for grids and edges). `error_on_0` fails the job
    where a result is 0.
    """
    check_spec(df, spec)
    by, column = binner(bin_by), bin_on or ordered_on
    order = default_order(df, ordered_on, seq)
    rows = by.assign(df, column, ordered_on, seq)
    extra = ["__origin"] if "__origin" in rows.columns else []
    found = rows.groupBy(*BIN_COLUMNS, *extra).agg(*aggregates(df, spec, order, nan_is_null))
    if empty and by.all_bins:
        every = by.all_bins(found, Axis.of(df, column))
        found = every.drop("__origin").join(found.select("bin_id", *spec), "bin_id", "left")
    found = found.select("bin_label", "bin_start", "bin_end", *spec)
    if error_on_0:
        zero = [n for n in spec if found.schema[n].dataType.typeName() in ("long", "integer", "double", "float")]
        for name in zero:
            found = found.withColumn(name, F.when(F.col(name) == 0, F.raise_error(F.lit(f"{name} is 0")).cast(found.schema[name].dataType)).otherwise(F.col(name)))
    return found


@dataclass(frozen=True)
class Instants:
    """Explicit observation points: a list or a frame of one column."""

    at: object

    def frame(self, df: DataFrame, column: str) -> DataFrame:
        kind = df.schema[column].dataType
        if isinstance(self.at, DataFrame):
            return self.at.select(F.col(self.at.columns[0]).cast(kind).alias("instant")).distinct()
        values = F.array(*(F.lit(x).cast(kind) for x in self.at)) if list(self.at) else F.array().cast(f"array<{kind.simpleString()}>")
        return df.sparkSession.range(1).select(F.explode(values).alias("instant")).distinct()


def snapper(by) -> TimeBins | Instants:
    if isinstance(by, str):
        return TimeBins(by)
    return by if isinstance(by, (TimeBins, Instants)) else Instants(by)


def snapshots(df: DataFrame, spec: Spec, bin_by, snap_by, ordered_on: str, bin_on: str | None = None, seq: list[str] | None = None, nan_is_null: bool = True) -> DataFrame:
    """A row for each instant: instant (its label), bin_label of the bin in progress and the aggregates so far, null if none.

    At an instant s the bin in progress is that with start < s <= end; its rows before s (left-closed) or up to s
    (right-closed) count. Instants on a grid run from the slot of the first row to the first one that covers the last row;
    explicit ones from the first given to that.
    """
    check_spec(df, spec)
    by, at, column = binner(bin_by), snapper(snap_by), bin_on or ordered_on
    left = by.closed == "left"
    if isinstance(at, TimeBins) and at.closed != by.closed:
        if snap_by is not at or at.closed != at.frequency.default_side:
            raise ValueError("bins and snapshots must be closed on the same side")
        at = TimeBins(at.freq, by.closed, at.label, at.origin, at.offset)
    axis, order = Axis.of(df, column), default_order(df, ordered_on, seq)
    rows = by.assign(df, column, ordered_on, seq)
    partial = aggregates(df, spec, order, nan_is_null)
    by_row = F.struct(*(F.col(f"`{c}`") for c in order))
    if isinstance(at, TimeBins):
        # Slot i ends at anchor i + 1; the grid's origin is the bins' where both are grids.
        own = rows.drop("__origin") if "__origin" in rows.columns and (at.origin is not None or at.offset) else rows
        own = own if "__origin" in own.columns else at.prepare(own, column)
        own = own.withColumn("__slot", at.index(axis.number(F.col(column))))
        parts = own.groupBy("bin_id", "__slot", "__origin").agg(*partial)
        ends = parts.agg(F.min("__slot").alias("__low"), F.max("__slot").alias("__high"), F.first("__origin").alias("__origin")).filter("__low is not null")
        spine = spread(ends, "__low", "__high", "__slot")
        spine = spine.withColumn("__point", axis.value(at.start(F.col("__slot") + 1))).withColumn("instant", axis.value(at.start(F.col("__slot") + (0 if at.label == "left" else 1))))
        parts = parts.drop("__origin")
    else:
        marks = numbered(at.frame(df, column), ["instant"], "__slot")
        own = next_of(rows, column, marks, "instant", inclusive=not left, out="__instant", payload=["__slot"])
        # Rows after the last instant are in no snapshot.
        parts = own.filter("__slot is not null").groupBy("bin_id", "__slot").agg(*partial)
        last = df.agg(F.max(column).alias("__last"))
        covers = marks.join(F.broadcast(last), (F.col("instant") > F.col("__last")) if left else (F.col("instant") >= F.col("__last"))).agg(F.min("__slot").alias("__cover"))
        spine = marks.join(F.broadcast(covers), F.col("__cover").isNull() | (F.col("__slot") <= F.col("__cover"))).select("__slot", F.col("instant").alias("__point"), "instant")
    spine = _bin_of(spine, by, rows, axis)
    joined = spine.join(parts, ["bin_id", "__slot"], "left")
    so_far = Window.partitionBy("bin_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("instant", "bin_label", *(_accumulated(f, out).over(so_far).alias(out) for out, (_, f) in spec.items()))


def _accumulated(function: str, name: str) -> Column:
    if function in ("first", "last"):
        return (F.first if function == "first" else F.last)(name, ignorenulls=True)
    return {"min": F.min, "max": F.max, "sum": F.sum}[function](name)


def _bin_of(spine: DataFrame, by, rows: DataFrame, axis: Axis) -> DataFrame:
    """Adds to each instant the bin with start < instant <= end."""
    if isinstance(by, TimeBins) and "__origin" in spine.columns:
        grid = TimeBins(by.freq, "right", by.label, by.origin, by.offset)
        micros = axis.number(F.col("__point"))
        origin = by._origin()
        spine = spine.withColumn("bin_id", by.frequency.index(micros - 1, origin))
        label = F.col("bin_id") + (0 if grid.label == "left" else 1)
        return spine.withColumn("bin_label", axis.value(by.start(label))).drop("__origin")
    known = rows.groupBy("bin_id", "bin_start", "bin_end", "bin_label").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    # The end of the last row bin isn't known; all later instants are its.
    bounded = known.filter("bin_end is not null").groupBy("bin_end").agg(F.min_by(F.struct("bin_id", "bin_start", "bin_label"), F.col("bin_id")).alias("b"))
    marks = bounded.select("bin_end", F.col("b.bin_id").alias("__id"), F.col("b.bin_start").alias("__start"), F.col("b.bin_label").alias("__label"))
    found = next_of(spine.drop("__origin"), "__point", marks, "bin_end", inclusive=True, out="__end", payload=["__id", "__start", "__label"])
    open_bin = known.filter("bin_end is null").agg(F.max("bin_id").alias("__open"), F.max("bin_label").alias("__open_label"), F.max("bin_start").alias("__open_start"))
    found = found.join(F.broadcast(open_bin))  # one row
    begun = F.col("__start").isNull() | (F.col("__start") < F.col("__point")) if isinstance(by, (EdgeBins, TimeBins)) else F.lit(True)
    inside = F.col("__end").isNotNull() & begun
    after = F.col("__end").isNull() & F.col("__open").isNotNull()
    found = found.withColumn("bin_id", F.when(inside, F.col("__id")).when(after, F.col("__open")))
    label = F.when(inside, F.col("__label")).when(after, F.col("__open_label"))
    return found.withColumn("bin_label", label).drop("__id", "__start", "__label", "__end", "__open", "__open_label", "__open_start")
