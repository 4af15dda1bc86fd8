"""Several datasets along their common axis: cut at edges, interval by interval or all at once.

The edges are the starts of all datasets' files but their first ones (a start equal to the file before's greatest value is
none), or a list, or a frequency. They come from manifests, so planning opens no data. Intervals can be walked one after the other, or all rows can
carry their interval's number, for joins and co-groups on it that run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frequency import Frequency, floor_value
from tidemark.operators.ordering import next_of


def common_order(datasets: dict) -> str:
    names = {d.ordered_on for d in datasets.values()}
    if len(names) != 1:
        raise ValueError(f"the datasets are ordered on different columns: {sorted(map(str, names))}")
    return names.pop()


def _in_range(files, start, end_excl) -> list:
    return [f for f in files if (start is None or f.high >= start) and (end_excl is None or f.low < end_excl)]


def file_starts(files) -> list:
    """Values at which a new file begins; runs of files that share a value go together."""
    return [b.low for a, b in zip(files, files[1:], strict=False) if b.low != a.high]


@dataclass
class Intersections:
    datasets: dict
    ordered_on: str
    edges: list
    start: object = None
    end_excl: object = None

    @property
    def intervals(self) -> list[tuple]:
        """[start, end) of each interval; None is open."""
        if not self.datasets:
            return []
        return list(zip([self.start, *self.edges], [*self.edges, self.end_excl], strict=True))

    def __len__(self) -> int:
        return len(self.intervals)

    def __iter__(self) -> Iterator[dict[object, DataFrame]]:
        for start, end in self.intervals:
            yield {key: d.read(start=start, end_excl=end) for key, d in self.datasets.items()}

    def numbered(self, key) -> DataFrame:
        """A dataset's rows in the range with interval_id, from 0."""
        df = self.datasets[key].read(start=self.start, end_excl=self.end_excl)
        if len(self.edges) <= 64:
            kind = df.schema[self.ordered_on].dataType
            edges = F.array(*(F.lit(e).cast(kind) for e in self.edges)) if self.edges else F.array().cast(f"array<{kind.simpleString()}>")
            return df.withColumn("interval_id", F.size(F.filter(edges, lambda e: e <= F.col(self.ordered_on))))
        kind = df.schema[self.ordered_on]
        marks = df.sparkSession.createDataFrame(list(zip(self.edges, range(len(self.edges)), strict=True)), f"__edge {kind.dataType.simpleString()}, interval_id int")
        found = next_of(df, self.ordered_on, marks, "__edge", inclusive=False, out="__next", payload=["interval_id"])
        return found.drop("__next").withColumn("interval_id", F.coalesce("interval_id", F.lit(len(self.edges))))

    def union(self) -> DataFrame:
        """All rows, with key and interval_id."""
        parts = [self.numbered(k).withColumn("key", F.lit(str(k))) for k in self.datasets]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def cogroup(self, left, right, function: Callable, schema: str) -> DataFrame:
        """function(interval's pandas rows of left, of right) for each interval, in parallel; an interval must fit a task."""
        return self.numbered(left).groupBy("interval_id").cogroup(self.numbered(right).groupBy("interval_id")).applyInPandas(function, schema)


def intersections(datasets: dict, start=None, end_excl=None, edges="files") -> Intersections:
    """Datasets (key: dataset) cut at edges within [start, end_excl). Keys without data there are left out."""
    on = common_order(datasets)
    held = {k: _in_range(d.files, start, end_excl) for k, d in datasets.items()}
    held = {k: files for k, files in held.items() if files}
    if isinstance(edges, str) and edges == "files":
        starts = {s for files in held.values() for s in file_starts(files)}
        first = min((f[0].low for f in held.values()), default=None)
    elif isinstance(edges, str):
        starts, first = set(_grid(edges, held)), min((f[0].low for f in held.values()), default=None)
    else:
        starts, first = set(edges), min((f[0].low for f in held.values()), default=None)
    inside = sorted(s for s in starts if (first is None or s > first) and (start is None or s > start) and (end_excl is None or s < end_excl))
    return Intersections({k: datasets[k] for k in held}, on, inside, start, end_excl)


def _grid(freq: str, held: dict) -> list:
    low, high = min(f[0].low for f in held.values()), max(f[-1].high for f in held.values())
    step, at, found = Frequency.parse(freq), floor_value(high, freq), []
    from datetime import timedelta

    while at > low:
        found.append(at)
        at = floor_value(at - timedelta(microseconds=1), freq)
        if step.n > 1 and step.is_calendar:
            raise ValueError("calendar grids have a step of 1")
    return found
