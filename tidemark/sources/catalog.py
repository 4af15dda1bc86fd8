"""A store: the datasets below a base path whose folders are keys of one schema, as a sorted collection."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import intersect
from tidemark.sources.dataset import OrderedDataset
from tidemark.sources.fs import FileSystem
from tidemark.sources.keys import is_toplevel
from tidemark.sources.manifest import FOLDER


class Store:
    def __init__(self, spark: SparkSession, basepath: str, indexer: type):
        if not is_toplevel(indexer):
            raise TypeError(f"{indexer!r} is not a top-level key class")
        self.spark, self.basepath, self.indexer = spark, basepath.rstrip("/"), indexer
        self.fs = FileSystem(spark, self.basepath)

    def keys(self) -> list:
        """Keys of the datasets that exist, sorted; folders that are no keys, or hold no dataset, are left out."""
        found = (self.indexer.from_path(p) for p in self.fs.under(self.basepath, self.indexer.depth) if self.fs.names(f"{self.basepath}/{p}/{FOLDER}"))
        return sorted(k for k in found if k is not None)

    def __len__(self) -> int:
        return len(self.keys())

    def __iter__(self) -> Iterator:
        return iter(self.keys())

    def __contains__(self, key) -> bool:
        return isinstance(key, self.indexer) and bool(self.fs.names(f"{self.path(key)}/{FOLDER}"))

    def __repr__(self) -> str:
        return "\n".join(map(str, self.keys()))

    def path(self, key) -> str:
        if not isinstance(key, self.indexer):
            raise TypeError(f"{key!r} is not a {self.indexer.__name__}")
        return f"{self.basepath}/{key.to_path()}"

    def get(self, key, ordered_on: str | None = None) -> OrderedDataset:
        """The dataset of a key; a new one where there is none yet."""
        return OrderedDataset(self.spark, self.path(key), ordered_on)

    __getitem__ = get

    def __delitem__(self, key) -> None:
        """Deletes a dataset, and the folders above it that are then empty."""
        if key not in self:
            raise KeyError(key)
        self.get(key).drop()
        parts = key.to_path().split("/")[:-1]
        while parts:
            above = f"{self.basepath}/{'/'.join(parts)}"
            if self.fs.names(above):
                break
            self.fs.delete(above)
            parts.pop()

    @contextlib.contextmanager
    def opened(self, keys: list) -> Iterator[dict]:
        """The datasets of some keys, at one version each for as long as the block runs."""
        yield {k: self.get(k) for k in keys}

    def register(self, prefix: str = "") -> list[str]:
        """Temporary views of all datasets, named by their keys."""
        names = []
        for key in self:
            names.append(f"{prefix}{key}".replace(self.indexer.field_sep, "_"))
            self.get(key).read().createOrReplaceTempView(names[-1])
        return names

    def intersections(self, keys: list, start=None, end_excl=None, edges="files") -> intersect.Intersections:
        """The datasets cut at common edges; see tidemark.operators.intersect."""
        with self.opened(keys) as own:
            return intersect.intersections(own, start, end_excl, edges)

    def iter_intersections(self, keys: list, start=None, end_excl=None) -> Iterator[dict[object, DataFrame]]:
        """For each interval of files' starts, a frame for each key that has data in the range."""
        yield from self.intersections(keys, start, end_excl)
