"""Ordered, updatable datasets: parquet files in order of one column, listed by a versioned manifest.

A write merges new rows at their place: only the files that they overlap (and small neighbours, where these are limited) are
read and written again, in one job. Rows are put in order of the column, old rows before new ones on ties; duplicates keep
the last row. The rows of a rewritten region are numbered in order by range partitions and cut into files.
"""

from __future__ import annotations

import contextlib
import copy
import json
import time
import uuid
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.axis import Axis
from tidemark.functions.frequency import Frequency
from tidemark.operators.bins import INLINE_EDGES
from tidemark.operators.ordering import default_order, keep_last, next_of, numbered
from tidemark.operators.predicates import in_range
from tidemark.plans.layout import DEFAULT_TARGET, plan, slots_of
from tidemark.sources.fs import FileSystem
from tidemark.sources.manifest import ConcurrentCommit, DataFile, Manifest, commit, latest

_SRC, _FILE, _ROW, _PLACE, _REGION = "__src", "__file_no", "__row_no", "__place", "__region"
#: Up to so many files of a folder are read as a list of paths.
LISTED_PATHS = 32


class View:
    """A read-only part of a dataset: some of its files, in order."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self._manifest = spark, path.rstrip("/"), manifest

    @property
    def ordered_on(self) -> str | None:
        return self._manifest.ordered_on

    @property
    def metadata(self) -> dict:
        return copy.deepcopy(self._manifest.metadata)

    @property
    def version(self) -> int:
        return self._manifest.version

    @property
    def files(self) -> tuple[DataFile, ...]:
        return self._manifest.files

    @property
    def schema(self) -> T.StructType | None:
        return T.StructType.fromJson(json.loads(self._manifest.schema)) if self._manifest.schema else None

    def __len__(self) -> int:
        return len(self.files)

    def __getitem__(self, at: int | slice) -> View:
        files = self.files[at] if isinstance(at, slice) else (self.files[at],)
        return View(self.spark, self.path, replace(self._manifest, files=files))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.path!r}, ordered_on={self.ordered_on!r}, files={len(self)}, version={self.version})"

    def stats(self) -> DataFrame:
        """file, n_rows, low and high of each file, in order."""
        kind = self.schema[self.ordered_on].dataType if self.schema else T.LongType()
        schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("low", kind), T.StructField("high", kind)])
        return self.spark.createDataFrame([(f.path, f.rows, f.low, f.high) for f in self.files], schema)

    def count(self) -> int:
        """Rows, from the manifest."""
        return sum(f.rows for f in self.files)

    def paths(self) -> list[str]:
        return [f"{self.path}/{f.path}" for f in self.files]

    def read(self, start=None, end_excl=None, columns: list[str] | None = None) -> DataFrame:
        """The rows in [start, end_excl), lazily; files outside are not opened, and filters and columns reach the scan."""
        if self.schema is None:
            raise ValueError(f"{self.path} has no data yet")
        files = [f for f in self.files if (start is None or f.high >= start) and (end_excl is None or f.low < end_excl)]
        if not files:
            df = self.spark.createDataFrame([], self.schema)
        else:
            df = self._scan([f.path for f in files], self.schema)
        df = in_range(df, self.ordered_on, start, end_excl)
        return df.select(*columns) if columns else df

    def _scan(self, paths: list[str], schema: T.StructType) -> DataFrame:
        """Some files' rows. A folder of which all files are wanted is given as a folder: Spark lists that at once, but looks
        up each path of a list by a task of its own."""
        batches = {}
        for p in paths:
            batches.setdefault(p.rsplit("/", 1)[0], []).append(p)
        given = []
        for folder, own in batches.items():
            whole = len(own) > LISTED_PATHS and len(self._files.files(f"{self.path}/{folder}")) == len(own)
            given += [folder] if whole else own
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*(f"{self.path}/{p}" for p in given))

    @cached_property
    def _files(self) -> FileSystem:
        return FileSystem(self.spark, self.path)

    def ordered(self, **kwargs) -> DataFrame:
        """The rows in order."""
        return self.read(**kwargs).orderBy(self.ordered_on)

    def _refuse(self, *args, **kwargs):
        raise PermissionError("a part of a dataset is read-only")

    write = update_metadata = drop = remove_files = _refuse


class OrderedDataset(View):
    """A dataset at a path; `ordered_on` must be given for a new one, and can't change."""

    def __init__(self, spark: SparkSession, path: str, ordered_on: str | None = None):
        self.fs = FileSystem(spark, path)
        found = latest(self.fs, path.rstrip("/"))
        if found and ordered_on and found.ordered_on and found.ordered_on != ordered_on:
            raise ValueError(f"{path} is ordered on {found.ordered_on!r}, not on {ordered_on!r}")
        super().__init__(spark, path, found if found and found.ordered_on else replace(found or Manifest(), ordered_on=ordered_on))

    @property
    def is_new(self) -> bool:
        return self.version == 0

    def refresh(self) -> OrderedDataset:
        self._manifest = latest(self.fs, self.path) or self._manifest
        return self

    @contextlib.contextmanager
    def lock(self, timeout: float = 20.0, lifetime: float = 3600.0):
        """Keeps other writers that take the lock out; TimeoutError after `timeout` seconds. A lock older than `lifetime`
        belongs to a lost writer and is broken. Commits are safe without it: the lock spares writers lost work."""
        path, until = f"{self.path}/_lock", time.time() + timeout
        while not self.fs.create(path, uuid.uuid4().hex):
            with contextlib.suppress(Exception):
                if time.time() - self.fs.modified(path) > lifetime:
                    self.fs.delete(path)
                    continue
            if time.time() >= until:
                raise TimeoutError(f"{self.path} is locked")
            time.sleep(0.1)
        try:
            yield self.refresh()
        finally:
            self.fs.delete(path)

    def _commit(self, manifest: Manifest) -> None:
        self._manifest = commit(self.fs, self.path, manifest)

    def update_metadata(self, changes: dict) -> None:
        """Adds and updates keys; None removes one."""
        self._commit(self._manifest.with_metadata(changes))

    def remove_files(self, numbers: list[int], metadata: dict | None = None) -> None:
        """A version without the files of these numbers."""
        gone = {range(len(self.files))[n] for n in numbers}
        self._commit(replace(self._manifest, files=tuple(f for i, f in enumerate(self.files) if i not in gone)).with_metadata(metadata))

    def drop(self, preserve_metadata: bool = False) -> None:
        """Deletes the data; with `preserve_metadata` an empty version with the metadata stays."""
        if preserve_metadata:
            self._commit(replace(self._manifest, files=(), schema=None))
            self.vacuum()
        else:
            self.fs.delete(self.path)
            self._manifest = Manifest(ordered_on=self.ordered_on)

    def vacuum(self, keep_versions: int = 1) -> None:
        """Deletes data that no kept version lists, and older versions. Not to be run beside a writer or a reader of them."""
        names = [n for n in self.fs.names(f"{self.path}/_manifest") if n.endswith(".json")]
        kept = names[-keep_versions:]
        used = {f.path for n in kept for f in Manifest.parse(0, self.fs.read(f"{self.path}/_manifest/{n}")).files}
        for n in names[:-keep_versions]:
            self.fs.delete(f"{self.path}/_manifest/{n}")
        for batch in self.fs.names(f"{self.path}/data", True):
            inside = self.fs.names(f"{self.path}/data/{batch}", True)
            live = {u.split("/")[2] for u in used if u.startswith(f"data/{batch}/")}
            if not live:
                self.fs.delete(f"{self.path}/data/{batch}")
            else:
                for name in inside:
                    if name not in live:
                        self.fs.delete(f"{self.path}/data/{batch}/{name}")

    def write(self, df: DataFrame | None = None, target: int | str = DEFAULT_TARGET, duplicates_on: list[str] | str | None = None, max_off_target: int | None = None, metadata: dict | None = None, seq: list[str] | None = None, retries: int = 0) -> None:
        """Merges rows in at their place, as a new version.

        `target`: rows of a file, or a period. `duplicates_on`: columns that with the ordering one make a row unique (an
        empty list: all columns; None: duplicates stay); of equal rows the last stays, new ones being later than old ones.
        `seq`: columns that order new rows of one value. `max_off_target`: how many files in a row may be off the target
        size; without rows to write it compacts. `retries`: how often to plan anew after another writer's commit.
        """
        for left in range(retries, -1, -1):
            try:
                return self._write(df, target, duplicates_on, max_off_target, metadata, seq)
            except ConcurrentCommit:
                if not left:
                    raise
                self.refresh()

    def _write(self, df, target, duplicates_on, max_off_target, metadata, seq) -> None:
        on = self.ordered_on
        if on is None:
            raise ValueError("a new dataset needs an ordering column")
        if isinstance(target, str):
            Frequency.parse(target)
        elif target < 1:
            raise ValueError("a file needs at least one row")
        if df is not None:
            if on not in df.columns:
                raise ValueError(f"no column {on!r} in the rows to write")
            self._check_schema(df.schema)
        if isinstance(target, str) and not Axis(self.schema[on].dataType if self.schema else df.schema[on].dataType).is_time:
            raise TypeError("files by period need a timestamp column")
        schema = self.schema or (df.schema if df is not None else None)
        distinct = duplicates_on is not None
        keys = None
        if distinct:
            named = [duplicates_on] if isinstance(duplicates_on, str) else list(duplicates_on)
            missing = [c for c in named if c not in schema.names]
            if missing:
                raise ValueError(f"no column {missing[0]!r} to find duplicates on")
            keys = list(dict.fromkeys([on, *named])) if named else list(schema.names)
        staging = f"{self.path}/_staging/{uuid.uuid4().hex}"
        try:
            self._merge(df, target, distinct, keys, max_off_target, metadata, seq, schema, staging)
        finally:
            if df is not None:
                self.fs.delete(staging)

    def _merge(self, df, target, distinct, keys, max_off_target, metadata, seq, schema, staging) -> None:
        new, places = self._placed(df, distinct, seq, keys, staging) if df is not None else (None, {})
        slots = slots_of([(f.low, f.high) for f in self.files], [f.rows for f in self.files], places, distinct)
        chosen = plan(slots, target, distinct, max_off_target)
        if not chosen:
            if metadata:
                self.update_metadata(metadata)
            return
        written, replaced = self._rewrite(new, places, slots, chosen, schema, keys, target, seq)
        kept = [f for i, f in enumerate(self.files) if i not in replaced]
        files = tuple(sorted([*kept, *written], key=lambda f: (f.low, f.high)))
        self._commit(replace(self._manifest, files=files, schema=json.dumps(schema.jsonValue())).with_metadata(metadata))

    def _check_schema(self, given: T.StructType) -> None:
        own = self.schema
        if own and {f.name: f.dataType for f in own} != {f.name: f.dataType for f in given}:
            raise ValueError(f"the rows have the schema {given.simpleString()}, the dataset has {own.simpleString()}")

    def _placed(self, df: DataFrame, distinct: bool, seq: list[str] | None, keys: list[str] | None, staging: str) -> tuple[DataFrame, dict]:
        """The new rows with their place among the files, and the count and bounds of each place."""
        on = self.ordered_on
        df = df.withColumn(_SRC, F.lit(1)).withColumn(_FILE, F.lit(0).cast("long")).withColumn(_ROW, F.lit(0).cast("long"))
        df = keep_last(df, keys, default_order(df, on, seq))
        if not self.files:
            df = df.withColumn(_PLACE, F.lit(0))
        elif len(self.files) <= INLINE_EDGES:
            kind = self.schema[on].dataType
            marks = F.array(*(F.struct(F.lit(f.low).cast(kind).alias("low"), F.lit(f.high).cast(kind).alias("high")) for f in self.files))
            before = F.size(F.filter(marks, lambda m: (m["high"] < F.col(on)) if distinct else (m["high"] <= F.col(on))))
            df = df.withColumn("__b", before)
            df = df.withColumn(_PLACE, F.col("__b") * 2 + F.coalesce((F.get(marks, F.col("__b"))["low"] <= F.col(on)).cast("int"), F.lit(0))).drop("__b")
        else:
            marks = self.stats().withColumn("__no", F.row_number().over(Window.orderBy("low", "high")) - 1)  # a row for each file
            # Files that share their greatest value (single values) count as the first of them.
            marks = marks.groupBy("high").agg(F.min_by("low", "__no").alias("low"), F.min("__no").alias("__no"))
            df = next_of(df, on, marks, "high", inclusive=distinct, out="__high", payload=["low", "__no"])
            n = len(self.files)
            df = df.withColumn(_PLACE, F.when(F.col("__high").isNull(), 2 * n).otherwise(F.col("__no") * 2 + (F.col("low") <= F.col(on)).cast("int")).cast("int")).drop("__high", "low", "__no")
        # The rows are read several times from here on.
        df.write.parquet(staging)
        df = self.spark.read.schema(df.schema).parquet(staging)
        found = df.groupBy(_PLACE).agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("low"), F.max(on).alias("high"), F.count(on).alias("set")).collect()
        if any(r.set < r.n for r in found):
            raise ValueError(f"null in the ordering column {on!r}")
        return df, {r[_PLACE]: (r.n, r.low, r.high) for r in found}

    def _rewrite(self, new, places, slots, chosen, schema, keys, target, seq) -> tuple[list[DataFile], set[int]]:
        on, names = self.ordered_on, schema.names
        region_of_file = {slots[i].file: r for r, (a, b) in enumerate(chosen) for i in range(a, b) if slots[i].file is not None}
        region_of_slot = {i: r for r, (a, b) in enumerate(chosen) for i in range(a, b)}
        slot_places = sorted({*places, *(2 * i + 1 for i in range(len(self.files)))})
        region_of_place = {place: region_of_slot[i] for i, place in enumerate(slot_places) if i in region_of_slot}
        parts = []
        if region_of_file:
            paths = sorted(region_of_file)
            old = self._scan([self.files[i].path for i in paths], schema)
            name = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
            rows = [(self.files[i].path.split("data/", 1)[1], i, region_of_file[i]) for i in paths]
            listed = self.spark.createDataFrame(rows, f"__name string, {_FILE} long, {_REGION} int")  # a row for each file
            old = old.select(*names, name.alias("__name"), F.col("_metadata.row_index").alias(_ROW), F.lit(0).alias(_SRC))
            parts.append(old.join(F.broadcast(listed), "__name").select(*names, _SRC, _FILE, _ROW, _REGION))
        pairs = [(p, region_of_place[p]) for p in places if p in region_of_place]
        if pairs:
            listed = self.spark.createDataFrame(pairs, f"{_PLACE} int, {_REGION} int")  # at most a row for each slot
            parts.append(new.withColumn(_PLACE, F.col(_PLACE).cast("int")).join(F.broadcast(listed), _PLACE).select(*names, _SRC, _FILE, _ROW, _REGION))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        order = [on, _SRC, _FILE, _ROW]
        order += [c for c in default_order(self.spark.createDataFrame([], schema), on, seq) if c not in order]
        if keys is not None:
            rows = keep_last(rows, [_REGION, *keys], order)
        batch = f"data/{uuid.uuid4().hex}"
        if not isinstance(target, str):
            return self._write_counted(rows, order, target, names, batch), set(region_of_file)
        axis = Axis(schema[on].dataType)
        cut = Frequency.parse(target).index(axis.number(F.col(on))).cast("long")
        rows = rows.select(*names, _SRC, _FILE, _ROW, F.concat_ws("-", _REGION, cut).alias("cut")).repartition("cut").sortWithinPartitions("cut", *order)
        rows.drop(_SRC, _FILE, _ROW).write.partitionBy("cut").parquet(f"{self.path}/{batch}")
        return self._read_back(batch, schema), set(region_of_file)

    def _write_counted(self, rows: DataFrame, order: list[str], target: int, names: list[str], batch: str) -> list[DataFile]:
        """Files of `target` rows, each region's last one of what is left.

        Tasks have whole files that follow each other, and Spark begins a new file after `target` rows; only regions have
        folders of their own, if there are several. Rows and bounds come from the numbered rows, not from the files.
        """
        on, spark = self.ordered_on, self.spark
        rows = numbered(rows, [_REGION, *order], "__rn")
        place = rows._place
        listed, before, cuts = [], 0, 0
        for region, n in sorted(rows.groupBy(_REGION).agg(F.count(F.lit(1))).collect()):  # a row for each region
            listed.append((region, before, cuts))
            before, cuts = before + n, cuts - (-n // target)
        if not listed:
            return []
        tasks = min(cuts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), before // DEFAULT_TARGET))
        share = -(-cuts // tasks)  # files of a task
        tasks = -(-cuts // share)
        listed = spark.createDataFrame(listed, f"{_REGION} int, __first long, __cuts long")
        cut = F.col("__cuts") + F.call_function("div", F.col("__rn") - F.col("__first"), F.lit(target))
        rows = rows.join(F.broadcast(listed), _REGION).withColumn("__cut", cut)
        stats = rows.groupBy(_REGION, "__cut").agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("low"), F.max(on).alias("high")).collect()  # a row for each file
        dealt = rows.repartitionById(tasks, F.call_function("div", F.col("__cut"), F.lit(share)).cast("int"))
        dealt = dealt.select(*names, F.col(_REGION).alias("region"), "__rn").sortWithinPartitions("region", "__rn").drop("__rn")
        several = len({r[_REGION] for r in stats}) > 1
        writer = (dealt.write.partitionBy("region") if several else dealt.drop("region").write).option("maxRecordsPerFile", target)
        writer.parquet(f"{self.path}/{batch}")
        self.fs.delete(place)
        held = {}
        for r in sorted(stats, key=lambda r: r["__cut"]):
            held.setdefault((r[_REGION] if several else 0, r["__cut"] // share), []).append(r)
        found = []
        for region in sorted({k[0] for k in held}):
            folder = f"{batch}/region={region}" if several else batch
            files = {}
            for name in self.fs.files(f"{self.path}/{folder}"):  # in the order of tasks, and of files within a task
                files.setdefault(int(name.split("-", 2)[1]), []).append(name)
            own = {task: v for (of, task), v in held.items() if of == region}
            if {t: len(v) for t, v in files.items()} != {t: len(v) for t, v in own.items()}:
                raise RuntimeError(f"{folder} doesn't have the files that were planned")
            found += [DataFile(f"{folder}/{name}", r.n, r.low, r.high) for t in files for name, r in zip(files[t], own[t], strict=True)]
        return found

    def _read_back(self, batch: str, schema: T.StructType) -> list[DataFile]:
        on = self.ordered_on
        stats = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{batch}")
        stats = stats.select(F.col("_metadata.file_path").alias("p"), on).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("low"), F.max(on).alias("high"))
        return [DataFile(f"{batch}/{r.p.split(f'{batch}/', 1)[1]}", r.n, r.low, r.high) for r in stats.collect()]


def write(spark: SparkSession, dataset: str | OrderedDataset, ordered_on: str | None = None, df: DataFrame | None = None, **options) -> OrderedDataset:
    """Writes to a dataset given by path or object."""
    own = dataset if isinstance(dataset, OrderedDataset) else OrderedDataset(spark, dataset, ordered_on)
    if ordered_on and own.ordered_on != ordered_on:
        if own.ordered_on:
            raise ValueError(f"{own.path} is ordered on {own.ordered_on!r}, not on {ordered_on!r}")
        own._manifest = replace(own._manifest, ordered_on=ordered_on)
    own.write(df, **options)
    return own
