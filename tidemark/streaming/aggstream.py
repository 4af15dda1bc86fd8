"""Restartable aggregation of an ordered seed into datasets: many keys, filters and hooks over one pass.

A run aggregates new rows into bins (and snapshots) for each key and upserts the results. What the last bin still needs is
kept as rows: the seed rows of the bin in progress, in a state dataset beside the result, so that a restarted run gives what
one run over everything would. What a hook looks back on is kept too, where it says how far (`lookback`). A key's restart index is kept by key, in its metadata.

The streaming runner feeds micro-batches of a Structured Streaming source to the same code through foreachBatch. `windowed`
is the plain streaming aggregate, whose watermark decides what is closed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import segagg
from tidemark.operators.bins import binner
from tidemark.operators.predicates import NO_FILTER, checked_order, fan_out, trim_start
from tidemark.plans.layout import DEFAULT_TARGET
from tidemark.sources.scratch import settled

TAG = "aggstream"


class SeedError(RuntimeError):
    """A check of the seed failed; rows before the failing chunk are stored."""


@dataclass(frozen=True)
class KeyConfig:
    """How one key is aggregated; unset fields come from the stream's defaults."""

    agg: dict | None = None
    bin_by: object = None
    bin_on: str | None = None
    snap_by: object = None
    post: Callable | None = None
    target: int | str | tuple = DEFAULT_TARGET
    max_off_target: int | None = None
    bin_on_out: str | None = None
    lookback: int = 0


@dataclass
class AggStream:
    """`keys`: a list of keys, or key: config (a dict of KeyConfig's fields); with `filters`, filter id: keys in either form.
    A key that is a pair of keys stores bins under the first and snapshots under the second one. `pre(df)` checks or changes
    each chunk (an exception stops the run as SeedError); `post(bins)` or `post(bins, snaps)` changes results, and may return
    None for nothing to store.

    A `post` that looks back over results (a rolling sum, a lag) names how many in `lookback`: so many finished results of
    earlier runs, as they were before `post`, stand before the new ones in what it is given, and its results for them aren't
    stored again. With that, chunked runs store what one run over everything would."""

    ordered_on: str
    store: object
    keys: object
    filters: dict | None = None
    agg: dict | None = None
    bin_by: object = None
    bin_on: str | None = None
    snap_by: object = None
    pre: Callable | None = None
    post: Callable | None = None
    target: int | str | tuple = DEFAULT_TARGET
    max_off_target: int | None = None
    lookback: int = 0
    seq: list[str] | None = None
    parallel: bool = False
    configs: dict = field(init=False)
    by_filter: dict = field(init=False)

    def __post_init__(self):
        by_filter = self.keys if self.filters is not None else {NO_FILTER: self.keys}
        if self.filters is not None and set(self.filters) - {NO_FILTER} != set(by_filter) - {NO_FILTER}:
            raise ValueError("filters and keys must have the same filter ids")
        self.configs, self.by_filter = {}, {}
        known = {f.name for f in fields(KeyConfig)}
        for name, own in by_filter.items():
            own = own if isinstance(own, dict) else dict.fromkeys(own if isinstance(own, list) else [own], {})
            for key, config in own.items():
                if key in self.configs:
                    raise ValueError(f"key {key} is given twice")
                unknown = set(config or {}) - known
                if unknown:
                    raise ValueError(f"unknown parameter {sorted(unknown)[0]!r} of key {key}")
                self.configs[key] = self._config(key, config or {})
                self.by_filter.setdefault(name, []).append(key)
        if not self.configs:
            raise ValueError("there are no keys")

    def _config(self, key, config: dict) -> KeyConfig:
        given = {f.name: config.get(f.name, getattr(self, f.name, None)) for f in fields(KeyConfig)}
        own = KeyConfig(**given)
        if not own.agg:
            raise ValueError(f"key {key} has no aggregation")
        if own.bin_by is None:
            raise ValueError(f"key {key} has no bins")
        if isinstance(key, tuple) and own.snap_by is None:
            raise ValueError(f"the pair {key} needs snapshots")
        by = binner(own.bin_by)
        out = own.bin_on_out or own.bin_on or self.ordered_on
        return replace(own, bin_by=by, bin_on_out=out)

    # ---- stored state

    def _names(self, key) -> tuple:
        return key if isinstance(key, tuple) else (key,)

    def _main(self, key, config: KeyConfig):
        return self.store.get(self._names(key)[0], config.bin_on_out if config.snap_by is None or isinstance(key, tuple) else self._snap_column(config))

    def _snap_column(self, config: KeyConfig) -> str:
        return self.ordered_on

    def _state(self, key, config: KeyConfig) -> dict:
        own = self._main(key, config)
        state = own.metadata.get(TAG)
        if state is None and not own.is_new and len(own):
            raise ValueError(f"the dataset of {key} was not made by an aggregation")
        return state or {}

    def restart_index(self, key):
        return self._state(key, self.configs[key]).get("restart_index")

    # ---- runs

    def run(self, seed: DataFrame | list | None = None, trim_start: bool = False, discard_last: bool = False, final_write: bool = True) -> None:
        """Aggregates a seed: a frame, or chunks of one in order, of which each is stored before the next is taken.

        `trim_start`: rows before a key's restart index are left out (they were in an earlier run). `discard_last`: rows at
        the greatest value wait for a later run. Without `final_write` results stay in the state until `flush`.
        """
        chunks = [seed] if isinstance(seed, DataFrame) or seed is None else seed
        for chunk in chunks:
            if chunk is not None:
                self._run(chunk, trim_start, discard_last, final_write)
        if seed is None and final_write:
            self.flush()

    def flush(self) -> None:
        """Stores what earlier runs without a final write left."""
        self._each(lambda key: self._aggregate(key, self.configs[key], None, None, True))

    def _each(self, work: Callable) -> None:
        if self.parallel and len(self.configs) > 1:
            with ThreadPoolExecutor(min(8, len(self.configs))) as pool:
                list(pool.map(work, self.configs))
        else:
            for key in self.configs:
                work(key)

    def _run(self, chunk: DataFrame, trim: bool, discard: bool, final: bool, batch: tuple[str, int] | None = None) -> None:
        if self.ordered_on not in chunk.columns:
            raise ValueError(f"no column {self.ordered_on!r} in the seed")
        try:
            if self.pre is not None:
                changed = self.pre(chunk)
                chunk = chunk if changed is None else changed
            ends = [F.min(self.ordered_on), F.max(self.ordered_on)]
            if self.pre is None:
                first, last = checked_order(chunk.select(self.ordered_on), self.ordered_on).agg(*ends).first()
            else:  # every column is read here, so that a check within any of them fails before anything is stored
                whole = F.bit_xor(F.xxhash64(*(F.col(f"`{f.name}`") for f in chunk.schema.fields if "map<" not in f.dataType.simpleString())))
                first, last, _ = checked_order(chunk, self.ordered_on).agg(*ends, whole).first()
        except Exception as e:
            raise SeedError(f"the seed failed its check: {e}") from e
        if last is None:
            return
        if discard:
            chunk = chunk.filter(F.col(self.ordered_on) < F.lit(last))
        branches = fan_out(chunk, {name: (self.filters or {}).get(name) for name in self.by_filter})
        of_key = {key: branches[name] for name, keys in self.by_filter.items() for key in keys}

        def work(key):
            config = self.configs[key]
            state = self._state(key, config)
            done = state.get("batch")
            if batch is not None and done and done[0] == batch[0] and done[1] >= batch[1]:
                return  # this key has had the batch before a failure
            restart = state.get("restart_index")
            if restart is not None and not trim and batch is None and first < restart:
                raise SeedError(f"the seed goes back to {first}, before {restart} where the last run of {key} ended")
            restart = restart if trim else None
            self._aggregate(key, config, trim_start(of_key[key], self.ordered_on, restart), last, final, batch)

        self._each(work)

    def _aggregate(self, key, config: KeyConfig, rows: DataFrame | None, last, final: bool, batch: tuple[str, int] | None = None) -> None:
        """Results of the open bin's kept rows and the new ones; then the rows of the bin that is open now are kept.

        Results are upserted by label, and the state (open rows, restart index, batch number) changes in one commit after
        them, so a run repeated after a failure gives the same.
        """
        spark, state = self.store.spark, self._state(key, config)
        kept = state.get("open_rows")
        if kept:
            held = spark.read.parquet(f"{self._main(key, config).path}/{kept}")
            if batch is not None:  # bins before the open one are done
                rows = rows.filter(F.col(self.ordered_on) >= F.lit(held.agg(F.min(self.ordered_on)).first()[0]))
            rows = held if rows is None else held.unionByName(rows)
        main = self._main(key, config)
        changes = dict(state)
        if last is not None:
            changes["restart_index"] = last
        if batch is not None:
            changes["batch"] = list(batch)
        if rows is None or rows.isEmpty():
            if changes != state:
                main.update_metadata({TAG: changes})
            return
        by, column = config.bin_by, config.bin_on or self.ordered_on
        if getattr(by, "origin", 0) in (None, "start_day", "start") and not by.frequency.is_calendar and by.frequency.unit != "W":
            first = F.min(column) if by.origin == "start" else F.date_trunc("DAY", F.min(column))
            origin = state.get("origin") or rows.agg(first.cast("timestamp_ntz")).first()[0]
            by = replace(by, origin=origin)
            changes["origin"] = origin
        snap = segagg.snapper(config.snap_by) if config.snap_by is not None else None
        if getattr(snap, "origin", 0) is None and getattr(by, "origin", None) is not None:
            snap = replace(snap, closed=by.closed, origin=by.origin)
        recent = {}
        if final:
            recent = self._store_results(key, config, main, rows, by, snap, column, state.get("recent") or {})
        # Bins before the open one are done; its rows come again with the next run's.
        assigned = by.assign(rows, column, self.ordered_on, self.seq)
        open_rows = assigned.join(F.broadcast(assigned.agg(F.max("bin_id").alias("__open"))), F.col("bin_id") == F.col("__open")) if final else assigned
        folder = f"_state/{uuid.uuid4().hex}"
        open_rows.select(*rows.columns).write.parquet(f"{main.path}/{folder}")
        changes["open_rows"] = folder
        if recent:
            changes["recent"] = recent
        main.refresh().update_metadata({TAG: changes})
        for gone in [kept, *(state.get("recent") or {}).values()] if recent else [kept]:
            if gone:
                main.fs.delete(f"{main.path}/{gone}")

    def _looking_back(self, main, new: DataFrame, on: str, before: str | None):
        """(the results of earlier runs that end before the new ones, and the new ones; the first new one's place)."""
        new = settled(new, "results")
        first = new.agg(F.min(on)).first()[0]
        if before is None or first is None:
            return new, first
        held = self.store.spark.read.schema(new.schema).parquet(f"{main.path}/{before}")
        return held.filter(F.col(on) < F.lit(first)).unionByName(new), first

    def _remember(self, main, given: DataFrame, on: str, least: int) -> str:
        """Writes the last results that the next run won't make again: `least` of them, those of open bins not counted."""
        folder = f"_state/{uuid.uuid4().hex}"
        given.orderBy(F.col(on).desc()).limit(least).write.parquet(f"{main.path}/{folder}")
        return folder

    def _store_results(self, key, config: KeyConfig, main, rows: DataFrame, by, snap, column: str, recent: dict) -> dict:
        pair = isinstance(key, tuple)
        found, snaps = None, None
        if snap is None or pair:
            found = segagg.bins(rows, config.agg, by, self.ordered_on, column, self.seq)
            found = found.withColumnRenamed("bin_label", config.bin_on_out).drop("bin_start", "bin_end") if config.bin_on_out not in config.agg else found.drop("bin_start", "bin_end", "bin_label")
        if snap is not None:
            snaps = segagg.snapshots(rows, config.agg, by, snap, self.ordered_on, column, self.seq)
            snaps = snaps.withColumnRenamed("instant", self.ordered_on).drop("bin_label") if self.ordered_on not in config.agg else snaps.drop("bin_label")
        memory = {}
        if config.post is not None:
            given = [found, snaps] if pair else [found if snaps is None else snaps]
            places = [config.bin_on_out, self.ordered_on] if pair else [config.bin_on_out if snaps is None else self.ordered_on]
            firsts = [None] * len(given)
            if config.lookback:
                open_start = by.assign(rows, column, self.ordered_on, self.seq).agg(F.max_by("bin_start", "bin_id")).first()[0] if snap is not None else None
                for i, on in enumerate(places):
                    given[i], firsts[i] = self._looking_back(main, given[i], on, recent.get(str(i)))
                    last = given[i].agg(F.max(on)).first()[0]
                    # The next run makes the open bin again, and the snapshots within it.
                    done = F.col(on) < F.lit(last) if on == config.bin_on_out and (pair and i == 0 or snaps is None) else F.col(on) <= F.lit(open_start)
                    memory[str(i)] = self._remember(main, given[i].filter(done), on, config.lookback)
            result = config.post(*given)
            if result is None:
                return memory
            result = result if isinstance(result, tuple) else (result,)
            if len(result) != len(given):
                raise ValueError(f"post of {key} must return {len(given)} frame(s), not {len(result)}")
            result = [df if first is None or df is None else df.filter(F.col(on) >= F.lit(first)) for df, on, first in zip(result, places, firsts, strict=True)]
            found, snaps = result if pair else ((result[0], None) if snaps is None else (None, result[0]))
        targets = config.target if isinstance(config.target, tuple) else (config.target, config.target)
        if found is not None:
            on = config.bin_on_out
            self._upsert(main, found, on, targets[0], config)
        if snaps is not None:
            own = self.store.get(key[1], self.ordered_on) if pair else main
            self._upsert(own, snaps, self.ordered_on, targets[1], config)
        return memory

    def _upsert(self, own, df: DataFrame, on: str, target, config: KeyConfig) -> None:
        if len(own):
            df = df.select(*own.schema.names)
        own.write(df, target=target, duplicates_on=on, max_off_target=config.max_off_target)

    def stream(self, source: DataFrame, checkpoint: str, **trigger):
        """A started streaming query over a source.

        Each micro-batch is a run; its checkpoint and number are part of the state's commit, so that a batch repeated after a
        failure is not counted twice. Rows before the first row of a key's open bin come too late and are dropped.
        """

        def batch(df: DataFrame, number: int) -> None:
            if not df.isEmpty():
                self._run(df, False, False, True, (checkpoint, number))

        writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def windowed(source: DataFrame, spec: dict, ordered_on: str, step: str, delay: str, seq: list[str]) -> DataFrame:
    """Time bins as a streaming aggregate: appended when the watermark passes them. Left-closed, from the epoch."""
    rows = source.withColumn("__on", F.col(ordered_on).cast("timestamp")).withWatermark("__on", delay)
    order = [ordered_on, *seq]
    found = rows.groupBy(F.window("__on", step).alias("w")).agg(*segagg.aggregates(source, spec, order))
    return found.select(F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *spec)

