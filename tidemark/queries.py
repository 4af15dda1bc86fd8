"""Registered queries of the ordered-data engine and their SQL oracles.

Each query runs over whole tables. Sums are of integer cents, so that their order doesn't matter; rows of one time are
ordered by event_id. Queries that go through a dataset write it to a new shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.frequency import ceil_ts, floor_ts
from tidemark.operators import ordering, predicates
from tidemark.operators.bins import EdgeBins, FlagBins, GroupedBins, RowBins, TimeBins
from tidemark.operators.segagg import Instants, bins, snapshots
from tidemark.plans.layout import Slot, plan, regions
from tidemark.sources import columns
from tidemark.sources.catalog import Store
from tidemark.sources.dataset import OrderedDataset
from tidemark.sources.keys import sublevel, toplevel
from tidemark.sources.scratch import shared_place
from tidemark.streaming.aggstream import AggStream, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SPEC = {"first_c": ("cents", "first"), "last_c": ("cents", "last"), "min_c": ("cents", "min"), "max_c": ("cents", "max"), "sum_c": ("cents", "sum")}
SEQ = ["event_id"]
_CENTS = "cast(round(value * 100) as bigint)"
_E = f"e as (select event_id, ts, user_id, event_type, value, {_CENTS} cents from events)"
_AGG = "arg_min(cents, {o}) first_c, arg_max(cents, {o}) last_c, min(cents) min_c, max(cents) max_c, sum(cents)::bigint sum_c"
_O = _AGG.format(o="(ts, event_id)")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


def _bins(spark, sf_dir, by, spec=None, **options) -> DataFrame:
    return bins(events(spark, sf_dir), spec or SPEC, by, "ts", seq=SEQ, **options)


# ---- bins


@query(f"with {_E} select date_trunc('hour', ts) bin_label, {_O} from e group by 1")
def bin_1h(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("1h"), empty=False).drop("bin_start", "bin_end")


@query(f"with {_E} select time_bucket(interval '13 minutes', ts, (select date_trunc('day', min(ts)) from e)) bin_label, {_O} from e group by 1")
def bin_13min_start_day(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("13min"), empty=False).drop("bin_start", "bin_end")


@query(f"with {_E} select make_timestamp(cast(ceil(epoch_us(ts) / 1800000000.0) as bigint) * 1800000000) bin_label, {_O} from e group by 1")
def bin_30min_right_right(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("30min", "right", "right"), empty=False).drop("bin_start", "bin_end")


@query(f"""with {_E}, b as (select time_bucket(interval '5 minutes', ts) t, {_O} from e group by 1),
s as (select unnest(generate_series((select min(t) from b), (select max(t) from b), interval '5 minutes')) t)
select s.t bin_label, s.t bin_start, s.t + interval '5 minutes' bin_end, first_c, last_c, min_c, max_c, sum_c from s left join b on b.t = s.t""")
def bin_5min_empty_filled(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("5min"))


@query("""select date_trunc('month', l_shipdate)::timestamp bin_label, min(l_quantity::bigint) min_q, max(l_quantity::bigint) max_q, sum(l_quantity::bigint)::bigint sum_q
from lineitem group by 1""")
def bin_month_shipdate(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("q", F.col("l_quantity").cast("bigint"))
    spec = {"min_q": ("q", "min"), "max_q": ("q", "max"), "sum_q": ("q", "sum")}
    return bins(items, spec, TimeBins("MS"), "l_shipdate", seq=["l_orderkey", "l_linenumber"], empty=False).drop("bin_start", "bin_end")



@query(f"with {_E} select last_day(ts)::timestamp bin_label, {_O} from e group by 1")
def bin_month_end(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("ME"), empty=False).drop("bin_start", "bin_end")


@query(f"with {_E} select date_trunc('month', ts) + (case when day(ts) >= 15 then interval '14 days' else interval '0 days' end) bin_label, {_O} from e group by 1")
def bin_semi_month(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("SMS"), empty=False).drop("bin_start", "bin_end")


@query(f"with {_E} select time_bucket(interval '1 hour', ts - interval '20 minutes') + interval '20 minutes' bin_label, {_O} from e group by 1")
def bin_1h_offset(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("1h", offset="20min"), empty=False).drop("bin_start", "bin_end")


@query(f"with {_E} select time_bucket(interval '10 minutes', ts) bin_label, sum(case when event_type = 'purchase' then cents else 0 end)::bigint sum_c from e group by 1")
def bin_zero_allowed(spark, sf_dir):
    """Bins whose sum is 0, as no row of theirs counts."""
    rows = events(spark, sf_dir).withColumn("cents", F.when(F.col("event_type") == "purchase", F.col("cents")).otherwise(0))
    return bins(rows, {"sum_c": ("cents", "sum")}, TimeBins("10min"), "ts", seq=SEQ, empty=False, error_on_0=False).drop("bin_start", "bin_end")


@query(f"with {_E} select date_trunc('month', ts - interval '5 days') + interval '5 days' bin_label, {_O} from e group by 1")
def bin_month_offset(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("MS", offset="5D"), empty=False).drop("bin_start", "bin_end")


@query(f"with {_E} select time_bucket(interval '7 hours', ts, (select max(ts) from e)) bin_label, {_O} from e group by 1")
def bin_origin_end(spark, sf_dir):
    return _bins(spark, sf_dir, TimeBins("7h", origin="end"), empty=False).drop("bin_start", "bin_end")


_EDGES = ["2024-01-02 00:00:00", "2024-01-05 06:30:00", "2024-01-05 06:31:00", "2024-01-20 00:00:00", "2024-02-01 00:00:00"]
_EDGE_LABELS = ", ".join(f"(timestamp '{e}', 'until {e}')" for e in _EDGES)
_EDGE_ROWS = ", ".join(f"(timestamp '{e}')" for e in _EDGES)


@query(f"""with {_E}, d as (select * from (values {_EDGE_ROWS}) t(edge)), a as (select e.*, (select min(edge) from d where edge > ts) edge from e)
select edge bin_label, {_O} from a where edge is not null group by 1""")
def bin_edges(spark, sf_dir):
    return _bins(spark, sf_dir, EdgeBins(_EDGES, "left"), empty=False).drop("bin_start", "bin_end")


@query(f"""with {_E}, d as (select * from (values {_EDGE_LABELS}) t(edge, label)), a as (select e.*, (select min(edge) from d where edge > ts) edge from e)
select label bin_label, {_O} from a join d using (edge) group by 1""")
def bin_edge_labels(spark, sf_dir):
    """Labels given with the edges: a list, here, beyond what a row searches by itself in the next query."""
    return _bins(spark, sf_dir, EdgeBins(_EDGES, "left", labels=[f"until {e}" for e in _EDGES]), empty=False).drop("bin_start", "bin_end")


@query(f"""with {_E}, d as (select * from (values {_EDGE_LABELS}) t(edge, label)), a as (select e.*, (select min(edge) from d where edge >= ts) edge from e)
select label bin_label, {_O} from a join d using (edge) group by 1""")
def bin_edge_label_column(spark, sf_dir):
    edges = spark.sql(f"select edge, label from values {_EDGE_LABELS} as t(edge, label)").withColumn("edge", F.col("edge").cast("timestamp_ntz"))
    return _bins(spark, sf_dir, EdgeBins(edges, "right"), empty=False).drop("bin_start", "bin_end")


@query(f"""with {_E}, d as (select ts edge from e where event_id % 97 = 0), a as (select e.*, (select min(edge) from d where edge >= ts) edge from e)
select edge bin_label, {_O} from a where edge is not null group by 1""")
def bin_edges_frame(spark, sf_dir):
    edges = events(spark, sf_dir).filter("event_id % 97 = 0").select("ts").distinct()
    return _bins(spark, sf_dir, EdgeBins(edges, "right"), empty=False).drop("bin_start", "bin_end")


@query(f"with {_E}, r as (select *, (row_number() over (order by ts, event_id) - 1) // 100 b from e) select min(ts) bin_label, {_O} from r group by b")
def bin_100_rows(spark, sf_dir):
    return _bins(spark, sf_dir, RowBins(100)).drop("bin_start", "bin_end")


@query(f"with {_E}, r as (select *, sum((event_type = 'purchase')::int) over (order by ts, event_id) b from e) select min(ts) bin_label, {_O} from r group by b")
def bin_start_flag(spark, sf_dir):
    return _bins(spark, sf_dir, FlagBins(F.col("event_type") == "purchase")).drop("bin_start", "bin_end")


@query(f"with {_E} select event_type, min(ts) bin_label, {_O} from (select *, (row_number() over (partition by event_type order by ts, event_id) - 1) // 250 b from e) group by event_type, b")
def bin_user_function(spark, sf_dir):
    by = GroupedBins(lambda rows: [i // 250 for i in range(len(rows))], group="event_type")
    spec = {**SPEC, "event_type": ("event_type", "min")}
    return bins(events(spark, sf_dir), spec, by, "ts", seq=SEQ).drop("bin_start", "bin_end")


@query(f"""with {_E} select date_trunc('day', ts) bin_label, arg_min(ts, (ts, event_id)) first_ts, max(value) max_value, min(user_id) min_user, arg_max(event_type, (ts, event_id)) last_type
from e group by 1""")
def bin_multi_dtype(spark, sf_dir):
    spec = {"first_ts": ("ts", "first"), "max_value": ("value", "max"), "min_user": ("user_id", "min"), "last_type": ("event_type", "last")}
    return _bins(spark, sf_dir, TimeBins("D"), spec, empty=False).drop("bin_start", "bin_end")


# ---- snapshots


def _snap_sql(closed: str) -> str:
    inside = "e.ts >= {b} and e.ts < s.t" if closed == "left" else "e.ts > {b} and e.ts <= s.t"
    start = "make_timestamp((cast(ceil(epoch_us(s.t) / 1800000000.0) as bigint) - 1) * 1800000000)"
    slot = "floor(epoch_us(x) / 300000000.0) + 1" if closed == "left" else "ceil(epoch_us(x) / 300000000.0)"
    at = lambda f: f"make_timestamp(cast((select {slot.replace('x', f'{f}(ts)')} from e) as bigint) * 300000000)"
    return f"""with {_E}, s as (select unnest(generate_series({at('min')}, {at('max')}, interval '5 minutes')) t),
w as (select t, {start} b from s)
select s.t instant, s.b + interval '30 minutes' bin_label, {_O} from w s left join e on {inside.format(b='s.b')} and e.ts < s.b + interval '30 minutes 1 microsecond'
group by s.t, s.b"""


@query(_snap_sql("left"))
def snap_5min_in_30min_left(spark, sf_dir):
    return snapshots(events(spark, sf_dir), SPEC, TimeBins("30min", "left", "right"), TimeBins("5min", "left", "right"), "ts", seq=SEQ)


@query(_snap_sql("right"))
def snap_5min_in_30min_right(spark, sf_dir):
    return snapshots(events(spark, sf_dir), SPEC, TimeBins("30min", "right", "right"), TimeBins("5min", "right", "right"), "ts", seq=SEQ)


_INSTANTS = [f"2024-01-{d:02d} {h:02d}:{m:02d}:00" for d in (1, 3, 9, 17, 30) for h, m in ((0, 0), (4, 17), (4, 59), (5, 0), (18, 30))] + ["2024-02-03 00:00:00", "2024-02-04 00:00:00"]


@query(f"""with {_E}, s as (select * from (values {', '.join(f"(timestamp '{x}')" for x in _INSTANTS)}) v(t)),
k as (select * from s where t <= coalesce((select min(t) from s where t > (select max(ts) from e)), timestamp '9999-01-01')),
w as (select t, make_timestamp((cast(ceil(epoch_us(t) / 3600000000.0) as bigint) - 1) * 3600000000) b from k)
select w.t instant, b + interval '1 hour' bin_label, {_O} from w left join e on e.ts >= b and e.ts < t group by all""")
def snap_instants(spark, sf_dir):
    at = Instants(spark.createDataFrame([(x,) for x in _INSTANTS], "t string").select(F.col("t").cast("timestamp_ntz")))
    got = snapshots(events(spark, sf_dir), SPEC, TimeBins("1h", "left", "right"), at, "ts", seq=SEQ)
    hour = F.date_trunc("hour", F.col("instant") - F.expr("interval 1 microsecond")).cast("timestamp_ntz") + F.expr("interval 1 hour")
    return got.withColumn("bin_label", hour)


@query(f"""with {_E}, r as (select *, (row_number() over (order by ts, event_id) - 1) // 100 b from e), g as (select b, min(ts) lo from r group by b),
i as (select b, lo, lead(lo) over (order by b) hi from g), s as (select unnest(generate_series(timestamp '2024-01-01 01:00:00', timestamp '2024-01-31 00:00:00', interval '1 hour')) t),
k as (select * from s where t <= coalesce((select min(t) from s where t > (select max(ts) from e)), timestamp '9999-01-01')),
w as (select t, b, lo from k left join i on lo < t and (t <= hi or hi is null))
select w.t instant, w.lo bin_label, {_O} from w left join r on r.b = w.b and r.ts < w.t group by all""")
def snap_row_bins(spark, sf_dir):
    hours = spark.range(1, 24 * 30 + 1).select(F.timestamp_add("HOUR", F.col("id"), F.expr("timestamp_ntz '2024-01-01 00:00:00'")).alias("t"))
    return snapshots(events(spark, sf_dir), SPEC, RowBins(100), Instants(hours), "ts", seq=SEQ)


# ---- filters and ranges


@query("select event_id from events where (event_type = 'click' and value > 50) or (user_id >= 10 and user_id <= 20 and event_type <> 'view')")
def filter_dnf(spark, sf_dir):
    return predicates.keep(events(spark, sf_dir), [[("event_type", "==", "click"), ("value", ">", 50)], [("user_id", ">=", 10), ("user_id", "<=", 20), ("event_type", "!=", "view")]]).select("event_id")


@query("select event_id from events where event_type in ('click', 'view') and user_id not in (1, 2, 3)")
def filter_in_notin(spark, sf_dir):
    return predicates.keep(events(spark, sf_dir), [("event_type", "in", ["click", "view"]), ("user_id", "not in", [1, 2, 3])]).select("event_id")


@query("select event_id from events where not (value > 50)")
def filter_not(spark, sf_dir):
    return predicates.keep(events(spark, sf_dir).withColumn("large", F.col("value") > 50), [("large", "~", None)]).select("event_id")


@query("""select '_' filter_id, count(*) n from events union all select 'click', count(*) from events where event_type = 'click'
union all select 'large', count(*) from events where value > 50""")
def filter_fanout(spark, sf_dir):
    filters = {"_": None, "click": [("event_type", "==", "click")], "large": [[("value", ">", 50)]]}
    return predicates.tagged(events(spark, sf_dir), filters).groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"))


@query("select event_id from events where ts >= timestamp '2024-01-15 00:00:00'")
def trim_start(spark, sf_dir):
    return predicates.trim_start(events(spark, sf_dir), "ts", "2024-01-15 00:00:00").select("event_id")


@query("select event_id from events where date_trunc('hour', ts) < (select max(date_trunc('hour', ts)) from events)")
def discard_last_group(spark, sf_dir):
    return predicates.discard_last(events(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts")), "ts").select("event_id")


# ---- datasets


def _seeded(spark, sf_dir, target=1000, ordered_on: str = "event_id") -> OrderedDataset:
    own = OrderedDataset(spark, shared_place(spark), ordered_on)
    own.write(events(spark, sf_dir).select("event_id", "ts", "user_id", "cents"), target=target)
    return own


@query(f"with {_E} select event_id, ts, user_id, cents from e where ts >= timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-12 00:00:00'")
def range_scan(spark, sf_dir):
    from datetime import datetime

    return _seeded(spark, sf_dir, "D", "ts").read(start=datetime(2024, 1, 10), end_excl=datetime(2024, 1, 12))


@query(f"with {_E} select event_id, ts, user_id, cents from e order by event_id")
def dataset_read(spark, sf_dir):
    return _seeded(spark, sf_dir).ordered()


@query("select i file_no, count(*) n_rows, min(event_id) low, max(event_id) high from (select event_id, (row_number() over (order by event_id) - 1) // 1000 i from events) group by i")
def row_group_stats(spark, sf_dir):
    stats = _seeded(spark, sf_dir).stats()
    return stats.select((F.row_number().over(Window.orderBy("low")) - 1).cast("long").alias("file_no"), "n_rows", "low", "high")


@query("select event_id from (select event_id, (row_number() over (order by event_id) - 1) // 1000 i from events) where i in (2, 3)")
def row_group_slice(spark, sf_dir):
    return _seeded(spark, sf_dir)[1:4][1:].read(columns=["event_id"])


_NEW = "select event_id + 5 event_id, ts, user_id, 7::bigint cents from e where event_id % 10 = 0"


@query(f"""with {_E}, a as (select event_id, ts, user_id, cents, 0 src from e union all select *, 1 from ({_NEW}))
select event_id, ts, user_id, cents from (select *, row_number() over (partition by event_id order by src desc) k from a) where k = 1""")
def upsert_keep_last(spark, sf_dir):
    own = _seeded(spark, sf_dir)
    new = events(spark, sf_dir).filter("event_id % 10 = 0").select((F.col("event_id") + 5).alias("event_id"), "ts", "user_id", F.lit(7).cast("bigint").alias("cents"))
    own.write(new, target=1000, duplicates_on="event_id", max_off_target=2)
    return own.read()


@query(f"with {_E}, a as (select event_id, ts, user_id, cents from e union all select event_id, ts, user_id, cents from e where event_id % 3 = 0) select distinct * from a")
def dedup_all_columns(spark, sf_dir):
    own = _seeded(spark, sf_dir)
    own.write(events(spark, sf_dir).filter("event_id % 3 = 0").select("event_id", "ts", "user_id", "cents"), target=1000, duplicates_on=[])
    return own.read()


@query(f"with {_E} select event_id, ts, user_id, cents from e union all {_NEW}")
def append_keep_all(spark, sf_dir):
    own = _seeded(spark, sf_dir)
    new = events(spark, sf_dir).filter("event_id % 10 = 0").select((F.col("event_id") + 5).alias("event_id"), "ts", "user_id", F.lit(7).cast("bigint").alias("cents"))
    own.write(new, target=1000)
    return own.read()


@query("select i file_no, count(*) n_rows from (select (row_number() over (order by event_id) - 1) // 768 i from events) group by i")
def layout_n_rows(spark, sf_dir):
    stats = _seeded(spark, sf_dir, 768).stats()
    return stats.select((F.row_number().over(Window.orderBy("low")) - 1).cast("long").alias("file_no"), "n_rows")


@query("select time_bucket(interval '2 days', ts, timestamp '1970-01-01') period, count(*) n_rows from events group by 1")
def layout_period(spark, sf_dir):
    stats = _seeded(spark, sf_dir, "2D", "ts").stats()
    return stats.select(floor_ts(F.col("low"), "2D").alias("period"), "n_rows")


@query("""with r as (select event_id, (row_number() over (order by event_id) - 1) // 1000 f from events)
select f::int file, count(*) n_rows, min(event_id) low, max(event_id) high, 'kept' tag from r group by f""")
def metadata_and_compaction(spark, sf_dir):
    """Small files merged into full ones, with the metadata that two updates left."""
    own = _seeded(spark, sf_dir, 300)
    own.write(None, target=1000, max_off_target=1, metadata={"tag": "kept", "gone": 1})
    own.update_metadata({"gone": None})
    tag = own.metadata["tag"] if "gone" not in own.metadata else "both"
    return spark.createDataFrame([(i, f.rows, f.low, f.high, tag) for i, f in enumerate(own.files)], "file int, n_rows long, low long, high long, tag string")


@query("select * from (values (0, 2), (4, 5)) t(slot_start, slot_end)")
def merge_regions(spark, sf_dir):
    new, on = [True, False, False, False, True, False], [True, False, True, False, False, True]
    return spark.createDataFrame(regions(new, on, lambda a, b: a == 0, 2), "slot_start int, slot_end int")


@query("select * from (values (1, 3)) t(slot_start, slot_end)")
def merge_plan(spark, sf_dir):
    slots = [Slot(0, 100, 0, 0, 9), Slot(1, 30, 60, 10, 19), Slot(2, 50, 0, 20, 29), Slot(3, 100, 0, 30, 39)]
    return spark.createDataFrame(plan(slots, 100, False, 3), "slot_start int, slot_end int")


@toplevel
class Table:
    name: str
    part: int


@sublevel
class _Below:
    kind: str


@toplevel
class Nested:
    name: str
    below: _Below


def _two(spark, sf_dir) -> Store:
    store, rows = Store(spark, shared_place(spark), Table), events(spark, sf_dir)
    for i, kind in enumerate(("click", "view")):
        store.get(Table("events", i), "event_id").write(rows.filter(F.col("event_type") == kind).select("event_id", "cents"), target=100)
    return store


@query("""with r as (select event_id, event_type, (row_number() over (partition by event_type order by event_id) - 1) // 100 f from events where event_type in ('click', 'view')),
g as (select event_type, f, min(event_id) lo from r group by all), d as (select distinct lo from g where f > 0 and lo > (select min(lo) from g)),
x as (select case event_type when 'click' then 'events-0' else 'events-1' end key, (select count(*) from d where lo <= event_id) interval_id from r)
select key, interval_id::int interval_id, count(*) n from x group by all""")
def intersections_2_keys(spark, sf_dir):
    store = _two(spark, sf_dir)
    return store.intersections(store.keys()).union().groupBy("key", "interval_id").agg(F.count(F.lit(1)).alias("n"))


@query("""with k as (select event_type, count(*) n, min(event_id) low from events group by 1)
select event_type || '-' || n as key, event_type || '-' || n as path, n from k union all
select event_type || '-' || low, event_type || '/' || low, low from k""")
def catalog_keys(spark, sf_dir):
    """Keys found again in a store's folders, of one level and of two, with what their datasets hold."""
    rows, place = events(spark, sf_dir), shared_place(spark)
    flat, deep = Store(spark, f"{place}/flat", Table), Store(spark, f"{place}/deep", Nested)
    for name, n, low in rows.groupBy("event_type").agg(F.count(F.lit(1)), F.min("event_id")).collect():
        own = rows.filter(F.col("event_type") == name).select("event_id")
        flat.get(Table(name, n), "event_id").write(own, target=2000)
        deep.get(Nested(name, _Below(str(low))), "event_id").write(own.filter(F.col("event_id") == low), target=2000)
    found = [(str(k), k.to_path(), store[k].read().agg(f("event_id")).first()[0]) for store, f in ((Store(spark, f"{place}/flat", Table), F.count), (Store(spark, f"{place}/deep", Nested), F.max)) for k in store]
    return spark.createDataFrame(found, "key string, path string, n long")


# ---- ordered helpers


@query("""with d as (select date_trunc('day', ts) v, 0 source from events group by 1 union all select date_trunc('hour', ts), 1 from events where hour(ts) % 6 = 0 group by 1)
select v, source, row_number() over (order by v, source) - 1 as position from d""")
def merge_edges(spark, sf_dir):
    e = events(spark, sf_dir)
    day = e.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("v")).distinct()
    hour = e.filter(F.hour("ts") % 6 == 0).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("v")).distinct()
    return ordering.merge_edges(day, hour, "v")


@query("select distinct user_id + 40 q from events where user_id + 40 not in (select user_id from events)")
def not_in_sorted(spark, sf_dir):
    users = events(spark, sf_dir).select("user_id").distinct()
    return ordering.not_in(users.select((F.col("user_id") + 40).alias("q")), "q", users, "user_id")


@query("with u as (select distinct user_id from events), q as (select distinct user_id * 2 - 1 q from events) select q, (select count(*) from u where user_id < q) as position from q")
def insert_positions(spark, sf_dir):
    users = events(spark, sf_dir).select("user_id").distinct()
    return ordering.insert_positions(users.select((F.col("user_id") * 2 - 1).alias("q")), "q", users, "user_id")


_GAPS = "g as (select event_id, case when event_id % 7 = 3 then cents end v from e)"


@query(f"with {_E}, {_GAPS} select event_id, last_value(v ignore nulls) over (order by event_id) v from g")
def ffill(spark, sf_dir):
    e = events(spark, sf_dir)
    return ordering.ffill(e.select("event_id", F.when(F.col("event_id") % 7 == 3, F.col("cents")).alias("v")), "v", ["event_id"])


@query(f"with {_E}, {_GAPS} select event_id, first_value(v ignore nulls) over (order by event_id rows between current row and unbounded following) v from g")
def bfill(spark, sf_dir):
    e = events(spark, sf_dir)
    return ordering.bfill(e.select("event_id", F.when(F.col("event_id") % 7 == 3, F.col("cents")).alias("v")), "v", ["event_id"])


@query("""select event_id, date_trunc('hour', ts) floor_h, date_trunc('hour', ts) + interval '1 hour' ceil_h, date_trunc('day', ts)::timestamp floor_d, date_trunc('day', ts)::timestamp + interval '1 day' ceil_d,
date_trunc('month', ts)::timestamp floor_ms, (date_trunc('month', ts) + interval '1 month')::timestamp ceil_ms,
(case when ts::date = last_day(ts) then last_day(ts) else last_day(ts - interval '1 month') end)::timestamp floor_me,
(case when ts::date = last_day(ts) then last_day(last_day(ts) + interval '1 day') else last_day(ts) end)::timestamp ceil_me,
(date_trunc('month', ts) + (case when day(ts) >= 15 then interval '14 days' else interval '0 days' end))::timestamp floor_sms,
(case when day(ts) >= 15 then date_trunc('month', ts) + interval '1 month' else date_trunc('month', ts) + interval '14 days' end)::timestamp ceil_sms,
(case when ts::date = last_day(ts) then last_day(ts) when day(ts) >= 15 then date_trunc('month', ts) + interval '14 days' else last_day(date_trunc('month', ts) - interval '1 day') end)::timestamp floor_sme,
(case when ts::date = last_day(ts) then last_day(ts) + interval '15 days' when day(ts) >= 15 then last_day(ts) else date_trunc('month', ts) + interval '14 days' end)::timestamp ceil_sme from events""")
def floor_ceil_ts(spark, sf_dir):
    e, freqs = events(spark, sf_dir), {"h": "h", "d": "D", "ms": "MS", "me": "ME", "sms": "SMS", "sme": "SME"}
    made = [f(F.col("ts"), freq).alias(f"{word}_{name}") for name, freq in freqs.items() for word, f in (("floor", floor_ts), ("ceil", ceil_ts))]
    return e.select("event_id", *made)


# ---- streamed aggregation


def _chunks(rows: DataFrame) -> list[DataFrame]:
    """The rows in four uneven chunks, from the first one's time to the last one's; cuts fall within bins of any length."""
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low, *(low + (high - low) * share for share in (0.101, 0.337, 0.604)), high + timedelta(microseconds=1)]
    return [predicates.in_range(rows, "ts", a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


@query(f"with {_E} select time_bucket(interval '6 hours', ts) ts, {_O} from e group by 1")
def agg_restart(spark, sf_dir):
    store, key = Store(spark, shared_place(spark), Table), Table("restart", 0)
    for chunk in _chunks(events(spark, sf_dir)):  # a new object for each run, as after a restart
        AggStream("ts", store, key, agg=SPEC, bin_by=TimeBins("6h"), seq=SEQ).run(chunk)
    return store[key].read().filter("first_c is not null")


@query(f"with {_E} select 'click' key, time_bucket(interval '12 hours', ts) ts, {_O} from e where event_type = 'click' group by all union all select 'all', min(ts), {_AGG.format(o='(ts, event_id)')} from (select *, (row_number() over (order by ts, event_id) - 1) // 1000 b from e) group by b")
def agg_two_keys(spark, sf_dir):
    store = Store(spark, shared_place(spark), Table)
    one, two = Table("click", 0), Table("all", 0)
    stream = AggStream("ts", store, {"c": {one: {"bin_by": TimeBins("12h")}}, "_": {two: {"bin_by": RowBins(1000)}}}, filters={"c": [("event_type", "==", "click")]}, agg=SPEC, seq=SEQ, parallel=True)
    stream.run(_chunks(events(spark, sf_dir)))
    return store[one].read().filter("first_c is not null").withColumn("key", F.lit("click")).unionByName(store[two].read().withColumn("key", F.lit("all")))


@query(f"""with {_E}, s as (select unnest(generate_series((select time_bucket(interval '3 hours', min(ts)) + interval '3 hours' from e), (select time_bucket(interval '3 hours', max(ts)) + interval '3 hours' from e), interval '3 hours')) t)
select 'bins' kind, time_bucket(interval '12 hours', ts) + interval '12 hours' ts, {_O} from e group by all
union all select 'snaps', t, {_O} from (select t, make_timestamp((cast(ceil(epoch_us(t) / 43200000000.0) as bigint) - 1) * 43200000000) b from s) left join e on e.ts >= b and e.ts < t group by t""")
def agg_two_keys_bins_snaps(spark, sf_dir):
    store, pair = Store(spark, shared_place(spark), Table), (Table("bins", 0), Table("snaps", 0))
    stream = AggStream("ts", store, {pair: {}}, agg=SPEC, bin_by=TimeBins("12h", "left", "right"), snap_by=TimeBins("3h", "left", "right"), seq=SEQ, target=(8, 20))
    stream.run(_chunks(events(spark, sf_dir)))
    return store[pair[0]].read().filter("first_c is not null").withColumn("kind", F.lit("bins")).unionByName(store[pair[1]].read().withColumn("kind", F.lit("snaps")))


@query("""with e as (select date_trunc('day', ts) ts, cast(round(value * 100) as bigint) cents, user_id weight from events)
select ts, sum(cents * weight)::bigint weighted, sum(weight)::bigint weight, sum(cents * weight)::double / sum(weight) mean from e group by 1""")
def post_weighted_mean(spark, sf_dir):
    store, key = Store(spark, shared_place(spark), Table), Table("mean", 0)
    rows = events(spark, sf_dir).withColumn("weight", F.col("user_id")).withColumn("w", F.col("cents") * F.col("user_id"))
    spec = {"weighted": ("w", "sum"), "weight": ("weight", "sum")}
    mean = lambda found: found.withColumn("mean", F.col("weighted").cast("double") / F.col("weight"))
    AggStream("ts", store, key, agg=spec, bin_by=TimeBins("D"), post=mean, seq=SEQ).run(rows)
    return store[key].read()


@query(f"with {_E}, d as (select date_trunc('day', ts) ts, sum(cents)::bigint sum_c from e group by 1) select ts, sum_c, sum(sum_c) over (order by ts rows between 9 preceding and current row)::bigint roll from d")
def post_rolling_10(spark, sf_dir):
    store, key = Store(spark, shared_place(spark), Table), Table("rolling", 0)
    roll = lambda found: found.withColumn("roll", F.sum("sum_c").over(Window.orderBy("ts").rowsBetween(-9, 0)))
    AggStream("ts", store, key, agg={"sum_c": ("cents", "sum")}, bin_by=TimeBins("D"), post=roll, seq=SEQ).run(events(spark, sf_dir))
    return store[key].read()


@query(f"with {_E}, d as (select date_trunc('day', ts) ts, sum(cents)::bigint sum_c from e group by 1), r as (select ts, sum_c, sum(sum_c) over w roll, count(*) over w n from d window w as (order by ts rows between 9 preceding and current row)) select ts, sum_c, roll::bigint roll from r where n = 10")
def post_rolling_10_chunked(spark, sf_dir):
    """The same over restarts, from the tenth day on: the nine days before the new ones are kept for the hook."""
    store, key = Store(spark, shared_place(spark), Table), Table("rolling", 1)
    window = Window.orderBy("ts").rowsBetween(-9, 0)
    roll = lambda found: found.withColumn("roll", F.sum("sum_c").over(window)).withColumn("n", F.count(F.lit(1)).over(window)).filter("n = 10").drop("n")
    for chunk in _chunks(events(spark, sf_dir)):
        AggStream("ts", store, key, agg={"sum_c": ("cents", "sum")}, bin_by=TimeBins("D"), post=roll, lookback=9, seq=SEQ).run(chunk)
    return store[key].read()


@query(f"""with {_E}, b as (select time_bucket(interval '12 hours', ts) + interval '12 hours' t, sum(cents)::bigint sum_c from e group by 1),
g as (select unnest(generate_series((select min(t) from b), (select max(t) from b), interval '12 hours')) t), p as (select g.t, lag(sum_c) over (order by g.t) previous from g left join b on b.t = g.t),
s as (select unnest(generate_series((select time_bucket(interval '3 hours', min(ts)) + interval '3 hours' from e), (select time_bucket(interval '3 hours', max(ts)) + interval '3 hours' from e), interval '3 hours')) t),
w as (select t, make_timestamp(cast(ceil(epoch_us(t) / 43200000000.0) as bigint) * 43200000000) b from s)
select w.t instant, b bin_label, sum(cents)::bigint sum_c, any_value(previous) previous from w left join p on p.t = b left join e on e.ts >= b - interval '12 hours' and e.ts < w.t group by w.t, b""")
def post_snap_with_prev_bin(spark, sf_dir):
    e, spec = events(spark, sf_dir), {"sum_c": ("cents", "sum")}
    found = bins(e, spec, TimeBins("12h", "left", "right"), "ts", seq=SEQ)
    previous = found.select("bin_label", F.lag("sum_c").over(Window.orderBy("bin_label")).alias("previous"))
    return snapshots(e, spec, TimeBins("12h", "left", "right"), TimeBins("3h", "left", "right"), "ts", seq=SEQ).join(previous, "bin_label", "left")


@query("with w as (select time_bucket(interval '1 day', ts) bin_start, sum(cast(round(value * 100) as bigint))::bigint sum_c from events group by 1) select * from w where bin_start < (select max(bin_start) from w)")
def stream_windows(spark, sf_dir):
    """Structured Streaming over the events file: windows that the watermark has closed."""
    rows, place, name = events(spark, sf_dir), shared_place(spark), f"w{uuid.uuid4().hex}"
    rows.select("event_id", "ts", "cents").write.parquet(f"{place}/in")
    source = spark.readStream.schema("event_id long, ts timestamp_ntz, cents long").parquet(f"{place}/in")
    found = windowed(source, {"sum_c": ("cents", "sum")}, "ts", "1 day", "0 seconds", SEQ)
    run = found.writeStream.format("parquet").option("path", f"{place}/{name}").option("checkpointLocation", f"{place}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{place}/{name}").select(F.col("bin_start").cast("timestamp_ntz").alias("bin_start"), "sum_c")


@query(f"with {_E} select time_bucket(interval '6 hours', ts) ts, sum(cents)::bigint sum_c, arg_max(cents, (ts, event_id)) last_c from e group by 1")
def stream_upsert(spark, sf_dir):
    """Structured Streaming into a dataset through foreachBatch."""
    place = shared_place(spark)
    events(spark, sf_dir).select("event_id", "ts", "cents").write.parquet(f"{place}/in")
    source = spark.readStream.schema("event_id long, ts timestamp_ntz, cents long").parquet(f"{place}/in")
    store, key = Store(spark, f"{place}/store", Table), Table("stream", 0)
    AggStream("ts", store, key, agg={"sum_c": ("cents", "sum"), "last_c": ("cents", "last")}, bin_by=TimeBins("6h"), seq=SEQ).stream(source, f"{place}/checkpoint").awaitTermination()
    return store[key].read().filter("sum_c is not null")


@query("select l_orderkey key__order, l_linenumber key__line, l_quantity quantity from lineitem")
def struct_columns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.struct(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line")).alias("key"), F.col("l_quantity").alias("quantity"))
    return columns.flatten(columns.nest(columns.flatten(rows)))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snap_5min_in_30min_left(spark, sf_dir)
