"""Keys, stores, intersections and restartable aggregation."""

import pickle
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.bins import RowBins, TimeBins
from tidemark.operators.segagg import bins, snapshots
from tidemark.sources.catalog import Store
from tidemark.sources.dataset import write
from tidemark.sources.keys import is_toplevel, sublevel, toplevel
from tidemark.streaming.aggstream import AggStream, SeedError, windowed


@toplevel
class Name:
    ref: str


@sublevel
class Third:
    g: int
    h: int


@sublevel
class Second:
    d: str
    e: str
    third: Third


@toplevel
class Deep:
    a: str
    b: int
    second: Second


@toplevel(field_sep=".")
class Dotted:
    n: int
    s: str


def test_keys():
    key = Deep("aha", 2, Second("oh", "ou", Third(3, 7)))
    assert str(key) == "aha-2-oh-ou-3-7" and key.to_path() == "aha-2/oh-ou/3-7" and Deep.depth == 3
    assert Deep.from_str(str(key)) == Deep.from_path(key.to_path()) == key and pickle.loads(pickle.dumps(key)) == key
    assert Deep.from_path("aha-x/oh-ou/3-7") is None and Deep.from_path("aha-2") is None and Deep.from_str("a-b") is None
    assert str(Dotted(3, "oh")) == "3.oh" and Dotted.from_path("3.oh") == Dotted(3, "oh")
    assert is_toplevel(Deep) and is_toplevel(key) and not is_toplevel(Second) and not is_toplevel(3)
    assert sorted([Name("b"), Name("a")])[0] == Name("a") and len({Name("a"), Name("a")}) == 1
    for wrong in (lambda: Name("a-b"), lambda: Name("a.b"), lambda: Name("a/b")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(TypeError):
        Name(3)
    for make in (lambda: toplevel(type("A", (), {"__annotations__": {"x": float}})), lambda: toplevel(type("B", (), {"__annotations__": {"x": Third}})), lambda: toplevel(type("C", (), {"__annotations__": {"x": Third, "y": int}}))):
        with pytest.raises(TypeError):
            make()


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Deep)
    one, two = Deep("a", 1, Second("b", "c", Third(1, 2))), Deep("a", 1, Second("b", "d", Third(1, 2)))
    assert len(store) == 0 and one not in store and list(store) == []
    for key in (two, one):
        store.get(key, "id").write(spark.range(5))
    (tmp_path / "s" / "nokey" / "x" / "y").mkdir(parents=True)
    assert list(store) == [one, two] and len(store) == 2 and one in store and "a-1-b-c-1-2" in repr(store)
    assert store[one].read().count() == 5 and len(store.register("v_")) == 2
    assert spark.table("v_a_1_b_c_1_2").count() == 5
    del store[two]
    assert list(store) == [one] and not (tmp_path / "s" / "a-1" / "b-d").exists()
    with pytest.raises(KeyError):
        del store[two]
    with pytest.raises(TypeError):
        store[3]


def moment(text):
    return datetime.fromisoformat(f"2025-01-01 {text}")


#: Fixed values (FIXTURES.md): times of three datasets.
KEY_ROWS = {
    "key1": ["08:00", "09:00", "10:00", "10:00", "10:00", "10:00", "14:00", "14:15", "18:15", "18:15"],
    "key2": ["08:35", "08:35", "08:35", "10:00", "12:10", "12:10", "12:10", "12:10", "14:00", "15:15", "18:00", "19:15"],
    "key3": ["15:15", "16:00", "18:15", "19:00", "22:00", "22:05", "22:05", "22:05"],
}


@pytest.fixture(scope="module")
def three(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("three")), Name)
    for name, text in KEY_ROWS.items():
        rows = [(moment(t), i) for i, t in enumerate(text)]
        store.get(Name(name), "ts").write(spark.createDataFrame(rows, "ts timestamp_ntz, i long"), target=2, seq=["i"])
    return store


def test_intersections(three):
    keys = [Name(k) for k in KEY_ROWS]
    found = three.intersections(keys)
    assert found.edges == [moment(t) for t in ("10:00", "12:10", "14:00", "18:00", "18:15", "22:00")]
    counts = [tuple(part[k].count() for k in keys) for part in three.iter_intersections(keys)]
    assert counts == [(2, 3, 0), (4, 1, 0), (0, 4, 0), (2, 2, 2), (0, 1, 0), (2, 1, 2), (0, 0, 4)]
    assert three.intersections(keys, moment("10:10"), moment("10:20")).edges == []
    assert three.intersections(keys, end_excl=moment("10:05")).intervals == [(None, moment("10:00")), (moment("10:00"), moment("10:05"))]
    union = found.union().groupBy("key", "interval_id").count().collect()
    assert {(r.key, r.interval_id): r["count"] for r in union} == {(str(k), i): c[j] for i, c in enumerate(counts) for j, k in enumerate(keys) if c[j]}
    both = found.cogroup(keys[0], keys[1], lambda a, b: __import__("pandas").DataFrame({"n": [len(a) * 100 + len(b)]}), "n long")
    assert sorted(r.n for r in both.collect()) == sorted(a * 100 + b for a, b, _ in counts if a or b)
    grid = three.intersections(keys, edges="4h")
    assert grid.edges == [moment("12:00"), moment("16:00"), moment("20:00")]
    assert [p[keys[0]].count() for p in grid] == [6, 2, 2, 0]


#: Fixed values (FIXTURES.md).
TIMES = ["08:00", "08:30", "09:00", "09:30", "10:00", "10:20", "10:40", "11:00", "11:30", "12:00", "12:20", "12:40", "13:00", "13:20", "13:40", "14:00", "14:20"]


@pytest.mark.parametrize("target,sizes", [(6, [[6, 1], [6, 2], [6, 2]]), ("2h", [[2, 2, 2, 1], [2, 2, 2, 2], [2, 2, 2, 2]])])
def test_hourly_sum_with_restart(spark, tmp_path, target, sizes):
    store = Store(spark, str(tmp_path / "s"), Name)
    key = Name("hourly")
    rows = [(moment(t), i + 1) for i, t in enumerate(TIMES)]
    make = lambda: AggStream("ts", store, key, agg={"sum": ("val", "sum")}, bin_by=TimeBins("1h"), target=target)
    frame = lambda: spark.createDataFrame(rows, "ts timestamp_ntz, val long").repartition(3)
    result = lambda: [r["sum"] for r in store[key].ordered().collect()]
    files = lambda: [f.rows for f in store[key].files]
    make().run(frame(), trim_start=True, discard_last=True)
    assert result() == [3, 7, 18, 17, 33, 42, 16] and files() == sizes[0]
    assert make().restart_index(key) == moment("14:20")
    rows += [(moment("15:10"), 1), (moment("15:11"), 2)]
    make().run(frame(), trim_start=True, discard_last=True)
    assert result() == [3, 7, 18, 17, 33, 42, 33, 1] and files() == sizes[1]
    rows += [(moment("15:20"), 11), (moment("15:21"), 12)]
    make().run(frame(), trim_start=True, discard_last=False)
    assert result() == [3, 7, 18, 17, 33, 42, 33, 26] and files() == sizes[2]


def test_single_row_waits(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Name)
    stream = AggStream("ts", store, Name("x"), agg={"n": ("val", "sum")}, bin_by="1h")
    stream.run(spark.createDataFrame([(moment("08:00"), 1)], "ts timestamp_ntz, val long"), trim_start=True, discard_last=True)
    assert len(store[Name("x")]) == 0 and stream.restart_index(Name("x")) == moment("08:00")


OFFSETS = [2, 3, 4, 7, 10, 14, 14, 14, 16, 17, 24, 29, 30, 31, 32, 33, 36, 37, 39, 45, 48, 49, 50, 54, 54, 56, 58, 59, 60, 61, 64, 65, 77, 89, 90, 90, 90, 94, 98, 98, 99, 100, 103, 104, 108, 113, 114, 115, 117, 117]


@pytest.mark.parametrize("parallel", [False, True])
def test_filters_pairs_and_chunks_equal_one_run(spark, tmp_path, parallel):
    store = Store(spark, str(tmp_path / "s"), Name)
    rows = [(datetime(2020, 1, 1) + timedelta(minutes=o), o, i % 2 == 1, i) for i, o in enumerate(OFFSETS)]
    seed = spark.createDataFrame(rows, "ts timestamp_ntz, val long, filter_on boolean, seq long")
    spec = {"first": ("val", "first"), "last": ("val", "last"), "sum": ("val", "sum")}
    ten, two, twenty, rows4 = (Name("b10"), Name("s10")), (Name("b2"), Name("s2")), (Name("b20"), Name("s20")), Name("rows")
    stream = AggStream(
        "ts", store, {"on": {ten: {"bin_by": TimeBins("10min", "left", "right")}, two: {"bin_by": TimeBins("2min", "left", "right")}}, "off": {twenty: {"bin_by": TimeBins("20min", "left", "right")}}, "_": {rows4: {"bin_by": RowBins(4), "snap_by": None}}},
        filters={"on": [("filter_on", "==", True)], "off": [("filter_on", "~", None)]}, agg=spec, snap_by=TimeBins("5min", "left", "right"), seq=["seq"], parallel=parallel,
    )
    stream.configs[rows4] = type(stream.configs[rows4])(**{**stream.configs[rows4].__dict__, "snap_by": None})
    cuts = [datetime(2020, 1, 1) + timedelta(minutes=m) for m in (0, 15, 55, 91, 500)]
    stream.run([seed.filter((F.col("ts") >= a) & (F.col("ts") < b)) for a, b in zip(cuts, cuts[1:], strict=False)])
    parts = {ten: (seed.filter("filter_on"), "10min"), two: (seed.filter("filter_on"), "2min"), twenty: (seed.filter("not filter_on"), "20min")}
    for pair, (part, step) in parts.items():
        want = bins(part, spec, TimeBins(step, "left", "right"), "ts", seq=["seq"]).orderBy("bin_label").collect()
        got = store[pair[0]].ordered().collect()
        assert [tuple(r[c] for c in ("ts", *spec)) for r in got] == [tuple(r[c] for c in ("bin_label", *spec)) for r in want]
        want = snapshots(part, spec, TimeBins(step, "left", "right"), TimeBins("5min", "left", "right"), "ts", seq=["seq"]).orderBy("instant").collect()
        got = store[pair[1]].ordered().collect()
        assert [tuple(r[c] for c in ("ts", *spec)) for r in got] == [tuple(r[c] for c in ("instant", *spec)) for r in want]
    sums = [sum(OFFSETS[i : i + 4]) for i in range(0, 50, 4)]
    assert [r["sum"] for r in store[rows4].ordered().collect()] == sums


def test_hooks_and_errors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Name)
    rows = lambda a, b: spark.createDataFrame([(moment("08:00") + timedelta(minutes=i), i) for i in range(a, b)], "ts timestamp_ntz, val long")

    def check(df):
        if df.filter("val = 25").count():
            raise ValueError("25 is not allowed")

    def rolling(found):
        return found.withColumn("roll", F.sum("sum").over(Window.orderBy("ts").rowsBetween(-1, 0)))

    key = Name("k")
    stream = AggStream("ts", store, key, agg={"sum": ("val", "sum")}, bin_by="10min", pre=check, post=rolling)
    with pytest.raises(SeedError, match="25"):
        stream.run([rows(0, 10), rows(10, 20), rows(20, 30), rows(30, 40)])
    assert [r["sum"] for r in store[key].ordered().collect()] == [45, 145] and "roll" in store[key].read().columns
    quiet = AggStream("ts", store, Name("q"), agg={"sum": ("val", "sum")}, bin_by="10min", post=lambda b: None)
    quiet.run(rows(0, 10))
    assert len(store[Name("q")]) == 0
    late = AggStream("ts", store, Name("late"), agg={"sum": ("val", "sum")}, bin_by="10min")
    late.run(rows(0, 15), final_write=False)
    assert len(store[Name("late")]) == 0
    late.run(None)
    assert [r["sum"] for r in store[Name("late")].ordered().collect()] == [45, 60]
    for wrong in (dict(agg=None), dict(bin_by=None), dict(keys={key: {"nothing": 1}}), dict(keys=[key], filters={"a": []}), dict(keys=(key, Name("z")))):
        with pytest.raises(ValueError):
            AggStream(**{**dict(ordered_on="ts", store=store, keys=key, agg={"s": ("val", "sum")}, bin_by="1h"), **wrong})
    other = Name("other")
    write(spark, store.path(other), "ts", rows(0, 3))
    with pytest.raises(ValueError, match="not made by"):
        AggStream("ts", store, other, agg={"s": ("val", "sum")}, bin_by="1h").run(rows(3, 4))
    with pytest.raises(SeedError, match="goes back"):
        late.run(rows(3, 5))
    with pytest.raises(SeedError):
        late.run(spark.createDataFrame([(None, 1)], "ts timestamp_ntz, val long"))


def test_structured_streaming(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Name)
    key, schema = Name("k"), "ts timestamp_ntz, val long"
    rng = random.Random(1)
    values = [(moment("08:00") + timedelta(minutes=i), rng.randint(0, 9)) for i in range(120)]
    source = str(tmp_path / "in")
    frame = lambda a, b: spark.createDataFrame(values[a:b], schema).coalesce(1).write.mode("append").parquet(source)
    make = lambda: AggStream("ts", store, key, agg={"sum": ("val", "sum"), "last": ("val", "last")}, bin_by="15min")
    read = lambda: spark.readStream.schema(schema).parquet(source)
    for a, b in ((0, 50), (50, 51), (51, 120)):
        frame(a, b)
        make().stream(read(), str(tmp_path / "cp")).awaitTermination()
    got = [(r["sum"], r["last"]) for r in store[key].ordered().collect()]
    assert got == [(sum(v for _, v in values[i : i + 15]), values[i + 14][1]) for i in range(0, 120, 15)]
    again, before = make(), store[key].read().collect()
    again._run(spark.createDataFrame(values[51:], schema), False, False, True, (str(tmp_path / "cp"), 0))  # a batch that was done already
    again._run(spark.createDataFrame([(moment("07:00"), 5)], schema), False, False, True, (str(tmp_path / "cp"), 99))  # a row that comes too late
    assert sorted(map(str, store[key].read().collect())) == sorted(map(str, before))
    query = windowed(read(), {"sum": ("val", "sum"), "first": ("val", "first")}, "ts", "30 minutes", "1 minute", ["val"]).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    query.awaitTermination()
    assert sorted(r["sum"] for r in spark.table("w").collect()) == sorted(sum(v for _, v in values[i : i + 30]) for i in range(0, 90, 30))


@pytest.mark.parametrize("pair", [False, True])
def test_post_over_restarts_is_one_run(spark, tmp_path, pair):
    """A rolling sum of three bins, and a running one of two snapshots, in one run and in several."""
    rows = [(i, moment("08:00") + timedelta(minutes=7 * i), i % 5 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz, val long")
    roll = lambda found, n: found.withColumn("roll", F.sum("s").over(Window.orderBy("ts").rowsBetween(1 - n, 0)))
    post = (lambda found, snaps: (roll(found, 3), roll(snaps, 2))) if pair else (lambda found: roll(found, 3))
    got = []
    for name, cuts in (("one", []), ("many", [9, 10, 24, 26, 45]), ("flushed", [9, 26])):
        store = Store(spark, str(tmp_path / name), Name)
        key = (Name("bins"), Name("snaps")) if pair else Name("bins")
        options = {"snap_by": TimeBins("15min", "left", "right")} if pair else {}
        bounds = [0, *cuts, 60]
        for a, b in zip(bounds, bounds[1:], strict=False):
            stream = AggStream("ts", store, {key: {}}, agg={"s": ("val", "sum")}, bin_by=TimeBins("30min", "left", "right"), post=post, lookback=2, seq=["i"], **options)
            stream.run(df.filter((F.col("i") >= a) & (F.col("i") < b)), final_write=name != "flushed" or b == 60)
        got.append([sorted(map(repr, store[k].read().collect())) for k in (key if pair else (key,))])
    assert got[0] == got[1] == got[2] and len(got[0][0]) == 14


def test_a_check_of_any_column_stops_the_run(spark, tmp_path):
    df = spark.createDataFrame([(moment("08:00"), 1, 5), (moment("08:10"), 2, -5)], "ts timestamp_ntz, i long, val long")
    check = lambda chunk: chunk.withColumn("val", F.when(F.col("val") < 0, F.raise_error(F.lit("below zero")).cast("long")).otherwise(F.col("val")))
    store = Store(spark, str(tmp_path / "s"), Name)
    keys = {Name("counts"): {"agg": {"n": ("i", "sum")}}, Name("sums"): {"agg": {"s": ("val", "sum")}}}
    with pytest.raises(SeedError, match="below zero"):
        AggStream("ts", store, keys, bin_by=TimeBins("10min"), pre=check).run(df)
    assert len(list(store)) == 0
