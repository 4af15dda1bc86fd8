"""Golden bins and snapshots, frequencies, filters and ordered helpers."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.frequency import Frequency, ceil_ts, floor_ts, floor_value
from tidemark.operators import ordering, predicates
from tidemark.operators.bins import EdgeBins, FlagBins, GroupedBins, RowBins, TimeBins
from tidemark.operators.segagg import Instants, bins, snapshots


def at(text, day="2020-01-01"):
    return datetime.fromisoformat(f"{day} {text}")


S7 = [("08:10", 4.0, 4), ("08:10", 4.2, 3), ("08:12", 3.9, 1), ("08:17", 5.6, 7), ("08:19", 6.0, 2), ("08:20", 9.8, 6), ("09:00", 4.5, 2), ("09:10", 1.1, 8), ("09:30", 3.2, 1)]
SPEC = {"first": ("value", "first"), "max": ("value", "max"), "min": ("value", "min"), "last": ("value", "last"), "sum": ("qty", "sum"), "at": ("dti", "first")}


@pytest.fixture(scope="module")
def s7(spark):
    rows = [(i, at(t), v, q) for i, (t, v, q) in enumerate(S7)]
    return spark.createDataFrame(rows, "seq int, dti timestamp_ntz, value double, qty long").repartition(3)


def columns(df, *names):
    rows = df.orderBy(df.columns[0]).collect()
    return [[r[n] for r in rows] for n in names]


def test_snapshots_left(s7):
    got = snapshots(s7, SPEC, TimeBins("30min", "left", "right"), TimeBins("5min", "left", "right"), "dti", seq=["seq"])
    n = None
    instant, first, mx, mn, last, total, started = columns(got, "instant", "first", "max", "min", "last", "sum", "at")
    assert instant == [at("08:15") + timedelta(minutes=5 * i) for i in range(17)]
    assert first == [4.0] * 4 + [n] * 6 + [4.5] * 6 + [3.2]
    assert mx == [4.2, 6.0, 9.8, 9.8] + [n] * 6 + [4.5] * 6 + [3.2]
    assert mn == [3.9] * 4 + [n] * 6 + [4.5, 4.5] + [1.1] * 4 + [3.2]
    assert last == [3.9, 6.0, 9.8, 9.8] + [n] * 6 + [4.5, 4.5] + [1.1] * 4 + [3.2]
    assert total == [8, 17, 23, 23] + [n] * 6 + [2, 2] + [10] * 4 + [1]
    assert started == [at("08:10")] * 4 + [n] * 6 + [at("09:00")] * 6 + [at("09:30")]


def test_snapshots_right(s7):
    got = snapshots(s7, SPEC, TimeBins("30min", "right", "left"), TimeBins("5min", "right", "right"), "dti", seq=["seq"])
    n = None
    instant, first, mx, mn, last, total, _ = columns(got, "instant", "first", "max", "min", "last", "sum", "at")
    assert instant == [at("08:10") + timedelta(minutes=5 * i) for i in range(17)]
    assert first == [4.0] * 5 + [n] * 5 + [4.5, n] + [1.1] * 5
    assert mx == [4.2, 4.2] + [9.8] * 3 + [n] * 5 + [4.5, n] + [1.1] * 4 + [3.2]
    assert mn == [4.0] + [3.9] * 4 + [n] * 5 + [4.5, n] + [1.1] * 5
    assert last == [4.2, 3.9] + [9.8] * 3 + [n] * 5 + [4.5, n] + [1.1] * 4 + [3.2]
    assert total == [7, 8] + [23] * 3 + [n] * 5 + [2, n] + [8] * 4 + [9]


def test_explicit_instants(spark):
    df = spark.createDataFrame([(at("08:10"), 4.2), (at("08:55"), 3.2)], "dti timestamp_ntz, value double")
    times = ["08:00", "08:05", "08:06", "08:10", "08:44", "08:48", "08:52", "08:55", "09:06", "09:09", "09:16"]
    for side, want in (("left", [None] * 9), ("right", [None] * 3 + [4.2] + [None] * 3 + [3.2])):
        got = snapshots(df, {"v": ("value", "first")}, TimeBins("30min", side), Instants([at(t) for t in times]), "dti")
        assert columns(got, "v")[0] == want


def test_row_bins_with_instants(spark):
    rows = list(enumerate(zip(["08:10", "08:10", "08:12", "08:17", "08:19", "08:20", "09:00", "09:10", "09:30"], [1, 4, 6, 2, 3, 1, 9, 3, 2], strict=True)))
    df = spark.createDataFrame([(i, at(t), q) for i, (t, q) in rows], "seq int, dti timestamp_ntz, qty long").repartition(2)
    spec = {"min": ("qty", "min"), "last": ("qty", "last")}
    got = bins(df, spec, RowBins(4), "dti", seq=["seq"])
    assert [list(x) for x in zip(*columns(got, "bin_label", "min", "last"), strict=True)] == [[at("08:10"), 1, 2], [at("08:19"), 1, 3], [at("09:30"), 2, 2]]
    times = ["08:12", "08:15", "08:20", "08:35", "08:40", "09:00", "09:11", "09:20", "09:40", "09:44"]
    got = snapshots(df, spec, RowBins(4), Instants([at(t) for t in times]), "dti", seq=["seq"])
    assert [list(x) for x in zip(*columns(got, "instant", "min", "last"), strict=True)] == [[at(t), a, b] for t, a, b in [("08:12", 1, 4), ("08:15", 1, 6), ("08:20", 3, 3), ("08:35", 1, 1), ("08:40", 1, 1), ("09:00", 1, 1), ("09:11", 1, 3), ("09:20", 1, 3), ("09:40", 2, 2)]]


@pytest.mark.parametrize("freq", ["13min", "1h", "2D", "W", "MS", "ME", "SMS", "QE"])
@pytest.mark.parametrize("closed", ["left", "right"])
def test_bins_like_pandas(spark, freq, closed):
    rng = random.Random(11)
    times = sorted(datetime(2024, 1, 27, 8, 10) + timedelta(minutes=rng.randint(0, 200_000 if freq not in ("13min", "1h") else 3000)) for _ in range(80)) + [datetime(2024, 7, 1), datetime(2024, 7, 1)][: 2 * (freq not in ("13min", "1h"))]
    if freq == "SMS" and closed == "right":
        pytest.skip("pandas shifts the edges of this pair; see test_half_months_closed_right")
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts timestamp_ntz, v long").repartition(3)
    got = bins(df, {"first": ("v", "first"), "last": ("v", "last"), "sum": ("v", "sum")}, TimeBins(freq, closed, "left"), "ts", seq=["v"]).orderBy("bin_label").collect()
    want = pd.DataFrame({"ts": times, "v": range(len(times))}).groupby(pd.Grouper(key="ts", freq=freq, closed=closed, label="left")).agg(first=("v", "first"), last=("v", "last"), sum=("v", "sum"), n=("v", "count")).reset_index()
    want = want[want.index <= want[want.n > 0].index.max()].reset_index(drop=True)
    want = want[want.index >= want[want.n > 0].index.min()].reset_index(drop=True)
    assert [r.bin_label for r in got] == [t.to_pydatetime() for t in want.ts]
    assert [(r.first, r.last, r.sum) for r in got] == [(None,) * 3 if r.n == 0 else (r.first, r.last, r.sum) for r in want.itertuples()]


#: Fixed values (FIXTURES.md): a time, a frequency, its floor and its ceiling.
FLOORS = [
    ("2024-03-01", "MS", "2024-03-01", "2024-04-01"),
    ("2024-03-31", "MS", "2024-03-01", "2024-04-01"),
    ("2024-03-15 14:30", "MS", "2024-03-01", "2024-04-01"),
    ("2024-03-15 14:30", "ME", "2024-02-29", "2024-03-31"),
    ("2024-03-17 14:30", "SMS", "2024-03-15", "2024-04-01"),
    ("2024-03-07 14:30", "SMS", "2024-03-01", "2024-03-15"),
    ("2024-03-17 14:30", "SME", "2024-03-15", "2024-03-31"),
    ("2024-03-07 14:30", "SME", "2024-02-29", "2024-03-15"),
    ("2024-03-15 14:37:23", "h", "2024-03-15 14:00", "2024-03-15 15:00"),
    ("2024-03-15 01:00", "h", "2024-03-15 01:00", "2024-03-15 02:00"),
    ("2024-03-15 14:37:23", "D", "2024-03-15", "2024-03-16"),
    ("2024-03-15 00:00", "D", "2024-03-15", "2024-03-16"),
]


def test_floor_and_ceil(spark):
    for ts, freq, low, high in FLOORS:
        row = spark.createDataFrame([(datetime.fromisoformat(ts),)], "t timestamp_ntz").select(floor_ts(F.col("t"), freq).alias("low"), ceil_ts(F.col("t"), freq).alias("high")).first()
        assert (row.low, row.high) == (datetime.fromisoformat(low), datetime.fromisoformat(high)), (ts, freq)
        assert floor_value(datetime.fromisoformat(ts), freq) == row.low
    for wrong in ("", "x", "0h", "2q3"):
        with pytest.raises(ValueError):
            Frequency.parse(wrong)


def test_edges_flags_and_functions(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 300)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x long").repartition(4)
    for closed in ("left", "right"):
        ends = [10, 50, 51, 200]
        want = dict.fromkeys(ends)
        for _, x in rows:
            for e in ends:
                if x < e or closed == "right" and x == e:
                    want[e] = (want[e] or 0) + x
                    break
        few = {r.bin_label: r.s for r in bins(df, {"s": ("x", "sum")}, EdgeBins(ends, closed), "x").collect()}
        many = {r.bin_label: r.s for r in bins(df, {"s": ("x", "sum")}, EdgeBins(spark.createDataFrame([(e,) for e in ends], "e long"), closed), "x").collect()}
        assert few == many == want
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    want, n = {}, 0
    for i, x in ordered:
        n += i % 7 == 0
        want.setdefault(n, []).append(x)
    got = bins(df, {"s": ("x", "sum"), "f": ("x", "first")}, FlagBins(F.col("id") % 7 == 0), "x", seq=["id"]).collect()
    assert sorted((r.f, r.s) for r in got) == sorted((w[0], sum(w)) for w in want.values())
    by = GroupedBins(lambda p: (p["x"] // 100).tolist(), group="one")
    got = bins(df.withColumn("one", F.lit(1)), {"s": ("x", "sum")}, by, "x", seq=["id"]).orderBy("bin_start").collect()
    assert [r.s for r in got] == [sum(x for _, x in rows if x // 100 == k) for k in range(4) if any(x // 100 == k for _, x in rows)]


def test_groups_of_many_batches(spark):
    """Groups that end within a batch and beyond it, in order whatever the rows' order is, and rows without a group."""
    rows = spark.range(45_000).select(F.pmod(F.col("id") * 7919, F.lit(45_000)).alias("x"))
    kind = F.when(F.col("x") < 11_000, "a").when(F.col("x") < 36_000, "b")
    rows = rows.select("x", kind.alias("kind"), F.when(F.col("x") != 30_000, F.col("x")).alias("y"))
    by = GroupedBins(lambda p: [i // 10_000 for i in range(len(p))], group="kind")
    got = bins(rows, {"kind": ("kind", "min"), "n": ("x", "max"), "y": ("y", "sum")}, by, "x").orderBy("bin_start").collect()
    cuts = [("a", 0, 10_000), ("a", 10_000, 11_000), ("b", 11_000, 21_000), ("b", 21_000, 31_000), ("b", 31_000, 36_000), (None, 36_000, 45_000)]
    assert [(r.kind, r.bin_start, r.n, r.y) for r in got] == [(k, a, b - 1, sum(range(a, b)) - 30_000 * (a <= 30_000 < b)) for k, a, b in cuts]


def test_wrong_specs(s7):
    with pytest.raises(ValueError, match="unknown aggregation"):
        bins(s7, {"a": ("value", "mean")}, "1h", "dti")
    with pytest.raises(ValueError, match="no column"):
        bins(s7, {"a": ("nothing", "sum")}, "1h", "dti")
    with pytest.raises(ValueError, match="same side"):
        snapshots(s7, SPEC, TimeBins("1h", "left"), TimeBins("5min", "right"), "dti")
    with pytest.raises(Exception, match="s is 0"):
        bins(s7.withColumn("z", F.lit(0)), {"s": ("z", "sum")}, "1h", "dti", error_on_0=True).collect()
    assert bins(s7.limit(0), SPEC, TimeBins("1h"), "dti").count() == 0
    assert snapshots(s7.limit(0), SPEC, TimeBins("1h"), TimeBins("5min"), "dti").count() == 0


def test_filters(spark):
    df = spark.range(20).withColumn("b", F.col("id") % 2 == 0)
    ids = lambda f: [r.id for r in predicates.keep(df, f).orderBy("id").collect()]
    assert ids([("id", ">=", 5), ("id", "<", 8)]) == [5, 6, 7]
    assert ids([[("id", "==", 1)], [("id", "in", {3, 4}), ("b", "~", None)]]) == [1, 3]
    assert ids([[("id", "not in", range(2, 20))]]) == [0, 1]
    with pytest.raises(ValueError):
        ids([[("id", "like", 1)]])
    with pytest.raises(ValueError):
        predicates.dnf([("id", "==", 1)])
    both = predicates.tagged(df, {"_": None, "low": [("id", "<", 3)]}).groupBy("filter_id").count().collect()
    assert {r.filter_id: r["count"] for r in both} == {"_": 20, "low": 3}
    assert predicates.discard_last(df, "id").count() == 19 and predicates.trim_start(df, "id", 0).count() == 20
    with pytest.raises(Exception, match="null in the ordering"):
        predicates.checked_order(df.withColumn("id", F.when(F.col("id") > 3, F.col("id"))), "id").collect()


def test_ordered_helpers(spark):
    known = spark.createDataFrame([(x,) for x in [1, 2, 3, 4, 5]], "k long")
    queries = spark.createDataFrame([(x,) for x in [0, 1, 5, 10]], "q long")
    assert sorted(r.q for r in ordering.not_in(queries, "q", known, "k").collect()) == [0, 10]
    assert {r.q: r.position for r in ordering.insert_positions(queries, "q", known, "k").collect()} == {0: 0, 1: 0, 5: 4, 10: 5}
    nan = float("nan")
    values = spark.createDataFrame(list(enumerate([nan, 1.0, nan, 8.0, nan, 5.0, None])), "i int, v double").repartition(3)
    assert [r.v for r in ordering.ffill(values, "v", ["i"]).orderBy("i").collect()] == [None, 1, 1, 8, 8, 5, 5]
    assert [r.v for r in ordering.fill(values, "v", ["i"], forward=False, block=2).orderBy("i").collect()] == [1, 1, 8, 8, 5, 5, None]
    big = spark.range(1000).withColumn("v", F.when(F.col("id") % 97 == 5, F.col("id"))).repartition(7)
    got = ordering.fill(big, "v", ["id"], "f", block=10).collect()
    assert all(r.f == (None if r.id < 5 else (r.id - 5) // 97 * 97 + 5) for r in got)
    merged = ordering.merge_edges(known.withColumnRenamed("k", "e"), queries.withColumnRenamed("q", "e"), "e").orderBy("position").collect()
    assert [(r.e, r.source) for r in merged] == [(0, 1), (1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0), (5, 1), (10, 1)]
    rows = spark.createDataFrame([(1, "a", 0), (1, "a", 1), (1, "b", 2), (2, None, 3), (2, None, 4)], "k int, s string, n int")
    assert sorted((r.k, r.s, r.n) for r in ordering.keep_last(rows, ["k", "s"], ["n"]).collect() if r.s) == [(1, "a", 1), (1, "b", 2)]
    assert ordering.keep_last(rows, [], ["n"]).count() == 5 and ordering.keep_last(rows, None, ["n"]) is rows


def test_half_months_closed_right(spark):
    """The rule: (start, end] between the 1st and the 15th; a time at an anchor belongs to the bin that it ends."""
    times = [datetime(2024, 1, 1), datetime(2024, 1, 1, 1), datetime(2024, 1, 15), datetime(2024, 1, 15, 0, 1), datetime(2024, 2, 1), datetime(2024, 2, 2)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts timestamp_ntz, v long")
    got = bins(df, {"first": ("v", "first"), "last": ("v", "last")}, TimeBins("SMS", "right", "right"), "ts", seq=["v"]).orderBy("bin_label").collect()
    want = [(datetime(2024, 1, 1), 0, 0), (datetime(2024, 1, 15), 1, 2), (datetime(2024, 2, 1), 3, 4), (datetime(2024, 2, 15), 5, 5)]
    assert [(r.bin_label, r.first, r.last) for r in got] == want


@pytest.mark.parametrize("origin", ["start", "end", "start_day", "end_day", "epoch"])
@pytest.mark.parametrize("closed", ["left", "right"])
def test_named_origins_like_pandas(spark, origin, closed):
    rng = random.Random(4)
    times = sorted(datetime(2024, 1, 27, 8, 10) + timedelta(minutes=rng.randint(0, 5000)) for _ in range(60))
    df = spark.createDataFrame([(t, i) for i, t in enumerate(times)], "ts timestamp_ntz, v long").repartition(3)
    got = bins(df, {"sum": ("v", "sum")}, TimeBins("7h", closed, "left", origin=origin, offset="13min"), "ts", seq=["v"], empty=False).orderBy("bin_label").collect()
    want = pd.DataFrame({"ts": times, "v": range(60)}).groupby(pd.Grouper(key="ts", freq="7h", closed=closed, label="left", origin=origin, offset="13min")).agg(sum=("v", "sum"), n=("v", "count")).reset_index()
    want = want[want.n > 0]
    assert [(r.bin_label, r.sum) for r in got] == [(x.ts.to_pydatetime(), x.sum) for x in want.itertuples(index=False)]


@pytest.mark.parametrize("freq,first", [("MS", lambda t: t.replace(day=1)), ("W", lambda t: t - timedelta(days=(t.weekday() + 1) % 7))])
def test_offset_moves_calendar_steps(spark, freq, first):
    times = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(90)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    got = TimeBins(freq, "left", "left", offset="2D").assign(df, "ts").collect()
    assert {r.ts: r.bin_label for r in got} == {t: first(t - timedelta(days=2)) + timedelta(days=2) for t in times}


def test_next_mark_either_way(spark, monkeypatch):
    rng = random.Random(6)
    points = spark.createDataFrame([(i, rng.randint(0, 500), f"r{i}") for i in range(300)], "id long, x long, `odd.name` string").repartition(4)
    marks = spark.createDataFrame([(m, f"m{m}") for m in sorted(rng.sample(range(450), 40))], "m long, label string")
    for inclusive in (True, False):
        found = []
        for most in (50_000, 0):
            monkeypatch.setattr(ordering, "SENT_MARKS", most)
            rows = ordering.next_of(points, "x", marks, "m", inclusive, "next", ["label"]).collect()
            found.append(sorted((r.id, r["odd.name"], r.next, r.label) for r in rows))
        all_marks = [r.m for r in marks.collect()]
        want = sorted((r.id, r["odd.name"], m := min((m for m in all_marks if m > r.x or inclusive and m == r.x), default=None), m if m is None else f"m{m}") for r in points.collect())
        assert found[0] == found[1] == want
    assert ordering.next_of(points, "x", marks.limit(0), "m", True, "next").filter("next is not null").count() == 0
