"""Golden writes, layouts, plans and the life of a dataset."""

import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans.layout import RowTarget, Slot, regions, runs, slots_of
from tidemark.sources import columns
from tidemark.sources.dataset import OrderedDataset, write
from tidemark.sources.manifest import ConcurrentCommit, decode, encode


def frame(spark, **cols):
    names = list(cols)
    rows = [(*r, i) for i, r in enumerate(zip(*cols.values(), strict=True))]
    return spark.createDataFrame(rows, [*names, "seq"])


def seeded(spark, path, on, offsets, target=10**6, **cols):
    """A dataset with files beginning at the given rows: each file is appended on its own."""
    n = len(next(iter(cols.values())))
    own = OrderedDataset(spark, str(path), on)
    for a, b in zip(offsets, [*offsets[1:], n], strict=True):
        df = frame(spark, **{k: v[a:b] for k, v in cols.items()})
        own.write(df.drop("seq") if len(df.columns) == 2 else df.select(*cols), target=target, seq=[c for c in cols if c != on][:1])
    return own


def content(own, *names, by=None):
    rows = []
    for i in range(len(own)):
        part = own[i].read().select("*", F.col("_metadata.row_index").alias("__i")).orderBy("__i").collect()
        rows += part
    return [[r[n] for r in rows] for n in names]


def sizes(own):
    return [f.rows for f in own.files]


def test_append_with_duplicates(spark, tmp_path):
    own = seeded(spark, tmp_path / "d", "a", [0, 3, 6], a=[0, 1, 2, 3, 3, 3, 4, 5], b=list(range(8)), c=[0] * 8)
    assert sizes(own) == [3, 3, 2]
    new = frame(spark, a=[5, 5, 5, 5, 6, 6, 7, 8], b=[7, 7, 8, 9, 9, 9, 10, 10], c=list(range(1, 9)))
    new = new.repartition(3)
    own.write(new.select("a", "b", "c"), target=3, duplicates_on="b", seq=["c"])
    a, b, c = content(own, "a", "b", "c")
    assert a == [0, 1, 2, 3, 3, 3, 4, 5, 5, 5, 6, 7, 8]
    assert b == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 10]
    assert c == [0, 0, 0, 0, 0, 0, 0, 2, 3, 4, 6, 7, 8]
    assert sizes(own) == [3, 3, 3, 3, 1]


@pytest.mark.parametrize("duplicates_on", ["b", None])
def test_insertion(spark, tmp_path, duplicates_on):
    own = seeded(spark, tmp_path / "d", "a", [0, 3, 6, 9], a=[0, 1, 3, 3, 5, 7, 7, 8, 9, 11, 12], b=list(range(11)), c=[0] * 11)
    own.write(frame(spark, a=[3, 4, 5, 8], b=[7, 7, 4, 9], c=[1] * 4).select("a", "b", "c"), target=3, duplicates_on=duplicates_on)
    a, b, c = content(own, "a", "b", "c")
    if duplicates_on:
        assert (a, b, c) == ([0, 1, 3, 3, 3, 4, 5, 7, 7, 8, 8, 9, 11, 12], [0, 1, 2, 3, 7, 7, 4, 5, 6, 7, 9, 8, 9, 10], [0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 1, 0, 0, 0])
        assert sizes(own) == [3, 3, 3, 3, 2]
    else:
        assert (a, b, c) == ([0, 1, 3, 3, 3, 4, 5, 5, 7, 7, 8, 8, 9, 11, 12], [0, 1, 2, 3, 7, 7, 4, 4, 5, 6, 7, 9, 8, 9, 10], [0, 0, 0, 0, 1, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0])
        assert sizes(own) == [3, 3, 3, 3, 1, 2]


def test_coalescing(spark, tmp_path):
    row = lambda *v: spark.createDataFrame([(x,) for x in v], "a long")
    own = seeded(spark, tmp_path / "one", "a", [0], a=[0, 1])
    own.write(row(20), target=4, max_off_target=1)
    assert sizes(own) == [3]
    own = seeded(spark, tmp_path / "many", "a", [0, 4, 5, 9], a=list(range(10)))
    own.write(row(20), target=4, max_off_target=2)
    assert sizes(own) == [4, 1, 4, 1, 1]
    own.write(row(20), target=4, max_off_target=2)
    assert sizes(own) == [4, 1, 4, 3]
    own = seeded(spark, tmp_path / "target", "a", [0, 4, 5, 9, 10, 11], a=list(range(12)))
    own.write(row(20), target=4, max_off_target=5)
    assert sizes(own) == [4, 1, 4, 4] and content(own, "a")[0] == [*range(12), 20]
    with pytest.raises(ValueError, match="at least 1"):
        own.write(row(21), target=4, max_off_target=0)


def test_period_layout(spark, tmp_path):
    at = lambda h, m=0: datetime(2020, 1, 1, h, m)
    rows = lambda *x: spark.createDataFrame(list(x), "a timestamp_ntz, value long")
    own = OrderedDataset(spark, str(tmp_path / "d"), "a")
    own.write(rows(*((at(h), h) for h in (10, 11, 12, 13))), target="2h")
    assert sizes(own) == [2, 2]
    own.write(rows((at(8), 8), (at(9), 9), (at(9, 30), 9), (at(14), 14), (at(15), 15)), target="2h")
    assert sizes(own) == [3, 2, 2, 2]
    own.write(rows((at(14, 30), 10), (at(15), 11)), target="2h", duplicates_on="a")
    assert sizes(own) == [3, 2, 2, 3] and content(own, "value")[0][-3:] == [14, 10, 11]
    small = OrderedDataset(spark, str(tmp_path / "small"), "a")
    for h in range(8, 12):
        small.write(rows((at(h), h)), target="1h")
    small.write(spark.createDataFrame([], "a timestamp_ntz, value long"), target="2h", max_off_target=1)
    assert sizes(small) == [2, 2]
    with pytest.raises(TypeError):
        write(spark, str(tmp_path / "int"), "a", spark.range(3).withColumnRenamed("id", "a"), target="2h")


#: Fixed values (FIXTURES.md).
REGIONS = [
    ([False, True, True, False], [True, False, True, True], [True], 3, [(1, 3)]),
    ([True, False, False, True, False, False, False, True, False], [False, False, False, False, True, False, True, False, False], [False, False], 3, [(0, 4), (7, 8)]),
    ([True, False, False, True, False, False, False, True, False], [False, False, False, False, True, False, True, False, False], [False, True], 10, [(0, 1), (3, 4), (7, 9)]),
    ([False, True, False, False], [True, True, False, True], [True], 3, [(1, 3)]),
    ([True, False, True, False], [True, True, True, True], [True], 2, [(0, 1), (2, 3)]),
    ([False, False, False, True], [False, False, False, False], [False], 1, [(0, 4)]),
    ([True, False, False, False, True, False], [True, False, True, False, False, True], [True, False], 2, [(0, 2), (4, 5)]),
    ([True, False, False, False, True], [True, False, True, False, False], [True, False], None, [(0, 1), (4, 5)]),
    ([True, False, False, False, True], [False, False, True, False, False], [False, False], 1, [(0, 2), (3, 5)]),
    ([True, False, False, False, False, True], [False, True, False, False, True, False], [False, False], 1, [(0, 1), (5, 6)]),
    ([False, False], [False, False], [False], 1, [(0, 2)]),
    ([False, False, False], [True, True, True], [], 1, []),
]


@pytest.mark.parametrize("new,on,fills,most,want", REGIONS)
def test_regions(new, on, fills, most, want):
    wide = [r for r in runs(a or not b for a, b in zip(new, on, strict=True)) if not any(new) or any(new[r[0] : r[1]])]
    answers = dict(zip(wide, [*fills, *[False] * len(wide)], strict=False))
    assert regions(new, on, lambda a, b: answers.get((a, b), False), most) == want


def test_on_target():
    rows, new = [90, 0, 50, 30, 120, 30], [0, 85, 40, 30, 0, 80]
    own = RowTarget([Slot(i, r, n, i, i) for i, (r, n) in enumerate(zip(rows, new, strict=True))], 100, True)
    assert [own.on_target(i) for i in range(6)] == [True, True, True, False, False, True]
    slots = [Slot(0, 2, 0, 1, 2), Slot(1, 2, 0, 3, 4), Slot(None, 0, 2, 7, 8)]
    assert RowTarget(slots, 4, True).fills(0, 3) and not RowTarget(slots, 8, True).fills(0, 3)


def test_slots():
    bounds = [(10, 15), (20, 25), (30, 35)]
    got = slots_of(bounds, [2, 2, 2], {1: (1, 12, 12), 3: (1, 22, 22), 5: (1, 32, 32)}, True)
    assert [(s.file, s.new_rows) for s in got] == [(0, 1), (1, 1), (2, 1)]
    got = slots_of(bounds[1:], [2, 2], {0: (1, 5, 5), 1: (1, 22, 22), 3: (1, 32, 32)}, True)
    assert [(s.file, s.new_rows) for s in got] == [(None, 1), (0, 1), (1, 1)]
    got = slots_of([(1, 3), (3, 5)], [2, 2], {1: (2, 2, 3)}, True)
    assert [(s.file, bool(s.new_rows)) for s in got] == [(0, True), (1, True)]


def test_many_files_and_random_upserts(spark, tmp_path):
    import random

    rng = random.Random(9)
    own = OrderedDataset(spark, str(tmp_path / "d"), "a")
    want = {}
    for turn in range(4):
        rows = [(rng.randint(0, 400), rng.randint(0, 2), turn * 1000 + i) for i in range(150)]
        for a, b, c in sorted(rows, key=lambda r: (r[0], r[2])):
            want[a, b] = c
        own.write(spark.createDataFrame(rows, "a long, b long, c long").repartition(3), target=3, duplicates_on=["b"], seq=["c"])
        assert {(r.a, r.b): r.c for r in own.read().collect()} == want
        assert own.count() == len(want) and all(x.high <= y.low for x, y in zip(own.files, own.files[1:], strict=False))
    assert len(own) > 64
    got = own.read(start=100, end_excl=120).collect()
    assert {(r.a, r.b) for r in got} == {k for k in want if 100 <= k[0] < 120}
    before = len(own)
    own.vacuum()
    assert len(OrderedDataset(spark, own.path)) == before and own.read().count() == len(want)


def test_metadata_views_and_drop(spark, tmp_path):
    path = str(tmp_path / "d")
    own = write(spark, path, "a", spark.range(10).withColumnRenamed("id", "a"), target=4, metadata={"k": 1, "t": datetime(2024, 1, 1), "n": {1: [None]}})
    assert sizes(own) == [4, 4, 2] and len(own) == 3 and own[1].read().count() == 4 and own[1:].count() == 6
    assert OrderedDataset(spark, path).metadata == {"k": 1, "t": datetime(2024, 1, 1), "n": {1: [None]}}
    own.update_metadata({"k": None, "x": "y"})
    assert OrderedDataset(spark, path).metadata == {"t": datetime(2024, 1, 1), "n": {1: [None]}, "x": "y"}
    for refused in (own[0].write, own[0].update_metadata, own[0].drop, own[0].remove_files):
        with pytest.raises(PermissionError):
            refused()
    own.metadata["z"] = 1
    assert "z" not in own.metadata
    assert [(r.n_rows, r.low, r.high) for r in own.stats().collect()] == [(4, 0, 3), (4, 4, 7), (2, 8, 9)]
    assert own.read(start=5, end_excl=5).count() == 0 and own.read(start=100).count() == 0
    own.remove_files([0])
    assert sizes(own) == [4, 2]
    for wrong, kind in ((dict(ordered_on="b"), ValueError), (dict(ordered_on=None), None)):
        if kind:
            with pytest.raises(kind):
                OrderedDataset(spark, path, **wrong)
    with pytest.raises(ValueError, match="no column"):
        own.write(spark.range(3))
    with pytest.raises(ValueError, match="schema"):
        own.write(spark.range(3).select(F.col("id").cast("string").alias("a")))
    with pytest.raises(ValueError, match="null in the ordering"):
        own.write(spark.createDataFrame([(None,)], "a long"))
    own.drop(preserve_metadata=True)
    again = OrderedDataset(spark, path)
    assert len(again) == 0 and again.metadata["x"] == "y"
    again.drop()
    assert OrderedDataset(spark, path).is_new
    assert decode(encode({"a": (1, 2.5, True)})) == {"a": [1, 2.5, True]}


def test_concurrent_writers(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = lambda a, b: spark.range(a, b).withColumnRenamed("id", "a")
    write(spark, path, "a", rows(0, 5))
    one, two = OrderedDataset(spark, path), OrderedDataset(spark, path)
    one.write(rows(10, 12))
    with pytest.raises(ConcurrentCommit):
        two.write(rows(20, 22))
    two.write(rows(20, 22), retries=1)
    assert OrderedDataset(spark, path).count() == 9
    with one.lock():
        start = time.time()
        with pytest.raises(TimeoutError), two.lock(timeout=0.5):
            pass
        assert 0.4 < time.time() - start < 3
    done = []

    def later():
        with two.lock(timeout=5) as own:
            done.append(own.count())

    with one.lock() as own:
        t = threading.Thread(target=later)
        t.start()
        own.write(rows(30, 31))
    t.join()
    assert done == [10]


def test_struct_columns(spark):
    df = spark.createDataFrame([(1, (2.0, 3.0))], "ts long, temp struct<a:double,b:double>")
    flat = columns.flatten(df)
    assert flat.columns == ["ts", "temp__a", "temp__b"] and columns.nest(flat).dtypes == df.dtypes
    assert columns.conform_names([("a", 1), ("ts", ""), "x"]) == ["a__1", "ts", "x"]
    with pytest.raises(TypeError):
        columns.check_names([("a", 1)])


def test_many_files_lie_in_one_folder(spark, tmp_path):
    """A write's files stand side by side, each region's in a folder of its own, with bounds that agree with the rows."""
    own = OrderedDataset(spark, str(tmp_path / "d"), "a")
    own.write(spark.range(1000).select(F.pmod(F.col("id") * 7, F.lit(1000)).alias("a")), target=9)
    assert sizes(own) == [9] * 111 + [1] and len({f.path.rsplit("/", 1)[0] for f in own.files}) == 1
    assert [(f.low, f.high) for f in own.files] == [(i, min(i + 8, 999)) for i in range(0, 1000, 9)]
    assert all(own[i].read().agg(F.min("a"), F.max("a"), F.count("a")).first() == (f.low, f.high, f.rows) for i, f in enumerate(own.files) if i % 37 == 0)
    assert own.read().count() == 1000 and own[1:60].read().count() == 59 * 9
    own.write(spark.createDataFrame([(3,), (4,), (500,), (501,), (1500,)], "a long"), target=4)
    assert own.read().count() == own.count() == 1005 and [r.a for r in own.read(start=499, end_excl=503).orderBy("a").collect()] == [499, 500, 500, 501, 501, 502]
    assert all(x.high <= y.low for x, y in zip(own.files, own.files[1:], strict=False)) and max(sizes(own)) == 9
