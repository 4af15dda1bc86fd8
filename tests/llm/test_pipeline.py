"""The stages of corpus_pipeline against brute force, each on its own input."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tidemark.llm import op3_quality, op5_mixing, op8_decontaminate, op10_sharding

DATA = "/root/testdata/sf0.001"


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality(spark, docs):
    scores = {r.doc_id: r.score for r in op3_quality.op3_quality(spark, DATA).collect()}
    out = cp.quality(spark, docs, DATA)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {k for k, s in scores.items() if s >= 0.5}


def test_decontamination(spark, docs):
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {r.doc_id for r in docs.collect() if not any(s and len(s & shingle_set(r.text)) >= 0.8 * len(s) - 1e-9 for s in items)}
    out = cp.decontamination(spark, docs, DATA)
    assert {r.doc_id for r in out.collect()} == want and len(want) < docs.count() and out.columns == docs.columns


def test_contained_in_scattered_and_short_ones(spark):
    rng = random.Random(3)
    item = [f"i{i}" for i in range(30)]
    noise = [f"n{i}" for i in range(3000)]
    docs = [(1, " ".join(noise[:1500] + item + noise[1500:])), (2, " ".join(item[:27])), (3, " ".join(item[:20])), (4, " ".join(item[:15] + noise[:40] + item[11:])), (5, None), (6, "a B c"), (7, "a b c d"), (None, " ".join(item))]
    docs += [(100 + i, " ".join(rng.sample(noise, 50))) for i in range(20)]
    items = [(1, " ".join(item)), (2, "A b C"), (3, None), (4, " ")]
    got = {(r.doc_id, r.item_id) for r in op8_decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i) for d, t in docs for i, u in items if shingle_set(u) and len(shingle_set(u) & shingle_set(t)) >= 0.8 * len(shingle_set(u)) - 1e-9}
    assert got == want and {(1, 1), (6, 2), (None, 1)} <= got
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op8_decontaminate.search(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_mixing(spark, docs):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = Counter({r[0]: r[1] for r in con.sql(f"select doc_id, copies + (take_tokens > copies * n_tokens)::int from ({op5_mixing.oracle(epochs=1)})").fetchall()})
    out = cp.mixing(spark, docs, DATA)
    assert Counter(r.doc_id for r in out.collect()) == want and out.columns == docs.columns


def test_mixing_shortage_goes_to_siblings_first(spark):
    rows = [(i, " ".join(["w"] * 10), "en" if i < 40 else "de", f"src{0 if i < 5 else 4 if i < 40 else 8}", 0) for i in range(60)] + [(99, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    drawn = op5_mixing.mix(docs, *op5_mixing.document_levels(), budget_share=0.5, epochs=2).collect()
    got = defaultdict(int)
    for r in drawn:
        got[r.leaf] += r.take_tokens
    # en is due 5/7 of 300 tokens; src0 can give 100 in two epochs and src4 the rest of that share; de has the other 2/7.
    assert got == {"d0/en/src0": 100, "d0/en/src4": 114, "d0/de/src8": 85}
    assert {r.copies for r in drawn if r.leaf == "d0/en/src0"} == {2}
    assert op5_mixing.mix(docs.limit(0), *op5_mixing.document_levels()).count() == 0


def test_mixing_of_repeated_rows(spark):
    row = (1, "a b c", "en", "src1", 5)
    docs = spark.createDataFrame([row] * 6 + [(2, "d e", "en", "src1", 3)], "doc_id long, text string, lang string, source string, n_chars int")
    got = Counter(r.doc_id for r in cp.mixing(spark, docs, DATA).collect())
    assert sum(r.take_tokens for r in op5_mixing.mix(docs, *op5_mixing.document_levels(), epochs=1).collect()) == 16
    assert 14 <= got[1] * 3 + got[2] * 2 <= 20


def check_shards(rows, limit):
    total, size, depth = defaultdict(int), Counter(), {}
    for name, n, stated, d in rows:
        total[name] += n
        size[name] += 1
        assert depth.setdefault(name, (stated, d)) == (stated, d)
    for name, n in total.items():
        assert n == depth[name][0] and (n <= limit or size[name] == 1)
    names = [n for n in total if n != "root" and "+" not in n]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    return total


def test_sharding(spark, docs):
    for limit in (op10_sharding.PRODUCTION_LIMIT, 200_000, 20_000, 3000):
        rows = op10_sharding.shard(docs, limit).collect()
        assert len(rows) == docs.count()
        total = check_shards([(r.shard_id, len(r.text.encode()), r.shard_bytes, r.shard_depth) for r in rows], limit)
        for name in total:  # a bucket that needn't have split has too much with its sibling
            if len(name) > 1 and name != "root" and "+" not in name:
                parent = name[:-1]
                assert sum(n for m, n in total.items() if m.startswith(parent)) > limit
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = {(r[0], r[1]) for r in con.sql(f"select doc_id, shard_id from ({op10_sharding.oracle(20_000)})").fetchall()}
    assert {(r.doc_id, r.shard_id) for r in op10_sharding.shard(docs, 20_000).collect()} == want


def test_sharding_of_equal_rows(spark):
    rows = [(1, "x" * 10, "a")] * 50 + [(2, "y" * 95, "b")] + [(None, None, "c")] * 3 + [(3, f"{i:05d}", "d") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard_id string").repartition(4)
    out = op10_sharding.shard(frame, 40).collect()
    assert len(out) == len(rows)
    total = check_shards([(r.shard_id, len(r.text or ""), r.shard_bytes, r.shard_depth) for r in out], 40)
    assert len([n for n in total if "+" in n]) >= 13
    assert op10_sharding.shard(frame.limit(0), 40).count() == 0


def test_sharding_either_way_and_any_column_names(spark, docs, monkeypatch):
    named = docs.limit(60).select("*", *(F.lit(1).alias(c) for c in ("cell", "start", "n", "t", "d", "prefix", "shard_depth", "__task", "__rank", "__page")))
    want = sorted((r.doc_id, r.shard_id, r.shard_bytes) for r in op10_sharding.shard(named, 5000).collect())
    assert len(want) == 60 and op10_sharding.shard(named, 5000).columns[-3:] == ["shard_id", "shard_depth", "shard_bytes"]
    monkeypatch.setattr(op10_sharding, "SENT", 0)
    assert sorted((r.doc_id, r.shard_id, r.shard_bytes) for r in op10_sharding.shard(named, 5000).collect()) == want
    with pytest.raises(ValueError, match="own names"):
        op10_sharding.shard(docs.withColumn("__shard_h", F.lit(1)))


ODD = "doc_id long, text string, lang string, source string, n_chars int"
CLASH = ("__k", "__x", "__own", "__n", "__rows", "__copy", "__quality", "__salt", "k", "x", "c", "m", "row", "score", "item", "h", "t", "w")


def odd_rows(spark):
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(None, a, "en", "web", 1), (None, b, "de", None, None), (None, f"{c} {item} {c}", "en", "web", 2), (7, c, None, "web", 3), (7, f"{b} but {a}", "en", "web", 3), (8, None, None, None, None), (None, "", "en", "web", 0), (9, a, "fr", "x", 4), (9, a, "fr", "x", 4)]
    return rows, spark.createDataFrame(rows, ODD)


def test_stages_decide_by_row(spark):
    rows, docs = odd_rows(spark)
    clean = [r for r in rows if r[1] != rows[2][1]]
    got = cp.decontamination(spark, docs, DATA).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, clean))
    kept = Counter((r.doc_id, r.text) for r in cp.copies(spark, docs, DATA).collect())
    assert kept == Counter([(None, rows[1][1]), (None, rows[2][1]), (7, rows[3][1]), (7, rows[4][1]), (8, None), (9, rows[0][1])])
    drawn = Counter((r.doc_id, r.text) for r in cp.mixing(spark, docs, DATA).collect())
    assert drawn and all(n <= 2 and (k, t) in {(r[0], r[1]) for r in rows} for (k, t), n in drawn.items())


@pytest.mark.parametrize("stage", [n for n, _ in cp.STAGES])
def test_stages_of_empty_tables_and_clashing_columns(spark, stage):
    run = dict(cp.STAGES)[stage]
    rows, docs = odd_rows(spark)
    assert run(spark, docs.limit(0), DATA).count() == 0
    named = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))
    out = run(spark, named, DATA)
    assert [c for c in out.columns if not c.startswith("shard_")] == named.columns
    plain, got = (Counter((r.doc_id, r.text) for r in x.collect()) for x in (run(spark, docs, DATA), out))
    assert plain == got and all(r[c] == i for r in out.collect() for i, c in enumerate(CLASH))


def test_run_against_the_stages_by_brute_force(spark, docs):
    from tests.llm.test_near_copies import groups

    scores = {r.doc_id: r.score for r in op3_quality.op3_quality(spark, DATA).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] >= 0.5)
    least = {}
    for (k, _), g in zip(rows, groups([t for _, t in rows]), strict=True):
        least.setdefault(g, k)
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = [k for k, t in rows if k in set(least.values()) and not any(s and len(s & shingle_set(t)) >= 0.8 * len(s) - 1e-9 for s in items)]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet' where doc_id in ({','.join(map(str, kept))})")
    drawn = Counter({r[0]: r[1] for r in con.sql(f"select doc_id, copies + (take_tokens > copies * n_tokens)::int from ({op5_mixing.oracle(epochs=1)})").fetchall()})
    out = cp.run(spark, DATA).collect()
    assert Counter(r.doc_id for r in out) == drawn and {r.shard_id for r in out} == {"root"}


def test_run(spark):
    out = cp.run(spark, DATA)
    assert {"doc_id", "text", "shard_id"} <= set(out.columns) and 0 < out.count() < 200
