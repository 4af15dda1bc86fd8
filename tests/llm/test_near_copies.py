"""The pipeline's near-copy stage against brute force over all pairs of five-word shingle sets."""

import itertools
import os
import random
from collections import Counter

import corpus_pipeline as cp
from tests.llm.test_pipeline import DATA, shingle_set
from tidemark.llm import near_copies
from tidemark.llm.shared import shared_path, written

STAGE = dict(cp.STAGES)["near_duplicates"]


def groups(texts):
    """Component (a number) of each text by the rule."""
    sets = [shingle_set(t) for t in texts]
    best = list(range(len(texts)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        same = not a and not b if not a or not b else 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b))
        if same:
            best[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def test_stage_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    least = {}
    for (k, _), g in zip(rows, groups([t for _, t in rows]), strict=True):
        least[g] = min(k, least.get(g, k))
    out = STAGE(spark, docs, DATA)
    assert sorted(r.doc_id for r in out.collect()) == sorted(least.values()) and out.columns == docs.columns


def test_components_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "OFTEN", 5)
    rng = random.Random(11)
    words, line = [f"w{i}" for i in range(3000)], [f"common{i}" for i in range(30)]
    texts = [None, "", " \t", "a b", "A  b", "a b c", "a b c d e"]
    for _ in range(12):
        base = rng.sample(words, rng.randint(20, 150)) + line
        texts.append(" ".join(base))
        for n in (1, 2, 3, 4, 6, 9):
            own = list(base)
            for i in rng.sample(range(len(own)), n):
                own[i] = rng.choice(words)
            texts += [" ".join(own), " ".join(own[: -rng.randint(1, 12)])]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert len(near_copies.often(docs.select("text"))) > 0
    got, want = {}, {}
    for r in near_copies.near_copies(docs).collect():
        got.setdefault(r.c, set()).add(r.k)
    for i, g in enumerate(groups(texts)):
        want.setdefault(g, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) < len(texts)


def test_odd_rows(spark):
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    long = " ".join(f"w{i}" for i in range(200))
    near = long.replace("w100 ", "x ")
    rows = [(5, long, "en", "a", 1)] * 2 + [(3, near.upper(), "en", "b", 1), (None, "", None, None, None), (None, None, "en", None, 0), (None, "one of two", "en", "c", 1), (None, "another text", "en", "c", 1), (9, "alone here now", None, "c", 3)]
    out = STAGE(spark, spark.createDataFrame(rows, schema), DATA).collect()
    assert Counter(r.doc_id for r in out) == Counter({3: 1, None: 3, 9: 1})
    assert near_copies.near_copies(spark.createDataFrame([], schema)).count() == 0


def test_tables_that_nothing_reads_are_deleted(spark):
    folder = os.path.dirname(shared_path(spark)).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    long = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, long), (2, long.replace("w100 ", "x ")), (3, "alone here now")], "doc_id long, text string")
    found = near_copies.near_copies(docs)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"prefixes", "first-shingles", "buckets", "entries", "mixed", "met", "sets"} and len({r.c for r in found.collect()}) == 2


def test_likely_pairs_need_no_shingle_of_one_node_alone(spark):
    own = written(spark.createDataFrame([(1, list(range(11))), (2, list(range(1, 12))), (3, [0, 1]), (4, list(range(40, 50)))], "f long, p array<long>"), "own")
    pairs = spark.createDataFrame([(1, 2, 100, 100), (2, 1, 100, 100), (1, 3, 100, 100), (1, 4, 100, 100), (5, 1, 100, 100)], "fa long, fb long, na int, nb int")
    assert [tuple(r) for r in near_copies._likely(pairs, own).collect()] == [(1, 2)]


def test_first_candidates_are_linked_by_fingerprint(spark):
    rng = random.Random(5)
    prints = [rng.getrandbits(62) for _ in range(40)]
    prints += [p ^ 1 << rng.randrange(62) ^ 1 << rng.randrange(62) for p in prints[:20]] + prints[:5] + [p ^ 0b11111 for p in prints[30:]]
    rows = [(i, s, 100 if i != 40 else 300) for i, s in enumerate(prints)]
    least, want = {}, set()
    for i, s, n in rows:
        least.setdefault(s, (i, n))
    for i, s, n in rows:
        near = min((t for t in least if t < s and (s ^ t).bit_count() <= 3), default=None)
        other = least[s] if least[s][0] != i else least[near] if near is not None else None
        if other and 5 * min(n, other[1]) >= 4 * max(n, other[1]):
            want.add((min(i, other[0]), max(i, other[0])))
    got = near_copies.alike(written(spark.createDataFrame(rows, "f long, s long, n int"), "own")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_fingerprints_of_sets():
    own = near_copies.np.array([0b0111, 0b0011, 0b1001], "uint64")
    assert near_copies.simhash(own) == 0b0011 and near_copies.simhash(own, 2) == 0b0011 and near_copies.simhash(own[:0]) == 0
