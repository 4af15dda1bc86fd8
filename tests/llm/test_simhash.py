"""op7 against brute force over all pairs of fingerprints."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import op7_simhash as op


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(rows):
    """Component (the smallest key) of each row by brute force."""
    best = {i: i for i in range(len(rows))}

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            best[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(rows))]


def test_fingerprint():
    for text in [None, "", " \t\n", "One", "one two", "a b c", "A b\tc  d\ne", "é É ß x y z", "w " * 70000]:
        assert op.fingerprint(text.encode() if text is not None else None) % 2**64 == plain(text)


@pytest.mark.parametrize("schemes", [(2,), (3,), (4,), (2, 3, 4)])
def test_links_are_whole(spark, schemes):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    f = {0, 2**64 - 1, *seeds} | {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for s in seeds for _ in range(6)}
    signed = [x - 2**64 if x >> 63 else x for x in f]
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "f long, r long")
    got = {(r.a, r.b) for r in op.links(nodes, op.plan(nodes, schemes)).collect()}
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(signed, 2) if ((a ^ b) % 2**64).bit_count() <= 3}
    assert got == want and want


def test_allocation_is_the_best():
    rng = np.random.default_rng(3)
    for m in (2, 3, 4):
        table = np.sort(rng.random((m, 5)), axis=1).tolist()
        cost, chosen = op.allocate(table, 3 - m + 1)
        every = [t for t in itertools.product(range(-1, 4), repeat=m) if sum(t) == 3 - m + 1]
        assert sum(chosen) == 3 - m + 1
        assert cost == pytest.approx(min(sum(table[i][x + 1] for i, x in enumerate(t)) for t in every))


def test_components_of_documents(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + str(rng.randint(0, 400)) for _ in range(150)) for _ in range(12)]
    texts = [None, "", " ", "x", "X", "x y", *base]
    for b in base:
        for n in (1, 2, 3, 8):
            words = b.split()
            for i in rng.sample(range(len(words)), n):
                words[i] = "changed"
            texts.append(" ".join(words))
    rows = [(100 - i, t, "z") for i, t in enumerate(texts)] + [(None, base[0], "z"), (100, None, "z"), (None, "only null", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, f string")
    got = sorted(((r.k, r.f % 2**64, r.c) for r in op.near_duplicates(docs).collect()), key=str)
    prints = [(k, plain(t)) for k, t, _ in rows]
    want = sorted(((k, f, c) for (k, f), c in zip(prints, closure(prints), strict=True)), key=str)
    assert got == want


def test_chain(spark):
    f = [sum(1 << b for b in range(2 * i)) for i in range(32)]
    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x, 500 - i) for i, x in enumerate(f)], "f long, r long")
    got = op.components(nodes, op.links(nodes, op.plan(nodes))).collect()
    assert {r.r for r in got} == {500 - 31} and len(got) == 32


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
