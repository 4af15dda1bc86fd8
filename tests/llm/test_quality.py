import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op3_quality as op
from tidemark.llm import text_arrays

DATA = "/root/testdata/sf0.01"


def test_pieces_hold_whole_texts():
    rng = np.random.default_rng(1)
    texts = [None, "", "  ", "é ü", *("".join(rng.choice(list("ab cZ\n"), n)) for n in (3, 50, 900, 5000))]
    for most in (16, 300, 1 << 20):
        got = {}
        for p in text_arrays.pieces(pa.array(texts), most):
            start, end, piece = p.tokens()
            h = text_arrays.token_hashes(p.data, start, end)
            for s, e, i, x in zip(start, end, piece, h, strict=True):
                got.setdefault(int(p.texts[i]), []).append((bytes(p.data[s:e]), int(x)))
        seen = {}
        for i, t in enumerate(texts):
            assert [w for w, _ in got.get(i, [])] == (t or "").encode().split()
        for row in got.values():
            for w, x in row:
                assert seen.setdefault(w.lower(), x) == x
        assert len(set(seen.values())) == len(seen)


def test_slopes():
    rng = np.random.default_rng(2)
    x, bag = rng.normal(size=(9, op.WIDTH)), np.array([0, 0, 1, 1, 1, 2, 3, 3, 3])
    starts, y = np.array([0, 2, 5, 6]), np.array([1.0, 0, 1, 0])
    net = op.Network()
    p = {"W": rng.normal(size=(op.WIDTH, op.HIDDEN)) / 8, "h": rng.normal(size=op.HIDDEN), "V": rng.normal(size=(op.HIDDEN, op.GATE)), "U": rng.normal(size=(op.HIDDEN, op.GATE)), "w": rng.normal(size=op.GATE), "c": rng.normal(size=op.HIDDEN), "b": np.zeros(1)}

    def loss():
        e, _, _, s = net._attend(p, x)
        total = 0.0
        for i in range(4):
            a = np.exp(s[bag == i])
            q = 1 / (1 + np.exp(-(a @ e[bag == i] / a.sum() @ p["c"] + p["b"][0])))
            total -= y[i] * np.log(q) + (1 - y[i]) * np.log(1 - q)
        return total / 4

    slope = net._slopes(p, x, bag, starts, y)
    for k in p:
        i = tuple(0 for _ in p[k].shape)
        p[k][i] += 1e-6
        up = loss()
        p[k][i] -= 2e-6
        down = loss()
        p[k][i] += 1e-6
        assert slope[k][i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_held_out_accuracy(spark):
    got = op.op3_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, "", "s"), (None, "x " * 100_000, None), (3, "ok", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (3, 0)], "doc_id long, quality int")
    for own in (labels, labels.limit(0)):
        rows = op.score(docs, op.fit(docs, own)).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert op.score(docs.limit(0), op.fit(docs.limit(0), labels)).count() == 0


def plain_score(net, text):
    """The score of one text from all its passages at once."""
    whole = list(text_arrays.pieces(pa.array([text]), 1 << 40))
    x = np.concatenate([op._passages(p)[0] for p in whole]).astype(np.float64)
    e = np.tanh((x - net.mean) / net.scale @ net.p["W"] + net.p["h"])
    s = (np.tanh(e @ net.p["V"]) / (1 + np.exp(-(e @ net.p["U"])))) @ net.p["w"]
    a = np.exp(s - s.max())
    return 1 / (1 + np.exp(-((a / a.sum()) @ e @ net.p["c"] + net.p["b"][0])))


def test_scores_like_one_pass(monkeypatch):
    rng = np.random.default_rng(3)
    net = op.Network().fit([rng.normal(size=(3, op.WIDTH)) for _ in range(8)], np.array([0.0, 1.0] * 4), 40)
    words = ["some", "words", "and", "More!", "|", "12", "é"]
    texts = ["", None, "a", "   ", *(" ".join(rng.choice(words, n)) for n in (3, 64, 65, 900, 5000))]
    want = [plain_score(net, t or "") for t in texts]
    assert net.scores(pa.array(texts)) == pytest.approx(want, abs=1e-9)
    # With a passage to each of 40 pieces only the byte pair across each edge is missing.
    own = ["".join(f"w{i:02d} " for i in range(64)) * 40]
    pieces = [p for p in text_arrays.pieces(pa.array(own), 4 * 64 - 1)]
    monkeypatch.setattr(op, "pieces", lambda texts, cut_words: iter(pieces))
    assert len(pieces) == 40 and net.scores(pa.array(own)) == pytest.approx([plain_score(net, own[0])], abs=5e-3)


def test_long_texts_without_white_space():
    net = op.Network().fit([np.random.default_rng(i).normal(size=(3, op.WIDTH)) for i in range(8)], np.array([0.0, 1.0] * 4), 5)
    got = list(text_arrays.pieces(pa.array(["x" * 9_000_000, "a b"]), cut_words=True))
    assert max(len(p.data) for p in got) <= 3 * text_arrays.PIECE and sum(len(p.data) for p in got) == 9_000_003
    assert all(0 <= x <= 1 for x in net.scores(pa.array(["x" * 9_000_000, "words " * 900_000])))


def test_the_fit_takes_every_passage_and_one_row_a_key(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op.Network, "fit", lambda self, bags, labels, rounds=0: seen.append((bags, labels)) or self)
    free = [i for i in range(20) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = spark.createDataFrame([(free[0], "good words here " * 2000)] * 2 + [(i, "bad | bad") for i in range(20) if i != free[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, j % 2) for j, i in enumerate(free)] + [(i, 1) for i in range(20) if i not in free], "doc_id long, quality int")
    op.fit(docs, labels)
    assert len(seen[0][0]) == len(free)
    assert sorted(len(b) for b in seen[0][0]) == [1] * (len(free) - 1) + [-(-6000 // op.WORDS)]
