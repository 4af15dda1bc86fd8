"""op4 against a plain dictionary model."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op4_ngram as op
from tidemark.llm import text_arrays


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in "".join(" " if c in "\t\n\r\x0b\x0c" else c for c in low).split(" ") if w] + ["</s>"]


def brute(train, texts):
    uni, pair = Counter(), Counter()
    for t in train:
        row = ["<s>", *tokens(t)]
        uni.update(row[1:])
        pair.update(zip(row, row[1:], strict=False))
    context, before, after = Counter(), Counter(), Counter()
    for (v, w), c in pair.items():
        context[v] += c
        before[w] += 1
        after[v, min(c, 3)] += 1
    d = op.discounts(*(sum(c == i for c in pair.values()) for i in (1, 2, 3, 4)))
    e = op.discounts(*(sum(c == i for c in before.values()) for i in (1, 2, 3, 4)))
    n, v_size, types = sum(uni.values()), len(uni), len(pair)
    rest = sum(e[min(c, 3) - 1] for c in before.values()) / types if types else 0

    def low(w):
        b = before[w]
        return (max(b - (e[min(b, 3) - 1] if b else 0), 0) / types + rest / (v_size + 1)) if types else 1.0

    def p(v, w):
        if not context[v]:
            return low(w)
        c = pair[v, w]
        gamma = sum(d[i - 1] * after[v, i] for i in (1, 2, 3)) / context[v]
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / context[v] + gamma * low(w)

    out = []
    for t in texts:
        row = ["<s>", *tokens(t)]
        out.append((len(row) - 1, sum(uni[w] > 0 for w in row[1:]), sum(math.log10((uni[w] + 1) / (n + v_size + 1)) for w in row[1:]), sum(math.log10(p(v, w)) for v, w in zip(row, row[1:], strict=False))))
    total = sum(p("the", w) for w in [*uni, "?unknown?"])
    return n, out, total


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    vocabulary = ["the", "The", "of", *(f"w{i}é" for i in range(60))]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    return [" ".join(rng.choice(vocabulary, n, p=weight / weight.sum())) for n in rng.integers(1, 60, 120)] + [None, "", " \n", "the " * 900, "the the of", "unseen words only"]


def test_model_equals_plain_one(spark, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "the of", None), (3, texts[3], "y")], "doc_id long, text string, score string").repartition(3)
    train = [r.text for r in docs.collect()][:100]
    model = op.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(3))
    rows = {r.k: r for r in op.score(docs, model).collect()}
    n, want, total = brute(train, texts)
    assert model.totals["n"] == n and total == pytest.approx(1)
    for i, (size, known, base, score) in enumerate(want):
        assert (rows[i].n_tokens, rows[i].n_known) == (size, known)
        assert rows[i].base_score == pytest.approx(base, rel=1e-9)
        assert rows[i].score == pytest.approx(score, rel=1e-6), texts[i]
        assert rows[i].perplexity == pytest.approx(10 ** (-score / size), rel=1e-5)
    assert op.score(docs, model).count() == len(texts) + 2


def test_pieces_do_not_change_scores(spark, texts, monkeypatch):
    model = op.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    whole = op.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    scorer = op.Scorer(*(op.mapped(op._local(p, spark)[0], k) for p, k in ((model.pairs, "pair"), (model.tokens, "token"))), model.heavy, model.totals)
    small = text_arrays.pieces
    monkeypatch.setattr(op, "pieces", lambda a: small(a, 37))
    n, known, base, score = scorer.batch(pa.array(texts))
    for r in whole:
        assert (r.n_tokens, r.n_known) == (n[r.k], known[r.k]) and r.score == pytest.approx(score[r.k]) and r.base_score == pytest.approx(base[r.k])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = op.train(none)
    assert op.score(none, model).count() == 0
    row = op.score(spark.createDataFrame([(1, "a b")], none.schema), model).first()
    assert (row.n_tokens, row.n_known, row.score) == (3, 0, 0.0)


def test_pack():
    arrays = {"a": np.sort(np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)), "b": np.array([3, 1], np.uint64), "c": np.zeros(0, np.uint32), "d": np.array([1.5], np.float32)}
    for k, a in op.unpack(op.pack(**arrays)).items():
        assert a.dtype == arrays[k].dtype and (a == arrays[k]).all()


def test_tables_sent_to_executors(spark, texts, monkeypatch):
    """Where workers can't open the shared folder, the tables are sent as files."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = op.train(docs)
    want = {r.k: r.score for r in op.score(docs, model).collect()}
    local = op._local

    def sent(path, session):
        path = local(path, session)[0]
        session.sparkContext.addFile(path, recursive=True)
        return path.rsplit("/", 1)[1], False

    monkeypatch.setattr(op, "_local", sent)
    assert {r.k: r.score for r in op.score(docs, model).collect()} == want
