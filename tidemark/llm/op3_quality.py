"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded (shares of kinds of bytes, word statistics and hashed
byte pairs, then a learned layer); gated attention, learned from document labels alone, weighs the passages; the weighted
passage representation is scored by a logistic unit. Encoding runs over whole texts in numpy, in pieces of bounded size.

The network is fitted on the driver on a bounded sample of labelled documents: at most SAMPLE of them, the least by a hash of
their key, and of these as many, in that order, as have SAMPLE_BYTES of text together (two at least). A document of the sample
gives all its passages. Rows of one key are one document: the row with the least hash of its text. Fitting reads labels of
rows with crc32(doc_id) mod 3 other than 1 only; label, lang, source and key are never inputs of a score.

Defined cases: null and blank texts are one empty passage, and get a score like any other; several labels of a document
count as their mean (0.5 or more: 1), null labels don't count; without labels of both classes every score is the share of
label 1 (0.5 without any); repeated rows give repeated rows; texts of any length are scored whole, in pieces of bounded size,
which are cut within a word only where it alone is longer than a piece; an empty table gives an empty result. Extra columns
are carried; one that is named like the score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.text_arrays import Pieces, mix, pieces, token_hashes

#: Bounds of what is fitted on, and the network's sizes.
SAMPLE, SAMPLE_BYTES, ROUNDS = 4000, 32 << 20, 250
WORDS, PAIRS, HIDDEN, GATE = 64, 48, 24, 12
_KINDS = [
    lambda b: (b >= 65) & (b <= 90), lambda b: (b >= 97) & (b <= 122), lambda b: (b >= 48) & (b <= 57), lambda b: b == 32, lambda b: b == 10,
    lambda b: np.isin(b, list(b".,;:")), lambda b: np.isin(b, list(b"!?")), lambda b: b == ord("|"), lambda b: np.isin(b, list(b"*$%#&@~^_=+<>/\\{}[]")), lambda b: b >= 128,
]
_KIND = np.stack([k(np.arange(256)) for k in _KINDS], axis=1).astype(np.float64)
WIDTH = _KIND.shape[1] + PAIRS + 5


def _passages(own: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(features of the passages, the text of each)."""
    start, end, piece = own.tokens()
    count = np.bincount(piece, minlength=len(own.texts))
    n_passages = np.maximum(1, -(-count // WORDS))
    first = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    number = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
    passage = first[piece] + number // WORDS
    # A byte belongs to the passage of the last token that began before it, or else to its piece's first one.
    opens = np.concatenate([own.bounds[:-1], start[number % WORDS == 0]])
    of = np.concatenate([first, passage[number % WORDS == 0]])
    order = np.lexsort((of, opens))
    opens, of = opens[order], of[order]
    size = np.diff(np.append(opens, len(own.data)))
    owner = np.repeat(of, size)
    histogram = np.bincount(owner * 256 + own.data, minlength=total * 256).reshape(total, 256)
    n_bytes = np.maximum(histogram.sum(axis=1), 1)[:, None]
    x = np.zeros((total, WIDTH), np.float32)
    kinds = _KIND.shape[1]
    x[:, :kinds] = histogram @ _KIND / n_bytes
    if len(own.data) > 1:
        pair = (own.data[:-1].astype(np.int64) * 131 + own.data[1:].astype(np.int64) * 17) % PAIRS
        inner = np.ones(len(pair), bool)
        inner[own.bounds[(own.bounds > 0) & (own.bounds < len(own.data))] - 1] = False  # no pair spans two texts
        pairs = np.bincount((owner[1:] * PAIRS + pair)[inner], minlength=total * PAIRS).reshape(total, PAIRS)
        x[:, kinds : kinds + PAIRS] = np.sqrt(pairs / n_bytes)
    n = np.bincount(passage, minlength=total)
    some = np.maximum(n, 1)
    length = end - start
    x[:, -5] = np.bincount(passage, length, minlength=total) / some / 10
    x[:, -4] = np.bincount(passage, length <= 3, minlength=total) / some
    x[:, -3] = np.log1p(n) / 5
    keys = np.unique(mix(token_hashes(own.data, start, end) + mix(passage.astype(np.uint64))) >> np.uint64(20) | (passage.astype(np.uint64) << np.uint64(44)))
    x[:, -2] = np.bincount((keys >> np.uint64(44)).astype(np.int64), minlength=total)[:total] / some
    x[:, -1] = histogram.max(axis=1) / n_bytes[:, 0]
    return x, np.repeat(own.texts, n_passages)


def encoded(texts: pa.Array):
    """(features, text numbers) in pieces."""
    for own in pieces(texts, cut_words=True):
        yield _passages(own)


def _bags(batches):
    for batch in batches:
        own = list(encoded(batch.column(1)))
        x, of = (np.concatenate(p) for p in zip(*own, strict=True)) if own else (np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64))
        bound = np.searchsorted(of, np.arange(batch.num_rows + 1))  # texts come in order
        blobs = [x[a:b].astype(np.float32).tobytes() for a, b in zip(bound[:-1], bound[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.large_binary()).cast(pa.binary())], names=["y", "bag"])


class Network:
    """Gated attention over passages: p = s(c . sum_k a_k e_k + b), e = tanh(x W), a = softmax(w . (tanh(e V) * s(e U)))."""

    def __init__(self, constant: float = 0.5):
        self.constant, self.fitted = constant, False

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, rounds: int = ROUNDS) -> Network:
        x, bag = np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(0)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"W": draw(WIDTH, HIDDEN), "h": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "w": draw(GATE), "c": draw(HIDDEN), "b": np.zeros(1)}
        first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        starts = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        for step in range(1, rounds + 1):
            slope = self._slopes(p, x, bag, starts, labels)
            for k, g in slope.items():
                g = g + 2e-3 * p[k] * (k not in ("h", "b"))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.fitted = p, True
        return self

    @staticmethod
    def _attend(p: dict, x: np.ndarray):
        e = np.tanh(x @ p["W"] + p["h"])
        t, g = np.tanh(e @ p["V"]), 1 / (1 + np.exp(-(e @ p["U"])))
        return e, t, g, (t * g) @ p["w"]

    def _slopes(self, p, x, bag, starts, labels):
        e, t, g, s = self._attend(p, x)
        s = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = s / np.add.reduceat(s, starts)[bag]
        z = np.add.reduceat(a[:, None] * e, starts, axis=0)
        q = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        d = (q - labels) / len(labels)
        dz = d[:, None] * p["c"]
        da = (dz[bag] * e).sum(axis=1)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        de = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - e * e)
        return {"W": x.T @ de, "h": de.sum(axis=0), "V": e.T @ dt, "U": e.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A score for each text: running sums of exp(attention), so that long texts need no more memory."""
        n = len(texts)
        if not self.fitted:
            return np.full(n, self.constant)
        weight, held = np.zeros(n), np.zeros((n, HIDDEN))
        top = np.full(n, -np.inf)
        for x, of in encoded(texts):
            e, _, _, s = self._attend(self.p, (x - self.mean) / self.scale)
            peak = top.copy()
            np.maximum.at(peak, of, s)
            fade = np.where(np.isfinite(top), np.exp(np.where(np.isfinite(top), top, 0) - np.where(np.isfinite(peak), peak, 0)), 0.0)
            weight, held, top = weight * fade, held * fade[:, None], peak
            a = np.exp(s - top[of])
            np.add.at(weight, of, a)
            np.add.at(held, of, a[:, None] * e)
        z = held / np.maximum(weight, 1e-300)[:, None]
        return 1 / (1 + np.exp(-np.clip(z @ self.p["c"] + self.p["b"], -30, 30)))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Network:
    """The network fitted on the bounded sample of labelled documents that aren't held out."""
    own = labels.select(F.col(key).alias("lk"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("lk").isNotNull() & ~held_out(F.col("lk")))
    own = own.groupBy("lk").agg((F.avg("y") >= 0.5).cast("double").alias("y")).orderBy(F.xxhash64("lk"), "lk").limit(sample)
    own = own.select("lk", "y", F.xxhash64("lk").alias("o"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(own), F.col("k") == F.col("lk"))  # `sample` rows at most
    sizes = rows.groupBy("k", "o").agg(F.min(F.struct(F.xxhash64("t").alias("x"), F.coalesce(F.octet_length("t"), F.lit(0)).alias("b"))).alias("m"))
    taken, total = [], 0
    for r in sizes.select("k", "o", "m.b").orderBy("o", "k").collect():
        total += r.b
        if total > SAMPLE_BYTES and len(taken) > 1:
            break
        taken.append(r.k)
    rows = rows.filter(F.col("k").isin(taken)) if taken else rows.filter("false")
    # One row of a key: partial aggregation, so that a key with many rows meets no task whole.
    rows = rows.groupBy("k", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = rows.select("y", "t").mapInArrow(_bags, "y double, bag binary").collect()
    y = np.array([r.y for r in rows])
    if not len(y) or y.min() == y.max():
        return Network(float(y.mean()) if len(y) else 0.5)
    order = sorted(range(len(rows)), key=lambda i: (bytes(rows[i].bag), y[i]))  # the same network however rows arrive
    return Network().fit([np.frombuffer(rows[i].bag, np.float32).reshape(-1, WIDTH) for i in order], y[order])


def score(docs: DataFrame, network: Network, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with a score column (which replaces one of that name)."""
    docs = docs.drop(out)
    at = docs.columns.index(text)
    names = docs.columns

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(batch.column(at)), pa.float64())], names=[*names, out])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    network = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, network)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
