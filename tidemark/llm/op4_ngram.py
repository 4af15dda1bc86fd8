"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by workers.

Counting. Each task turns whole texts into token hashes (64 bits, A-Z lower-cased), forms the pairs of neighbours from a
begin mark to an end token, and sends sorted, distinct pairs with their counts to S segments as packed arrays. A segment is
the top bits of the pair's first token; the pairs of frequent first tokens (found on a sample of rows; they only steer the
dealing out, never a count) are spread over all segments by the pair's hash. A segment's task merges the counts, writes the
sorted pairs with counts, and sums by first and by last token, which a second exchange adds up to the tables of tokens:
count, number of different tokens before it, and what a context gives to the lower order (gamma).

Storage. Both tables are written to the shared folder in order of segment. A worker maps them as sorted arrays with an index
of the hashes' leading bits: pairs as 32 further bits and a count of one byte (larger counts apart), tokens as whole hashes.
Where the shared folder is a file system path there is one mapped copy for all; elsewhere each executor fetches the files.

Model, with c the pair's count, N the token's number of predecessors and T the number of different pairs:
  P(w|v) = max(c - D(c), 0) / c(v) + gamma(v) P(w),  gamma(v) = (D1 n1(v) + D2 n2(v) + D3 n3+(v)) / c(v)
  P(w)   = max(N - D'(N), 0) / T + gamma' / (V + 1), gamma' likewise; an unseen context leaves P(w).
D1, D2, D3 are estimated from the counts of counts by the usual formulas, kept within 0..1, 0..2, 0..3; where a count of
counts is zero they are 0.5, 1 and 1.5.

Defined cases: null and blank texts are a lone end token; repeated rows count and are scored each; with no training rows the
model is uniform over one unknown token (probability 1); an empty table gives an empty result. Extra columns are not carried.
"""

from __future__ import annotations

import contextlib
import glob
import json
import os
import shutil
import time
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, shared_path, words
from tidemark.llm.text_arrays import mix, pieces, token_hashes

BEGIN, END = np.uint64(0x1), np.uint64(0x2)
#: Pairs held before they are sorted and sent; rows that frequent tokens are looked for in.
FLUSH, STEER_ROWS = 1_500_000, 2000
_TOP = np.uint64(0xFFFF) << np.uint64(48)


# ---- packed arrays

def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one compressed blob; sorted 64-bit ones as differences, all by byte planes."""
    head, body = [], []
    for name, a in arrays.items():
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        kept = np.diff(a, prepend=np.uint64(0)) if rising else a
        head.append((name, a.dtype.str, len(a), rising))
        body.append(np.ascontiguousarray(kept).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    top = json.dumps(head).encode()
    return len(top).to_bytes(4, "big") + top + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(blob[:4], "big")
    body, at, out = zstandard.ZstdDecompressor().decompress(blob[4 + size :]), 0, {}
    for name, kind, n, rising in json.loads(blob[4 : 4 + size]):
        width = np.dtype(kind).itemsize
        a = np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(-1)
        out[name] = np.cumsum(a, dtype=np.uint64) if rising else a
        at += n * width
    return out


def summed(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the values summed by key."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], *(np.add.reduceat(v[order], at) for v in values)


def pair_hash(v: np.ndarray, w: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """A pair's hash. Its top 16 bits, which name the segment, are those of v, or of the pair itself where v is heavy."""
    m = mix(mix(v) + w)
    at = np.minimum(np.searchsorted(heavy, v), max(len(heavy) - 1, 0))
    spread = heavy[at] == v if len(heavy) else np.zeros(len(v), bool)
    return np.where(spread, m, v) & _TOP | m >> np.uint64(16)


# ---- counting

def neighbours(own, carry: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """(first tokens, last tokens, text of each pair, the last token so far) of the pieces of some texts."""
    start, end, piece = own.tokens()
    tokens = token_hashes(own.data, start, end)
    tokens = np.where(tokens <= END, tokens + np.uint64(3), tokens)
    count = np.bincount(piece, minlength=len(own.texts))
    size = count + 1 + own.ends
    first = np.cumsum(size) - size
    row = np.full(int(size.sum()), END, np.uint64)
    row[np.arange(len(tokens)) + np.repeat(first + 1 - (np.cumsum(count) - count), count)] = tokens
    row[first] = BEGIN
    for i in np.flatnonzero(~own.begins):  # a text that goes on: what came last, and it may be in these pieces too
        row[first[i]] = carry if i == 0 else row[first[i] - 1]
    last = np.ones(len(row), bool)
    last[first] = False
    at = np.flatnonzero(last)
    return row[at - 1], row[at], np.repeat(own.texts, size - 1), row[-1] if len(row) else carry


def _sent(held: list, heavy: np.ndarray, bits: int):
    """(segment, blob) of the distinct pairs of some texts."""
    v, w = (np.concatenate(x) for x in zip(*held, strict=True))
    g = pair_hash(v, w, heavy)
    order = np.argsort(g)
    g = g[order]
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    count = np.diff(np.append(at, len(g))).astype(np.uint32)
    v, w, segment = v[order][at], w[order][at], (g[at] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
    edges = np.searchsorted(segment, np.arange((1 << bits) + 1))
    for s in range(1 << bits):
        a, b = edges[s], edges[s + 1]
        if a < b:
            by = np.argsort(v[a:b], kind="stable")
            sv = v[a:b][by]
            new = np.flatnonzero(np.append(True, sv[1:] != sv[:-1]))
            yield s, pack(v=sv[new], n=np.diff(np.append(new, b - a)).astype(np.uint32), w=w[a:b][by], c=count[a:b][by])


def _pairs(heavy: np.ndarray, bits: int):
    def run(batches):
        held, size = [], 0
        for batch in batches:
            carry = BEGIN
            for own in pieces(batch.column(0)):
                v, w, _, carry = neighbours(own, carry)
                held.append((v, w))
                size += len(v)
                if size >= FLUSH:
                    yield _rows(_sent(held, heavy, bits))
                    held, size = [], 0
        if size:
            yield _rows(_sent(held, heavy, bits))

    return run


def _rows(found) -> pa.RecordBatch:
    segments, blobs = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(blobs, pa.binary())], names=["seg", "blob"])


def _gathered(batches) -> dict[int, list[bytes]]:
    held: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for s, blob in zip(batch.column("seg").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            held[s].append(blob)
    return held


_KEPT = "kind string, seg int, blob binary, stats array<long>"


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    kind, seg, blob, stats = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(seg, pa.int32()), pa.array(blob, pa.binary()), pa.array(stats, pa.list_(pa.int64()))], names=["kind", "seg", "blob", "stats"])


def _by_segment(kind: str, key: np.ndarray, bits: int, **values: np.ndarray):
    edges = np.searchsorted(key >> np.uint64(64 - bits) if bits else np.zeros(len(key), np.uint64), np.arange((1 << bits) + 1, dtype=np.uint64))
    for s in range(1 << bits):
        a, b = edges[s], edges[s + 1]
        if a < b:
            yield kind, s, pack(key=key[a:b], **{k: x[a:b] for k, x in values.items()}), None


def _merged(heavy: np.ndarray, bits: int):
    """Pairs of a segment: the sorted table, and partial sums by first and by last token."""

    def run(batches):
        for segment, blobs in _gathered(batches).items():
            parts = [unpack(b) for b in blobs]
            v = np.concatenate([np.repeat(p["v"], p["n"]) for p in parts])
            w, c = np.concatenate([p["w"] for p in parts]), np.concatenate([p["c"] for p in parts]).astype(np.int64)
            del parts
            g = pair_hash(v, w, heavy)
            order = np.argsort(g)
            g = g[order]
            at = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            v, w, g, c = v[order][at], w[order][at], g[at], np.add.reduceat(c[order], at)
            stats = [int(x) for x in (len(c), *((c == i).sum() for i in (1, 2, 3, 4)))]
            yield _kept([("pair", segment, pack(key=g, c=c), stats)])
            wk, wc, wn = summed(w, c, np.ones(len(w), np.int64))
            vk, vt, v1, v2, v3 = summed(v, c, *((x).astype(np.int64) for x in (c == 1, c == 2, c >= 3)))
            yield _kept([*_by_segment("last", wk, bits, c=wc, n=wn), *_by_segment("first", vk, bits, t=vt, n1=v1, n2=v2, n3=v3)])

    return run


def _tokens(discounts: tuple[float, float, float]):
    """Tokens of a segment: count, predecessors and gamma, in order of hash; the begin mark has no count."""

    def run(batches):
        held: dict[int, list] = defaultdict(list)
        for batch in batches:
            for kind, s, blob in zip(batch.column("kind").to_pylist(), batch.column("seg").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                held[s].append((kind, unpack(blob)))
        for segment, parts in held.items():
            join = lambda kind, name, kind_of=np.int64, parts=parts: np.concatenate([p[name] for k, p in parts if k == kind] or [np.zeros(0, kind_of)])
            wk, wc, wn = summed(join("last", "key", np.uint64), join("last", "c"), join("last", "n"))
            vk, vt, v1, v2, v3 = summed(join("first", "key", np.uint64), *(join("first", n) for n in ("t", "n1", "n2", "n3")))
            key = np.union1d(wk, vk)
            c, n, t, gamma = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.zeros(len(key))
            c[np.searchsorted(key, wk)], n[np.searchsorted(key, wk)] = wc, wn
            at = np.searchsorted(key, vk)
            t[at], gamma[at] = vt, (discounts[0] * v1 + discounts[1] * v2 + discounts[2] * v3) / np.maximum(vt, 1)
            begin = int(t[key == BEGIN].sum())
            stats = [int(x) for x in (c.sum(), (c > 0).sum(), n.sum(), *((n == i).sum() for i in (1, 2, 3, 4)), begin)]
            yield _kept([("token", segment, pack(key=key, c=c, n=n.astype(np.int64), gamma=gamma.astype(np.float32)), stats)])

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d1, d2 = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return min(max(d1, 0.0), 1.0), min(max(d2, 0.0), 2.0), min(max(d3, 0.0), 3.0)


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _frequent(texts: DataFrame, bits: int) -> np.ndarray:
    """Hashes of the tokens that make up more than a quarter of a segment's even share, on about STEER_ROWS rows from all
    over the table."""
    sample = texts.sample(min(1.0, STEER_ROWS / max(1, texts.count())), seed=1).select(F.explode(words(F.col("t"))).alias("w"))
    counts = sample.groupBy(ascii_lower(F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.orderBy(F.desc("n"), "w").limit(4 << bits).collect()
    total = sum(r.n for r in rows) or 1
    names = [r.w.encode() for r in rows if r.n > total / (4 << bits)]
    hashes = [np.zeros(0, np.uint64)]
    for own in pieces(pa.array(names, pa.large_binary())):
        start, end, _ = own.tokens()
        hashes.append(token_hashes(own.data, start, end))
    return np.unique(np.concatenate([*hashes, [BEGIN]]).astype(np.uint64))


class Model:
    """What scoring needs: the paths of the tables and the totals. It is small; the tables are mapped by each worker."""

    def __init__(self, pairs: str, tokens: str, heavy: np.ndarray, totals: dict):
        self.pairs, self.tokens, self.heavy, self.totals = pairs, tokens, heavy, totals


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all rows; writes the model's tables to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).cast("string").alias("t"))
    bits = max(0, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    heavy = _frequent(texts, bits)
    sent = texts.mapInArrow(_pairs(heavy, bits), "seg int, blob binary").repartitionById(1 << bits, F.col("seg"))
    pairs, tokens = shared_path(spark, "lm-pairs"), shared_path(spark, "lm-tokens")
    # Blobs are compressed already.
    sent.mapInArrow(_merged(heavy, bits), _KEPT).write.partitionBy("kind").option("compression", "uncompressed").parquet(pairs)
    read = lambda path: spark.read.schema(_KEPT).parquet(path)
    total = lambda df, n: df.select(*(F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(n))).first()
    types, *counts = total(read(pairs).filter("kind = 'pair'"), 5)
    high = discounts(*counts)
    partial = read(pairs).filter("kind <> 'pair'").repartitionById(1 << bits, F.col("seg"))
    partial.mapInArrow(_tokens(high), _KEPT).write.option("compression", "uncompressed").parquet(tokens)
    n, v, t, *low, begin = total(read(tokens), 8)
    return Model(f"{pairs}/kind=pair", tokens, heavy, {"types": types, "high": high, "low": discounts(*low), "low_counts": low, "n": n, "v": v, "begin": begin})


# ---- mapped tables

class Sorted:
    """A mapped sorted table of hashes: an index over their leading bits, then binary search in a bucket."""

    def __init__(self, folder: str):
        meta = json.load(open(f"{folder}/meta.json"))
        self.bits, self.n = meta["bits"], meta["n"]
        load = lambda name: np.memmap(f"{folder}/{name}", meta["files"][name], "r") if self.n else np.zeros(0, meta["files"][name])
        self.columns = {name: load(name) for name in meta["files"]}
        self.index, self.key = self.columns.pop("index"), self.columns.pop("key")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, position) of each hash."""
        if not self.n:
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        bucket = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        low, high = self.index[bucket].astype(np.int64), self.index[bucket + 1].astype(np.int64)
        want = residual(hashes, self.bits) if self.key.dtype == np.uint32 else hashes
        stop = high.copy()
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            less = self.key[np.minimum(middle, self.n - 1)] < want
            inside = low < high
            low = np.where(inside & less, middle + 1, low)
            high = np.where(inside & ~less, middle, high)
        at = np.minimum(low, self.n - 1)
        return (low < stop) & (self.key[at] == want), at


def residual(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _build(source: str, folder: str, kind: str, lock: str) -> None:
    """Writes the mapped form of a table from its parquet files, segment by segment."""
    files = sorted(glob.glob(f"{source}/**/*.parquet", recursive=True))
    place, n = [], 0
    for f in files:
        table = pq.ParquetFile(f)
        for g in range(table.num_row_groups):
            own = table.read_row_group(g, columns=["seg", "stats"])
            place += [(s, f, g, i) for i, s in enumerate(own.column("seg").to_pylist())]
            n += sum(x[0] if kind == "pair" else 0 for x in own.column("stats").to_pylist())
    place.sort()
    size = n if kind == "pair" else sum(os.path.getsize(f) for f in files) // 16
    bits = min(max(size.bit_length() - 3, 4), 28)
    index, out, n, large = np.zeros((1 << bits) + 1, np.int64), {}, 0, [[], []]
    kinds = {"key": "<u4", "c": "<u1"} if kind == "pair" else {"key": "<u8", "c": "<i8", "n": "<i8", "gamma": "<f4"}
    with contextlib.ExitStack() as stack:
        for name in kinds:
            out[name] = stack.enter_context(open(f"{folder}/{name}", "wb"))
        for _, f, g, i in place:
            blob = pq.ParquetFile(f).read_row_group(g, columns=["blob"]).column("blob")[i].as_py()
            own = unpack(blob)
            index[1:] += np.bincount((own["key"] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
            if kind == "pair":
                big = np.flatnonzero(own["c"] >= 255)
                large[0].append(big + n)
                large[1].append(own["c"][big])
            n += len(own["key"])
            if kind == "pair":
                own = {"key": residual(own["key"], bits), "c": np.minimum(own["c"], 255)}
            for name, form in kinds.items():
                own[name].astype(form).tofile(out[name])
            with contextlib.suppress(OSError):
                os.utime(lock)
    extra = {"index": np.cumsum(index), "large_at": np.concatenate(large[0] or [np.zeros(0)]), "large_c": np.concatenate(large[1] or [np.zeros(0)])}
    if kind != "pair" or not len(extra["large_at"]):
        extra = {"index": extra["index"]}
    for name, a in extra.items():
        a.astype("<i8").tofile(f"{folder}/{name}")
        kinds[name] = "<i8"
    with open(f"{folder}/meta.json", "w") as f:
        json.dump({"bits": bits, "n": n, "files": kinds}, f)


def mapped(source: str, kind: str, stale: float = 120.0) -> Sorted:
    """The mapped table; the first worker that needs it builds it, the others wait (or take over where that one is lost)."""
    folder, lock = f"{source}-mapped", f"{source}-mapped.lock"
    while not os.path.isdir(folder):
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            with contextlib.suppress(OSError):
                if time.time() - os.path.getmtime(lock) > stale:
                    os.remove(lock)
            time.sleep(0.1)
            continue
        own = f"{folder}-{uuid.uuid4().hex}"
        os.makedirs(own)
        try:
            if not os.path.isdir(folder):
                _build(source, own, kind, lock)
                with contextlib.suppress(OSError):
                    os.rename(own, folder)
        finally:
            shutil.rmtree(own, ignore_errors=True)
            with contextlib.suppress(OSError):
                os.remove(lock)
    return Sorted(folder)


_OPEN: dict[str, tuple[Sorted, Sorted]] = {}


def _opened(pairs: str, tokens: str) -> tuple[Sorted, Sorted]:
    if pairs not in _OPEN:
        _OPEN[pairs] = mapped(pairs, "pair"), mapped(tokens, "token")
    return _OPEN[pairs]


def _local(path: str, spark) -> tuple[str, bool]:
    """(the path that workers open, True) for a shared file system, else (the name of files sent to each executor, False)."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/"), True
    if "://" not in path:
        return path, True
    spark.sparkContext.addFile(path, recursive=True)
    return path.rstrip("/").rsplit("/", 1)[1], False


class Scorer:
    """Scores texts against mapped tables."""

    def __init__(self, pairs: Sorted, tokens: Sorted, heavy: np.ndarray, totals: dict):
        self.pairs, self.tokens, self.heavy, self.totals = pairs, tokens, heavy, totals
        low, t = totals["low"], max(totals["types"], 1)
        n1, n2, n3, _ = totals["low_counts"]
        self.lower = np.array(low), t, (low[0] * n1 + low[1] * n2 + low[2] * max(0, totals["v"] - n1 - n2)) / t

    def looked_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count, predecessors, gamma) of tokens; each distinct one is looked up once."""
        distinct, back = np.unique(hashes, return_inverse=True)
        found, at = self.tokens.find(distinct)
        at = np.where(found, at, 0)
        take = lambda name: (np.where(found, self.tokens.columns[name][at], 0) if self.tokens.n else np.zeros(len(distinct)))[back]
        return take("c").astype(np.int64), take("n").astype(np.int64), take("gamma").astype(np.float64)

    def logs(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of the model, log10 of the base, known) of each pair."""
        totals = self.totals
        count, before, gamma = self.looked_up(np.concatenate([v, w]))
        context, gamma, c, n = count[: len(v)], gamma[: len(v)], count[len(v) :], before[len(v) :]
        context = np.where(v == BEGIN, totals["begin"], context)
        low, types, rest = self.lower
        base = (np.maximum(n - _discount(n, tuple(low)), 0) / types) + rest / (totals["v"] + 1)
        if not totals["types"]:
            base = np.ones(len(w))
        found, at = self.pairs.find(pair_hash(v, w, self.heavy))
        pair = np.where(found, self.pairs.columns["c"][np.where(found, at, 0)], 0).astype(np.int64) if self.pairs.n else np.zeros(len(v), np.int64)
        if "large_at" in self.pairs.columns:
            big = np.flatnonzero(pair == 255)
            pair[big] = self.pairs.columns["large_c"][np.searchsorted(self.pairs.columns["large_at"], at[big])]
        high = np.maximum(pair - _discount(pair, totals["high"]), 0) / np.maximum(context, 1) + gamma * base
        p = np.where(context > 0, high, base)
        plain = np.log10((c + 1) / (totals["n"] + totals["v"] + 1))
        return np.log10(np.maximum(p, 1e-300)), plain, c > 0

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of each text."""
        out = [np.zeros(len(texts)) for _ in range(4)]
        carry = BEGIN
        for own in pieces(texts):
            v, w, of, carry = neighbours(own, carry)
            score, plain, known = self.logs(v, w)
            for total, x in zip(out, (None, known, plain, score), strict=True):
                total += np.bincount(of, x, minlength=len(texts))
        return out[0].astype(np.int64), out[1].astype(np.int64), out[2], out[3]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k (the key), n_tokens, n_known, base_score, score and perplexity of every row's whole text."""
    spark = docs.sparkSession
    (pairs, here), (tokens, _) = _local(model.pairs.removesuffix("/kind=pair"), spark), _local(model.tokens, spark)
    heavy, totals = model.heavy, model.totals
    own = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches):
        from pyspark import SparkFiles

        at = (lambda p: p) if here else SparkFiles.get
        scorer = Scorer(*_opened(at(pairs) + "/kind=pair", at(tokens)), heavy, totals)
        for batch in batches:
            n, known, base, own = scorer.batch(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(known), pa.array(base), pa.array(own), pa.array(10 ** np.minimum(-own / n, 300.0))], names=["k", "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return own.mapInArrow(run, f"k {own.schema['k'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double, perplexity double")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op4_ngram(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = score(docs, model)
    return found.select(F.col("k").alias("doc_id"), held_out(F.col("k")).alias("held_out"), "n_tokens", "n_known", F.lit(model.totals["n"]).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
