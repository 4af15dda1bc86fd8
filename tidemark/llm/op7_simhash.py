"""SimHash near-duplicates by generalised pigeonhole search.

Fingerprints: 64 bits over the hashes of three-word shingles. Equal fingerprints are one node, so a group of copies costs
one row from there on. Two fingerprints link at 3 or fewer differing bits. To find the links, the 64 bits are divided into m
parts; with thresholds t_i that sum to 3 - m + 1, any linked pair differs in at most t_i bits of some part i (t_i = -1: part
not used). The parts group correlated bits (from counts over all fingerprints), and m and the thresholds come from a dynamic
programme over estimated costs: candidates by part and threshold (exact at 0, from the sums of squared bucket sizes; scaled
by the bits' difference odds beyond) plus probes. Every fingerprint is indexed and probed in each part used, and each
candidate is verified on all 64 bits within the join, so only links leave it.

Components are found by hooking and pointer jumping over the links; every round is written to the shared folder.

Defined cases: null and blank texts have fingerprint zero and link like any other; fewer than three words make one shingle;
repeated rows are nodes' members like copies; where a key is null the component has the smallest key that isn't, or null if
there is none; a fingerprint that most rows have (blank texts, copies) is dealt over tasks; a text of any length is read whole,
in pieces; which of equal keys names a component can't differ; an empty table gives an empty result. Extra columns are not
carried, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import spread_join, written

BITS, DISTANCE, WIDTH, SEED = 64, 3, 3, 42
#: Cost of a probe row, in verified candidates: it is written, moved and sorted.
PROBE_COST = 8.0
_NONE = (1 << 63) - 1


def fingerprint(text: bytes | None, width: int = WIDTH, block: int = 1 << 16) -> int:
    """The 64-bit fingerprint of a whole text, as a signed integer."""
    parts = (text or b"").lower().split()  # of bytes: A-Z and the ASCII white space only
    n = len(parts)
    if not n:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if n <= width:
        hashes, total = [digest(joined, SEED)], 1
        counts = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8), bitorder="little").astype(np.int64)
    else:
        size = np.fromiter(map(len, parts), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start, end, total = (end - size)[: n - width + 1], end[width - 1 :], n - width + 1
        counts = np.zeros(BITS, np.int64)
        for i in range(0, total, block):
            spans = zip(start[i : i + block].tolist(), end[i : i + block].tolist(), strict=True)
            hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
            counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary()).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t) for t in texts], pa.int64())], names=["k", "f"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k (the key) and f (the fingerprint) of every row."""
    own = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = own.schema["k"].dataType.simpleString()
    return own.mapInArrow(_fingerprints, f"k {kind}, f long")


def _cooccurrence(batches):
    total = np.zeros((BITS, BITS))
    for batch in batches:
        f = batch.column(0).to_numpy(zero_copy_only=False)
        bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += bits.T @ bits
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j].astype(np.int64))], names=["i", "j", "c"])


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, the 64 x 64 counts of bits set together) over all fingerprints."""
    counts = nodes.select("f").mapInArrow(_cooccurrence, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c"))
    both = np.zeros((BITS, BITS))
    for r in counts.collect():  # 2080 rows
        both[r.i, r.j] = both[r.j, r.i] = r.c
    return nodes.count(), both


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of bits, of like width: each starts at the free bit with the strongest correlations and takes the free bits
    that correlate most with it."""
    q = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(q * (1 - q), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(q, q)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, parts = list(range(BITS)), []
    for i in range(m):
        width = len(free) // (m - i)
        part = [max(free, key=lambda b: (np.sort(tie[b, free])[-width:].sum(), -b))]
        while len(part) < width:
            rest = [b for b in free if b not in part]
            part.append(max(rest, key=lambda b: (tie[b, part].sum(), -b)))
        parts.append(sorted(part))
        free = [b for b in free if b not in part]
    return parts


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def costs(parts: list[list[int]], squares: list[float], both: np.ndarray, n: int) -> list[list[float]]:
    """For each part the estimated cost at thresholds -1, 0, ..., DISTANCE."""
    q = np.diag(both) / max(n, 1)
    table = []
    for bits, square in zip(parts, squares, strict=True):
        differ = np.clip(2 * q[bits] * (1 - q[bits]), 0, 0.5)
        odds = np.poly(-(differ / (1 - differ)))  # elementary symmetric sums: pairs at distance 0, 1, 2, ...
        row = [0.0]
        for t in range(DISTANCE + 1):
            near = min(square * odds[: t + 1].sum(), float(n) ** 2) / 2
            row.append(near + PROBE_COST * n * (1 + sum(math.comb(len(bits), k) for k in range(t + 1))))
        table.append(row)
    return table


def allocate(table: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the parts that sum to `total`, at the least cost, by dynamic programming over parts and sums."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in table:
        step: dict[int, tuple[float, list[int]]] = {}
        for got, (cost, chosen) in best.items():
            for t in range(-1, DISTANCE + 1):
                if got + t not in step or cost + row[t + 1] < step[got + t][0]:
                    step[got + t] = (cost + row[t + 1], [*chosen, t])
        best = step
    return best[total]


def plan(nodes: DataFrame, schemes=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part used."""
    n, both = bit_statistics(nodes)
    divided = {m: group_bits(both, n, m) for m in schemes}
    named = [(m, i, bits) for m, parts in divided.items() for i, bits in enumerate(parts)]
    rows = F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col("f").bitwiseAND(F.lit(_mask(bits)).cast("long")).alias("s")) for j, (_, _, bits) in enumerate(named))))
    buckets = nodes.select(rows.alias("p")).groupBy("p.j", "p.s").agg(F.count(F.lit(1)).alias("c"))
    squares = dict.fromkeys(range(len(named)), 0.0) | {r.j: float(r.q) for r in buckets.groupBy("j").agg(F.sum(F.col("c").cast("double") ** 2).alias("q")).collect()}
    found = []
    for m, parts in divided.items():
        own = [squares[j] for j, (k, _, _) in enumerate(named) if k == m]
        found.append((*allocate(costs(parts, own, both, n), DISTANCE - m + 1), parts))
    _, thresholds, parts = min(found, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0]


def _flips(bits: list[int], most: int) -> list[int]:
    """Masks that change up to `most` of the bits."""
    masks = [0]
    for t in range(most):
        masks += [x | 1 << b for x in masks if x.bit_count() == t for b in bits if x < 1 << b]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def links(nodes: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """Pairs a < b of fingerprints at DISTANCE or fewer bits, each once."""
    index = F.concat(*(_keys(p, bits, 0) for p, (bits, _) in enumerate(parts)))
    probe = F.concat(*(_keys(p, bits, t) for p, (bits, t) in enumerate(parts)))
    left = nodes.select(F.col("f").alias("a"), F.explode(probe).alias("x")).select("a", "x.p", "x.s")
    right = nodes.select(F.col("f").alias("b"), F.explode(index).alias("x")).select("b", "x.p", "x.s")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    return left.join(right, ["p", "s"]).filter(near).select("a", "b").distinct()


def _keys(p: int, bits: list[int], t: int):
    """The part number with each value within t bits of the node's own bits of that part."""
    base = F.col("f").bitwiseAND(F.lit(_mask(bits)).cast("long"))
    flips = F.array(*(F.lit(x).cast("long") for x in _flips(bits, t)))
    return F.transform(flips, lambda x: F.struct(F.lit(p).cast("byte").alias("p"), base.bitwiseXOR(x).alias("s")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """f and r of every node, r being the smallest r of its component (nodes: f, r; edges: a, b).

    A label is the pair (r, f) of a node. In a round each node and the node that its label names take the least label of a
    label among the node's neighbours; then labels of labels are taken. It ends when a round changes nothing.
    """
    label = F.struct("r", "f")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    known = nodes.join(both.select(F.col("a").alias("f")).distinct(), "f", "left_semi")
    # g: the label of the label
    state = written(known.select("f", label.alias("l"), label.alias("g")), "labels")
    while True:
        heard = both.join(state.select(F.col("f").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("g"))
        heard = written(heard, "heard")
        own = heard.join(state.select(F.col("f").alias("a"), F.col("l.f").alias("root")), "a")
        offers = own.select(F.explode(F.array("a", "root")).alias("f"), "g").groupBy("f").agg(F.min("g").alias("offer"))
        moved = state.join(written(offers, "offers"), "f", "left").select("f", F.least("l", "g", F.coalesce("offer", "l")).alias("l"), F.col("g").alias("old"))
        moved = written(moved, "moved")
        state = moved.select("f", "l", "old", F.col("l.f").alias("root")).join(moved.select(F.col("f").alias("root"), F.col("l").alias("g")), "root")
        state = written(state.select("f", "l", "g", (F.col("g") != F.col("old")).alias("changed")), "labels")
        if state.filter("changed").isEmpty():
            break
    state = state.select("f", F.col("g.r").alias("best"))
    return nodes.join(state, "f", "left").select("f", F.coalesce("best", "r").alias("r"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, f and c (the smallest key of the component) of every row; keys are integers."""
    rows = written(fingerprints(docs, key, text), "fingerprints")
    nodes = written(rows.groupBy("f").agg(F.coalesce(F.min(F.col("k").cast("long")), F.lit(_NONE)).alias("r")), "nodes")
    edges = written(links(nodes, plan(nodes)), "edges")
    named = written(components(nodes, edges), "components")
    return spread_join(rows, named, "f", "inner").select("k", "f", F.when(F.col("r") != _NONE, F.col("r")).alias("c"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("k").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("c").alias("component_id"))
