"""Near copies: groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of the same words are one node. The first candidates are op7's: SimHash fingerprints, here of the sets of five-word
shingles, linked at 3 or fewer bits by its generalised pigeonhole search, and each fingerprint with the least that it links to.
Sets of similarity 0.8 differ in more bits than any pigeonhole search can span, so the rest is found in an exact way (prefix
filter), which would find these too: under any one order of all shingles, two sets of that similarity share one of the first n - ceil(0.8 n) + 1 of each, n being the set's own size. The order is that of the
hashes, with shingles seen often last, so that common lines and passages rarely lead to candidates. What was seen often
decides the cost alone, never the result; it is counted over all rows, in blocks, and what occurs once in a block isn't sent.

The first shingle in the order that two such sets share stands early in both: at i of n and j of m with i <= n - o and j <= m - o
for the overlap o = 4 (n + m) / 9 that they need. So the smaller set has it among its first m / 9, and only entries that early
are met by others: what a bucket of a common passage is full of stands later than that and meets nothing.

Nodes with enough of these first shingles in common are verified on their whole sets, in two steps. First, with the candidates by
fingerprint, each against one node of the shingle's bucket, the one in which the shingle stands earliest: of a group of near copies that is the one with the fewest shingles of its
own, which is like most of the others, so that a large group is joined in work proportional to its size. Then those that are still in different components against
each other. Components are those of op7.

Defined cases: words lie between ASCII white space, and A-Z count as a-z; fewer than five words make one shingle; null and
blank texts are one node; repeated rows and keys are members like others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.op7_simhash import BITS, components, links, plan
from tidemark.llm.shared import released, spread_join, written
from tidemark.llm.text_arrays import PIECE, mix, pieces, token_hashes

WIDTH = 5
#: Shingles counted at a time, and how often one is seen to stand last in the order: the more of 64 times and one in 2^20.
BLOCK, OFTEN, RARE = 2_000_000, 64, 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLOT = "shiftrightunsigned(f, 40)"


def sets(texts: pa.Array):
    """(node, sorted distinct shingle hashes) of each text, in order."""
    texts = texts.cast(pa.large_binary())
    longest = max((len(t) for t in texts.to_pylist() if t), default=0)
    for own in pieces(texts, max(PIECE, longest)):  # never cut
        start, end, text = own.tokens()
        words, n = token_hashes(own.data, start, end), len(start)
        bound = np.searchsorted(text, np.arange(len(own.texts) + 1))
        after, owner = np.concatenate([words, np.zeros(WIDTH - 1, np.uint64)]), np.concatenate([text, np.full(WIDTH - 1, -1)])
        total = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            total = total * _STEP + np.where(owner[j : j + n] == text, after[j : j + n], np.uint64(0))
        total = mix(total)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            node = xxhash.xxh64_intdigest(words[a:b].tobytes(), 7)
            yield node - (1 << 64) if node >> 63 else node, np.unique(total[a : max(b - WIDTH + 1, min(a + 1, b))])


def _seen(batches):
    def counted(held):
        values, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64)), pa.array(np.full(int((n > 1).sum()), 0, np.int64))], names=["h", "n", "all"])

    held, size, total = [], 0, 0
    for batch in batches:
        for _, own in sets(batch.column(0)):
            held.append(own)
            size, total = size + len(own), total + len(own)
            if size >= BLOCK:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["h", "n", "all"])


def often(texts: DataFrame) -> np.ndarray:
    """The sorted hashes of shingles seen often; at most RARE."""
    seen = written(texts.mapInArrow(_seen, "h long, n long, all long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("all").alias("all")), "shingle-counts")
    total = seen.filter("h is null").agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0]
    found = seen.filter(F.col("h").isNotNull() & (F.col("n") > max(OFTEN, total // RARE))).select("h").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def simhash(own: np.ndarray, block: int = 1 << 16) -> int:
    """The fingerprint of a set of shingles, as a signed integer: a bit is set if it is in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(own), block):
        counts += np.unpackbits(own[i : i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view(np.int64)[0])


def _prefixes(late: np.ndarray):
    def run(batches):
        for batch in batches:
            nodes, prints, sizes, seldom, firsts = [], [], [], [], []
            for node, own in sets(batch.column(2)):
                n = len(own)
                at = np.minimum(np.searchsorted(late, own), max(len(late) - 1, 0))
                last = late[at] == own if len(late) else np.zeros(n, bool)
                ordered = np.concatenate([own[~last], own[last]])
                nodes.append(node)
                prints.append(simhash(own))
                sizes.append(n)
                seldom.append(n - int(last.sum()))
                firsts.append(ordered[: n - (4 * n + 4) // 5 + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(seldom, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], names=["k", "x", "f", "s", "n", "r", "p"])

    return run


def _whole(slots: np.ndarray):
    wanted = np.zeros(1 << 24, bool)
    wanted[slots] = True
    wanted = np.packbits(wanted)

    def run(batches):
        for batch in batches:
            nodes, found = [], []
            for node, own in sets(batch.column(0)):
                slot = (node >> 40) & 0xFFFFFF
                if wanted[slot >> 3] >> (7 - (slot & 7)) & 1:
                    nodes.append(node)
                    found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["f", "s"])

    return run


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs a, b of nodes whose sets have a similarity of 0.8 or more, by their whole sets."""
    slots = pairs.select(F.explode(F.array("a", "b")).alias("f")).select(F.expr(_SLOT).cast("int").alias("s")).distinct().toArrow().column(0).to_numpy()
    # A bit for each of 2^24 slots of nodes: others that share a slot with a candidate fall out of the joins.
    whole = written(texts.mapInArrow(_whole(slots), "f long, s array<long>").groupBy("f").agg(F.first("s").alias("s")), "sets")
    # A node that many meet, as the first of a large group is, is a hot key of both joins, whose rows carry sets.
    both = spread_join(pairs, whole.select(F.col("f").alias("a"), F.col("s").alias("sa")), "a", "inner")
    both = spread_join(both, whole.select(F.col("f").alias("b"), F.col("s").alias("sb")), "b", "inner")
    like = written(both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "verified")
    released(whole)
    return like


def _like(a: str, b: str):
    """Sets of these sizes can have the similarity."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _shared(a: str, b: str):
    """How many of the first shingles of a set of size a are among those of b's, if the similarity is reached and a's end first
    in the order: all but those that b lacks."""
    n, m = F.col(a).cast("long"), F.col(b).cast("long")
    return F.ceil(4 * (n + m) / 9) - F.floor((4 * n + 4) / 5) + 1


def _likely(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Those of the pairs fa, fb of sizes na, nb, as a < b, that have enough first shingles in common. own: p, of each node f
    those first shingles that another node has among its own too; no others can be in common, and most have none else."""
    least = F.least(_shared("na", "nb"), _shared("nb", "na"))
    # A node that is like many meets most of a bucket.
    met = spread_join(pairs, own.select(F.col("f").alias("fa"), F.col("p").alias("pa")), "fa", "inner").filter(F.size("pa") >= least)
    met = spread_join(met, own.select(F.col("f").alias("fb"), F.col("p").alias("pb")), "fb", "inner").filter(F.size("pb") >= least)
    return met.filter(F.size(F.array_intersect("pa", "pb")) >= least).select(F.least("fa", "fb").alias("a"), F.greatest("fa", "fb").alias("b")).distinct()


def alike(nodes: DataFrame) -> DataFrame:
    """Pairs a < b of nodes (f, s: the fingerprint, n: the size) that op7's search links: each node with the least one of its
    fingerprint, and that with the least one of the least fingerprint within 3 bits, so that large groups have no more."""
    heads = written(nodes.groupBy("s").agg(F.min(F.struct("f", "n")).alias("m")), "fingerprints")
    prints = heads.select(F.col("s").alias("f"))
    near = written(links(prints, plan(prints)).groupBy("b").agg(F.min("a").alias("a")), "fingerprint-links")
    same = spread_join(nodes.select("s", "f", "n"), heads, "s", "inner").filter(F.col("f") != F.col("m.f"))
    other = heads.select(F.col("s").alias("b"), F.col("m.f").alias("f"), F.col("m.n").alias("n"))
    other = spread_join(near.join(other, "b"), heads.withColumnRenamed("s", "a"), "a", "inner")
    both = same.select("f", "n", "m").unionByName(other.select("f", "n", "m")).filter(_like("n", "m.n"))
    return both.select(F.least("f", "m.f").alias("a"), F.greatest("f", "m.f").alias("b"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, x (xxhash64 of key and text), f (the node) and c (the component, one of its nodes) of every row."""
    own = docs.select(F.col(key).alias("k"), F.xxhash64(key, text).alias("x"), F.col(text).cast("string").alias("t"))
    texts = own.select("t")
    kind = own.schema["k"].dataType.simpleString()
    found = written(own.mapInArrow(_prefixes(often(texts)), f"k {kind}, x long, f long, s long, n int, r int, p array<long>"), "prefixes")
    rows = written(found.select("k", "x", "f"), "rows")
    nodes = written(found.groupBy("f").agg(F.first("s").alias("s"), F.first("n").alias("n"), F.first("r").alias("r"), F.first("p").alias("p")), "first-shingles")
    released(found)
    entries = nodes.select("f", "n", "r", F.posexplode("p").alias("i", "h"))
    lead = F.min(F.struct((F.col("i") / F.col("n")).alias("at"), F.xxhash64("h", "f").alias("o"), "f", "n"))
    # Of shingles not seen often a bucket is small; the others' may hold a large part of the nodes, so they are counted in parts.
    small, large = entries.filter("i < r"), entries.filter("i >= r")
    bucket = Window.partitionBy("h")
    # The window's own exchange would carry `lead` besides what it is made of.
    small = small.select("h", "f", "n", "i").repartition("h")
    small = small.select("h", "f", "n", "i", lead.over(bucket).alias("l"), F.count(F.lit(1)).over(bucket).alias("w")).filter("w > 1")
    heads = written(large.groupBy("h").agg(lead.alias("l"), F.count(F.lit(1)).alias("w")).filter("w > 1"), "large-buckets")
    held = small.unionByName(spread_join(large.select("h", "f", "n", "i"), heads, "h", "inner"))
    held = written(held.select("h", "f", "n", "i", F.col("l.f").alias("lf"), F.col("l.n").alias("ln")), "buckets")
    all_nodes = written(nodes.select("f", F.col("f").alias("r")), "nodes")
    near = written(alike(nodes), "alike")
    released(nodes, heads)
    own = written(held.groupBy("f").agg(F.collect_list("h").alias("p")), "shared-shingles")
    first = held.filter((F.col("f") != F.col("lf")) & _like("n", "ln")).select(F.col("f").alias("fa"), F.col("lf").alias("fb"), F.col("n").alias("na"), F.col("ln").alias("nb")).distinct()
    first = written(_likely(written(first, "leader-pairs"), own).unionByName(near).distinct(), "likely-pairs")
    found = verified(first, texts)
    label = written(components(all_nodes, found), "leader-components")
    # Buckets of several components: early entries are met by those of the other components and no smaller set.
    label = label.withColumnRenamed("r", "c").join(own.select("f", F.size("p").alias("s")), "f")
    entry = written(held.select("h", "f", "n", "i").join(label, "f"), "entries")
    released(held)
    mixed = entry.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("h")
    mixed = written(entry.join(mixed, "h", "left_semi"), "mixed")
    released(entry)
    early = mixed.filter("9 * i <= n").select("h", F.col("c").alias("d"), F.col("f").alias("fb"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("s").alias("sb"))
    overlap = F.ceil(4 * (F.col("na").cast("long") + F.col("nb")) / 9)
    reach = (F.col("ia") <= F.col("na") - overlap) & (F.col("ib") <= F.col("nb") - overlap)
    enough = F.least("sa", "sb") >= F.least(_shared("na", "nb"), _shared("nb", "na"))
    meets = (F.col("e.h") == F.col("y.h")) & (F.col("c") != F.col("d")) & (F.col("na") >= F.col("nb")) & _like("na", "nb") & reach & enough
    late = mixed.select("h", "c", F.col("f").alias("fa"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("s").alias("sa"))
    met = written(late.alias("e").join(early.alias("y"), meets).select("fa", "fb", "na", "nb").distinct(), "met")
    rest = written(_likely(met, own).join(first, ["a", "b"], "left_anti"), "pairs")
    released(mixed, met, own)
    found = written(found.unionByName(verified(rest, texts)), "all-links")
    return rows.join(written(components(all_nodes, found), "components").withColumnRenamed("r", "c"), "f").select("k", "x", "f", "c")
