"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of shingles of five words (A-Z lower-cased; an item or document with fewer words is one
shingle). A document holds an item if it contains at least 0.8 of the item's shingles. Estimates of the Jaccard similarity
can't find a short item in a long document, where that similarity is near zero, so both sides have sketches for containment:

* Items are partitioned by size (the power of two below their number n of shingles). An item's sketch is its k least hash
  values; among n shingles, k = n - ceil(0.8 n) + 1 of them can't all be missing from a document that holds the item. The
  size partition fixes k, and with it a bound: the largest value in any sketch of the partition.
* A document's sketch for a partition is all of its hash values up to that bound (its least ones, as many as its length
  makes them), so whatever it shares with an item's sketch is in its own.

A document is a candidate for an item if their sketches share a value: no holding document is lost. Candidates are verified by
the exact share of the item's shingles in the document, counted by a join on the shingles' text.

Sketches and the shingles of candidates' items are sent to the tasks while their tables are below Spark's broadcast threshold,
and shuffled beyond it, with the same result. Values that many documents hold are left to AQE's splitting of skewed joins.

Defined cases: null and blank texts have no shingles, so they are in no pair; documents shorter than five words only match
items that are equal to them, and so do items; rows of a document with the same text count as one, with different texts each
for itself, and the pair is reported once, with the largest containment; so are rows of one item_id; null keys are keys like
others; a text of any length is read whole, in linear time; empty tables give no pairs. Extra columns of the inputs are not
carried, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import ascii_lower, words, written

WIDTH, LEAST = 5, 0.8


def with_words(df: DataFrame, text: str, out: str = "w") -> DataFrame:
    """Adds the words of a text as a column of their own: the shingles refer to it many times."""
    return df.withColumn(out, words(ascii_lower(F.col(text))))


def shingles(w: Column, width: int = WIDTH) -> Column:
    """The shingles of a column of words, space-joined, in order and with repeats."""
    many = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " "))
    one = F.array(F.array_join(w, " "))
    return F.when(F.size(w) >= width, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<string>"))


def sketches(items: DataFrame, key: str, text: str, least: float = LEAST) -> DataFrame:
    """Columns item (the row's key), i (a number of the row), n (shingles), part (the size partition), sh (shingles) and sketch (bottom-k hashes)."""
    rows = with_words(items.select(F.col(key).alias("item"), F.col(text).cast("string").alias("t")), "t").filter(F.size("w") > 0)
    rows = rows.select("item", F.xxhash64("item", "t").alias("i"), F.array_distinct(shingles(F.col("w"))).alias("sh"))
    rows = rows.withColumn("n", F.size("sh")).withColumn("part", F.floor(F.log2("n")).cast("int"))
    # The largest item of a partition fixes its k; smaller ones need no more.
    top = F.expr("shiftleft(1, part + 1) - 1")
    k = F.least(F.col("n").cast("long"), top - F.ceil(F.lit(least) * top - 1e-9) + 1)
    hashes = F.array_sort(F.array_distinct(F.transform("sh", lambda s: F.xxhash64(s))))
    return rows.withColumn("sketch", F.slice(hashes, F.lit(1), k.cast("int")))


def bounds(known: DataFrame) -> DataFrame:
    """part and bound (the largest hash in a sketch of the partition): a row for each power of two, 31 at most."""
    return known.groupBy("part").agg(F.max(F.element_at("sketch", -1)).alias("bound"))


def document_sketches(docs: DataFrame, key: str, text: str, bound: int) -> DataFrame:
    """d (key k and the text's hash x) and h: the document's distinct hash values up to the largest partition's bound, which
    hold its sketches of all partitions."""
    own = with_words(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")), "t")
    own = own.select(F.struct("k", F.xxhash64("t").alias("x")).alias("d"), F.transform(shingles(F.col("w")), lambda s: F.xxhash64(s)).alias("h"))
    return own.select("d", F.explode(F.array_distinct(F.filter("h", lambda h: h <= F.lit(bound)))).alias("h"))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """k, x (of the document's row: key and xxhash64 of the text), item, n (shingles) and f (those found) of every pair of rows
    with a containment of `least` or more."""
    known = written(sketches(items, item_key, item_text, least), "items")
    bound = bounds(known).agg(F.max("bound")).first()[0]
    index = written(known.select("i", F.explode("sketch").alias("h")).distinct(), "sketch")
    found = document_sketches(docs, key, text, bound if bound is not None else -(1 << 63))
    pairs = written(found.join(index, "h").select("d", "i").distinct(), "candidates")
    return _verified(docs, known, pairs, key, text, least)


def _verified(docs: DataFrame, known: DataFrame, pairs: DataFrame, key: str, text: str, least: float) -> DataFrame:
    wanted = pairs.select(F.col("d.k").alias("wk"), F.col("d.x").alias("wx")).distinct()
    own = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).withColumn("x", F.xxhash64("t"))
    held = with_words(own.join(wanted, (F.col("x") == F.col("wx")) & F.col("k").eqNullSafe(F.col("wk")), "left_semi"), "t")
    held = held.select(F.struct("k", "x").alias("d"), F.explode(F.array_distinct(shingles(F.col("w")))).alias("s"))
    asked = known.join(pairs.select("i").distinct(), "i", "left_semi")
    both = held.join(written(asked.select("i", F.explode("sh").alias("s")).distinct(), "asked"), "s")
    both = both.select(F.col("d.k").alias("k"), F.col("d.x").alias("x"), "i", F.xxhash64("s").alias("s")).repartition("k", "x", "i")
    counted = both.groupBy("k", "x", "i").agg(F.count_distinct("s").alias("f"))  # over equal rows too
    rows = counted.join(known.select("i", "item", "n").distinct(), "i").filter(F.col("f") / F.col("n") >= least - 1e-12)
    # What the sketches didn't find is no match; by the choice of k there is none of it.
    near = pairs.select(F.col("d.k").alias("pk"), F.col("d.x").alias("px"), F.col("i").alias("pi"))
    return rows.join(near, (F.col("i") == F.col("pi")) & (F.col("x") == F.col("px")) & F.col("k").eqNullSafe(F.col("pk")), "left_semi").select("k", "x", "item", "n", "f")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = LEAST) -> DataFrame:
    """Pairs (key, item, n_shingles, n_found, containment) with a containment of `least` or more."""
    found = matches(docs, items, key, text, item_key, item_text, least).withColumn("c", F.col("f") / F.col("n"))
    best = found.groupBy("k", "item").agg(F.max(F.struct("c", "f", "n")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("item").alias("item_id"), F.col("b.n").cast("long").alias("n_shingles"), F.col("b.f").cast("long").alias("n_found"), F.col("b.c").alias("containment"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def oracle() -> str:
    """DuckDB SQL of op8: every item against every shingle."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sh = r"""list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end)"""
    words_of = rf"regexp_extract_all({low}, '[^\x20\x09-\x0D]+')"
    return f"""
with i as (select item_id, {sh} sh from (select item_id, {words_of} w from benchmark)),
d as (select doc_id, unnest({sh}) s from (select doc_id, {words_of} w from documents)),
e as (select item_id, len(sh) n, unnest(sh) s from i),
f as (select doc_id, item_id, n, count(*) f from e join d using (s) group by all)
select doc_id, item_id, n::bigint n_shingles, f::bigint n_found, f / n containment from f where f / n >= 0.8 - 1e-12
"""
