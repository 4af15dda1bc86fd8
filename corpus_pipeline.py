"""A training-data pipeline over `documents`: quality, near-duplicates, benchmark passages, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their input, and every
one works on all rows that the one before kept.

Stages decide by row: a row is known by its doc_id and a hash of its content, never by doc_id alone.

Defined cases, for every stage: null doc_ids are no document's name, so that each text under them is decided for itself, and so
is each of several texts under one doc_id; rows equal in doc_id and text are copies of one another, of which the near-duplicate
stage keeps one (that whose columns have the least hash), and among equal hashes they are equal; null and blank texts are one
text without words, which quality scores, near-duplicates keep once, no benchmark item is in, and mixing gives no tokens; texts
of any length are read whole; an empty table passes through all stages; extra columns are carried, and columns named like a
stage's own are left alone (sharding replaces shard_id, shard_depth and shard_bytes). A table without labels is kept whole by
quality if the constant score is 0.5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_copies, op3_quality, op5_mixing, op8_decontaminate, op10_sharding
from tidemark.llm.shared import spare, written

#: Mixing draws from one epoch here: what the stages before it made unique stays so.
EPOCHS = 1


# Where a decision is a row for most documents it meets them in a shuffled hash join at every size: the table of decisions is
# the built side, a broadcast of it would grow with the input, and a switch between the two would change the work with size.


def _decided(docs: DataFrame, decisions: DataFrame, how: str, content) -> DataFrame:
    """The rows joined to decisions, which have a row at most for each key __k and content hash __x."""
    own, k, x = spare(docs, "__own"), spare(docs, "__k"), spare(docs, "__x")
    decisions = decisions.withColumnRenamed("__k", k).withColumnRenamed("__x", x)
    meets = (F.col(own) == F.col(x)) & F.col("doc_id").eqNullSafe(F.col(k))
    return docs.withColumn(own, content).join(decisions.hint("shuffle_hash"), meets, how).drop(own)


def _one_of_each(docs: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of the keys: that with the least hash of all its columns."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    best = docs.groupBy(*keys).agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return best.select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects (a score under 0.5)."""
    network = op3_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = spare(docs, "__quality")
    return op3_quality.score(docs, network, out=score).filter(F.col(score) >= 0.5).drop(score)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more): that with the
    smallest doc_id (null ones last), and of several texts under that id the one with the least hash."""
    found = written(near_copies.near_copies(docs).select("k", "x", "c"), "groups")
    kept = found.groupBy("c").agg(F.min(F.struct(F.col("k").isNull().alias("no"), "k", "x")).alias("m"))
    kept = written(kept.select(F.col("m.k").alias("__k"), F.col("m.x").alias("__x")), "kept")
    rest = _decided(docs, kept, "left_semi", F.xxhash64("doc_id", "text"))
    # Where no row is repeated the rows are what choosing one of each would give.
    return rest if found.groupBy("k", "x").count().filter("count > 1").isEmpty() else _one_of_each(rest, ["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark item."""
    pairs = op8_decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    held = written(pairs.select(F.col("k").alias("__k"), F.col("x").alias("__x")).distinct(), "contaminated")
    return _decided(docs, held, "left_anti", F.xxhash64("text"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents to the target weights; a document drawn in part is kept whole. Of rows equal in doc_id and text as many
    stay as were drawn, as copies of one of them."""
    drawn = op5_mixing.mix(docs, *op5_mixing.document_levels(), epochs=EPOCHS)
    times = F.col("copies") + (F.col("part") > 0).cast("long")
    drawn = drawn.groupBy(F.col("k").alias("__k"), F.col("x").alias("__x")).agg(F.sum(times).alias("__n"), F.count(F.lit(1)).alias("__rows"))
    drawn = written(drawn, "drawn")
    if not drawn.filter("__rows > 1").isEmpty():
        docs = _one_of_each(docs, ["doc_id", "text"])
    n, copy, columns = spare(docs, "__n"), spare(docs, "__copy"), [F.col(f"`{c}`") for c in docs.columns]
    drawn = drawn.select("__k", "__x", F.col("__n").alias(n + "_drawn"))
    rows = _decided(docs, drawn, "inner", F.xxhash64("doc_id", "text"))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n + "_drawn")))).select(*columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document."""
    return op10_sharding.shard(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Attention, fingerprints by XXH64 and components are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
