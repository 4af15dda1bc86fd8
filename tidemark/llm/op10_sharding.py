"""Sharding by extendible hashing: only a bucket over its byte limit splits on one more bit of the hash.

A row's hash has 60 bits: the first 30 of the MD5 of its key, then the first 30 of the MD5 of key and text. A shard is a
hash prefix; the directory is built in rounds of eight bits. A round sums bytes by cell (a prefix eight bits longer) of the
buckets still over the limit, rolls the sums up to every shorter prefix, and takes as shards the shortest prefixes that fit.
Buckets over the limit at the round's last bit go to the next round, all others are done. Rounds see hash and bytes alone;
rows with their texts meet the directory once, when it is finished.

Only rows equal in key and text share all 60 bits (but for one chance in 2^30 for rows of one key). Where such a group is over
the limit it gets overflow pages by its rows' running number, which is dealt out over tasks. A single row larger than the
limit is a page of its own.

Defined cases: a null text has no bytes; a null key hashes as the empty string; repeated rows count as often as they occur,
and of equal rows any may be in any page; an empty table gives an empty result. The text is measured in UTF-8 bytes, whatever
its length. Columns of the input that are named like the result's (shard_id, shard_depth, shard_bytes) are replaced; the
operator's own columns begin with __shard_, and an input column of such a name is an error that is raised at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import spread_join, written

BITS, STEP = 60, 8
PRODUCTION_LIMIT = 256 << 20
SMALL_LIMIT = 16 << 10
#: Shards sent to every task (24 bytes each), and their depths, at most; the same rows come of the other way.
SENT, LOOKUPS = 1_000_000, 12
_H, _B, _X, _C, _R, _T = "__shard_h", "__shard_b", "__shard_x", "__shard_cell", "__shard_row", "__shard_task"


def placed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The rows with their hash, bytes and content hash (60 bits of an MD5 each)."""
    bits = lambda value: F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")
    own = F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")
    content = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = rows.withColumn(_B, F.octet_length(content).cast("long")).withColumn(_X, bits(F.concat(own, F.lit(b"\0"), content)))
    return rows.withColumn(_H, F.shiftleft(F.shiftright(bits(own), 30), 30).bitwiseOR(F.shiftright(F.col(_X), 30)))


def _cell(last: int):
    return F.expr(f"shiftright({_H}, {BITS - last})")


def directory_round(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """Cells of `depth + STEP` bits, each with the depth and bytes of the shard that takes it, or with none.

    `rows` holds hash and bytes of the buckets that are over the limit at `depth`.
    """
    last = min(BITS, depth + STEP)
    cells = rows.groupBy(_cell(last).alias(_C)).agg(F.sum(_B).alias("cb"))
    tried = cells.select(_C, "cb", F.explode(F.sequence(F.lit(depth), F.lit(last))).alias("d"))
    tried = tried.withColumn("prefix", F.expr(f"shiftright({_C}, {last} - d)"))
    sums = tried.groupBy("d", "prefix").agg(F.sum("cb").alias("shard_bytes"))
    fits = tried.join(sums, ["d", "prefix"]).filter(F.col("shard_bytes") <= limit)
    first = fits.groupBy(_C).agg(F.min(F.struct("d", "shard_bytes")).alias("f"))
    return cells.join(first, _C, "left").select(_C, F.col("f.d").alias("shard_depth"), F.col("f.shard_bytes").alias("shard_bytes"))


def _name(depth: str) -> str:
    """SQL: the prefix of the hash at a depth as a string of bits; the root is 'root'."""
    return f"if({depth} = 0, 'root', lpad(conv(cast(shiftright({_H}, {BITS} - {depth}) as string), 10, 2), {depth}, '0'))"


def directory(thin: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(each shard's first hash, depth and bytes; the hashes of those over the limit at the last bit, or None)."""
    done, depth = [], 0
    while depth < BITS:
        last = min(BITS, depth + STEP)
        cells = written(directory_round(thin, depth, limit), "directory")
        fit = F.col("shard_depth").cast("int")
        start = F.expr(f"shiftleft(shiftright({_C}, {last} - shard_depth), {BITS} - shard_depth)")
        done.append(cells.filter("shard_depth is not null").select(start.alias("start"), fit.alias("shard_depth"), "shard_bytes").distinct())
        over = cells.filter("shard_depth is null").select(_C)
        if over.isEmpty():
            return _all(done), None
        thin = written(thin.withColumn(_C, _cell(last)).join(over, _C, "left_semi").drop(_C), "over")
        depth = last
    return _all(done), over.select(F.col(_C).alias(_H))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return written(out, "shards")


def assign(thin: DataFrame, rows: DataFrame, limit: int) -> DataFrame:
    """The rows with shard_id, shard_depth and shard_bytes. The directory is made from `thin`, which has the hash and bytes of
    the same rows. Shards are of few depths, and at each a row has one prefix: while there are at most SENT shards they are
    sent to the rows, a lookup for each depth. More are resolved on distinct hashes first, and meet the rows in one join."""
    shards, over = directory(thin, limit)
    depths = sorted(r[0] for r in shards.select("shard_depth").distinct().collect())  # at most 61
    at = lambda d: F.expr(f"shiftleft(shiftright({_H}, {BITS - d}), {BITS - d})")
    few = shards.count() <= SENT
    if few and len(depths) <= LOOKUPS:
        found = rows
        for d in depths:
            own = shards.filter(F.col("shard_depth") == d).select(F.col("start").alias(f"__shard_s{d}"), F.col("shard_bytes").alias(f"__shard_b{d}"))
            found = found.join(F.broadcast(own), at(d) == F.col(f"__shard_s{d}"), "left")
        sizes = [F.col(f"__shard_b{d}") for d in depths] or [F.lit(None).cast("long")]
        depth = F.coalesce(*(F.when(F.col(f"__shard_b{d}").isNotNull(), d) for d in depths), F.lit(None).cast("int"))
        found = found.withColumn("shard_depth", depth).withColumn("shard_bytes", F.coalesce(*sizes)).filter("shard_depth is not null")
        found = found.drop(*(f"__shard_{x}{d}" for x in "sb" for d in depths))
    else:
        starts = F.array(*(F.struct(F.lit(d).alias("shard_depth"), at(d).alias("start")) for d in depths))
        tried = thin.select(_H).distinct().withColumn("t", F.explode(starts)).select(_H, "t.*")
        by_hash = written(tried.join(shards, ["shard_depth", "start"]).select(_H, "shard_depth", "shard_bytes"), "hashes")
        found = spread_join(rows, by_hash, _H, "inner")
    found = found.withColumn("shard_id", F.expr(_name("shard_depth")))
    if over is None:
        return found
    return found.unionByName(overflow(rows.join(F.broadcast(over) if few else over, _H, "left_semi"), limit))


def overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of rows that are equal in key and text: each page holds as many as fit, one at least."""
    rows = written(rows.withColumn(_R, F.monotonically_increasing_id()), "overflow")
    rows = rows.withColumn(_T, F.shiftright(_R, 33))
    same = [_H, _X]
    parts = rows.groupBy(*same, _T).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*same).orderBy(_T).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*same, _T, F.coalesce(earlier, F.lit(0)).alias("__shard_before"))
    rank = F.row_number().over(Window.partitionBy(*same, _T).orderBy(_R)) - 1
    per_page = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col(_B), F.lit(1).cast("long"))))
    paged = rows.withColumn("__shard_rank", rank).join(parts, [*same, _T]).withColumn("__shard_page", F.floor((F.col("__shard_before") + F.col("__shard_rank")) / per_page))
    sizes = paged.groupBy(*same, "__shard_page").agg(F.sum(_B).alias("shard_bytes"))
    name = F.concat(F.expr(_name(str(BITS))), F.lit("+"), F.lower(F.hex(_X)), F.lit("."), F.col("__shard_page"))
    paged = paged.join(sizes, [*same, "__shard_page"]).withColumn("shard_depth", F.lit(BITS)).withColumn("shard_id", name)
    return paged.drop(_R, _T, "__shard_before", "__shard_rank", "__shard_page")


def shard(docs: DataFrame, limit: int = PRODUCTION_LIMIT, key: str = "doc_id", text: str = "text", keep_rows: bool = True) -> DataFrame:
    """Every row with shard_id, shard_depth and shard_bytes (of the whole shard); without `keep_rows` the key, n_bytes and these."""
    if limit < 1:
        raise ValueError("limit must be positive")
    docs = docs.drop("shard_id", "shard_depth", "shard_bytes")
    if clash := [c for c in docs.columns if c.lower().startswith("__shard_")]:
        raise ValueError(f"columns of the operator's own names: {clash}")
    thin = written(placed(docs.select(key, text), key, text).select(key, _H, _B, _X), "sizes")
    out = assign(thin, placed(docs, key, text) if keep_rows else thin, limit)
    kept = [F.col(f"`{c}`") for c in docs.columns] if keep_rows else [F.col(key), F.col(_B).alias("n_bytes")]
    return out.select(*kept, "shard_id", F.col("shard_depth").cast("int").alias("shard_depth"), F.col("shard_bytes").cast("long").alias("shard_bytes"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_rows=False)


def sharding_splits(spark, sf_dir: str) -> DataFrame:
    """The operator at a limit that makes many shards, and overflow pages, of small tables too."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), SMALL_LIMIT, keep_rows=False)


def oracle(limit: int = PRODUCTION_LIMIT) -> str:
    """DuckDB SQL of op10: every row's bucket at every depth, the first that fits; equal rows over the limit in pages."""
    return f"""
with k as (select doc_id, coalesce(doc_id::varchar, '') k, coalesce(text, '') c from documents),
x as (select doc_id, octet_length(encode(c))::bigint b, ('0x' || substr(md5(k), 1, 15))::bigint kh,
             ('0x' || substr(md5(encode(k) || '\x00'::blob || encode(c)), 1, 15))::bigint x from k),
r as (select doc_id, b, x, ((kh >> 30) << 30) | (x >> 30) h, row_number() over () id from x),
t as (select id, b, d, h >> (60 - d) p, h from r, (select unnest(generate_series(0, 60)) d)),
s as (select d, p, sum(b)::bigint sb from t group by all having sb <= {limit}),
f as (select id, min(d) d from t join s using (d, p) group by id),
o as (select id, floor((row_number() over (partition by h, x order by id) - 1) / greatest(1, {limit} // greatest(b, 1)))::bigint page
      from r where id not in (select id from f)),
z as (select h, x, page, sum(b)::bigint sb from r join o using (id) group by all)
select doc_id, b n_bytes, case when f.d = 0 then 'root' else lpad(bin(h >> (60 - f.d)), f.d::int, '0') end shard_id, f.d::int shard_depth, s.sb shard_bytes
from r join f using (id) join s on s.d = f.d and s.p = h >> (60 - f.d)
union all
select doc_id, b, lpad(bin(h), 60, '0') || '+' || lower(hex(x)) || '.' || page, 60, z.sb from r join o using (id) join z using (h, x, page)
"""
