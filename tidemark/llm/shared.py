"""What the corpus operators share: whole-text tokens, regex spans with positions, joins on uneven keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import released
from tidemark.sources.scratch import settled as written
from tidemark.sources.scratch import shared_place as shared_path

__all__ = ["ascii_lower", "regex_spans", "released", "shared_path", "span_text", "spare", "spread_join", "words", "written"]

#: White space of the token contracts: space and \x09-\x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than one in HOT rows is dealt over SALTS tasks; there are at most HOT such keys.
HOT, SALTS = 1000, 48


def spare(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it differ from all columns of the frame."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left joined to right, which has one row for each key, where one key may hold a large part of left's rows.

    Such keys are found by their counts (at most HOT of them, so that they may be broadcast); left's rows of these go to SALTS
    tasks, right's rows to each of them. Null keys match nothing and are dealt out too.
    """
    counts = written(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.filter((F.col("n") * HOT > total) & F.col(key).isNotNull()).select(key, F.lit(True).alias("__hot"))
    dealt = F.when(F.col("__hot") | F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int")
    left = left.join(F.broadcast(hot), key, "left").withColumn("__salt", dealt).drop("__hot")
    right = right.join(F.broadcast(hot), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(F.col("__hot"), SALTS - 1).otherwise(0)))).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    """The runs of characters between ASCII white space, in order; null counts as empty."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+", -1)
    return F.filter(parts, lambda w: w != "")


def regex_spans(df: DataFrame, text: str, pattern: str, out: str, context: int = 24) -> DataFrame:
    """Adds `out`: the leftmost non-overlapping matches of `pattern`, as structs of start and end (code points, end
    exclusive), the match `m`, up to `context` characters before it (`pre`) and the one after it (`nxt`).

    The text between matches and the matches themselves come from two passes of the same matcher, so ends are running sums
    of lengths. These are made by doubling (each round adds the sum that stood twice as far ahead), n log n in the matches.
    """
    gaps, hits, ends = f"__gap_{out}", f"__hit_{out}", f"__end_{out}"
    df = df.withColumn(hits, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    rounds = f"cast(ceil(log2(greatest(size({hits}), 2))) as int) - 1"
    lengths = f"zip_with({hits}, slice({gaps}, 1, size({hits})), (m, g) -> length(m) + length(g))"
    further = "transform(acc, (x, i) -> x + if(i >= shiftleft(1, k), get(acc, i - shiftleft(1, k)), 0))"
    df = df.withColumn(ends, F.expr(f"aggregate(sequence(0, {rounds}), {lengths}, (acc, k) -> {further})"))
    df = df.withColumn(out, F.expr(f"arrays_zip({hits}, slice({gaps}, 1, size({hits})), slice({gaps}, 2, size({hits})), {ends})"))
    fields = df.schema[out].dataType.elementType.names
    m, gap, after, end = (f"z.`{f}`" for f in fields)
    one = f"named_struct('s', {end} - length({m}), 'e', {end}, 'm', {m}, 'pre', right({gap}, {context}), 'nxt', left({after}, 1))"
    return df.withColumn(out, F.expr(f"transform({out}, z -> {one})")).drop(gaps, hits, ends)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the order given; empty if there is none."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
