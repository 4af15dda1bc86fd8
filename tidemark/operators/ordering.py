"""Global order without a single task: numbering, fills, set membership and keep-last over ranges of the order.

A window over the whole table would gather it in one task. Instead rows are sorted by ranges of the order and written once, a
file for each range: a row's number is its place in the file and the count of the files before (one row each). What is written
doesn't change, so every pass over the rows agrees on their numbers, however Spark plans it. Running values work on blocks of the numbering in the same way: inside a block by a window, across blocks by a window over
one row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import settled

#: Rows of a block of running values.
BLOCK = 1 << 18
#: Marks sent to every task as one sorted array, at most.
SENT_MARKS = 50_000


def default_order(df: DataFrame, ordered_on: str, seq: list[str] | None = None) -> list[str]:
    """The order of rows: the ordering column, then the tie-break columns (all other orderable ones by default)."""
    if seq is None:
        seq = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    return [ordered_on, *(c for c in seq if c != ordered_on)]


def numbered(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """Adds the row's number in the order, from 0.

    The rows are sorted by Spark's own range sort and written, a file for each range; a row's number is its place in its file
    and the rows of the files before. What is read back again and again is computed once.
    """
    names = df.columns
    rows = settled(df.orderBy(*(F.col(f"`{c}`") for c in order)), "numbered")
    place, where = rows._place, F.col("_metadata.file_name")
    counts = rows.groupBy(where.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    before, offsets = 0, []
    for name, n in sorted(counts):  # files are named in the order of their tasks
        offsets.append((name, before))
        before += n
    offsets = df.sparkSession.createDataFrame(offsets, "__range string, __before long")
    rows = rows.select(*(F.col(f"`{c}`") for c in names), where.alias("__range"), F.col("_metadata.row_index").alias("__within"))
    rows = rows.join(F.broadcast(offsets), "__range").withColumn(out, F.col("__before") + F.col("__within")).drop("__range", "__within", "__before")
    rows._place = place
    return rows


def _blocked(df: DataFrame, order: list[str], block: int) -> DataFrame:
    return numbered(df, order, "__rn").withColumn("__block", F.call_function("div", F.col("__rn"), F.lit(block)))


def running_count(df: DataFrame, flag: Column, order: list[str], out: str, block: int = BLOCK) -> DataFrame:
    """Adds how many rows up to and with this one have the flag."""
    rows = _blocked(df.withColumn("__flag", flag.cast("long")), order, block)
    within = F.sum("__flag").over(Window.partitionBy("__block").orderBy("__rn"))
    totals = rows.groupBy("__block").agg(F.sum("__flag").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__within", within).join(totals.select("__block", before.alias("__before")), "__block").withColumn(out, F.col("__before") + F.col("__within")).drop("__flag", "__rn", "__block", "__within", "__before")


def _present(df: DataFrame, column: str) -> Column:
    """The value, or null where it is NaN."""
    value = F.col(column)
    return F.when(F.isnan(value), F.lit(None)).otherwise(value) if df.schema[column].dataType.typeName() in ("double", "float") else value


def fill(df: DataFrame, column: str, order: list[str], out: str | None = None, forward: bool = True, block: int = BLOCK) -> DataFrame:
    """Adds the last (or with forward=False the next) value that is neither null nor NaN, this row's own included."""
    out = out or column
    rows = _blocked(df.withColumn("__v", _present(df, column)), order, block)
    # A fill from behind runs over the reverse order: a frame that reaches to the end is read anew for each row.
    way = F.asc if forward else F.desc
    so_far = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    within = F.last("__v", ignorenulls=True).over(so_far(Window.partitionBy("__block").orderBy(way("__rn")), 0))
    outermost = F.max_by if forward else F.min_by
    ends = rows.groupBy("__block").agg(outermost(F.col("__v"), F.when(F.col("__v").isNotNull(), F.col("__rn"))).alias("__e"))
    carried = F.last("__e", ignorenulls=True).over(so_far(Window.orderBy(way("__block")), -1))
    rows = rows.withColumn("__within", within).join(ends.select("__block", carried.alias("__carried")), "__block")
    return rows.withColumn(out, F.coalesce("__within", "__carried")).drop("__v", "__rn", "__block", "__within", "__carried")


def ffill(df: DataFrame, column: str, order: list[str], out: str | None = None) -> DataFrame:
    return fill(df, column, order, out, forward=True)


def bfill(df: DataFrame, column: str, order: list[str], out: str | None = None) -> DataFrame:
    return fill(df, column, order, out, forward=False)


def next_of(points: DataFrame, point: str, marks: DataFrame, mark: str, inclusive: bool, out: str, payload: list[str] | None = None) -> DataFrame:
    """Adds to each point the next mark: the first at or after it (inclusive), or after it; null if there is none.

    Up to SENT_MARKS marks (counted) are sent as a sorted array and searched by halves; more meet the points by a union in
    order and a backward fill, so that neither side is gathered. `payload` columns come with the mark.
    """
    payload = payload or []
    marks = settled(marks.select(mark, *payload), "marks")
    n = marks.count()
    if n <= SENT_MARKS:
        one = F.struct(F.col(mark).alias(out), *(F.col(c) for c in payload))
        table = marks.agg(F.array_sort(F.collect_list(one)).alias("__marks"))
        passed = "<" if inclusive else "<="
        middle = "cast((a.l + a.h) div 2 as int)"
        search = f"""aggregate(sequence(1, {n.bit_length() + 1}), named_struct('l', 0, 'h', size(__marks)), (a, i) -> if(a.l < a.h,
            if(get(__marks, {middle}).`{out}` {passed} __at, named_struct('l', {middle} + 1, 'h', a.h), named_struct('l', a.l, 'h', {middle})), a), a -> a.l)"""
        found = points.withColumn("__at", F.col(f"`{point}`")).join(F.broadcast(table)).withColumn("__mark", F.expr(f"get(__marks, {search})"))
        return found.select(*(F.col(f"`{c}`") for c in points.columns), "__mark.*")
    held = F.struct(F.col(mark).alias(out), *(F.col(c) for c in payload))
    own = F.struct(*(F.col(f"`{c}`") for c in points.columns))
    left = points.select(F.col(point).alias("__at"), F.lit(0 if inclusive else 1).alias("__side"), own.alias("__row"), F.lit(None).cast(marks.select(held.alias("m")).schema["m"].dataType).alias("__mark"), F.xxhash64(own).alias("__tie"))
    right = marks.select(F.col(mark).alias("__at"), F.lit(1 if inclusive else 0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), held.alias("__mark"), F.lit(0).cast("long").alias("__tie"))
    filled = bfill(left.unionByName(right), "__mark", ["__at", "__side", "__tie"])
    return filled.filter("__row is not null").select("__row.*", "__mark.*")


def not_in(queries: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """The query values that aren't known."""
    return queries.join(known.select(F.col(known_column).alias(column)), column, "left_anti")


def insert_positions(queries: DataFrame, column: str, known: DataFrame, known_column: str, out: str = "position") -> DataFrame:
    """Adds to each query value how many known values are less than it: where it would be inserted."""
    ranks = numbered(known.select(F.col(known_column).alias("__k")), ["__k"], "__p")
    marks = ranks.groupBy("__k").agg(F.min("__p").alias("__p"))
    found = next_of(queries, column, marks, "__k", inclusive=True, out="__next", payload=["__p"])
    return found.withColumn(out, F.coalesce("__p", F.lit(known.count()))).drop("__next", "__p")


def keep_last(df: DataFrame, keys: list[str] | None, order: list[str]) -> DataFrame:
    """Of the rows equal in `keys` (all columns if the list is empty, no removal if None) the last in the order.

    An aggregate with map-side combining, not a window: a key may have any number of rows.
    """
    if keys is None:
        return df
    keys = keys or list(df.columns)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last"))
    return last.select(*keys, "__last.*").select(*df.columns)


def merge_edges(first: DataFrame, second: DataFrame, value: str, out: str = "source") -> DataFrame:
    """The values of both with their source (0, 1) and place in the common order; the first ones lead on ties."""
    both = first.select(value, F.lit(0).alias(out)).unionByName(second.select(value, F.lit(1).alias(out)))
    return numbered(both, [value, out], "position")
