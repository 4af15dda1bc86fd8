"""Mixing sources to target weights by hierarchical budgeting.

A tree of levels (domain, language, source) has a weight at each node. The root's token budget goes down level by level: the
children of a node share its budget by weight, a child takes no more than it can give (its tokens times the epochs), and what
it leaves is shared anew among its siblings (water-filling, in closed form with one window over the siblings). Since a child's
limit is the sum over its own subtree, a shortage stays with the siblings as long as they have tokens and only then reaches
the level above.

A leaf draws its budget from seeded epochs: all rows once for each whole epoch that fits, then a prefix of the next epoch's
order, which is the MD5 of seed, epoch and key. The end of the prefix is found by radix selection: sums by the order's first
two hex digits, then by the next two in the digit pair that holds the end, and only the rows of that last cell are put in
order. No leaf is sorted whole, so one leaf may hold any share of the rows.

Defined cases: a null or empty text has no tokens and is never drawn; null levels form a node of their own (the empty name);
unknown nodes have weight 1; repeated rows are drawn each; ties of the order fall to the text's hash; an empty table or a
budget of 0 draws nothing. The row at the end of the prefix is drawn in part: take_tokens says how many of its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import WORD_PATTERN, written

#: Production settings of the registered query.
SEED, EPOCHS, BUDGET_SHARE = 17, 3, 0.8
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
#: A document's domain is the residue of its source's number; the weights are those of the domains.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
#: Weights of the levels of `documents`: domain, language, source.
TABLES = [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, {}]


def token_count(text: Column) -> Column:
    """The number of words of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(WORD_PATTERN + "+")).cast("long")


def weights(column: Column, table: dict[str, int]) -> Column:
    """The weight of a node by its name; 1 where the table has none."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.create_map().cast("map<string,int>")
    return F.coalesce(F.element_at(known, column), F.lit(1)).cast("double")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Water-filling: adds `budget` to nodes with w (weight), cap and parent_budget, siblings being equal in `parent`.

    In order of cap/w, the first ones are those that give all they have; the level that the rest is filled to follows from
    running sums of caps and weights.
    """
    nodes = nodes.withColumn("__fill", F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))))
    siblings = Window.partitionBy(*parent)
    ordered = siblings.orderBy("__fill", "node").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("__cap", F.coalesce(F.sum("cap").over(ordered), F.lit(0.0))).withColumn("__w", F.sum("w").over(siblings) - F.coalesce(F.sum("w").over(ordered), F.lit(0.0)))
    # This node is full if filling it leaves no less than nothing for it and all after it.
    nodes = nodes.withColumn("__full", (F.col("w") > 0) & (F.col("__fill") * F.col("__w") <= F.col("parent_budget") - F.col("__cap") + 1e-6))
    level = F.min(F.when((F.col("w") > 0) & ~F.col("__full"), F.struct("__fill", ((F.col("parent_budget") - F.col("__cap")) / F.col("__w")).alias("at")))).over(siblings)
    budget = F.when(F.col("w") <= 0, 0.0).when(F.col("__full"), F.col("cap")).otherwise(F.least(F.col("cap"), level["at"] * F.col("w")))
    return nodes.withColumn("budget", budget).drop("__fill", "__cap", "__w", "__full")


def leaf_budgets(leaves: DataFrame, levels: list[str], tables: list[dict[str, int]], budget_share: float, epochs: int) -> DataFrame:
    """leaves (the levels and `have`, the tokens of each leaf): adds `budget`, in whole tokens."""
    tree = leaves.withColumn("cap", (F.col("have") * epochs).cast("double")).withColumn("__root", F.lit(0))
    above = None
    for depth, (level, table) in enumerate(zip(levels, tables, strict=True)):
        at = tree.groupBy("__root", *levels[: depth + 1]).agg(F.sum("cap").alias("cap"), F.sum("have").cast("double").alias("have"))
        at = at.withColumn("w", weights(F.col(level), table)).withColumn("node", F.col(level))
        if depth:
            at = share(at.join(above, levels[:depth]), levels[:depth])
        else:
            whole = F.sum("have").over(Window.partitionBy("__root"))
            at = share(at.withColumn("parent_budget", F.floor(whole * budget_share).cast("double")), ["__root"])
        above = at.select(*levels[: depth + 1], F.col("budget").alias("parent_budget"))
    return leaves.join(above.select(*levels, F.floor(F.col("parent_budget") + 1e-6).cast("long").alias("budget")), levels)


def _cut(sums: DataFrame, keys: list[str], digit: str) -> DataFrame:
    """For each key: the digit pair that holds the end of the prefix, and the tokens still wanted at its start."""
    running = F.sum("t").over(Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__before", F.coalesce(running, F.lit(0)))
    held = (F.col("__before") < F.col("want")) & (F.col("__before") + F.col("t") >= F.col("want"))
    return sums.filter(held).select(*keys, F.col(digit).alias(f"cut_{digit}"), (F.col("want") - F.col("__before")).alias(f"want_{digit}"))


def draw(rows: DataFrame, leaf: str, plan: DataFrame, seed: int) -> DataFrame:
    """rows (k, x, n tokens, leaf) with copies (whole epochs) and take_tokens, those drawn at all.

    `plan` has leaf, have and budget.
    """
    plan = plan.withColumn("epoch", F.floor(F.col("budget") / F.col("have"))).withColumn("want", F.col("budget") - F.floor(F.col("budget") / F.col("have")) * F.col("have"))
    plan = written(plan.select(leaf, "epoch", "want"), "mix-plan")
    rows = rows.filter("n > 0").join(plan, leaf).withColumn("o", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.coalesce(F.col("k").cast("string"), F.lit(""))).cast("binary")))
    rows = rows.withColumn("d1", F.substring("o", 1, 2)).withColumn("d2", F.substring("o", 3, 2))
    cells = written(rows.filter("want > 0").groupBy(leaf, "want", "d1", "d2").agg(F.sum("n").alias("t")), "mix-cells")
    first = _cut(cells.groupBy(leaf, "want", "d1").agg(F.sum("t").alias("t")), [leaf], "d1")
    inner = cells.drop("want").join(first.withColumnRenamed("want_d1", "want"), leaf).filter("d1 = cut_d1").drop("d1")
    second = _cut(inner, [leaf, "cut_d1"], "d2")
    cut = written(second.select(leaf, "cut_d1", "cut_d2", F.col("want_d2").alias("want_in")), "mix-cut")
    rows = rows.join(cut, leaf, "left")
    here, end = F.concat("d1", "d2"), F.concat("cut_d1", "cut_d2")
    at_end = rows.filter(here == end)
    running = F.sum("n").over(Window.partitionBy(leaf).orderBy("o", "x").rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), F.col("want_in") - F.coalesce(running, F.lit(0).cast("long"))))
    whole = rows.filter(end.isNull() | (here != end)).withColumn("part", F.when((F.col("want") > 0) & (here < end), F.col("n")).otherwise(F.lit(0).cast("long")))
    both = whole.unionByName(at_end.withColumn("part", part))
    take = F.col("epoch") * F.col("n") + F.col("part")
    return both.withColumn("take_tokens", take).filter("take_tokens > 0").select("k", "x", leaf, "n", F.col("epoch").alias("copies"), "part", "take_tokens")


def mix(docs: DataFrame, levels: list[Column], tables: list[dict[str, int]], budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k (the key), x (hash of key and text), leaf, n, copies, part and take_tokens of the rows drawn."""
    names = [f"l{i}" for i in range(len(levels))]
    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels, names, strict=True)]
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(key), F.col(text)).alias("x"), token_count(F.col(text)).alias("n"), *named)
    rows = written(rows.withColumn("leaf", F.concat_ws("/", *names)), "mix-rows")
    leaves = written(rows.filter("n > 0").groupBy("leaf", *names).agg(F.sum("n").alias("have")), "mix-leaves")
    plan = leaf_budgets(leaves, names, tables, budget_share, epochs)
    return draw(rows, "leaf", plan.select("leaf", "have", "budget"), seed)


def document_levels() -> tuple[list[Column], list[dict[str, int]]]:
    """Domain, language and source of `documents`; the domain follows from the source's number."""
    number = F.coalesce(F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), "([0-9]{1,9})$", 1), F.lit(""))
    domain = F.when(number == "", F.lit("d0")).otherwise(F.concat(F.lit("d"), number.try_cast("int") % 4))
    return [domain, F.col("lang"), F.col("source")], TABLES


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drawn = mix(docs, *document_levels())
    return drawn.select(F.col("k").alias("doc_id"), "leaf", F.col("n").alias("n_tokens"), F.col("copies").cast("long").alias("copies"), F.col("take_tokens").cast("long").alias("take_tokens"))


def _case(column: str, table: dict[str, int]) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + " else 1 end" if table else "1"


def oracle(budget_share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """DuckDB SQL of op5: the same tree filled level by level, and each leaf's order summed row by row."""
    tables = TABLES
    parts = [f"""
r as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint n,
        case when regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' then 'd0'
             else 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::int % 4) end l0,
        coalesce(lang, '') l1, coalesce(source, '') l2 from documents),
leaves as (select l0, l1, l2, sum(n)::double have from r where n > 0 group by all),
b0 as (select floor(sum(have) * {budget_share}) pb from leaves)"""]
    for d, table in enumerate(tables):
        keys = ", ".join(f"l{i}" for i in range(d + 1))
        parent = ", ".join(f"l{i}" for i in range(d)) or "1"
        join = f"join b{d} using ({parent})" if d else "cross join b0"
        parts.append(f"""
c{d} as (select {keys}, sum(have) * {epochs} cap, ({_case(f'l{d}', table)})::double w from leaves group by {keys}),
f{d} as (select c{d}.*, pb, coalesce(sum(cap) over o, 0) before_cap, sum(w) over (partition by {parent}) - coalesce(sum(w) over o, 0) rest_w
   from c{d} {join} window o as (partition by {parent} order by cap / w, l{d} rows between unbounded preceding and 1 preceding)),
g{d} as (select *, cap / w * rest_w <= pb - before_cap + 1e-6 is_full from f{d}),
h{d} as (select *, min_by((pb - before_cap) / rest_w, cap / w) filter (not is_full) over (partition by {parent}) lvl from g{d}),
b{d + 1} as (select {keys}, case when is_full then cap else least(cap, lvl * w) end pb from h{d})""")
    parts.append(f"""
p as (select l0, l1, l2, have::bigint have, floor(pb + 1e-6)::bigint budget from leaves join b3 using (l0, l1, l2)),
q as (select doc_id, n, concat_ws('/', l0, l1, l2) leaf, budget // have copies, budget - (budget // have) * have want,
        md5('{seed}:' || (budget // have) || ':' || coalesce(doc_id::varchar, '')) o from r join p using (l0, l1, l2) where n > 0),
s as (select *, coalesce(sum(n) over (partition by leaf order by o rows between unbounded preceding and 1 preceding), 0) before from q),
t as (select doc_id, leaf, n n_tokens, copies, (copies * n + greatest(0, least(n, want - before)))::bigint take_tokens from s)
select * from t where take_tokens > 0""")
    return "with " + ",".join(parts)
