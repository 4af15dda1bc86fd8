"""Secret scanning with an incremental blob ledger.

Every historical version of every path is content-addressed (SHA-256 of its bytes). A ledger holds one row for each pair of
blob and rule version that was scanned, with its findings, empty ones too. A run scans only pairs that the ledger lacks,
once for each blob however many paths share it, and joins the findings back to all paths and versions.

Between runs a Ledger keeps these rows as Parquet, a folder for each run, so that a run that fails leaves the others whole.

Defined cases: null content counts as empty; repeated rows give repeated rows; null paths are kept and get the findings of
their content; spans that start at the same place stand in the order of their rules; a text of any length is scanned whole, in
time n log n in its matches; an empty table gives an empty result. A path that most rows share and a content that most rows
share are dealt over tasks. Extra columns of the input are not carried, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import regex_spans, shared_path, span_text, spread_join, written
from tidemark.sources.fs import FileSystem


@dataclass(frozen=True)
class Rule:
    """A scan rule: its kind, a pattern, and SQL over the match x.m that accepts it."""

    kind: str
    pattern: str
    accept: str = "true"

    @property
    def version(self) -> str:
        """Changes with the rule, so that a changed rule is scanned anew."""
        return f"{self.kind}@{hashlib.sha256((self.pattern + chr(0) + self.accept).encode()).hexdigest()[:12]}"


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
_ASSIGN_SQL = _ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
#: The base kinds in their order of rank, then well-known public token forms. Runs shorter than the least length can't match
#: at any place of a run, so the length is part of the pattern.
RULES = (
    Rule("assign", _ASSIGN, f"length(regexp_extract(x.m, '{_ASSIGN_SQL}', 1)) >= 6"),
    Rule("access", r"AKIA[A-Z0-9]{16,}+"),
    Rule("hex", r"[0-9a-f]{24,}+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN\x20(?:[A-Z]{2,10}\x20){0,3}PRIVATE\x20KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")
FINDING = "struct<kind:string,s:int,e:int>"
LEDGER = f"blob string, rule_version string, findings array<{FINDING}>"


def empty_ledger(spark) -> DataFrame:
    return spark.sql(f"select * from values ('', '', cast(array() as array<{FINDING}>)) as t(blob, rule_version, findings) where false")


class Ledger:
    """Ledger rows that outlast a run: blob, rule_version and findings under a path of any file system that Spark writes."""

    def __init__(self, spark, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), FileSystem(spark, path)

    def runs(self) -> list[str]:
        """The folders of finished runs, oldest first."""
        return [f"{self.path}/{name}" for name in self.files.names(self.path, True) if self.files.exists(f"{self.path}/{name}/_SUCCESS")]

    def rows(self) -> DataFrame:
        found = self.runs()
        return self.spark.read.schema(LEDGER).parquet(*found) if found else empty_ledger(self.spark)

    def append(self, new: DataFrame) -> DataFrame:
        """Writes the rows as one more run and gives them as read back."""
        path = f"{self.path}/run-{len(self.files.names(self.path, True)):08d}"
        new.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(LEDGER).parquet(path)


def addressed(versions: DataFrame, path: str, content: str, version: str | None = None) -> DataFrame:
    """Columns path, version, content and blob, the content's address."""
    return versions.select(
        F.col(path).alias("path"),
        (F.col(version) if version else F.lit(0)).alias("version"),
        F.coalesce(F.col(content).cast("string"), F.lit("")).alias("content"),
    ).withColumn("blob", F.sha2("content", 256))


def unseen(blobs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """For each blob (with a holder that has its content) the rule versions that the ledger lacks; none: no row."""
    heads = blobs.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("holder"))
    every = F.array(*(F.lit(r.version) for r in rules))
    pairs = heads.withColumn("rule_version", F.explode(every))
    pairs = pairs.join(ledger.select("blob", "rule_version"), ["blob", "rule_version"], "left_anti")
    return pairs.groupBy("blob").agg(F.first("holder").alias("holder"), F.collect_set("rule_version").alias("need"))


def scan(blobs: DataFrame, todo: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows for the pairs in `todo`; the content of one holder of each blob is read, the other copies aren't."""
    heads = todo.select(F.col("blob").alias("h_blob"), F.col("holder.path").alias("h_path"), F.col("holder.version").alias("h_version"), "need")
    same = (F.col("blob") == F.col("h_blob")) & F.col("path").eqNullSafe(F.col("h_path")) & F.col("version").eqNullSafe(F.col("h_version"))
    held = blobs.join(heads, same).select("blob", "need", "content")
    names = []
    for rule in rules:
        name = f"__{rule.kind}"
        needed = F.when(F.array_contains("need", rule.version), F.col("content")).otherwise(F.lit(""))
        held = regex_spans(held.withColumn("__content", needed), "__content", rule.pattern, name, context=0)
        held = held.withColumn(name, F.expr(f"transform(filter({name}, x -> {rule.accept}), x -> named_struct('kind', '{rule.kind}', 's', x.s, 'e', x.e))"))
        names.append(F.struct(F.lit(rule.version).alias("rule_version"), F.col(name).alias("findings")))
    rows = held.select("blob", "need", F.explode(F.array(*names)).alias("r"))
    rows = rows.filter(F.array_contains("need", F.col("r.rule_version"))).select("blob", "r.rule_version", F.col("r.findings").cast(f"array<{FINDING}>").alias("findings"))
    return rows.groupBy("blob", "rule_version").agg(F.first("findings").alias("findings"))  # a repeated row holds the same


def update(versions: DataFrame, ledger: DataFrame | Ledger | None = None, path: str = "path", content: str = "content", version: str | None = "version", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of every path and version, the ledger rows that are new). Give the ledger that earlier runs left: a Ledger, to
    which the new rows are appended, or its rows, to which the caller appends them."""
    spark = versions.sparkSession
    blobs = addressed(versions, path, content, version)
    before = ledger.rows() if isinstance(ledger, Ledger) else empty_ledger(spark) if ledger is None else ledger
    found = scan(blobs, unseen(blobs, before, rules), rules)
    new = ledger.append(found) if isinstance(ledger, Ledger) else written(found, "ledger")
    current = before.unionByName(new).filter(F.col("rule_version").isin([r.version for r in rules]))
    by_blob = written(current.groupBy("blob").agg(F.flatten(F.collect_list("findings")).alias("findings")), "by-blob")
    return spread_join(blobs.select("path", "version", "blob"), by_blob, "blob"), new


def digest(found: DataFrame, key: str = "doc_id", rules=RULES) -> DataFrame:
    """The contract's columns: spans by start, then by rank of their kind."""
    rank = F.array(*(F.lit(r.kind) for r in rules))
    keyed = F.transform("findings", lambda x: F.struct(x["s"], F.array_position(rank, x["kind"]), x["e"], x["kind"]))
    ordered = F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    df = found.select(F.col("path").alias(key), ordered.alias("__all"))
    base = F.filter("__all", lambda x: x["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.filter("__all", lambda x: x["kind"] == kind)
    return df.select(
        key,
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("__all")).alias("spans"),
    )


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """A first run over `documents`, whose ledger lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(update(docs, Ledger(spark, shared_path(spark, "blob-ledger")), path="doc_id", content="text", version=None)[0])


def secret_ledger(spark, sf_dir: str) -> DataFrame:
    """A second run: the ledger has every document's first version; the history now holds both, and all findings are joined
    back. `scanned` is the number of pairs of blob and rule version that this run had to scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content"))
    later = F.concat(F.coalesce("content", F.lit("")), F.lit("\ntoken="), F.md5(F.col("path").cast("string").cast("binary")))
    both = docs.unionByName(docs.select("path", F.lit(2).alias("version"), later.alias("content")))
    ledger = Ledger(spark, shared_path(spark, "blob-ledger"))
    update(docs, ledger)
    found, new = update(both, ledger)
    scanned = new.groupBy("blob").agg(F.count(F.lit(1)).alias("scanned"))
    counts = [F.expr(f"cast(size(filter(findings, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE_KINDS]
    rows = found.join(scanned, "blob", "left")
    return rows.select(F.col("path").alias("doc_id"), "version", *counts, F.coalesce("scanned", F.lit(0)).cast("long").alias("scanned"))


def ledger_oracle() -> str:
    """DuckDB SQL of secret_ledger."""
    assign = r"""(?:(?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    return f"""
with t as (select doc_id, 1 as version, coalesce(text, '') c from documents union all
           select doc_id, 2, coalesce(text, '') || chr(10) || 'token=' || md5(doc_id::varchar) from documents)
select doc_id, version,
       len(list_filter(regexp_extract_all(c, '{assign}', 1), lambda x: len(x) >= 6))::bigint n_assign,
       len(regexp_extract_all(c, 'AKIA[A-Z0-9]{{16,}}'))::bigint n_access,
       len(regexp_extract_all(c, '[0-9a-f]{{24,}}'))::bigint n_hex,
       case when c in (select coalesce(text, '') from documents) then 0 else {len(RULES)} end::bigint scanned
from t
"""
