"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Candidates are regex matches of two kinds: *base* ones, which a strict pattern and its validation accept and which always
stay, and *weak* ones, of forms that the strict patterns don't take (national phone numbers, spelled-out addresses, card
numbers of 13 to 15 digits that pass Luhn, IPv6 addresses). Matches of a strict pattern that fail its validation are dropped.

On each candidate five labelers vote +1, 0 or -1: the strict format, a gazetteer, the words before it, its borders and a
placeholder check. The votes of all candidates are counted by pattern in Spark (4 kinds x 3^5 rows at most);
expectation-maximisation over that table estimates the labelers' class-conditional reliabilities and gives each pattern a soft
label. The span classifier doesn't see the votes: its features are the span's kind, length, shape and border and the word
before it (hashed). Soft labels of all candidates are summed by these features in Spark (4 x 4 x SHAPES x WORDS_BEFORE x 3
rows at most), which is all that its logistic fit on the driver needs. Weak candidates that it scores at 0.5 or more are added.

Defined cases: a null text counts as empty; an empty table gives an empty result; repeated rows and keys give repeated rows;
weak spans that overlap a base span of the same kind are dropped; spans of different kinds may overlap; a text of any length
is searched whole, in time n log n in its matches. Extra columns of the input are not carried, so their names can't clash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import regex_spans, span_text, written

KINDS = ("email", "ip", "card", "phone")

#: Strict patterns. Possessive loops and the anchors keep matching linear on long runs; they accept the same spans as
#: the plain forms: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip four dotted digit runs,
#: card [0-9]([\x20-]?[0-9])+ (of 16 digits or more: a run of fewer has no match at any place of it), phone \+[0-9][\x20().0-9-]+[0-9].
_L = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_L})){_L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms that the strict patterns do not take, and SQL over the match x.m that accepts them.
WEAK = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+.)(-])(?<!\+[0-9]\x20)(?<!\+[0-9]{2}\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
}
#: Gazetteers and cue words (fixed lists of the labelers).
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|io|de|fr|es|it|nl|uk|us|eu|ch|at|be|pl|se|no|dk|fi|pt|ca|au|jp|cn|in|br|mx|ru"
COUNTRY_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92"
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\W{0,4}(?:to|at|is|:)?\W{0,4}$",
    "ip": r"(?i)(?:\bip|address|host|server|from|addr|adresse)\W{0,4}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\W{0,4}(?:number|no|nr|:)?\W{0,4}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|telefon|t[eé]l[eé]fono?)\W{0,4}(?:at|is|no|:)?\W{0,4}$",
}
COUNTER_CUES = r"(?i)(?:version|release|isbn|issn|doi|order|invoice|ticket|build|section|figure|\bv)\W{0,3}$"
VOTES = ("v_format", "v_gazetteer", "v_context", "v_border", "v_placeholder")
EM_ROUNDS, ADD_AT = 60, 0.5
SHAPES, WORDS_BEFORE = 16, 32
FEATURES = ("kind", "size", "shape", "before", "after")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: str) -> str:
    """SQL for: the digits, doubled at every second place from the right, sum to a multiple of ten."""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (acc, i) -> acc + if(i % 2 = 0, {d}, if({d} > 4, {d} * 2 - 9, {d} * 2))) % 10 = 0"


def _valid(kind: str) -> str:
    """SQL over a struct x with the match x.m: the strict validation of the kind."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": r"x.m rlike '^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))(?:\\.|$)){4}$'",
        "card": f"length({digits}) between 16 and 19 and if(length({digits}) between 16 and 19, {_luhn(digits)}, false)",
        "phone": f"length({digits}) between 8 and 15",
    }[kind]


def _gazetteer(kind: str) -> str:
    return {
        "email": f"if(lower(x.m) rlike '[.\\\\])](?:{TOP_LEVEL})$', 1, -1)",
        "ip": r"if(x.m rlike '^(?:0|127|255|224|fe80|::)\\.', -1, if(x.m rlike '^[0-9]\\.[0-9]\\.[0-9]\\.[0-9]$', -1, 1))",
        "card": "if(x.m rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6)', 1, 0)",
        "phone": f"if(x.m rlike '^\\\\+(?:{COUNTRY_CODES})', 1, if(x.m rlike '^[(]?[2-9]', 0, -1))",
    }[kind]


def _quote(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _weak_valid(kind: str) -> str:
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    return f"{digits} rlike '^(?:3[04678]|4)' and {_luhn(digits)}" if kind == "card" else "true"


def _candidates(column: str, kind: str, weak: bool) -> Column:
    """Structs of a span, whether it is a base one, the votes on it and the classifier's features."""
    held = f"filter({column}, x -> {_weak_valid(kind) if weak else _valid(kind)})"
    tail = "x.m rlike '([0-9])\\\\1{9,}|(?:0123|1234)56789|0{8,}'"
    shape = "regexp_replace(regexp_replace(regexp_replace(x.m, '[0-9]+', '0'), '[a-z]+', 'a'), '[A-Z]+', 'A')"
    return F.expr(f"""transform({held}, x -> named_struct('kind', '{kind}', 's', x.s, 'e', x.e, 'base', {"false" if weak else "true"},
        'v_format', {0 if weak else 1}, 'v_gazetteer', {_gazetteer(kind)},
        'v_context', if(x.pre rlike '{_quote(CUES[kind])}', 1, if(x.pre rlike '{_quote(COUNTER_CUES)}', -1, 0)),
        'v_border', if(right(x.pre, 1) rlike '[A-Za-z0-9_]' or x.nxt rlike '[A-Za-z0-9_]', -1, 1),
        'v_placeholder', if({tail}, -1, 0),
        'size', cast(case when x.e - x.s < 8 then 0 when x.e - x.s < 13 then 1 when x.e - x.s < 20 then 2 else 3 end as int),
        'shape', cast(pmod(xxhash64({shape}), {SHAPES}) as int),
        'before', cast(pmod(xxhash64(lower(regexp_extract(x.pre, '([^\\\\W0-9_]+)\\\\W*$', 1))), {WORDS_BEFORE}) as int),
        'after', case when x.nxt rlike '[A-Za-z0-9_]' then 2 when x.nxt rlike '[^ ]' then 1 else 0 end))""")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and array `cand` of all candidate spans of each row, in the order of KINDS, base ones before weak ones."""
    df = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    names = []
    for kind, pattern in BASE.items():
        df = regex_spans(df, "__text", pattern, f"__{kind}").withColumn(f"__{kind}", _candidates(f"__{kind}", kind, False))
        df = regex_spans(df, "__text", WEAK[kind], f"__w{kind}").withColumn(f"__w{kind}", _candidates(f"__w{kind}", kind, True))
        df = df.withColumn(f"__w{kind}", F.expr(f"filter(__w{kind}, w -> not exists(__{kind}, b -> b.s < w.e and w.s < b.e))"))
        names += [f"__{kind}", f"__w{kind}"]
    return df.select(key, F.concat(*names).alias("cand"))


def fit_reliabilities(patterns: list[dict]) -> list[float]:
    """EM (two classes, a reliability table for each labeler) over counted vote patterns: P(true) of each pattern."""
    if not patterns:
        return []
    n = np.array([p["n"] for p in patterns], float)
    votes = np.array([[p[v] + 1 for v in VOTES] for p in patterns])
    posterior = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    for _ in range(EM_ROUNDS):
        weight = np.stack([n * (1 - posterior), n * posterior])
        prior = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        logs = np.tile(np.log(prior)[:, None], (1, len(patterns)))
        for j in range(len(VOTES)):
            # The pseudo-counts say that a labeler is right more often than not.
            table = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])
            for vote in range(3):
                table[:, vote] += weight[:, votes[:, j] == vote].sum(axis=1)
            logs += np.log(table / table.sum(axis=1, keepdims=True))[:, votes[:, j]]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))
    return posterior.tolist()


def _hot(kind: str, size: int, shape: int, before: int, after: int) -> list[int]:
    """The places of a candidate's features that are 1: bias, kind and size, kind and shape, word before, character after."""
    k = KINDS.index(kind)
    return [0, 1 + 4 * k + size, 17 + SHAPES * k + shape, 17 + 4 * SHAPES + before, 17 + 4 * SHAPES + WORDS_BEFORE + after]


_WIDTH = 20 + 4 * SHAPES + WORDS_BEFORE


def fit_classifier(groups: list[dict]) -> list[float]:
    """Weights of a ridge logistic regression, by Newton steps, over groups of equal features with n members and the sum y of
    their soft labels."""
    w = np.zeros(_WIDTH)
    if not groups:
        return w.tolist()
    x = np.zeros((len(groups), _WIDTH))
    for row, g in zip(x, groups, strict=True):
        row[_hot(*(g[f] for f in FEATURES))] = 1.0
    n = np.array([g["n"] for g in groups], float)
    y = np.array([g["y"] for g in groups], float) / n
    # Rare forms must not drown in frequent ones: a group counts by the root of its size.
    n = np.sqrt(n)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.05 * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(_WIDTH)
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return w.tolist()


def _score(weights: list[float]) -> str:
    """SQL of the classifier's score over a candidate x."""
    table = f"array({', '.join(f'{w if math.isfinite(w) else 0.0!r}D' for w in weights)})"
    k = "case x.kind " + " ".join(f"when '{kind}' then {i}" for i, kind in enumerate(KINDS)) + " end"
    at = ["0", f"1 + 4 * {k} + x.size", f"17 + {SHAPES} * {k} + x.shape", f"{17 + 4 * SHAPES} + x.before", f"{17 + 4 * SHAPES + WORDS_BEFORE} + x.after"]
    return f"1D / (1D + exp(-({' + '.join(f'get({table}, {i})' for i in at)})))"


def soft_labelled(one: DataFrame) -> list[dict]:
    """Groups of candidates of equal features: their number n and the sum y of their soft labels, from EM over all votes."""
    patterns = [r.asDict() for r in one.groupBy("kind", *VOTES).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 4 x 3^5
    patterns.sort(key=lambda p: tuple(map(str, p.values())))
    soft = fit_reliabilities(patterns)
    if not patterns:
        return []
    rows = ", ".join("('{}', {}, {!r}D)".format(p["kind"], ", ".join(str(p[v]) for v in VOTES), y) for p, y in zip(patterns, soft, strict=True))
    known = one.sparkSession.sql(f"select * from values {rows} as t(kind, {', '.join(VOTES)}, y)")
    groups = one.join(F.broadcast(known), ["kind", *VOTES]).groupBy(*FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("decimal(20,12)")).cast("double").alias("y"))
    return sorted((r.asDict() for r in groups.collect()), key=lambda g: tuple(str(g[f]) for f in FEATURES))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and `found`: array of structs kind, s, e, base, score; base spans and those that the classifier adds."""
    cand = written(candidates(docs, key, text), "pii")
    one = cand.select(F.explode("cand").alias("x")).select("x.kind", *(f"x.{v}" for v in VOTES), *(f"x.{f}" for f in FEATURES[1:]))
    weights = fit_classifier(soft_labelled(one))
    scored = F.expr(f"transform(cand, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'base', x.base, 'score', {_score(weights)}))")
    return cand.select(key, F.filter(scored, lambda x: x["base"] | (x["score"] >= ADD_AT)).alias("found"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns: counts of base spans, their digest, and all spans."""
    base = F.filter("found", lambda x: x["base"])
    by_kind = lambda spans, kind: F.filter(spans, lambda x: x["kind"] == kind)
    # Base and weak spans of a kind come from two lists, so a kind's spans are put in order of their start.
    start_first = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["e"], x["kind"]))), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return found.select(
        key,
        *(F.size(by_kind(base, k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(span_text(F.concat(*(by_kind(base, k) for k in KINDS))), 256).alias("base_sha256"),
        span_text(F.concat(*(start_first(by_kind(F.col("found"), k)) for k in KINDS))).alias("spans"),
    )


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return digest(detect(spark.read.parquet(f"{sf_dir}/documents.parquet")))
