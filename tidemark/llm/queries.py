"""The registered queries of the corpus operators, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import op1_pii, op2_secrets, op3_quality, op4_ngram, op5_mixing, op6_html, op7_simhash, op8_decontaminate, op9_media, op10_sharding

QUERIES = {
    "op1_pii": op1_pii.op1_pii,
    "op2_secrets": op2_secrets.op2_secrets,
    "op3_quality": op3_quality.op3_quality,
    "op4_ngram": op4_ngram.op4_ngram,
    "op5_mixing": op5_mixing.op5_mixing,
    "op6_html": op6_html.op6_html,
    "op7_simhash": op7_simhash.op7_simhash,
    "op8_decontaminate": op8_decontaminate.op8_decontaminate,
    "op9_media": op9_media.op9_media,
    "op10_sharding": op10_sharding.op10_sharding,
    # The same operators where op2 and op10 at their production parameters don't reach: a second run, many splits.
    "secret_ledger": op2_secrets.secret_ledger,
    "sharding_splits": op10_sharding.sharding_splits,
}

ORACLE_SQL = {
    "op5_mixing": op5_mixing.oracle(),
    "op8_decontaminate": op8_decontaminate.oracle(),
    "op10_sharding": op10_sharding.oracle(),
    "secret_ledger": op2_secrets.ledger_oracle(),
    "sharding_splits": op10_sharding.oracle(op10_sharding.SMALL_LIMIT),
}
