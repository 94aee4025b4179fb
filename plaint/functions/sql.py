"""The rule functions for SQL users: temporary SQL functions, inlined by Catalyst (no Python).

    register(spark)
    spark.sql("SELECT complaint_category(text), complaint_amount(text) FROM ...")

The bodies are written from the same lexicon and patterns as the Columns of the library.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from plaint import domains as D
from plaint.functions import rules
from plaint.functions import text as X


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hit(row: D.LexiconRow) -> str:
    hit = f"contains(t, {literal(row.keyword)})"
    if row.whole_word:
        hit += f" AND t RLIKE {literal(X.NOT_WORD_BEFORE + re.escape(row.keyword) + X.NOT_WORD_AFTER)}"
    return f"({hit})"


def _any(rule: str) -> str:
    return "(" + " OR ".join(_hit(r) for r in D.lexicon() if r.rule == rule) + ")"


def _category() -> str:
    """The best (score, place in a tie, label) of one array; no score at all gives the default."""
    scored = []
    for place, label in enumerate(reversed(D.TIE_ORDER)):
        hits = " + ".join(f"CAST({_hit(r)} AS INT)" for r in D.lexicon() if r.rule == "category" and r.label == label)
        scored.append(f"struct({D.category_weight(label)}D * ({hits}) AS score, {place} AS place, {literal(label)} AS label)")
    best = f"array(array_max(array({', '.join(scored)})))"
    return f"transform({best}, b -> if(b.score = 0, {literal(D.DEFAULT_CATEGORY)}, b.label))[0]"


def _amount() -> str:
    found = [f"regexp_extract_all(t, {literal(rules.AMOUNT_REGEX)}, {i})" for i in (1, 2)]
    digits = f"translate(replace(z, ',', ''), {literal(X.DIGITS)}, {literal(X.DIGIT_VALUES)})"
    return f"coalesce(array_max(transform(zip_with({found[0]}, {found[1]}, (x, y) -> concat(x, y)), z -> try_cast({digits} AS DOUBLE))), 0D)"


#: name, parameters, type, body; a body may use the functions before it.
FUNCTIONS = [
    ("complaint_clean", "t STRING", "STRING", f"regexp_replace(trim(BOTH {literal(D.WHITESPACE)} FROM t), '[ \\\\t]+', ' ')"),
    ("complaint_mask", "t STRING", "STRING", f"regexp_replace(t, {literal(X.CARD_PATTERN)}, {literal(X.CARD_REPLACEMENT)})"),
    ("complaint_amount", "t STRING", "DOUBLE", _amount()),
    ("complaint_lowered_category", "t STRING", "STRING", _category()),
    ("complaint_category", "t STRING", "STRING", "complaint_lowered_category(lower(t))"),
    ("complaint_lowered_priority", "category STRING, t STRING, amount DOUBLE", "STRING",
     f"CASE WHEN category = 'fraud' OR {_any('high')} OR amount >= {D.HIGH_AMOUNT} THEN 'high' "
     f"WHEN category IN ('billing', 'loan') OR amount >= {D.MEDIUM_AMOUNT} THEN 'medium' ELSE 'low' END"),
    ("complaint_priority", "category STRING, t STRING", "STRING", "complaint_lowered_priority(category, lower(t), complaint_amount(t))"),
    ("complaint_lowered_sentiment", "t STRING", "STRING",
     f"CASE WHEN {_any('angry')} THEN 'angry' WHEN {_any('frustrated')} THEN 'frustrated' "
     f"WHEN {_any('positive')} THEN 'positive' ELSE 'neutral' END"),
    ("complaint_sentiment", "t STRING", "STRING", "complaint_lowered_sentiment(lower(t))"),
]


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session (again, if they exist); returns their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
