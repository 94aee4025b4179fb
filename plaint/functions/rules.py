"""The keyword rule engine, compiled from the lexicon rows into Column expressions.

A keyword counts once however often it occurs; overlapping keywords each count.
Short all-letter category keywords must stand as whole words, everything else is a
substring test.  The cheap ``contains`` guard in front of each whole-word regex
keeps the regex engine off rows that cannot match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE, ascii_digits

AMOUNT_REGEX = "(?iU)" + D.AMOUNT_PATTERN.replace(r"rs\b", "rs" + NOT_WORD_AFTER)


def keyword_hit(lowered: Column, row: D.LexiconRow) -> Column:
    """0/1 presence of one keyword in already-lowercased text."""
    present = lowered.contains(row.keyword)
    if row.whole_word:
        present = present & lowered.rlike(NOT_WORD_BEFORE + re.escape(row.keyword) + NOT_WORD_AFTER)
    return present


def _any(lowered: Column, rule: str) -> Column:
    return reduce(lambda a, b: a | b, [keyword_hit(lowered, r) for r in D.lexicon() if r.rule == rule])


def category_score(lowered: Column, category: str) -> Column:
    hits = [keyword_hit(lowered, r).cast("int") for r in D.lexicon()
            if r.rule == "category" and r.label == category]
    return F.lit(D.category_weight(category)) * reduce(lambda a, b: a + b, hits)


def category_from_scores(scores: dict[str, Column]) -> Column:
    """Arg-max with ties broken fraud > loan > billing > app_issue; all zero -> app_issue."""
    order = D.TIE_ORDER
    expr = F.when(F.greatest(*[scores[c] for c in order]) == 0, F.lit(D.DEFAULT_CATEGORY))
    for i, cat in enumerate(order[:-1]):
        rest = [scores[c] for c in order[i + 1:]]
        best_rest = rest[0] if len(rest) == 1 else F.greatest(*rest)
        expr = expr.when(scores[cat] >= best_rest, F.lit(cat))
    return expr.otherwise(F.lit(order[-1]))


def amount(text: Column) -> Column:
    """Largest rupee amount in the text, 0.0 when none parses.

    Each match fills group 1 (prefix form) or group 2 (suffix form).  The pairing uses
    ``zip_with``/``transform``; being interpreted, they also end the fused codegen stage
    here, which keeps the generated methods of the keyword stage small enough for the
    JIT (a variant without them fused everything into one stage and measured ~25% slower).
    """
    prefix = F.regexp_extract_all(text, F.lit(AMOUNT_REGEX), 1)
    suffix = F.regexp_extract_all(text, F.lit(AMOUNT_REGEX), 2)
    values = F.transform(
        F.zip_with(prefix, suffix, lambda x, y: F.concat(x, y)),
        lambda z: ascii_digits(F.replace(z, F.lit(","), F.lit(""))).try_cast("double"),
    )
    return F.coalesce(F.array_max(values), F.lit(0.0))


def priority(category: Column, lowered: Column, amt: Column) -> Column:
    return (
        F.when((category == "fraud") | _any(lowered, "high") | (amt >= D.HIGH_AMOUNT), F.lit("high"))
        .when(category.isin("billing", "loan") | (amt >= D.MEDIUM_AMOUNT), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def sentiment(lowered: Column) -> Column:
    return (
        F.when(_any(lowered, "angry"), F.lit("angry"))
        .when(_any(lowered, "frustrated"), F.lit("frustrated"))
        .when(_any(lowered, "positive"), F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )


def with_rule_labels(df: DataFrame, text_col: str, prefix: str = "rule_") -> DataFrame:
    """Add ``{prefix}category, {prefix}priority, {prefix}sentiment`` (and the amount).

    ``lower(text)``, the four scores and the amount are projected once; the label
    CASEs read them from the next projection.
    """
    lowered = F.lower(F.col(text_col))
    staged = df.withColumn("_lt", lowered)
    lt = F.col("_lt")
    staged = staged.select(
        "*",
        *[category_score(lt, c).alias(f"_s_{c}") for c in D.CATEGORIES],
        amount(F.col(text_col)).alias(f"{prefix}amount"),
    )
    cat = category_from_scores({c: F.col(f"_s_{c}") for c in D.CATEGORIES})
    staged = staged.withColumn(f"{prefix}category", cat)
    staged = staged.withColumn(
        f"{prefix}priority", priority(F.col(f"{prefix}category"), lt, F.col(f"{prefix}amount")))
    staged = staged.withColumn(f"{prefix}sentiment", sentiment(lt))
    return staged.drop("_lt", *[f"_s_{c}" for c in D.CATEGORIES])


def with_rule_scores(df: DataFrame, text_col: str) -> DataFrame:
    """The four weighted category scores as doubles (``score_<category>``)."""
    lt = F.lower(F.col(text_col))
    return df.select("*", *[category_score(lt, c).alias(f"score_{c}") for c in D.CATEGORIES])
