"""Lexicons of any size as data: the keywords of a text from one pass over it.

All keywords become one alternation that shares their common beginnings, so the time for a text
does not grow with the number of keywords as it does with one test a keyword.  A look-ahead
finds the longest keyword at each position; the shorter ones that it begins with are known
from the lexicon alone.  The fixed rules of :mod:`plaint.functions.rules` are small and keep their own tests.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint.domains import LexiconRow
from plaint.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE


def _is_word(c: str) -> bool:
    return c == "_" or unicodedata.category(c)[0] in "LN"


def alternation(keywords: Sequence[str], after: str = "") -> str:
    """A pattern for the longest of ``keywords`` at a position; ``after`` must hold behind it."""
    tree: dict = {}
    for k in keywords:
        node = tree
        for c in k:
            node = node.setdefault(c, {})
        node[""] = True

    def pattern(node: dict) -> str:
        branches = [re.escape(c) + pattern(below) for c, below in sorted(node.items()) if c]
        if "" in node:
            branches.append(after)
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    return pattern(tree)


def _found(lowered: Column, rows: list[tuple[int, str]], whole: bool) -> Column:
    """Positions in the lexicon of the rows whose keywords stand in the text, as whole words or anywhere."""
    keywords = sorted({k for _, k in rows})
    pattern = alternation(keywords, NOT_WORD_AFTER if whole else "")
    longest = F.regexp_extract_all(lowered, F.lit(f"{NOT_WORD_BEFORE if whole else ''}(?=({pattern}))"), F.lit(1))
    begun = [[i for i, short in rows if k.startswith(short) and (not whole or k == short or not _is_word(k[len(short)]))] for k in keywords]
    meant = F.map_from_arrays(F.array(*map(F.lit, keywords)), F.array(*[F.array(*map(F.lit, b)) for b in begun]))
    return F.flatten(F.transform(F.array_distinct(longest), lambda k: F.element_at(meant, k)))


def keyword_hits(lowered: Column, lexicon: Sequence[LexiconRow]) -> Column:
    """Array of the positions in ``lexicon`` whose keywords the lower-cased text holds, each once, in order.

    Overlapping keywords all count.  Null and empty texts, and texts under an empty lexicon, hold none.
    Keywords are lower case; an empty one is refused.
    """
    if any(not r.keyword for r in lexicon):
        raise ValueError("a keyword is empty")
    kinds = [[(i, r.keyword) for i, r in enumerate(lexicon) if r.whole_word == whole] for whole in (True, False)]
    parts = [_found(lowered, rows, whole) for rows, whole in zip(kinds, (True, False)) if rows]
    none = F.array().cast("array<int>")
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(none, *parts))), none)


def keyword_report(df: DataFrame, text_col: str, lexicon: Sequence[LexiconRow]) -> DataFrame:
    """(rule, label, keyword, complaints): the texts that hold each keyword, 0 included.

    One pass over the texts and an aggregation of at most one row a keyword and task.
    """
    counted = (df.select(F.explode(keyword_hits(F.lower(F.col(text_col)), lexicon)).alias("_at"))
               .groupBy("_at").agg(F.count("*").alias("complaints")))
    rows = df.sparkSession.createDataFrame([(i, r.rule, r.label, r.keyword) for i, r in enumerate(lexicon)],
                                           "_at int, rule string, label string, keyword string")
    return rows.join(counted, "_at", "left").select(
        "rule", "label", "keyword", F.coalesce("complaints", F.lit(0).cast("long")).alias("complaints"))
