"""Acknowledgement text, signature enforcement and label repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions.text import ustrip


def build_response(category: Column, sentiment: Column, company: str = D.DEFAULT_COMPANY) -> Column:
    opening = F.when(sentiment.isin("angry", "frustrated"), F.lit(D.APOLOGY)).otherwise(F.lit(""))
    topic = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in D.TOPICS.items() for x in (F.lit(k), F.lit(v))]),
                                    category), F.lit(D.TOPIC_UNKNOWN))
    team = F.when(category == "fraud", F.lit(D.FRAUD_TEAM_LINE)).otherwise(F.lit(D.SUPPORT_TEAM_LINE))
    return F.concat(
        F.lit("Dear Customer,\n\n"), opening,
        F.lit(f"Thank you for contacting {company}. We have received your complaint regarding "),
        topic, F.lit(". "), team, F.lit(" " + D.RESPONSE_CLOSING + f"\n\nRegards,\n{company}"),
    )


def ensure_signature(response: Column, company: str = D.DEFAULT_COMPANY) -> Column:
    """Append the sign-off when the company name is absent (case-insensitive)."""
    return F.when(F.lower(response).contains(company.lower()), response).otherwise(
        F.concat(response, F.lit(f"\n\nRegards,\n{company}")))


def normalize_label(raw: Column, allowed: list[str]) -> Column:
    """Map free model output onto a closed domain, or NULL.

    lower/strip, keep only ``[a-z_ ]``, spaces to ``_``; exact match first, else the
    first allowed label (in domain order) contained in the token.
    """
    token = F.replace(F.regexp_replace(F.lower(ustrip(raw)), r"[^a-z_ ]", ""), F.lit(" "), F.lit("_"))
    expr = F.when(token.isin(*allowed), token)
    for label in allowed:
        expr = expr.when(token.contains(label), F.lit(label))
    return expr


def label_of(code: Column, domain: str) -> Column:
    """Code -> display label; unknown codes fall through unchanged."""
    mapping = {c: lbl for d, _, c, lbl in D.domain_rows() if d == domain}
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, code), code)
