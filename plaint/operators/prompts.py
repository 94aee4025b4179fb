"""Prompt materialisation: one row per (complaint, step) with the system and human text.

User text only ever goes into ``human``; the system text is fixed per step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint import domains as D

STAGE1 = ["category", "sentiment"]        # need only the complaint text
STAGE2 = ["priority", "response"]         # need the category (and, for the reply, all three)


def render(template: str, values: dict[str, Column | str]) -> Column:
    """Fill ``{name}`` placeholders with Columns/strings; the rest is literal."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        if head:
            parts.append(F.lit(head))
        v = values[name]
        parts.append(F.lit(v) if isinstance(v, str) else v)
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts) if parts else F.lit("")


def step_prompt(step: str, values: dict[str, Column | str]) -> tuple[Column, Column]:
    """The system and human text of one step."""
    system, human = next((s, h) for name, s, h in D.PROMPTS if name == step)
    return render(system, values), render(human, values)


def prompts(df: DataFrame, steps: list[str], key: str = "complaint_id", text: str = "complaint",
            company: str = D.DEFAULT_COMPANY) -> DataFrame:
    """(key, step, system, human) for the given steps; a fixed-size fan-out per row."""
    values = {"text": F.col(text), "company": company}
    for name, col in (("cat", "category"), ("priority", "priority"), ("sentiment", "sentiment")):
        if col in df.columns:
            values[name] = F.col(col)
    rows = [F.struct(F.lit(step).alias("step"), render(system, values).alias("system"),
                     render(human, values).alias("human"))
            for step, system, human in D.PROMPTS if step in steps]
    return df.select(F.col(key), F.inline(F.array(*rows)))


def insights_prompt(stats: DataFrame) -> DataFrame:
    """The management-summary prompt from the one-row statistics text."""
    system, human = D.INSIGHTS_PROMPT
    return stats.select(F.lit(system).alias("system"), render(human, {"stats": F.col("stats")}).alias("human"))
