"""Pluggable batch scorer: the plug point for an external model, as ``mapInPandas``.

``answer_fn(step, system, human)`` is called for each prompt row of an Arrow batch.  A
failure on one row, a missing usage included, is caught there and reported in ``error``
so the batch (and the task) survives; the rest of the plan stays JVM-side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    import pandas as pd


def ask(answer_fn: Callable[[str, str, str], tuple[str, int, int]], step: str, system: str,
        human: str) -> tuple[str | None, int, int, str | None]:
    """(answer, input_tokens, output_tokens, error) of one call; it never raises."""
    try:
        answer, tin, tout = answer_fn(step, system, human)
        return None if answer is None else str(answer), int(tin or 0), int(tout or 0), None
    except Exception as exc:  # one bad row must not fail the batch
        return None, 0, 0, f"{type(exc).__name__}: {str(exc)[:160]}"


def ask_many(answer_fn: Callable, prompts: list[tuple[str, str, str]],
             batched: bool = False) -> list[tuple[str | None, int, int, str | None]]:
    """``ask`` for each prompt; with ``batched`` one call takes them all.

    A batched ``answer_fn`` returns an (answer, in_tokens, out_tokens) or an exception for
    each prompt; if it raises or returns too few, the error goes to every prompt without one.
    """
    if not batched:
        return [ask(answer_fn, *p) for p in prompts]

    def given(result):
        if isinstance(result, Exception):
            raise result
        return result

    try:
        results = list(answer_fn(prompts))[:len(prompts)]
    except Exception as exc:
        results = [exc] * len(prompts)
    results += [ValueError("no answer returned")] * (len(prompts) - len(results))
    return [ask(lambda *_, r=r: given(r), *p) for r, p in zip(results, prompts)]


def score_prompts(prompts: DataFrame, answer_fn: Callable, key: str = "complaint_id", batched: bool = False) -> DataFrame:
    """Call ``answer_fn(step, system, human) -> (answer, in_tokens, out_tokens)`` per prompt row.

    With ``batched`` it is called once an Arrow batch, as in ``ask_many``.

    Returns (complaint_id, step, answer, input_tokens, output_tokens, error); the id keeps
    the type of ``key``, unreported token counts are 0.
    """
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # here, so that workers which only call ``ask`` do not hold it

        for pdf in batches:
            answers = ask_many(answer_fn, list(zip(pdf["step"], pdf["system"], pdf["human"])), batched)
            out = pd.DataFrame(answers, columns=["answer", "input_tokens", "output_tokens", "error"])
            out.insert(0, "complaint_id", pdf[key].to_numpy())
            out.insert(1, "step", pdf["step"].to_numpy())
            yield out

    return prompts.select(key, "step", "system", "human").mapInPandas(
        run, f"complaint_id {kind}, step string, answer string, input_tokens bigint, output_tokens bigint, error string")
