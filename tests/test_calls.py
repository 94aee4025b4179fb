"""The call log: nothing is asked twice after a task dies, failures are asked again, steps fold to one row."""

import os
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plaint.operators import calls as CL
from plaint.operators.evaluate import usage_per_complaint
from plaint.operators.model_pipeline import model_triage
from plaint.operators.prompts import prompts
from plaint.operators.scorer import ask_many, score_prompts

TEXTS = ["My EMI was deducted twice", "Someone hacked my account!!!", "The app crashes", "I was charged Rs. 30,000", "hello there all"]


def _complaints(spark, n=30):
    return spark.createDataFrame([(i, f"{TEXTS[i % 5]} case {i}") for i in range(n)], "complaint_id bigint, complaint string").repartition(3)


def _model(folder, die_at=None, fail=()):
    """Answers, leaving a line for each call; ends its worker once before it answers ``die_at``, fails on ``fail`` once."""
    def answer(step, system, human):
        case = human.rpartition("case ")[2].split()[0].strip('"')
        once = f"{folder}/once-{step}-{case}"
        if (step, case) == die_at and not os.path.exists(once):
            open(once, "w").close()
            os._exit(1)
        if (step, case) in fail and not os.path.exists(once):
            open(once, "w").close()
            raise TimeoutError("no answer")
        with open(f"{folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(f"{step} {case}")
        return {"category": "fraud", "priority": "??", "sentiment": "Angry.", "response": "We look into it."}[step], 10, 2
    return answer


def _made(folder):
    return Counter(open(f"{folder}/{f}").read() for f in os.listdir(folder) if f.startswith("call-"))


def test_no_call_is_repeated_after_a_task_dies_half_way(spark, tmpdir_path):
    folder, log = f"{tmpdir_path}/calls", f"{tmpdir_path}/log"
    os.makedirs(folder)
    answer = _model(folder, die_at=("category", "29"))
    asked = prompts(_complaints(spark), ["category"])
    with pytest.raises(Exception):
        CL.ask_missing(asked, answer, log, "r1", buckets=2)
    half = _made(folder)
    assert 0 < len(half) < 30
    done, failed = CL.ask_missing(asked, answer, log, "r1", buckets=2)
    assert (done, failed) == (30 - len(half), 0)
    assert _made(folder) == {f"category {i}": 1 for i in range(30)}
    assert CL.ask_missing(asked, answer, log, "r1") == (0, 0)
    rows = CL.read_calls(spark, log, "r1")
    assert rows.count() == 30 and rows.where("error is null and attempt = 1").count() == 30
    CL.compact_calls(spark, log, "r1")
    assert CL.newest_calls(CL.read_calls(spark, log, "r1")).count() == 30
    # another run of the same prompts asks anew
    assert CL.ask_missing(asked, answer, log, "r2", block=7) == (30, 0)


def test_a_task_tried_again_reads_its_own_pass(tmpdir_path):
    import pandas as pd
    os.makedirs(f"{tmpdir_path}/calls")
    rows = pd.DataFrame([(str(i), "category", "s", f"case {i}", 1, i % 2) for i in [0, 2, 4, 2, 1, 3, 3]],
                        columns=["complaint_id", "step", "system", "human", "attempt", "bucket"])
    answer = _model(f"{tmpdir_path}/calls")
    first = list(CL._ask_rows(iter([rows.iloc[:3]]), answer, f"{tmpdir_path}/log", "run=a/pass=b", 2, False))
    again = list(CL._ask_rows(iter([rows]), answer, f"{tmpdir_path}/log", "run=a/pass=b", 2, False))
    assert first[0].asked.sum() == 3 and again[0].asked.sum() == 2
    assert _made(f"{tmpdir_path}/calls") == {f"category {i}": 1 for i in range(5)}


def test_resumed_triage_equals_the_narrow_path(spark, tmpdir_path):
    folder, log = f"{tmpdir_path}/calls", f"{tmpdir_path}/log"
    os.makedirs(folder)
    answer = _model(folder, fail={("category", "3"), ("priority", "4"), ("response", "5")})
    complaints = _complaints(spark)
    names = ["complaint_id", "category", "priority", "sentiment", "response", "mode", "format_repairs"]
    first = CL.resumable_triage(complaints, answer, log, "run/1", buckets=3)
    assert {r.complaint_id for r in first.where("mode = 'offline'").collect()} == {3, 4, 5}
    second = CL.resumable_triage(complaints, answer, log, "run/1", buckets=3)
    want = model_triage(complaints, _model(folder)).select(names)
    assert sorted(second.select(names).collect()) == sorted(want.collect())
    made = _made(folder)
    assert all(made[f"{s} {i}"] == 2 for s in CL.STEPS for i in range(30))  # once logged, once by the narrow path
    folded = {r.complaint_id: r for r in CL.fold_steps(CL.read_calls(spark, log, "run_1")).collect()}
    assert folded["4"].calls == 5 and folded["4"].error is None and folded["0"].calls == 4
    usage = {r.complaint_id: tuple(r)[1:] for r in usage_per_complaint(CL.read_calls(spark, log, "run_1")).collect()}
    assert usage["4"] == (40, 8, 5) and usage["0"] == (40, 8, 4)


def test_fold_takes_the_newest_attempt(spark):
    rows = [("a", "category", 1, "loan", 1, 1, None), ("a", "category", 2, "fraud", 1, 1, None), ("a", "priority", 1, "low", 1, 1, None),
            ("a", "priority", 3, None, 1, 0, "E: late"), ("a", "sentiment", 1, None, 1, 1, None), ("a", "response", 1, "r", 1, 1, None),
            ("b", "category", 1, "loan", 1, 1, None), ("b", "category", 1, None, 0, 0, "E: twice"), ("c", "other", 1, "x", None, 1, None)]
    calls = spark.createDataFrame(rows, "complaint_id string, step string, attempt int, answer string, input_tokens long, output_tokens long, error string")
    got = {r.complaint_id: r for r in CL.fold_steps(calls).collect()}
    assert (got["a"].raw_category, got["a"].raw_priority, got["a"].call_ok, got["a"].error, got["a"].calls) == ("fraud", None, False, "E: late", 6)
    assert (got["b"].raw_category, got["b"].call_ok, got["b"].error) == ("loan", False, None)
    assert (got["c"].call_ok, got["c"].calls, got["c"].input_tokens) == (False, 1, None)
    assert CL.fold_steps(calls.limit(0)).count() == 0


def test_batched_answers(spark):
    def many(items):
        return [ValueError("bad") if "case 2" in h else (f"{s}!", 1, None) for s, _, h in items][: 4 if len(items) > 4 else None]

    prompts_ = [("category", "s", f"case {i}") for i in range(6)]
    got = ask_many(many, prompts_, batched=True)
    assert [g[3] for g in got] == [None, None, "ValueError: bad", None, "ValueError: no answer returned", "ValueError: no answer returned"]
    assert got[0] == ("category!", 1, 0, None)
    assert [g[3] for g in ask_many(lambda items: 1 / 0, prompts_, batched=True)] == ["ZeroDivisionError: division by zero"] * 6
    rows = score_prompts(prompts(_complaints(spark, 4), ["category"]), lambda items: [("loan", 1, 1)] * len(items), batched=True)
    assert sorted(r.complaint_id for r in rows.where("answer = 'loan' and error is null").collect()) == [0, 1, 2, 3]
    assert rows.select(F.sum("input_tokens")).first()[0] == 4
