"""A durable log of model calls, and a model run that resumes after a loss.

Answers are written by the task that got them, a few at a time, before it asks on, so a
killed task, a lost executor or a stopped job loses no answer that a block had written:

* ``<path>/run=<run>/pass=<id>/bucket=<k>/<uuid>.json`` holds one line a call.  A file is
  renamed to its name when it is complete; readers do not see unfinished ones.
* ``ask_missing`` asks the prompts that have no answer in the log (an anti-join), dealt into
  buckets by key.  A task that is tried again reads what its buckets already wrote in this
  pass, so it asks only the rest; the next pass does the same through the log.  What can be
  asked twice is one block: answered, but not yet written when its task died.
* Failed calls are logged with their error and asked again by the next pass; the newest
  attempt of a (run, complaint, step) counts.
* ``fold_steps`` turns (complaint, step) rows into the one row that ``triage_with_model`` takes.

The path must be one that Python workers can open through Arrow (file, hdfs, s3, gs), shared
by all executors.  Speculative execution would ask twice; keep it off for such jobs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions.respond import normalize_label
from plaint.operators.prompts import prompts
from plaint.operators.scorer import ask_many
from plaint.operators.triage import rule_triage, triage_with_model

LOG = ("complaint_id string, step string, attempt int, answer string, input_tokens bigint, output_tokens bigint, "
       "error string, run string, pass string, bucket int")
STEPS = ["category", "priority", "sentiment", "response"]


def read_calls(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Every logged call (of ``run``); none where nothing was logged."""
    try:
        calls = spark.read.schema(LOG).json(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        calls = spark.createDataFrame([], LOG)
    return calls if run is None else calls.where(F.col("run") == run)


def newest_calls(calls: DataFrame, keys: tuple[str, ...] = ("run", "complaint_id")) -> DataFrame:
    """The last attempt of each (run, complaint, step); an answer goes before an error of the same attempt."""
    values = F.struct("answer", "input_tokens", "output_tokens", "error")
    order = F.struct("attempt", F.col("error").isNull().alias("fine"), "answer", "error")
    return calls.groupBy(*keys, "step").agg(F.max_by(values, order).alias("_v"), F.max("attempt").alias("attempt")).select(
        *keys, "step", "attempt", "_v.*")


class _Bucket:
    """The calls that this pass has logged for one bucket."""

    def __init__(self, path: str, name: str):
        self.files, root = fs.FileSystem.from_uri(path)
        self.folder = f"{root.rstrip('/')}/{name}"
        self.files.create_dir(self.folder)
        self.asked = set()
        for info in self.files.get_file_info(fs.FileSelector(self.folder)):
            if info.base_name.endswith(".json"):
                with self.files.open_input_stream(info.path) as f:
                    self.asked.update((r["complaint_id"], r["step"]) for r in map(json.loads, f.read().decode().splitlines()))

    def write(self, rows: list[dict]) -> None:
        name = uuid.uuid4().hex
        with self.files.open_output_stream(f"{self.folder}/.{name}") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.files.move(f"{self.folder}/.{name}", f"{self.folder}/{name}.json")
        self.asked.update((r["complaint_id"], r["step"]) for r in rows)


def _ask_rows(batches: Iterator[pd.DataFrame], answer_fn: Callable, path: str, folder: str, block: int,
              batched: bool) -> Iterator[pd.DataFrame]:
    bucket, number = None, None
    for batch in batches:
        tally: dict[int, list[int]] = {}
        rows, keys = [], set()

        def flush() -> None:
            if rows:
                answers = ask_many(answer_fn, [(r.step, r.system, r.human) for r in rows], batched)
                bucket.write([
                    {"complaint_id": r.complaint_id, "step": r.step, "attempt": int(r.attempt), "answer": a,
                     "input_tokens": tin, "output_tokens": tout, "error": err}
                    for r, (a, tin, tout, err) in zip(rows, answers)])
                count = tally.setdefault(number, [0, 0])
                count[0] += len(rows)
                count[1] += sum(err is not None for *_, err in answers)
                rows.clear()
                keys.clear()

        for r in batch.itertuples(index=False):
            if r.bucket != number:
                flush()
                bucket, number = _Bucket(path, f"{folder}/bucket={r.bucket}"), r.bucket
            key = r.complaint_id, r.step
            if key not in bucket.asked and key not in keys:
                rows.append(r)
                keys.add(key)
                if len(rows) >= block:
                    flush()
        flush()
        yield pd.DataFrame([(b, *n) for b, n in tally.items()], columns=["bucket", "asked", "failed"])


def ask_missing(asked: DataFrame, answer_fn: Callable, path: str, run: str, key: str = "complaint_id",
                buckets: int = 64, block: int = 1, batched: bool = False) -> tuple[int, int]:
    """Asks the prompts (key, step, system, human) that ``run`` has no answer to; (calls, failures) of this pass.

    ``answer_fn(step, system, human) -> (answer, in_tokens, out_tokens)``; with ``batched`` it
    takes up to ``block`` such triples in a list and returns as many answers or exceptions.
    ``block`` answers are written together: a larger one makes fewer files and puts more at
    stake.  A prompt that is repeated is asked once; one with a null key or text is not asked.
    """
    spark = asked.sparkSession
    name = run.replace("/", "_")
    known = read_calls(spark, path, name).groupBy("complaint_id", "step").agg(
        F.max("attempt").alias("_tried"), F.bool_or(F.col("error").isNull()).alias("_answered"))
    rows = asked.select(F.col(key).cast("string").alias("complaint_id"), "step", "system", "human")
    rows = rows.where("complaint_id is not null and human is not null").join(known, ["complaint_id", "step"], "left")
    missing = rows.where("not coalesce(_answered, false)").select(
        "complaint_id", "step", "system", "human", (F.coalesce("_tried", F.lit(0)) + 1).alias("attempt"),
        F.pmod(F.xxhash64("complaint_id", "step"), F.lit(buckets)).cast("int").alias("bucket"))
    folder = f"run={name}/pass={uuid.uuid4().hex}"
    done = (missing.repartition(buckets, "bucket").sortWithinPartitions("bucket", "complaint_id", "step")
            .mapInPandas(lambda it: _ask_rows(it, answer_fn, path, folder, block, batched), "bucket int, asked bigint, failed bigint"))
    total = done.agg(F.sum("asked"), F.sum("failed")).first()
    return total[0] or 0, total[1] or 0


def compact_calls(spark: SparkSession, path: str, run: str) -> None:
    """Writes the newest calls of ``run`` as one pass of few files, for reading; older passes stay until removed by the owner."""
    name = run.replace("/", "_")
    newest = newest_calls(read_calls(spark, path, name)).select(
        "complaint_id", "step", "attempt", "answer", "input_tokens", "output_tokens", "error")
    newest.write.mode("overwrite").json(f"{path.rstrip('/')}/run={name}/pass=compacted-{uuid.uuid4().hex}/bucket=0")


def fold_steps(calls: DataFrame, keys: tuple[str, ...] = ("complaint_id",)) -> DataFrame:
    """One row for each complaint from its (step, attempt) rows: the newest answer of each step.

    Adds call_ok (all four steps have an answer), raw_category, raw_priority, raw_sentiment,
    raw_response, input_tokens and output_tokens over all attempts, calls, and the first
    failed step's error.  Steps of other names only count as calls.  One aggregation with
    partial sums, so a complaint of very many attempts is no hot key.
    """
    order = F.struct("attempt", F.col("error").isNull().alias("fine"), "answer", "error")

    def newest(step: str):
        at = F.col("step") == step
        return F.max_by(F.when(at, F.struct("answer", "error")), F.when(at, order)).alias(f"_{step}")

    folded = calls.groupBy(*keys).agg(
        *[newest(s) for s in STEPS], F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"))
    fine = [F.col(f"_{s}").isNotNull() & F.col(f"_{s}.error").isNull() for s in STEPS]
    ok = fine[0] & fine[1] & fine[2] & fine[3]
    return folded.select(
        *keys, ok.alias("call_ok"), *[F.col(f"_{s}.answer").alias(f"raw_{s}") for s in STEPS],
        "input_tokens", "output_tokens", "calls", F.coalesce(*[F.col(f"_{s}.error") for s in STEPS]).alias("error"))


def resumable_triage(complaints: DataFrame, answer_fn: Callable, path: str, run: str, key: str = "complaint_id",
                     text_col: str = "complaint", company: str = D.DEFAULT_COMPANY, **asking) -> DataFrame:
    """``triage_with_model`` over a run whose calls are logged at ``path``; start it again to resume.

    Category first, then priority (from the repaired category) and sentiment, then the reply
    (from all three).  A complaint whose call fails is asked no further in this pass.
    ``asking`` goes to ``ask_missing``.
    """
    spark, name = complaints.sparkSession, run.replace("/", "_")
    kind = complaints.schema[key].dataType
    ruled = rule_triage(complaints, text_col, company)

    def answered(*steps: str) -> DataFrame:
        """The complaints whose ``steps`` are answered, with their repaired labels."""
        newest = newest_calls(read_calls(spark, path, name)).where("error is null")
        wide = newest.groupBy(F.col("complaint_id").cast(kind).alias(key)).agg(
            *[F.max(F.when(F.col("step") == s, F.struct("answer"))).alias(f"_{s}") for s in steps])
        wide = wide.where(" and ".join(f"_{s} is not null" for s in steps))
        labels = {"category": D.CATEGORIES, "priority": D.PRIORITIES, "sentiment": D.SENTIMENTS}
        both = ruled.join(wide, key)
        category = F.coalesce(normalize_label(F.col("_category.answer"), D.CATEGORIES), F.col("category"))
        if "priority" not in steps:
            return both.select(key, text_col, category.alias("category"))
        # Where the category differs from the rules', so may their priority: the same repair as in the result.
        raw = wide.select(key, F.lit(True).alias("call_ok"), *[F.col(f"_{s}.answer").alias(f"raw_{s}") for s in labels],
                          F.lit("").alias("raw_response"))
        return triage_with_model(complaints.join(wide.select(key), key, "left_semi"), raw, key, text_col, company)

    ask_missing(prompts(complaints, ["category"], key, text_col, company), answer_fn, path, run, key, **asking)
    ask_missing(prompts(answered("category"), ["priority", "sentiment"], key, text_col, company), answer_fn, path, run, key, **asking)
    ask_missing(prompts(answered("category", "priority", "sentiment"), ["response"], key, text_col, company),
                answer_fn, path, run, key, **asking)
    outputs = fold_steps(read_calls(spark, path, name)).withColumn("complaint_id", F.col("complaint_id").cast(kind))
    return triage_with_model(complaints, outputs.withColumnRenamed("complaint_id", key).select(
        key, "call_ok", *[f"raw_{s}" for s in STEPS]), key, text_col, company)
