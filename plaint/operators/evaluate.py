"""Model back-end evaluation: run records, reply rubric, per-provider metrics, verdict.

Records carry their gold labels (every test item yields one record per provider, failed
or not), so accuracy, fraud and rubric metrics are conditional aggregations grouped by
provider — partial aggregation, no join.  The exact median latency is computed with the
distributed position operator, never by gathering a provider's latencies in one task.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions.text import NOT_WORD_AFTER, NOT_WORD_BEFORE, preview, ustrip, word_count
from plaint.operators.sequence import sequence_within
from plaint.operators.triage import repair_labels
from plaint.session import materialize

PROMISE_REGEX = "(?i)" + NOT_WORD_BEFORE + D.PROMISE_PATTERN[2:-2] + NOT_WORD_AFTER
_SECRET_VERBS, _SECRET_THINGS = (p.removeprefix("\\b").removesuffix("\\b") for p in D.SECRET_PATTERN.split(r"\b[^.\n]{0,40}\b"))
SECRET_REGEX = ("(?i)" + NOT_WORD_BEFORE + _SECRET_VERBS + NOT_WORD_AFTER + r"[^.\n]{0,40}"
                + NOT_WORD_BEFORE + _SECRET_THINGS + NOT_WORD_AFTER)
PLACEHOLDERS = ["text", "company", "cat", "priority", "sentiment"]


def prompt_char_model() -> tuple[int, Counter]:
    """Fixed characters of the four step prompts and how often each placeholder occurs."""
    const, counts = 0, Counter()
    for _, system, human in D.PROMPTS:
        for tpl in (system, human):
            for ph in PLACEHOLDERS:
                counts[ph] += tpl.count("{" + ph + "}")
                tpl = tpl.replace("{" + ph + "}", "")
            const += len(tpl)
    return const, counts


def estimate_tokens(text: Column, company: str, cat: Column, priority: Column, sentiment: Column,
                    response: Column) -> tuple[Column, Column]:
    """chars/4 of the rendered prompts and of the answers, half-even rounded."""
    const, counts = prompt_char_model()
    in_chars = (F.lit(const) + counts["text"] * F.length(text) + F.lit(counts["company"] * len(company))
                + counts["cat"] * F.length(cat) + counts["priority"] * F.length(priority)
                + counts["sentiment"] * F.length(sentiment))
    out_chars = F.length(cat) + F.length(priority) + F.length(sentiment) + F.length(response)
    return (F.bround(in_chars / F.lit(4.0), 0).cast("bigint"),
            F.bround(out_chars / F.lit(4.0), 0).cast("bigint"))


def quality_checks(response: Column, company: str, gold_category: Column,
                   words: Column | None = None) -> dict[str, Column]:
    """The 7-rule reply rubric; ``fraud_team`` is NULL (absent) unless gold is fraud.

    ``words`` may pass an already computed word count of ``response``.
    """
    low = F.lower(response)
    words = word_count(response) if words is None else words
    return {
        "length_50_60": (words >= 50) & (words <= 60),
        "investigation": low.contains("investigat"),
        "support_team": low.contains("support team") | (low.contains("support") & low.contains("team")),
        "no_promise": ~response.rlike(PROMISE_REGEX),
        "signature": F.right(F.lower(ustrip(response)), F.lit(len(company) + 20)).contains(company.lower()),
        "safe": ~response.rlike(SECRET_REGEX)
        & ~F.regexp_replace(response, "[ -]", "").rlike(r"\p{Nd}{13,19}"),
        "fraud_team": F.when(gold_category == "fraud", low.contains("fraud")),
    }


def checks_map(checks: dict[str, Column]) -> Column:
    base = F.create_map(*[x for k in D.CHECK_NAMES[:-1] for x in (F.lit(k), checks[k])])
    extra = F.create_map(F.lit("fraud_team"), checks["fraud_team"])
    return F.when(checks["fraud_team"].isNull(), base).otherwise(F.map_concat(base, extra))


def model_run_records(raw: DataFrame, company: str = D.DEFAULT_COMPANY) -> DataFrame:
    """One scored record per (provider, complaint): the raw reply is scored as returned.

    Unparseable labels are repaired with the rules (counted in ``format_repairs``);
    usage of 0/0 is replaced by the chars/4 estimate; failed calls keep their ``error_type``
    and the first 160 characters of their ``error_message``.
    """
    rep = repair_labels(raw, "text")
    ok = F.col("ok")
    response = ustrip(F.col("raw_response"))
    est_in, est_out = estimate_tokens(F.col("text"), company, F.col("category"), F.col("priority"),
                                      F.col("sentiment"), F.col("raw_response"))
    estimated = (F.col("input_tokens") == 0) & (F.col("output_tokens") == 0)
    checks = quality_checks(F.col("response"), company, F.col("g_category"), F.col("response_words"))
    error = F.concat(F.coalesce("error_type", F.lit("Error")), F.lit(": "),
                     F.substring(F.coalesce("error_message", F.lit("")), 1, 160))
    staged = rep.select(
        "provider", F.col("source_id").alias("complaint_id"), "ok", "latency_s",
        "g_category", "g_priority", "g_sentiment", "text",
        F.when(ok, F.col("category")).otherwise(F.lit("")).alias("category"),
        F.when(ok, F.col("priority")).otherwise(F.lit("")).alias("priority"),
        F.when(ok, F.col("sentiment")).otherwise(F.lit("")).alias("sentiment"),
        F.when(ok, response).otherwise(F.lit("")).alias("response"),
        F.when(ok & estimated, est_in).when(ok, F.col("input_tokens")).otherwise(F.lit(0)).cast("bigint")
        .alias("input_tokens"),
        F.when(ok & estimated, est_out).when(ok, F.col("output_tokens")).otherwise(F.lit(0)).cast("bigint")
        .alias("output_tokens"),
        (ok & estimated).alias("tokens_estimated"),
        F.when(ok, F.col("format_repairs")).otherwise(F.lit(0)).cast("int").alias("format_repairs"),
        F.when(ok, F.lit("")).otherwise(error).alias("error"),
    )
    staged = staged.withColumn("response_words", word_count(F.col("response")))
    return staged.withColumn(
        "checks", F.when(ok, checks_map(checks)).otherwise(F.create_map().cast("map<string,boolean>")))


def flat_checks(records: DataFrame) -> DataFrame:
    """Records with the rubric as one nullable boolean column per check (``chk_*``)."""
    return records.select(*[c for c in records.columns if c != "checks"],
                          *[F.col("checks").getItem(k).alias(f"chk_{k}") for k in D.CHECK_NAMES])


# ------------------------------------------------------------------------ metrics
def _ok() -> Column:
    return F.col("ok")


def correct_counts(records: DataFrame) -> DataFrame:
    """G1: per provider, correct category / priority / sentiment among successful records."""
    return records.groupBy("provider").agg(
        *[F.count_if(_ok() & (F.col(a) == F.col(f"g_{a}"))).alias(f"{a}_correct")
          for a in ("category", "priority", "sentiment")])


def triage_accuracy(records: DataFrame) -> DataFrame:
    """100 * correct labels / (3 * test-set size); failed calls count as wrong."""
    hits = sum(F.count_if(_ok() & (F.col(a) == F.col(f"g_{a}"))) for a in ("category", "priority", "sentiment"))
    return records.groupBy("provider").agg(
        (F.lit(100.0) * hits / (F.lit(3) * F.count(F.lit(1)))).alias("triage_accuracy"))


def _check_ratio() -> Column:
    vals = F.map_values(F.col("checks"))
    passed = F.aggregate(vals, F.lit(0), lambda acc, v: acc + v.cast("int"))
    return F.when(F.size(vals) > 0, passed / F.size(vals))


def quality_score(records: DataFrame) -> DataFrame:
    """Mean over successful records of each record's passed/total checks, in %."""
    return records.groupBy("provider").agg(
        F.coalesce(F.lit(100.0) * F.avg(F.when(_ok(), _check_ratio())), F.lit(0.0)).alias("quality_score"))


def check_pass_counts(records: DataFrame) -> DataFrame:
    """(provider, check, passed, relevant) over the records that have the check."""
    return (records.filter(_ok()).select("provider", F.explode("checks").alias("check", "passed"))
            .groupBy("provider", "check")
            .agg(F.count_if(F.col("passed")).alias("passed"), F.count(F.lit(1)).alias("relevant")))


def exact_median(df: DataFrame, group_cols: list[str], value: str, tiebreak: str, out_col: str) -> DataFrame:
    """Exact (interpolated) median per group from distributed positions.

    Positions and group sizes come from :func:`sequence_within`; the middle one or two
    rows are picked by position and averaged — no group is gathered in one task.
    """
    ranked = sequence_within(df.select(*group_cols, value, tiebreak), group_cols, [value, tiebreak], "_pos",
                             size_col="_cnt")
    mid = ranked.filter((F.col("_pos") == F.floor((F.col("_cnt") + 1) / 2))
                        | (F.col("_pos") == F.floor(F.col("_cnt") / 2) + 1))
    return mid.groupBy(*group_cols).agg(F.avg(value).alias(out_col))


SUMMARY_COLUMNS = ["provider", "n", "failed", "clean_outputs", "median_latency", "max_latency", "avg_words",
                   "avg_input_tokens", "avg_output_tokens", "tokens_estimated"]


def _metric_aggs() -> list[Column]:
    """Every per-provider number, as aggregate expressions over one pass of the records."""
    ok = _ok()
    hit = {a: ok & (F.col(a) == F.col(f"g_{a}")) for a in ("category", "priority", "sentiment")}
    length = F.col("checks").getItem("length_50_60")
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.col("format_repairs") == 0)).alias("clean_outputs"),
        F.coalesce(F.max(F.when(ok, F.col("latency_s"))), F.lit(0.0)).alias("max_latency"),
        F.coalesce(F.avg(F.when(ok, F.col("response_words"))), F.lit(0.0)).alias("avg_words"),
        F.coalesce(F.avg(F.when(ok, F.col("input_tokens"))), F.lit(0.0)).alias("avg_input_tokens"),
        F.coalesce(F.avg(F.when(ok, F.col("output_tokens"))), F.lit(0.0)).alias("avg_output_tokens"),
        F.coalesce(F.bool_or(F.when(ok, F.col("tokens_estimated"))), F.lit(False)).alias("tokens_estimated"),
        *[F.count_if(hit[a]).alias(f"{a}_correct") for a in hit],
        (F.lit(100.0) * (F.count_if(hit["category"]) + F.count_if(hit["priority"]) + F.count_if(hit["sentiment"]))
         / (F.lit(3) * F.count(F.lit(1)))).alias("triage_accuracy"),
        F.coalesce(F.lit(100.0) * F.avg(F.when(ok, _check_ratio())), F.lit(0.0)).alias("quality_score"),
        F.count_if(ok & length).alias("length_pass"),
        F.count_if(ok & length.isNotNull()).alias("length_relevant"),
    ]


METRIC_INPUTS = ["provider", "complaint_id", "ok", "latency_s", "format_repairs", "response_words",
                 "input_tokens", "output_tokens", "tokens_estimated", "category", "priority", "sentiment",
                 "g_category", "g_priority", "g_sentiment", "checks"]


def provider_metrics(records: DataFrame, stored: bool = False) -> DataFrame:
    """Every per-provider number of the comparison: one aggregation pass + the median.

    Unless ``records`` is already a stored table, it is evaluated once into a narrow
    checkpoint (labels, numbers, rubric map — no texts) that the aggregation and the
    median both read.
    """
    narrow = records.select(*METRIC_INPUTS)
    if not stored:
        narrow = materialize(narrow)
    base = narrow.groupBy("provider").agg(*_metric_aggs())
    med = exact_median(narrow.filter(_ok()), ["provider"], "latency_s", "complaint_id", "median_latency")
    return base.join(med, "provider", "left").withColumn(
        "median_latency", F.coalesce(F.col("median_latency"), F.lit(0.0)))


def provider_summary(records: DataFrame, stored: bool = False) -> DataFrame:
    """N, failed, clean outputs, latency median/max, mean words and tokens."""
    return provider_metrics(records, stored).select(*SUMMARY_COLUMNS)


def fraud_marked_high(records: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Fraud complaints (by gold) that the back-end marked high, and how many exist.

    Gold labels come from a table keyed by complaint_id (of any size; repeated keys are
    harmless): a semi join keeps the records of its fraud complaints.  Records that carry
    their own gold labels need none.
    """
    if gold is not None:
        frauds = gold.where(F.col("g_category") == "fraud").select("complaint_id")
        kept = records.join(frauds, "complaint_id", "left_semi").groupBy("provider").agg(
            F.count_if(_ok() & (F.col("priority") == "high")).alias("_high"), F.count(F.lit(1)).alias("_total"))
        none = F.lit(0).cast("bigint")
        return records.select("provider").distinct().join(kept, "provider", "left").select(
            "provider", F.coalesce("_high", none).alias("fraud_high"), F.coalesce("_total", none).alias("fraud_total"))
    fraud = F.col("g_category") == "fraud"
    return records.groupBy("provider").agg(
        F.count_if(_ok() & fraud & (F.col("priority") == "high")).alias("fraud_high"),
        F.count_if(fraud).alias("fraud_total"))


def injection_probe(records: DataFrame, probe_id: int) -> DataFrame:
    """The category each back-end predicted for the probe item (successful calls)."""
    return records.filter(_ok() & (F.col("complaint_id") == probe_id)).select("provider", "category")


def token_usage(records: DataFrame) -> DataFrame:
    """Tokens per provider over successful records (and how many were estimated)."""
    return records.filter(_ok()).groupBy("provider").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if(F.col("tokens_estimated")).alias("estimated_records"))


def usage_per_complaint(calls: DataFrame, keys: tuple[str, ...] = ("complaint_id",)) -> DataFrame:
    """Tokens summed over the model calls of each complaint (per-call rows, e.g. the
    scorer's output) and the number of calls."""
    return calls.groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count(F.lit(1)).alias("calls"))


def label_repairs(records: DataFrame) -> DataFrame:
    """How many successful records needed 0, 1, 2 or 3 label repairs."""
    return records.filter(_ok()).groupBy("provider", "format_repairs").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------- costs, verdict
def cost_per_1000(avg_in: Column, avg_out: Column, price_in: float = D.PRICE_IN_PER_M,
                  price_out: float = D.PRICE_OUT_PER_M) -> Column:
    """USD per 1,000 requests for a per-token priced API."""
    return (avg_in * F.lit(price_in) + avg_out * F.lit(price_out)) / F.lit(1_000_000.0) * F.lit(1000.0)


def breakeven(server_monthly: float, cost: Column) -> Column:
    """Monthly requests above which a fixed-cost server wins; +inf when the API is free."""
    return F.when(cost > 0, F.lit(server_monthly) / cost * F.lit(1000.0)).otherwise(F.lit(float("inf")))


def cost_and_breakeven(summary: DataFrame, server_monthly: float = D.SERVER_MONTHLY_USD) -> DataFrame:
    cost = cost_per_1000(F.col("avg_input_tokens"), F.col("avg_output_tokens"))
    return summary.select("provider", "avg_input_tokens", "avg_output_tokens",
                          cost.alias("cost_per_1000"), breakeven(server_monthly, cost).alias("breakeven_requests"))


COMPARISON_ROWS = [
    ("Reply quality", "category_correct"), ("Reply quality", "priority_correct"),
    ("Reply quality", "sentiment_correct"), ("Reply quality", "failed"),
    ("Reply quality", "quality_score"), ("Reply quality", "length_pass"),
    ("Reply quality", "avg_words"), ("Reply quality", "clean_outputs"),
    ("Latency", "median_latency"), ("Latency", "max_latency"),
    ("Cost", "avg_input_tokens"), ("Cost", "avg_output_tokens"), ("Cost", "cost_per_1000"),
]


def provider_comparison(records: DataFrame, hosted: str = "hosted", local: str = "local",
                        stored: bool = False) -> DataFrame:
    """(section, dimension, hosted, local) numeric comparison rows."""
    m = provider_metrics(records, stored).withColumn(
        "cost_per_1000", cost_per_1000(F.col("avg_input_tokens"), F.col("avg_output_tokens")))
    long = m.select("provider", F.inline(F.array(*[
        F.struct(F.lit(sec).alias("section"), F.lit(dim).alias("dimension"),
                 F.col(dim).cast("double").alias("value")) for sec, dim in COMPARISON_ROWS])))
    return long.groupBy("section", "dimension").agg(
        F.max(F.when(F.col("provider") == hosted, F.col("value"))).alias("hosted"),
        F.max(F.when(F.col("provider") == local, F.col("value"))).alias("local"))


def provider_verdict(records: DataFrame, hosted: str = "hosted", local: str = "local",
                     server_monthly: float = D.SERVER_MONTHLY_USD, stored: bool = False) -> DataFrame:
    """Accuracy gap band, latency ratio band, recommended tail, faster back-end."""
    m = provider_metrics(records, stored)

    def pick(col: str, who: str) -> Column:
        return F.max(F.when(F.col("provider") == who, F.col(col)))

    row = m.agg(
        pick("triage_accuracy", hosted).alias("acc_h"), pick("triage_accuracy", local).alias("acc_l"),
        pick("median_latency", hosted).alias("med_h"), pick("median_latency", local).alias("med_l"),
        pick("avg_input_tokens", hosted).alias("in_h"), pick("avg_output_tokens", hosted).alias("out_h"))
    gap = F.col("acc_h") - F.col("acc_l")
    both = (F.col("med_h") > 0) & (F.col("med_l") > 0)
    ratio = F.when(both, F.col("med_l") / F.col("med_h")).otherwise(F.lit(1.0))
    staged = row.select("*", gap.alias("accuracy_gap"), ratio.alias("latency_ratio"))
    g, r = F.col("accuracy_gap"), F.col("latency_ratio")
    cost = cost_per_1000(F.col("in_h"), F.col("out_h"))
    return staged.select(
        F.col("acc_h").alias("hosted_accuracy"), F.col("acc_l").alias("local_accuracy"),
        "accuracy_gap",
        F.when(g <= 0.5, "matched").when(g <= 5, "within").otherwise("trailed").alias("accuracy_band"),
        F.col("med_h").alias("hosted_median"), F.col("med_l").alias("local_median"), "latency_ratio",
        F.when(r >= 1.5, "slower").when(r <= 1 / 1.5, "faster").otherwise("similar").alias("speed_band"),
        F.when(g > 5, "larger_model").when(r >= 1.5, "gpu_hardware").otherwise("no_cost").alias("tail"),
        F.when(both, F.when(F.col("med_l") / F.col("med_h") >= 1, hosted).otherwise(local)).alias("faster"),
        F.when(both, F.greatest(F.col("med_l") / F.col("med_h"), F.col("med_h") / F.col("med_l")))
        .alias("speed_factor"),
        cost.alias("hosted_cost_per_1000"), breakeven(server_monthly, cost).alias("breakeven_requests"),
    )


# ------------------------------------------------------------------ side by side
def result_cell(ok: Column, category: Column, priority: Column, sentiment: Column, error: Column) -> Column:
    """``cat/prio/sent``, ``FAILED (<first 40 chars>)``, or ``n/a`` when there is no record."""
    return (F.when(ok.isNull(), F.lit("n/a"))
            .when(ok, F.concat_ws("/", category, priority, sentiment))
            .otherwise(F.concat(F.lit("FAILED ("), F.substring(error, 1, 40), F.lit(")"))))


def side_by_side(records: DataFrame, gold: DataFrame, hosted: str = "hosted", local: str = "local") -> DataFrame:
    """Gold ⟕ hosted ⟕ local as one shuffle: union the three inputs, group by id.

    ``gold``: (complaint_id, text, g_category, g_priority, g_sentiment).  The preview and
    the result cells are made before the shuffle, so no full text travels.
    """
    g = gold.select("complaint_id", F.lit(None).cast("string").alias("provider"),
                    preview(F.col("text")).alias("shown"),
                    F.concat_ws("/", "g_category", "g_priority", "g_sentiment").alias("gold"),
                    F.lit(None).cast("string").alias("cell"), F.lit(None).cast("double").alias("latency_s"))
    cell = result_cell(F.col("ok"), F.col("category"), F.col("priority"), F.col("sentiment"), F.col("error"))
    r = records.select("complaint_id", "provider", F.lit(None).cast("string").alias("shown"),
                       F.lit(None).cast("string").alias("gold"), cell.alias("cell"), "latency_s")
    is_gold = F.col("provider").isNull()

    def of(who: str, column: str) -> Column:
        return F.max(F.when(F.col("provider") == who, F.col(column)))

    agg = g.unionByName(r).groupBy("complaint_id").agg(
        F.count_if(is_gold).alias("_g"), F.max("shown").alias("complaint_preview"), F.max("gold").alias("gold"),
        *[F.coalesce(of(w, "cell"), F.lit("n/a")).alias(f"{w}_result") for w in (hosted, local)],
        *[of(w, "latency_s").alias(f"{w}_latency") for w in (hosted, local)])
    return agg.filter(F.col("_g") > 0).drop("_g")
