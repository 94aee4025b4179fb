"""Registered queries: ``name -> (spark_fn(spark, sf_dir) -> DataFrame, duckdb_sql | None)``.

Every query reads the driver's tables (or views Spark derives from them) in full.
Averages of ratios are rounded to 9 decimals in both engines, because summation order
differs between them; everything else is compared exactly.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions import lexicon as LX
from plaint.functions import rules
from plaint.functions import sql as SF
from plaint.functions.respond import build_response, ensure_signature, label_of, normalize_label
from plaint.functions.text import clean_text, display_time, mask_cards, preview, ustrip, word_count
from plaint.functions.validate import validate
from plaint.operators import analytics as A
from plaint.operators import calls as CL
from plaint.operators import evaluate as EV
from plaint.operators import export as X
from plaint.operators import prompts as PR
from plaint.operators import search_index as SX
from plaint.operators import store as ST
from plaint.operators.model_pipeline import model_triage
from plaint.operators.triage import triage_with_model
from plaint.plans import oracle as O
from plaint.plans import views as V
from plaint.plans.stand_in import stand_in
from plaint.session import checkpoint_dir
from plaint.sources import fixtures as FX
from plaint.sources.tables import spread, table
from plaint.sources.tolerant import read_complaints

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None, extra_ctes: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, O.with_ctes(sql, extra_ctes) if sql is not None else None)
        return fn
    return deco


def _docs(spark, d):
    return spread(table(spark, d, "documents"))


def _records(spark, d):
    """Evaluation reports read the stored, scored run records (see ``views.model_runs_store``)."""
    return V.model_runs_store(spark, d)


def _records_raw(spark, d):
    return EV.model_run_records(FX.model_runs_raw(spark, d))


CHK = ", ".join(f"chk_{k}" for k in D.CHECK_NAMES)

# ============================================================== text and validation
@query("mask_cards", f"SELECT doc_id, {O.mask('text')} AS masked FROM documents")
def q_mask_cards(spark, d):
    return _docs(spark, d).select("doc_id", mask_cards(F.col("text")).alias("masked"))


# The same texts with the digits of another script: masking and amounts do not depend on the script.
DEVANAGARI = "०१२३४५६७८९"


def _other_digits(c):
    return F.translate(c, "0123456789", DEVANAGARI)


@query("mask_cards_other_digits",
       f"SELECT doc_id, translate({O.mask('text')}, '0123456789', '{DEVANAGARI}') AS masked FROM documents")
def q_mask_cards_other_digits(spark, d):
    return _docs(spark, d).select("doc_id", mask_cards(_other_digits(F.col("text"))).alias("masked"))


@query("sql_functions", f"""
SELECT doc_id, {O.clean('text')} AS cleaned, {O.mask('text')} AS masked, {O.amount('text')} AS amount,
  {O.category('lower(text)')} AS category, {O.sentiment('lower(text)')} AS sentiment,
  {O.priority(O.category('lower(text)'), 'lower(text)', O.amount('text'))} AS priority FROM documents""")
def q_sql_functions(spark, d):
    SF.register(spark)
    return spark.sql("""
        SELECT doc_id, complaint_clean(text) AS cleaned, complaint_mask(text) AS masked, complaint_amount(text) AS amount,
          complaint_category(text) AS category, complaint_sentiment(text) AS sentiment,
          complaint_priority(complaint_category(text), text) AS priority
        FROM {documents}""", documents=_docs(spark, d))


@query("clean_text", f"SELECT doc_id, {O.clean('text')} AS cleaned FROM documents")
def q_clean_text(spark, d):
    return _docs(spark, d).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


def _validated_sql(src: str, key: str, text: str) -> str:
    return (f"SELECT {key}, code IS NULL AS ok, code AS error_code, {O.error_msg('code', 'c0')} AS error, "
            f"CASE WHEN code IS NULL THEN {O.mask('c0')} ELSE '' END AS cleaned "
            f"FROM (SELECT {key}, c0, {O.error_code(text, 'c0')} AS code "
            f"FROM (SELECT {key}, {text}, {O.clean(text)} AS c0 FROM {src}))")


@query("validate_documents", _validated_sql("documents", "doc_id", "text"))
def q_validate_documents(spark, d):
    return validate(_docs(spark, d), "text").select("doc_id", "ok", "error_code", "error", "cleaned")


@query("validate_complaints", _validated_sql("complaints_raw", "source_id", "raw_text"))
def q_validate_complaints(spark, d):
    return V.validated_raw(spark, d).select("source_id", "ok", "error_code", "error", "cleaned")


@query("rejects_by_reason", f"""
SELECT src, error_code, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'complaints' AS src, {O.error_code('raw_text', O.clean('raw_text'))} AS error_code FROM complaints_raw
  UNION ALL SELECT 'documents', {O.error_code('text', O.clean('text'))} FROM documents
  UNION ALL SELECT 'conversations', {O.error_code('text', O.clean('text'))} FROM conversations)
WHERE error_code IS NOT NULL GROUP BY src, error_code""")
def q_rejects_by_reason(spark, d):
    """Reject counts per source and reason: conditional counts, unpivoted, zero rows dropped.

    (Filtering ``error_code`` before aggregating would let Catalyst push the expensive
    validation below ``spread`` into the single scan task.)
    """
    from plaint.functions.validate import ERROR_CODES
    parts = [validate(FX.complaints_raw(spark, d), "raw_text").select(F.lit("complaints").alias("src"), "error_code"),
             validate(_docs(spark, d), "text").select(F.lit("documents").alias("src"), "error_code"),
             validate(spread(table(spark, d, "conversations")), "text").select(
                 F.lit("conversations").alias("src"), "error_code")]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = u.groupBy("src").agg(*[F.count_if(F.col("error_code") == c).alias(c) for c in ERROR_CODES])
    long = counts.select("src", F.inline(F.array(*[
        F.struct(F.lit(c).alias("error_code"), F.col(c).alias("n")) for c in ERROR_CODES])))
    return long.filter(F.col("n") > 0)


@query("intake_accepted", "SELECT source_id, created_at, customer_name, complaint FROM accepted")
def q_intake_accepted(spark, d):
    v = V.validated_raw(spark, d).filter(F.col("ok"))
    return v.select("source_id", FX.whole_seconds(F.col("ts")).alias("created_at"),
                    ustrip(F.col("customer_name")).alias("customer_name"), F.col("cleaned").alias("complaint"))


@query("intake_rejected", f"SELECT source_id, error_code, {O.error_msg('error_code', 'c0')} AS error "
                          f"FROM validated WHERE error_code IS NOT NULL")
def q_intake_rejected(spark, d):
    return V.validated_raw(spark, d).filter(~F.col("ok")).select("source_id", "error_code", "error")


@query("word_count", f"SELECT conv_id, turn, {O.words('text')} AS words FROM conversations")
def q_word_count(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", word_count(F.col("text")).alias("words"))


@query("text_preview", f"SELECT doc_id, {O.preview('text')} AS preview FROM documents")
def q_text_preview(spark, d):
    return _docs(spark, d).select("doc_id", preview(F.col("text")).alias("preview"))


@query("display_time", "SELECT source_id, strftime(created_at, '%d %b %Y, %H:%M') AS logged FROM triaged")
def q_display_time(spark, d):
    return V.complaints_triaged(spark, d).select("source_id", display_time(F.col("created_at")).alias("logged"))


# ======================================================================= rules
@query("rule_category", "SELECT source_id, category FROM triaged")
def q_rule_category(spark, d):
    return V.complaints_triaged(spark, d).select("source_id", "category")


@query("rule_scores", "SELECT source_id, " + ", ".join(
    f"{O.score('lower(complaint)', c)} AS score_{c}" for c in D.CATEGORIES) + " FROM accepted")
def q_rule_scores(spark, d):
    acc = q_intake_accepted(spark, d)
    return rules.with_rule_scores(acc, "complaint").select("source_id", *[f"score_{c}" for c in D.CATEGORIES])


@query("keyword_report", "SELECT u.rule, u.label, u.keyword, u.complaints FROM (SELECT unnest([" + ", ".join(
    f"{{'rule': {O.lit(r.rule)}, 'label': {O.lit(r.label)}, 'keyword': {O.lit(r.keyword)}, "
    f"'complaints': count(*) FILTER (WHERE {O.hit('lt', r.keyword, r.whole_word)})}}" for r in D.lexicon())
    + "]) AS u FROM (SELECT lower(complaint) AS lt FROM accepted))")
def q_keyword_report(spark, d):
    return LX.keyword_report(q_intake_accepted(spark, d), "complaint", D.lexicon())


@query("extract_amount", f"SELECT source_id, {O.amount('complaint')} AS amount FROM accepted")
def q_extract_amount(spark, d):
    return q_intake_accepted(spark, d).select("source_id", rules.amount(F.col("complaint")).alias("amount"))


@query("extract_amount_other_digits", f"SELECT source_id, {O.amount('complaint')} AS amount FROM accepted")
def q_extract_amount_other_digits(spark, d):
    return q_intake_accepted(spark, d).select(
        "source_id", rules.amount(_other_digits(F.col("complaint"))).alias("amount"))


@query("rule_priority", "SELECT source_id, priority FROM triaged")
def q_rule_priority(spark, d):
    return V.complaints_triaged(spark, d).select("source_id", "priority")


@query("rule_sentiment", "SELECT source_id, sentiment FROM triaged")
def q_rule_sentiment(spark, d):
    return V.complaints_triaged(spark, d).select("source_id", "sentiment")


@query("rule_triage", "SELECT source_id, category, priority, sentiment, response, mode FROM triaged")
def q_rule_triage(spark, d):
    return V.complaints_triaged(spark, d).select("source_id", "category", "priority", "sentiment", "response", "mode")


@query("build_response", f"SELECT source_id, {O.response('category', 'sentiment')} AS response FROM triaged")
def q_build_response(spark, d):
    t = V.complaints_triaged(spark, d)
    return t.select("source_id", build_response(F.col("category"), F.col("sentiment")).alias("response"))


@query("ensure_signature", f"SELECT provider, source_id, {O.signature(O.ustrip('raw_response'))} AS response "
                           f"FROM model_runs_raw WHERE ok")
def q_ensure_signature(spark, d):
    r = FX.model_runs_raw(spark, d).filter(F.col("ok"))
    return r.select("provider", "source_id", ensure_signature(ustrip(F.col("raw_response"))).alias("response"))


@query("normalize_labels", f"SELECT provider, source_id, {O.normalize('raw_category', D.CATEGORIES)} AS category, "
                           f"{O.normalize('raw_priority', D.PRIORITIES)} AS priority, "
                           f"{O.normalize('raw_sentiment', D.SENTIMENTS)} AS sentiment FROM model_runs_raw")
def q_normalize_labels(spark, d):
    r = FX.model_runs_raw(spark, d)
    return r.select("provider", "source_id",
                    normalize_label(F.col("raw_category"), D.CATEGORIES).alias("category"),
                    normalize_label(F.col("raw_priority"), D.PRIORITIES).alias("priority"),
                    normalize_label(F.col("raw_sentiment"), D.SENTIMENTS).alias("sentiment"))


def _triage_with_model(spark, d):
    complaints = V.complaints_triaged(spark, d).select("source_id", "complaint")
    outputs = (FX.model_runs_raw(spark, d).filter(F.col("provider") == "hosted")
               .select("source_id", F.col("ok").alias("call_ok"), "raw_category", "raw_priority", "raw_sentiment",
                       "raw_response"))
    return triage_with_model(complaints, outputs, key="source_id")


_TWM_SQL = f"""
twm0 AS (
  SELECT t.source_id, t.complaint, t.category AS r_cat, t.priority AS r_pri, t.sentiment AS r_sen,
    t.response AS r_resp, coalesce(m.ok, false) AS called,
    {O.normalize('m.raw_category', D.CATEGORIES)} AS n_cat, {O.normalize('m.raw_priority', D.PRIORITIES)} AS n_pri,
    {O.normalize('m.raw_sentiment', D.SENTIMENTS)} AS n_sen, m.raw_response
  FROM triaged t LEFT JOIN (SELECT * FROM model_runs_raw WHERE provider = 'hosted') m ON m.source_id = t.source_id),
twm1 AS (SELECT *, coalesce(n_cat, r_cat) AS m_cat FROM twm0),
twm AS (
  SELECT source_id,
    CASE WHEN called THEN m_cat ELSE r_cat END AS category,
    CASE WHEN called THEN coalesce(n_pri, {O.priority('m_cat', 'lower(complaint)', O.amount('complaint'))})
      ELSE r_pri END AS priority,
    CASE WHEN called THEN coalesce(n_sen, r_sen) ELSE r_sen END AS sentiment,
    CASE WHEN called THEN {O.signature(O.ustrip('raw_response'))} ELSE r_resp END AS response,
    CASE WHEN called THEN 'ai' ELSE 'offline' END AS mode,
    CASE WHEN called THEN NULL ELSE {O.lit(D.FALLBACK_WARNING)} END AS warning,
    CASE WHEN called THEN CAST(n_cat IS NULL AS INTEGER) + CAST(n_pri IS NULL AS INTEGER)
      + CAST(n_sen IS NULL AS INTEGER) ELSE 0 END AS format_repairs
  FROM twm1)
"""


@query("triage_with_model", "SELECT * FROM twm", _TWM_SQL)
def q_triage_with_model(spark, d):
    return _triage_with_model(spark, d).select(
        "source_id", "category", "priority", "sentiment", "response", "mode", "warning", "format_repairs")


@query("mode_counts", "SELECT mode, CAST(count(*) AS BIGINT) AS n FROM twm GROUP BY mode", _TWM_SQL)
def q_mode_counts(spark, d):
    return _triage_with_model(spark, d).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


# The same from long rows: one for each call of either run, attempts before the last included.
@query("triage_from_calls", "SELECT run, source_id AS complaint_id, * EXCLUDE (run, source_id) FROM twm",
       _TWM_SQL.replace("(SELECT * FROM model_runs_raw WHERE provider = 'hosted')", "model_runs_raw")
       .replace("FROM triaged t LEFT JOIN", "FROM triaged t CROSS JOIN (VALUES ('hosted'), ('local')) p(run) LEFT JOIN")
       .replace("ON m.source_id = t.source_id", "ON m.source_id = t.source_id AND m.provider = p.run")
       .replace("SELECT t.source_id,", "SELECT p.run, t.source_id,").replace("  SELECT source_id,", "  SELECT run, source_id,"))
def q_triage_from_calls(spark, d):
    outputs = CL.fold_steps(FX.model_calls(spark, d), ("run", "complaint_id"))
    runs = F.explode(F.array(*[F.lit(p[0]) for p in FX.PROVIDERS]))
    complaints = V.complaints_triaged(spark, d).select(runs.alias("run"), F.col("source_id").alias("complaint_id"), "complaint")
    return triage_with_model(complaints, outputs, key=["run", "complaint_id"]).select(
        "run", "complaint_id", "category", "priority", "sentiment", "response", "mode", "warning", "format_repairs")


@query("usage_by_call", """
SELECT provider AS run, source_id AS complaint_id,
  CAST(CASE WHEN ok THEN input_tokens ELSE 0 END + CASE WHEN source_id % 11 = 0 THEN 7 ELSE 0 END
    + CASE WHEN ok AND source_id % 13 = 0 THEN 5 ELSE 0 END AS BIGINT) AS input_tokens,
  CAST(CASE WHEN ok THEN output_tokens ELSE 0 END + CASE WHEN ok AND source_id % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS output_tokens,
  CAST(CASE WHEN ok THEN 4 ELSE 1 END + CASE WHEN source_id % 11 = 0 THEN 1 ELSE 0 END
    + CASE WHEN ok AND source_id % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS calls
FROM model_runs_raw""")
def q_usage_by_call(spark, d):
    return EV.usage_per_complaint(FX.model_calls(spark, d), ("run", "complaint_id"))


_PIPELINE_SQL = f"""
mp0 AS (SELECT *, length(complaint) + 11 AS n1, (length(complaint) + 11) % 5 <> 0 AS ai,
    CASE WHEN (length(complaint) + 11) % 5 = 1 THEN 'fraud' END AS n_cat FROM triaged),
mp1 AS (SELECT *, coalesce(n_cat, category) AS m_cat, n1 + 11 + length(coalesce(n_cat, category)) AS n2 FROM mp0),
mp2 AS (SELECT *, CASE WHEN m_cat = 'fraud' AND n2 % 3 = 0 THEN 'high' END AS n_pri,
    CASE WHEN n1 % 2 = 1 THEN 'neutral' END AS n_sen FROM mp1),
mp3 AS (SELECT *, coalesce(n_pri, {O.priority('m_cat', 'lower(complaint)', O.amount('complaint'))}) AS m_pri,
    coalesce(n_sen, sentiment) AS m_sen FROM mp2),
mp4 AS (SELECT *, n1 + 35 + length(m_cat) + length(m_pri) + length(m_sen) AS n4,
    'Category: ' || m_cat || chr(10) || 'Priority: ' || m_pri || chr(10) || 'Sentiment: ' || m_sen AS reply FROM mp3),
mp AS (
  SELECT source_id, CASE WHEN ai THEN m_cat ELSE category END AS category,
    CASE WHEN ai THEN m_pri ELSE priority END AS priority, CASE WHEN ai THEN m_sen ELSE sentiment END AS sentiment,
    CASE WHEN ai THEN {O.signature('reply')} ELSE response END AS response,
    CASE WHEN ai THEN 'ai' ELSE 'offline' END AS mode,
    CASE WHEN NOT ai THEN {O.lit(D.FALLBACK_WARNING)} END AS warning,
    CASE WHEN ai THEN CAST(n_cat IS NULL AS INTEGER) + CAST(n_pri IS NULL AS INTEGER) + CAST(n_sen IS NULL AS INTEGER)
      ELSE 0 END AS format_repairs,
    CAST(CASE WHEN ai THEN n1 + n2 + n1 + n4 ELSE 0 END AS BIGINT) AS input_tokens,
    CAST(CASE WHEN ai THEN 10 ELSE 0 END AS BIGINT) AS output_tokens,
    CAST(CASE WHEN ai THEN 4 ELSE 1 END AS BIGINT) AS calls,
    CASE WHEN NOT ai THEN 'TimeoutError: no answer' END AS error
  FROM mp4)
"""


@query("model_pipeline", "SELECT * FROM mp", _PIPELINE_SQL)
def q_model_pipeline(spark, d):
    complaints = V.accept_raw(FX.complaints_raw(spark, d)).select("source_id", "complaint")
    return model_triage(complaints, stand_in).drop("complaint")


@query("usage_per_complaint", "SELECT source_id, input_tokens, output_tokens, calls FROM mp", _PIPELINE_SQL)
def q_usage_per_complaint(spark, d):
    return q_model_pipeline(spark, d).select("source_id", "input_tokens", "output_tokens", "calls")


# ===================================================================== analytics
def _t(spark, d):
    """Reports read the materialised intake table (see ``views.complaints_store``)."""
    return V.complaints_store(spark, d)


def _c(spark, d):
    """The stored complaint table with the store's 10 columns."""
    return V.complaints_store(spark, d).select(*ST.COLUMNS)


KPI_SQL = ("SELECT CAST(count(*) AS BIGINT) AS total, " + ", ".join(
    f"CAST(count_if(category = '{c}') AS BIGINT) AS {c}" for c in ["fraud", "loan", "billing", "app_issue"])
    + ", CAST(count_if(status IS DISTINCT FROM 'Closed') AS BIGINT) AS open, "
      "CAST(count_if(status IS NOT DISTINCT FROM 'Closed') AS BIGINT) AS closed FROM triaged")


@query("kpi_summary", KPI_SQL)
def q_kpi_summary(spark, d):
    return A.kpi_summary(_t(spark, d))


def _dist_sql(column: str, domain: str) -> str:
    dom = O._values([r[1:] for r in D.domain_rows() if r[0] == domain], ["ord", "code", "label"])
    return (f"SELECT dm.ord, dm.code, dm.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM {dom} dm "
            f"LEFT JOIN (SELECT {column} AS code, count(*) AS n FROM triaged GROUP BY {column}) c ON c.code = dm.code")


for _col in ["category", "priority", "sentiment", "status"]:
    def _mk(col):
        def fn(spark, d):
            return A.distribution(_t(spark, d), col, col)
        fn.__name__ = f"q_{col}_counts"
        return fn
    query(f"{_col}_counts", _dist_sql(_col, _col))(_mk(_col))


@query("all_distributions", " UNION ALL ".join(
    f"SELECT '{dm}' AS domain, {o} AS ord, {O.lit(c)} AS code, {O.lit(lbl)} AS label, "
    f"CAST(count_if({dm} = {O.lit(c)}) AS BIGINT) AS n FROM triaged" for dm, o, c, lbl in D.domain_rows()))
def q_all_distributions(spark, d):
    return A.all_distributions(_t(spark, d))


@query("daily_trend", """
SELECT CAST(g.day AS DATE) AS day, CAST(coalesce(c.n, 0) AS BIGINT) AS complaints
FROM (SELECT unnest(generate_series(min(CAST(created_at AS DATE)), max(CAST(created_at AS DATE)), INTERVAL 1 DAY)) AS day
      FROM triaged) g
LEFT JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM triaged GROUP BY 1) c
  ON c.day = CAST(g.day AS DATE)""")
def q_daily_trend(spark, d):
    return A.daily_trend(_t(spark, d))


_L7 = f"created_at > {O.AS_OF} - INTERVAL 7 DAY"
_P7 = f"created_at <= {O.AS_OF} - INTERVAL 7 DAY AND created_at > {O.AS_OF} - INTERVAL 14 DAY"
_CAT_DOM = O._values([r[1:] for r in D.domain_rows() if r[0] == "category"], ["ord", "code", "label"])
_WOW = (f"SELECT dm.ord, dm.code AS category, dm.label, CAST(coalesce(c.l7, 0) AS BIGINT) AS last_7, "
        f"CAST(coalesce(c.p7, 0) AS BIGINT) AS prev_7 FROM {_CAT_DOM} dm LEFT JOIN "
        f"(SELECT category, count_if({_L7}) AS l7, count_if({_P7}) AS p7 FROM triaged GROUP BY category) c "
        f"ON c.category = dm.code")


@query("week_over_week_counts", _WOW)
def q_week_over_week(spark, d):
    return A.week_over_week_counts(_t(spark, d), FX.as_of())


@query("category_trend", f"""
SELECT *, CASE WHEN prev_7 > 0 THEN (last_7 - prev_7) / prev_7 END AS change,
  CASE WHEN prev_7 > 0 THEN CASE WHEN last_7 > prev_7 THEN 'increase' WHEN last_7 < prev_7 THEN 'decrease'
  ELSE 'flat' END WHEN last_7 > 0 THEN 'new' ELSE 'none' END AS direction FROM ({_WOW})""")
def q_category_trend(spark, d):
    return A.category_trend(_t(spark, d), FX.as_of())


@query("high_priority_health", "SELECT coalesce(avg(CAST(priority = 'high' AS DOUBLE)), 0.0) AS high_share, "
                               "CAST(count_if(priority = 'high' AND status IS DISTINCT FROM 'Closed') AS BIGINT) "
                               "AS open_high FROM triaged")
def q_high_priority_health(spark, d):
    return A.high_priority_health(_t(spark, d))


@query("upset_share", "SELECT coalesce(avg(CAST(sentiment IN ('angry', 'frustrated') AS DOUBLE)), 0.0) "
                      "AS upset_share FROM triaged")
def q_upset_share(spark, d):
    return A.upset_share(_t(spark, d))


_CAT_COUNTS = (f"SELECT dm.ord, dm.code, dm.label, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM {_CAT_DOM} dm "
               f"LEFT JOIN (SELECT category, count(*) AS n FROM triaged GROUP BY category) c ON c.category = dm.code")


@query("top_category", f"SELECT code AS category, label, n, n / (SELECT count(*) FROM triaged) AS share "
                       f"FROM ({_CAT_COUNTS}) ORDER BY n DESC, ord ASC LIMIT 1")
def q_top_category(spark, d):
    return A.top_category(_t(spark, d))


@query("row_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM triaged")
def q_row_count(spark, d):
    return A.row_count(_t(spark, d))


def _stats_sql() -> str:
    def by(domain):
        return " || ', ' || ".join(
            f"{O.lit(lbl + '=')} || CAST(count_if({domain} = {O.lit(c)}) AS VARCHAR)"
            for dm, _, c, lbl in D.domain_rows() if dm == domain)
    week = " || ".join(
        f"chr(10) || {O.lit(D.CATEGORY_LABELS[c] + ' last 7 days=')} || "
        f"CAST(count_if(category = '{c}' AND {_L7}) AS VARCHAR) || ', previous 7 days=' || "
        f"CAST(count_if(category = '{c}' AND {_P7}) AS VARCHAR)" for c in D.CATEGORIES)
    return (f"SELECT 'Total complaints: ' || CAST(count(*) AS VARCHAR) || ' (open/in progress: ' || "
            f"CAST(count_if(status IS DISTINCT FROM 'Closed') AS VARCHAR) || ', closed: ' || "
            f"CAST(count_if(status = 'Closed') AS VARCHAR) || ')' || chr(10) || 'By category: ' || {by('category')} "
            f"|| chr(10) || 'By priority: ' || {by('priority')} || chr(10) || 'By sentiment: ' || {by('sentiment')} "
            f"|| CASE WHEN count(*) > 0 THEN {week} ELSE '' END AS stats FROM triaged")


@query("stats_text", _stats_sql())
def q_stats_text(spark, d):
    return A.stats_text(_t(spark, d), FX.as_of())


def _insights_sql() -> str:
    cats = D.CATEGORIES
    lines = []
    lines.append(
        "(SELECT '**' || label || '** is the largest complaint category: ' || CAST(n AS VARCHAR) || ' cases (' || "
        f"{O.pct('n / (SELECT count(*) FROM triaged)')} || ' of all complaints).' FROM ({_CAT_COUNTS}) "
        "ORDER BY n DESC, ord ASC LIMIT 1)")
    body = [f"SELECT 0 AS ord, {lines[0]} AS insight",
            f"SELECT 1, {O.pct('avg(CAST(priority = ' + chr(39) + 'high' + chr(39) + ' AS DOUBLE))')} || "
            f"' of complaints are high priority; **' || CAST(count_if(priority = 'high' AND status IS DISTINCT FROM "
            f"'Closed') AS VARCHAR) || '** high-priority complaint(s) are still unresolved.' FROM triaged",
            f"SELECT 2, {O.pct('avg(CAST(sentiment IN (' + chr(39) + 'angry' + chr(39) + ', ' + chr(39) + 'frustrated' + chr(39) + ') AS DOUBLE))')} "
            f"|| ' of customers sound angry or frustrated.' FROM triaged"]
    for i, c in enumerate(cats):
        lbl = D.CATEGORY_LABELS[c]
        body.append(
            f"SELECT {3 + i}, CASE WHEN p > 0 THEN CASE WHEN l > p THEN {O.lit(lbl + ' complaints **increased by ')} "
            f"|| {O.pct('(l - p) / p')} || '** vs the previous 7 days (' || CAST(p AS VARCHAR) || ' → ' || "
            f"CAST(l AS VARCHAR) || ').' WHEN l < p THEN {O.lit(lbl + ' complaints **decreased by ')} || "
            f"{O.pct('abs((l - p) / p)')} || '** vs the previous 7 days (' || CAST(p AS VARCHAR) || ' → ' || "
            f"CAST(l AS VARCHAR) || ').' END WHEN l > 0 THEN {O.lit(lbl + ': ')} || CAST(l AS VARCHAR) || "
            f"' new complaint(s) this week (none in the previous 7 days).' END FROM "
            f"(SELECT count_if(category = '{c}' AND {_L7}) AS l, count_if(category = '{c}' AND {_P7}) AS p FROM triaged)")
    allrows = " UNION ALL ".join(body)
    return (f"SELECT ord, insight FROM ({allrows}) WHERE insight IS NOT NULL AND (SELECT count(*) FROM triaged) > 0 "
            f"UNION ALL SELECT 0, {O.lit(D.NO_DATA_INSIGHT)} WHERE (SELECT count(*) FROM triaged) = 0")


@query("insights", _insights_sql())
def q_insights(spark, d):
    return A.insights(_t(spark, d), FX.as_of())


@query("ageing_by_status", f"SELECT CASE WHEN a > 10 THEN 'over_10_days' WHEN a > 3 THEN '4_to_10_days' "
                           f"ELSE '0_to_3_days' END AS age_band, status, CAST(count(*) AS BIGINT) AS n "
                           f"FROM (SELECT {O.age_days('created_at')} AS a, status FROM triaged) GROUP BY 1, 2")
def q_ageing_by_status(spark, d):
    return A.ageing_by_status(_t(spark, d), FX.as_of())


# ========================================================================= store
COLS10 = ", ".join(ST.COLUMNS)


@query("assign_ids", "SELECT source_id, complaint_id FROM complaints")
def q_assign_ids(spark, d):
    return V.complaints(spark, d, keep_source=True).select("source_id", "complaint_id")


@query("intake_append", f"SELECT {COLS10} FROM complaints")
def q_intake_append(spark, d):
    """Two loads into a fresh store, cut where the first day of the data ends."""
    path = f"{_scratch(spark)}/store"
    accepted = V.triage_raw(FX.complaints_raw(spark, d))
    first = accepted.agg(F.min(F.to_date("created_at"))).first()[0]
    ST.append(accepted.where(F.to_date("created_at") <= F.lit(first)), path, batch="first")
    ST.append(accepted.where(F.to_date("created_at") > F.lit(first)), path, batch="second")
    return ST.read(spark, path)


@query("scan_newest_first", f"SELECT {COLS10} FROM complaints ORDER BY created_at DESC, complaint_id DESC")
def q_scan_newest_first(spark, d):
    return ST.newest_first(_c(spark, d))


@query("parse_created_at", "SELECT complaint_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_text, "
                           "strptime(strftime(created_at, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS created_at "
                           "FROM complaints")
def q_parse_created_at(spark, d):
    c = _c(spark, d).select("complaint_id", F.date_format("created_at", ST.CREATED_FORMAT).alias("t"))
    return c.select("complaint_id", F.col("t").alias("created_text"),
                    F.to_timestamp_ntz(F.col("t"), F.lit(ST.CREATED_FORMAT)).alias("created_at"))


FILTERS = {
    "filter_category": dict(categories=["fraud", "loan"]),
    "filter_priority": dict(priorities=["high"]),
    "filter_status": dict(statuses=["Open", "In Progress"]),
    "search_keyword": dict(search="  emi "),
    "search_combined": dict(categories=["billing", "fraud"], priorities=["high", "medium"], statuses=["Open"],
                            search="user 1"),
}


def _filter_sql(categories=None, priorities=None, statuses=None, search=None) -> str:
    clauses = []
    for col, vals in (("category", categories), ("priority", priorities), ("status", statuses)):
        if vals:
            clauses.append(f"{col} IN ({', '.join(O.lit(v) for v in vals)})")
    if search and search.strip():
        like = O.lit("%" + search.strip() + "%")
        clauses.append(f"(complaint_id ILIKE {like} OR complaint ILIKE {like} OR customer_name ILIKE {like})")
    where = (" WHERE " + " AND ".join(clauses)) if clauses else ""
    return f"SELECT {COLS10} FROM complaints{where} ORDER BY created_at DESC, complaint_id DESC"


for _name, _kw in FILTERS.items():
    def _mkf(kw):
        def fn(spark, d):
            return ST.list_complaints(_c(spark, d), **kw)
        return fn
    query(_name, _filter_sql(**_kw))(_mkf(_kw))

# Terms of all kinds: in texts, names and IDs, with wildcards, too short for the index, without a hit.
SEARCH_TERMS = ["  emi ", "hacked", "user 1", "CMP-2024-00", "refund", "r%fund", "charged tw_ce", "₹", "no such text"]


@query("search_by_index", " UNION ALL ".join(
    f"SELECT {O.lit(t)} AS term, complaint_id, created_at FROM complaints WHERE complaint_id ILIKE {O.lit('%' + t.strip() + '%')} "
    f"OR complaint ILIKE {O.lit('%' + t.strip() + '%')} OR customer_name ILIKE {O.lit('%' + t.strip() + '%')}" for t in SEARCH_TERMS))
def q_search_by_index(spark, d):
    path = f"{checkpoint_dir(spark).rstrip('/')}/indexed-{uuid.uuid4().hex}"
    ST.write_rows(ST.read_stored(spark, V.complaints_store_path(spark, d)), path)
    SX.index_batch(spark, path, "all")
    parts = [SX.search(spark, path, t).select(F.lit(t).alias("term"), "complaint_id", "created_at") for t in SEARCH_TERMS]
    return reduce(DataFrame.union, parts)


TRACK_ID = " cmp-2024-007 "


@query("track_by_id", f"SELECT complaint_id, status, {O.label_of('category', 'category')} AS category_label, "
                      f"upper(substring(priority, 1, 1)) || lower(substring(priority, 2)) AS priority_title, "
                      f"strftime(created_at, '%Y-%m-%d %H:%M:%S') AS logged FROM complaints "
                      f"WHERE lower(complaint_id) = {O.lit(TRACK_ID.strip().lower())}")
def q_track_by_id(spark, d):
    return ST.tracking_card(ST.lookup(spark, V.complaints_store_path(spark, d), TRACK_ID))


# No complaints: a listing without a hit, and the table after it was cleared.
@query("kpi_of_no_hit", "SELECT CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS fraud, CAST(0 AS BIGINT) AS loan, "
                        "CAST(0 AS BIGINT) AS billing, CAST(0 AS BIGINT) AS app_issue, CAST(0 AS BIGINT) AS \"open\", "
                        "CAST(0 AS BIGINT) AS closed FROM (SELECT count(*) AS n FROM complaints WHERE complaint ILIKE '%no such text%') WHERE n = 0")
def q_kpi_of_no_hit(spark, d):
    return A.kpi_summary(ST.list_complaints(_c(spark, d), search="no such text", ordered=False))


@query("counts_after_clear", "SELECT 'before' AS state, CAST(count(*) AS BIGINT) AS n FROM complaints "
                             "UNION ALL SELECT 'after', CAST(0 AS BIGINT)")
def q_counts_after_clear(spark, d):
    path = _stored_by_month(spark, d)
    before = spark.createDataFrame([("before", ST.read(spark, path).count())], "state string, n bigint")
    ST.clear(spark, path)
    return before.union(ST.count(ST.read(spark, path)).select(F.lit("after"), "n"))


def _stored_by_month(spark, d) -> str:
    """A store of its own, with the complaints of each month as one load."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/by-month-{uuid.uuid4().hex}"
    rows = ST.read_stored(spark, V.complaints_store_path(spark, d))
    ST.write_rows(rows.withColumn("batch", F.date_format("created_at", "yyyy-MM")), path)
    return path


@query("merge_status_updates", "SELECT c.complaint_id, c.created_at, coalesce(l.status, c.status) AS status FROM complaints c "
                               "LEFT JOIN latest_status l ON l.complaint_id = c.complaint_id")
def q_merge_status_updates(spark, d):
    path = _stored_by_month(spark, d)
    ST.merge_status(spark, path, FX.status_changes(spark, d))
    return ST.read(spark, path).select("complaint_id", "created_at", "status")


@query("complaint_detail", f"SELECT complaint_id, created_at, CASE WHEN customer_name = '' THEN 'Not provided' "
                           f"ELSE customer_name END AS customer, complaint, "
                           f"{O.label_of('category', 'category')} AS category_label, priority, sentiment, status, "
                           f"mode, response FROM complaints")
def q_complaint_detail(spark, d):
    c = _c(spark, d)
    return c.select("complaint_id", "created_at",
                    F.when(F.col("customer_name") == "", "Not provided").otherwise(F.col("customer_name"))
                    .alias("customer"), "complaint", label_of(F.col("category"), "category").alias("category_label"),
                    "priority", "sentiment", "status", "mode", "response")


def console_view(df: DataFrame) -> DataFrame:
    return df.select(F.col("complaint_id").alias("ID"), F.col("created_at").alias("Date"),
                     label_of(F.col("category"), "category").alias("Category"), F.col("priority").alias("Priority"),
                     F.col("sentiment").alias("Sentiment"), F.col("status").alias("Status"),
                     F.col("complaint").alias("Complaint"))


_CONSOLE_SQL = (f"SELECT complaint_id AS \"ID\", created_at AS \"Date\", {O.label_of('category', 'category')} "
                f"AS \"Category\", priority AS \"Priority\", sentiment AS \"Sentiment\", status AS \"Status\", "
                f"complaint AS \"Complaint\" FROM complaints")


@query("console_view", _CONSOLE_SQL)
def q_console_view(spark, d):
    return console_view(ST.newest_first(_c(spark, d)))


@query("latest_10", f"SELECT complaint_id AS \"ID\", created_at AS \"Date\", "
                    f"{O.label_of('category', 'category')} AS \"Category\", priority AS \"Priority\", "
                    f"status AS \"Status\" FROM complaints ORDER BY created_at DESC, complaint_id DESC LIMIT 10")
def q_latest_10(spark, d):
    top = ST.newest_first(_c(spark, d)).limit(10)
    return top.select(F.col("complaint_id").alias("ID"), F.col("created_at").alias("Date"),
                      label_of(F.col("category"), "category").alias("Category"), F.col("priority").alias("Priority"),
                      F.col("status").alias("Status"))


@query("label_map", f"SELECT source_id, {O.label_of('category', 'category')} AS category_label FROM triaged")
def q_label_map(spark, d):
    return _t(spark, d).select("source_id", label_of(F.col("category"), "category").alias("category_label"))


def _guard_sql(c: str) -> str:
    return f"CASE WHEN substring({c}, 1, 1) IN ('=', '+', '-', '@') THEN '''' || {c} ELSE {c} END"


@query("csv_safe", f"SELECT doc_id, {_guard_sql('text')} AS text, {_guard_sql('lang')} AS lang, "
                   f"{_guard_sql('source')} AS source, n_chars FROM documents")
def q_csv_safe(spark, d):
    return X.csv_safe(_docs(spark, d))


@query("csv_report_rows", "SELECT " + ", ".join(
    f"{_guard_sql(chr(34) + c + chr(34))} AS \"{c}\"" if c != "Date" else "\"Date\""
    for c in ["ID", "Date", "Category", "Priority", "Sentiment", "Status", "Complaint"])
    + f" FROM ({_CONSOLE_SQL})")
def q_csv_report_rows(spark, d):
    return X.csv_safe(console_view(_c(spark, d)))


@query("status_update_rejects", "SELECT change_id, complaint_id, new_status, 'Invalid status: ''' || new_status "
                                "|| '''' AS error FROM status_changes "
                                "WHERE new_status IS NULL OR new_status NOT IN ('Open', 'In Progress', 'Closed')")
def q_status_update_rejects(spark, d):
    return ST.status_change_rejects(FX.status_changes(spark, d))


@query("latest_status", "SELECT complaint_id, status, changed_at FROM latest_status")
def q_latest_status(spark, d):
    return ST.latest_status(FX.status_changes(spark, d))


@query("apply_status_updates", "SELECT c.complaint_id, c.status AS previous_status, coalesce(l.status, c.status) "
                               "AS status, l.status IS NOT NULL AS updated FROM complaints c "
                               "LEFT JOIN latest_status l ON l.complaint_id = c.complaint_id")
def q_apply_status_updates(spark, d):
    out = ST.apply_status_updates(_c(spark, d), FX.status_changes(spark, d))
    return out.select("complaint_id", "previous_status", "status", "updated")


@query("kpi_after_updates", KPI_SQL.replace("FROM triaged", "FROM (SELECT c.category, coalesce(l.status, c.status) AS status "
                                            "FROM complaints c LEFT JOIN latest_status l ON l.complaint_id = c.complaint_id)"))
def q_kpi_after_updates(spark, d):
    return A.kpi_summary(ST.current(_c(spark, d), FX.status_changes(spark, d)))


@query("status_updates_unmatched", "SELECT change_id, complaint_id, new_status FROM status_changes s "
                                   "WHERE new_status IN ('Open', 'In Progress', 'Closed') AND NOT EXISTS "
                                   "(SELECT 1 FROM complaints c WHERE c.complaint_id = s.complaint_id)")
def q_status_updates_unmatched(spark, d):
    return ST.unmatched_changes(_c(spark, d), FX.status_changes(spark, d))


# ==================================================================== evaluation
REC_COLS = ("provider, complaint_id, ok, latency_s, category, priority, sentiment, response, input_tokens, "
            "output_tokens, tokens_estimated, format_repairs, error")


def _flat(records: DataFrame) -> DataFrame:
    return EV.flat_checks(records).select(*[c.strip() for c in REC_COLS.split(",")],
                                          *[f"chk_{k}" for k in D.CHECK_NAMES])


@query("model_run_records", f"SELECT {REC_COLS}, {CHK} FROM scored")
def q_model_run_records(spark, d):
    return _flat(_records_raw(spark, d))


@query("reply_quality_checks", f"SELECT provider, complaint_id, {CHK} FROM scored WHERE ok")
def q_reply_quality_checks(spark, d):
    return _flat(_records(spark, d)).filter("ok").select("provider", "complaint_id", *[f"chk_{k}" for k in D.CHECK_NAMES])


@query("estimate_tokens", "SELECT provider, complaint_id, input_tokens, output_tokens FROM records WHERE tokens_estimated")
def q_estimate_tokens(spark, d):
    return _records(spark, d).filter("tokens_estimated").select("provider", "complaint_id", "input_tokens",
                                                                 "output_tokens")


@query("label_repairs", "SELECT provider, format_repairs, CAST(count(*) AS BIGINT) AS n FROM records WHERE ok "
                        "GROUP BY 1, 2")
def q_label_repairs(spark, d):
    return EV.label_repairs(_records(spark, d))


@query("token_usage", "SELECT provider, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, "
                      "CAST(sum(output_tokens) AS BIGINT) AS output_tokens, "
                      "CAST(count_if(tokens_estimated) AS BIGINT) AS estimated_records FROM records WHERE ok GROUP BY 1")
def q_token_usage(spark, d):
    return EV.token_usage(_records(spark, d))


_CORRECT = ", ".join(f"CAST(count_if(ok AND {a} = g_{a}) AS BIGINT) AS {a}_correct"
                     for a in ("category", "priority", "sentiment"))


@query("eval_correct", f"SELECT provider, {_CORRECT} FROM records GROUP BY provider")
def q_eval_correct(spark, d):
    return EV.correct_counts(_records(spark, d))


_ACC = ("CAST(100.0 AS DOUBLE) * (" + " + ".join(f"count_if(ok AND {a} = g_{a})" for a in
                                                ("category", "priority", "sentiment"))
        + ") / (3 * count(*))")


@query("eval_triage_accuracy", f"SELECT provider, {_ACC} AS triage_accuracy FROM records GROUP BY provider")
def q_eval_triage_accuracy(spark, d):
    return EV.triage_accuracy(_records(spark, d))


_QS = "round(coalesce(CAST(100.0 AS DOUBLE) * avg(ratio), 0.0), 9)"


@query("eval_quality_score", f"SELECT provider, {_QS} AS quality_score FROM scored2 GROUP BY provider")
def q_eval_quality_score(spark, d):
    return EV.quality_score(_records(spark, d)).select("provider", F.round("quality_score", 9).alias("quality_score"))


@query("eval_check_pass", " UNION ALL ".join(
    f"SELECT provider, '{k}' AS \"check\", CAST(count_if(chk_{k}) AS BIGINT) AS passed, "
    f"CAST(count(chk_{k}) AS BIGINT) AS relevant FROM scored WHERE ok GROUP BY provider HAVING count(chk_{k}) > 0"
    for k in D.CHECK_NAMES))
def q_eval_check_pass(spark, d):
    return EV.check_pass_counts(_records(spark, d))


_MEDIAN = ("SELECT provider, avg(latency_s) AS median_latency FROM (SELECT provider, latency_s, "
           "row_number() OVER (PARTITION BY provider ORDER BY latency_s, complaint_id) AS pos, "
           "count(*) OVER (PARTITION BY provider) AS cnt FROM records WHERE ok) "
           "WHERE pos = floor((cnt + 1) / 2) OR pos = floor(cnt / 2) + 1 GROUP BY provider")
_SUMMARY = (f"SELECT r.provider, CAST(count(*) AS BIGINT) AS n, CAST(count_if(NOT ok) AS BIGINT) AS failed, "
            f"CAST(count_if(ok AND format_repairs = 0) AS BIGINT) AS clean_outputs, "
            f"coalesce(any_value(m.median_latency), 0.0) AS median_latency, "
            f"coalesce(max(CASE WHEN ok THEN latency_s END), 0.0) AS max_latency, "
            f"coalesce(avg(CASE WHEN ok THEN {O.words('response')} END), 0.0) AS avg_words, "
            f"coalesce(avg(CASE WHEN ok THEN input_tokens END), 0.0) AS avg_input_tokens, "
            f"coalesce(avg(CASE WHEN ok THEN output_tokens END), 0.0) AS avg_output_tokens, "
            f"coalesce(bool_or(CASE WHEN ok THEN tokens_estimated END), false) AS tokens_estimated "
            f"FROM records r LEFT JOIN ({_MEDIAN}) m ON m.provider = r.provider GROUP BY r.provider")


@query("eval_provider_summary", _SUMMARY)
def q_eval_provider_summary(spark, d):
    return EV.provider_summary(_records(spark, d), stored=True)


@query("fraud_marked_high", "SELECT provider, CAST(count_if(ok AND g_category = 'fraud' AND priority = 'high') AS "
                            "BIGINT) AS fraud_high, CAST(count_if(g_category = 'fraud') AS BIGINT) AS fraud_total "
                            "FROM records GROUP BY provider")
def q_fraud_marked_high(spark, d):
    return EV.fraud_marked_high(_records(spark, d).drop("g_category"), _gold(spark, d))


_COST = (f"(avg_input_tokens * {O.dbl(D.PRICE_IN_PER_M)} + avg_output_tokens * {O.dbl(D.PRICE_OUT_PER_M)}) "
         f"/ {O.dbl(1e6)} * {O.dbl(1000.0)}")


@query("cost_and_breakeven", f"SELECT provider, avg_input_tokens, avg_output_tokens, {_COST} AS cost_per_1000, "
                             f"CASE WHEN {_COST} > 0 THEN {O.dbl(D.SERVER_MONTHLY_USD)} / ({_COST}) * "
                             f"{O.dbl(1000.0)} ELSE CAST('inf' AS DOUBLE) END AS breakeven_requests FROM ({_SUMMARY})")
def q_cost_and_breakeven(spark, d):
    return EV.cost_and_breakeven(EV.provider_summary(_records(spark, d), stored=True))


_METRICS = (f"SELECT s.*, a.triage_accuracy, q.quality_score, c.category_correct, c.priority_correct, "
            f"c.sentiment_correct, l.length_pass, {_COST} AS cost_per_1000 FROM ({_SUMMARY}) s "
            f"JOIN (SELECT provider, {_ACC} AS triage_accuracy FROM records GROUP BY provider) a USING (provider) "
            f"JOIN (SELECT provider, coalesce(CAST(100.0 AS DOUBLE) * avg(ratio), 0.0) AS quality_score FROM scored2 "
            f"GROUP BY provider) q USING (provider) "
            f"JOIN (SELECT provider, {_CORRECT} FROM records GROUP BY provider) c USING (provider) "
            f"LEFT JOIN (SELECT provider, count_if(chk_length_50_60) AS length_pass FROM scored WHERE ok "
            f"GROUP BY provider) l USING (provider)")


@query("provider_comparison", " UNION ALL ".join(
    f"SELECT '{sec}' AS section, '{dim}' AS dimension, "
    f"round(max(CASE WHEN provider = 'hosted' THEN CAST({dim} AS DOUBLE) END), 9) AS hosted, "
    f"round(max(CASE WHEN provider = 'local' THEN CAST({dim} AS DOUBLE) END), 9) AS local FROM ({_METRICS})"
    for sec, dim in EV.COMPARISON_ROWS))
def q_provider_comparison(spark, d):
    out = EV.provider_comparison(_records(spark, d), stored=True)
    return out.select("section", "dimension", F.round("hosted", 9).alias("hosted"), F.round("local", 9).alias("local"))


_VERDICT = f"""
SELECT acc_h AS hosted_accuracy, acc_l AS local_accuracy, gap AS accuracy_gap,
  CASE WHEN gap <= 0.5 THEN 'matched' WHEN gap <= 5 THEN 'within' ELSE 'trailed' END AS accuracy_band,
  med_h AS hosted_median, med_l AS local_median, ratio AS latency_ratio,
  CASE WHEN ratio >= 1.5 THEN 'slower' WHEN ratio <= 1 / 1.5 THEN 'faster' ELSE 'similar' END AS speed_band,
  CASE WHEN gap > 5 THEN 'larger_model' WHEN ratio >= 1.5 THEN 'gpu_hardware' ELSE 'no_cost' END AS tail,
  CASE WHEN med_h > 0 AND med_l > 0 THEN CASE WHEN med_l / med_h >= 1 THEN 'hosted' ELSE 'local' END END AS faster,
  CASE WHEN med_h > 0 AND med_l > 0 THEN greatest(med_l / med_h, med_h / med_l) END AS speed_factor,
  cost AS hosted_cost_per_1000,
  CASE WHEN cost > 0 THEN {O.dbl(D.SERVER_MONTHLY_USD)} / cost * {O.dbl(1000.0)} ELSE CAST('inf' AS DOUBLE) END
    AS breakeven_requests
FROM (SELECT *, acc_h - acc_l AS gap,
        CASE WHEN med_h > 0 AND med_l > 0 THEN med_l / med_h ELSE {O.dbl(1.0)} END AS ratio,
        (in_h * {O.dbl(D.PRICE_IN_PER_M)} + out_h * {O.dbl(D.PRICE_OUT_PER_M)}) / {O.dbl(1e6)} * {O.dbl(1000.0)} AS cost
      FROM (SELECT max(CASE WHEN provider = 'hosted' THEN triage_accuracy END) AS acc_h,
              max(CASE WHEN provider = 'local' THEN triage_accuracy END) AS acc_l,
              max(CASE WHEN provider = 'hosted' THEN median_latency END) AS med_h,
              max(CASE WHEN provider = 'local' THEN median_latency END) AS med_l,
              max(CASE WHEN provider = 'hosted' THEN avg_input_tokens END) AS in_h,
              max(CASE WHEN provider = 'hosted' THEN avg_output_tokens END) AS out_h
            FROM ({_METRICS})))"""


@query("provider_verdict", _VERDICT)
def q_provider_verdict(spark, d):
    return EV.provider_verdict(_records(spark, d), stored=True)


def _gold(spark, d):
    raw = FX.complaints_raw(spark, d)
    t = F.broadcast(FX.templates(spark))
    return raw.join(t, "tid").select(F.col("source_id").alias("complaint_id"),
                                     F.coalesce(F.col("raw_text"), F.lit("")).alias("text"),
                                     "g_category", "g_priority", "g_sentiment")


@query("side_by_side", f"""
SELECT g.source_id AS complaint_id, {O.preview("coalesce(g.raw_text, '')")} AS complaint_preview,
  t.g_category || '/' || t.g_priority || '/' || t.g_sentiment AS gold,
  coalesce(x.h_cell, 'n/a') AS hosted_result, coalesce(x.l_cell, 'n/a') AS local_result,
  x.h_latency AS hosted_latency, x.l_latency AS local_latency
FROM complaints_raw g JOIN templates t ON t.tid = g.tid
LEFT JOIN cells x ON x.complaint_id = g.source_id""", """
cells AS (
  SELECT complaint_id,
    max(CASE WHEN provider = 'hosted' THEN cell END) AS h_cell, max(CASE WHEN provider = 'local' THEN cell END) AS l_cell,
    max(CASE WHEN provider = 'hosted' THEN latency_s END) AS h_latency,
    max(CASE WHEN provider = 'local' THEN latency_s END) AS l_latency
  FROM (SELECT complaint_id, provider, latency_s, CASE WHEN ok THEN concat_ws('/', category, priority, sentiment)
        ELSE 'FAILED (' || substring(error, 1, 40) || ')' END AS cell FROM records)
  GROUP BY complaint_id)""")
def q_side_by_side(spark, d):
    return EV.side_by_side(_records(spark, d), _gold(spark, d))


@query("gold_join", """
SELECT g.source_id AS complaint_id, t.g_category, t.g_priority, t.g_sentiment, p.category, p.priority, p.sentiment
FROM complaints_raw g JOIN templates t ON t.tid = g.tid
LEFT JOIN (SELECT * FROM records WHERE provider = 'hosted' AND ok) p ON p.complaint_id = g.source_id""")
def q_gold_join(spark, d):
    preds = _records(spark, d).filter((F.col("provider") == "hosted") & F.col("ok")).select(
        "complaint_id", "category", "priority", "sentiment")
    return _gold(spark, d).drop("text").join(preds, "complaint_id", "left")


PROBE_ID = 9


@query("injection_probe", f"SELECT provider, category FROM records WHERE ok AND complaint_id = {PROBE_ID}")
def q_injection_probe(spark, d):
    return EV.injection_probe(_records(spark, d), PROBE_ID)


@query("provider_union", "SELECT provider, CAST(count(*) AS BIGINT) AS n, CAST(count_if(ok) AS BIGINT) AS ok_n "
                         "FROM records GROUP BY provider")
def q_provider_union(spark, d):
    r = _records(spark, d)
    hosted, local = r.filter(F.col("provider") == "hosted"), r.filter(F.col("provider") == "local")
    return hosted.unionByName(local).groupBy("provider").agg(F.count(F.lit(1)).alias("n"),
                                                             F.count_if("ok").alias("ok_n"))


# ======================================================================= prompts
def _prompt_sql(steps: list[str]) -> str:
    parts = []
    for step, system, human in D.PROMPTS:
        if step not in steps:
            continue

        def render(tpl: str) -> str:
            out, rest = [], tpl
            vals = {"text": "complaint", "company": O.lit(D.DEFAULT_COMPANY), "cat": "category",
                    "priority": "priority", "sentiment": "sentiment"}
            while "{" in rest:
                head, _, tail = rest.partition("{")
                name, _, rest = tail.partition("}")
                if head:
                    out.append(O.lit(head))
                out.append(vals[name])
            if rest:
                out.append(O.lit(rest))
            return " || ".join(out)
        parts.append(f"SELECT source_id AS complaint_id, '{step}' AS step, {render(system)} AS system, "
                     f"{render(human)} AS human FROM triaged")
    return " UNION ALL ".join(parts)


@query("prompts_stage1", _prompt_sql(PR.STAGE1))
def q_prompts_stage1(spark, d):
    t = _t(spark, d).select(F.col("source_id").alias("complaint_id"), "complaint")
    return PR.prompts(t, PR.STAGE1)


@query("prompts_stage2", _prompt_sql(PR.STAGE2))
def q_prompts_stage2(spark, d):
    t = _t(spark, d).select(F.col("source_id").alias("complaint_id"), "complaint", "category", "priority",
                            "sentiment")
    return PR.prompts(t, PR.STAGE2)


@query("prompt_insights", f"SELECT {O.lit(D.INSIGHTS_PROMPT[0])} AS system, "
                          f"{O.lit('Complaint statistics:' + chr(10))} || stats AS human FROM ({_stats_sql()})")
def q_prompt_insights(spark, d):
    return PR.insights_prompt(A.stats_text(_t(spark, d), FX.as_of()))


@query("results_json_roundtrip", f"SELECT {REC_COLS}, {CHK} FROM scored")
def q_results_json_roundtrip(spark, d):
    recs = _records_raw(spark, d).select(
        F.col("provider").alias("key"), F.col("provider").alias("label"),
        F.concat(F.lit("model-"), F.col("provider")).alias("model"), F.lit(D.DEFAULT_COMPANY).alias("company"),
        F.lit(0.0).alias("cold_start_s"), F.lit("2024-01-31 00:00").alias("generated_at"),
        F.lit("").alias("hardware"), F.lit("").alias("endpoint"), "*")
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    X.write_results(recs, path)
    back = X.read_results(spark, path).withColumnRenamed("key", "provider")
    return _flat(back)


# Complaints as JSON lines, some cut short, some with a time that is none or without one.
def _broken_lines(spark, d) -> str:
    path = f"{checkpoint_dir(spark).rstrip('/')}/lines-{uuid.uuid4().hex}"
    sid = F.col("source_id")
    ts = F.date_format("ts", ST.CREATED_FORMAT)
    ts = F.when(sid % 19 == 4, F.concat(F.lit("on "), ts)).when(sid % 29 == 5, F.lit("2024-13-01 10:00:00")).when(sid % 23 != 6, ts)
    line = F.to_json(F.struct("source_id", ts.alias("ts"), "customer_name", "raw_text"))
    line = F.when(sid % 17 == 3, F.substring(line, 1, 20)).otherwise(line)
    FX.complaints_raw(spark, d).select(line.alias("value")).write.text(path)
    return path


_BROKEN = """(SELECT source_id, customer_name, raw_text, CASE WHEN source_id % 17 = 3 THEN 'malformed'
  WHEN source_id % 19 = 4 OR source_id % 29 = 5 THEN 'bad time: ts' WHEN source_id % 23 = 6 THEN 'missing: ts' END AS reason,
  date_trunc('second', ts) AS ts FROM complaints_raw)"""


@query("tolerant_rows", f"SELECT source_id, CAST(ts AS TIMESTAMP) AS ts, customer_name, raw_text FROM {_BROKEN} WHERE reason IS NULL")
def q_tolerant_rows(spark, d):
    return read_complaints(spark, _broken_lines(spark, d)).rows


@query("tolerant_rejects", f"SELECT reason, CAST(count(*) AS BIGINT) AS n FROM {_BROKEN} WHERE reason IS NOT NULL GROUP BY reason")
def q_tolerant_rejects(spark, d):
    return read_complaints(spark, _broken_lines(spark, d)).rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ===================================================================== streaming
def _scratch(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("stream_intake", f"SELECT complaint_id, created_at, customer_name, complaint, category, priority, sentiment, "
                        f"response, 'Open' AS status, mode FROM complaints")
def q_stream_intake(spark, d):
    from plaint.streaming import intake as S
    base = _scratch(spark)
    q = S.start_intake(S.raw_complaint_stream(spark, d), f"{base}/store", f"{base}/quarantine", f"{base}/ckpt")
    q.awaitTermination()
    return ST.read(spark, f"{base}/store")


@query("stream_daily_counts", "SELECT CAST(created_at AS DATE) AS day, CAST(count(*) AS BIGINT) AS complaints "
                              "FROM triaged GROUP BY 1")
def q_stream_daily_counts(spark, d):
    from plaint.streaming import intake as S
    base = _scratch(spark)
    q = S.start_windows(S.daily_counts(V.triage_raw(S.raw_complaint_stream(spark, d))), f"{base}/out",
                        f"{base}/ckpt")
    q.awaitTermination()
    return S.current_windows(spark, f"{base}/out", "complaints")


@query("stream_rolling_week", """
SELECT CAST(ws AS TIMESTAMP) AS window_start, CAST(ws + INTERVAL 7 DAY AS TIMESTAMP) AS window_end, category,
  CAST(count(*) AS BIGINT) AS n
FROM (SELECT category, unnest(generate_series(date_trunc('day', created_at) - INTERVAL 6 DAY,
        date_trunc('day', created_at), INTERVAL 1 DAY)) AS ws FROM triaged)
GROUP BY ws, category""")
def q_stream_rolling_week(spark, d):
    from plaint.streaming import intake as S
    base = _scratch(spark)
    panes = S.daily_category_counts(V.triage_raw(S.raw_complaint_stream(spark, d)))
    q = S.start_windows(panes, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return S.rolling_from_panes(S.current_windows(spark, f"{base}/out", "n"))


@query("stream_late_rows", """
SELECT day, CAST(count_if(NOT late) AS BIGINT) AS complaints, CAST(count_if(late) AS BIGINT) AS late
FROM (SELECT CAST(created_at AS DATE) AS day,
        created_at < TIMESTAMP '2024-01-20' AND CAST(created_at AS DATE) + INTERVAL 1 DAY <= w AS late
      FROM triaged, (SELECT max(created_at) - INTERVAL 1 DAY AS w FROM triaged WHERE created_at >= TIMESTAMP '2024-01-20'))
GROUP BY day""")
def q_stream_late_rows(spark, d):
    """The days after the 20th arrive first; most of what follows is too late by then."""
    from plaint.streaming import intake as S
    base = _scratch(spark)
    rows = V.triage_raw(FX.complaints_raw(spark, d)).select("source_id", "created_at")
    for i, part in enumerate(("created_at >= timestamp_ntz'2024-01-20'", "created_at < timestamp_ntz'2024-01-20'")):
        rows.where(part).coalesce(1).write.parquet(f"{base}/in/part={i}")
        time.sleep(1.1)  # the file source takes older files first
    stream = (spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(f"{base}/in"))
    q = S.start_checked_daily_counts(stream, f"{base}/out", f"{base}/late", f"{base}/ckpt")
    q.awaitTermination()
    late = spark.read.parquet(f"{base}/late").groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("late"))
    none = F.lit(0).cast("bigint")
    return S.checked_daily_counts(spark, f"{base}/out").join(late, "day", "full").select(
        "day", F.coalesce("complaints", none).alias("complaints"), F.coalesce("late", none).alias("late"))


@query("stream_ending_status", "SELECT complaint_id, status, changed_at FROM latest_status")
def q_stream_ending_status(spark, d):
    from plaint.streaming import intake as S
    base = _scratch(spark)
    q = S.start_ending_status_fold(FX.changes_from_events(S.events_stream(spark, d)), f"{base}/state", f"{base}/ckpt", 86_400_000)
    q.awaitTermination()
    return S.latest_status_table(spark, f"{base}/state")


@query("stream_latest_status", "SELECT complaint_id, status, changed_at FROM latest_status")
def q_stream_latest_status(spark, d):
    from plaint.streaming import intake as S
    base = _scratch(spark)
    q = S.start_status_fold(FX.changes_from_events(S.events_stream(spark, d)), f"{base}/state", f"{base}/ckpt")
    q.awaitTermination()
    return S.latest_status_table(spark, f"{base}/state")
