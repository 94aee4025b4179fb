"""Dashboard analytics over a complaints DataFrame.

Every report is a single scan: KPI counts, week windows, shares and the text reports
come from one global conditional aggregation (partial aggregation per task, a single
tiny final merge), not one pass per number.  Distributions group by the label and
join the 3-4 row domain table so every domain value appears, zero-filled, in order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.sources import tables
from plaint.sources.fixtures import age_days, ntz

def _closed() -> Column:
    return F.col("status").eqNullSafe("Closed")


def _not_closed() -> Column:
    """'Open' KPI: anything not Closed, so In Progress counts as open."""
    return ~_closed()


def _now(now: dt.datetime | Column | None) -> Column:
    if now is None:
        return F.current_timestamp().cast("timestamp_ntz")
    if isinstance(now, dt.datetime):
        return ntz(now)
    return now


def last_7(now: Column) -> Column:
    return F.col("created_at") > now - F.expr("INTERVAL 7 DAYS")


def prev_7(now: Column) -> Column:
    return (F.col("created_at") <= now - F.expr("INTERVAL 7 DAYS")) & (
        F.col("created_at") > now - F.expr("INTERVAL 14 DAYS"))


# ------------------------------------------------------------------------------ C1
def kpi_summary(df: DataFrame) -> DataFrame:
    """total, one count per category, open (= not Closed), closed; zeros when empty."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("category") == c).alias(c) for c in ["fraud", "loan", "billing", "app_issue"]],
        F.count_if(_not_closed()).alias("open"),
        F.count_if(_closed()).alias("closed"),
    )


# ------------------------------------------------------------------------- C2-C5, J1
def distribution(df: DataFrame, column: str, domain: str) -> DataFrame:
    """(ord, code, label, n): every domain value in domain order, 0 when absent."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(column).alias("code")).agg(F.count(F.lit(1)).alias("_n"))
    dom = tables.domain(spark, domain).select("ord", "code", "label")
    return (dom.join(counts, "code", "left")
            .select("ord", "code", "label", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n")))


def category_counts(df: DataFrame) -> DataFrame:
    return distribution(df, "category", "category")


def priority_counts(df: DataFrame) -> DataFrame:
    return distribution(df, "priority", "priority")


def sentiment_counts(df: DataFrame) -> DataFrame:
    return distribution(df, "sentiment", "sentiment")


def status_counts(df: DataFrame) -> DataFrame:
    return distribution(df, "status", "status")


def all_distributions(df: DataFrame) -> DataFrame:
    """C2-C5 from one scan: (domain, ord, code, label, n) by grouping sets over the four labels.

    Every domain value has a row, 0 when absent.  A label outside its domain, null included,
    is a row of its own with a null ord, its code as label, and its count, so the counts of a
    domain always add up to the complaints.
    """
    names = ["category", "priority", "sentiment", "status"]
    sets = df.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names])
    counts = sets.agg(F.count(F.lit(1)).alias("_n"), *[F.grouping(n).alias(f"_not_{n}") for n in names])
    domain = F.coalesce(*[F.when(F.col(f"_not_{n}") == 0, F.lit(n)) for n in names])
    counts = counts.select(domain.alias("_domain"), F.coalesce(*names).alias("_code"), "_n")
    known = tables.domains(df.sparkSession)
    both = known.join(counts, (F.col("domain") == F.col("_domain")) & (F.col("code") == F.col("_code")), "full")
    return both.select(F.coalesce("domain", "_domain").alias("domain"), "ord", F.coalesce("code", "_code").alias("code"),
                       F.coalesce("label", "_code").alias("label"), F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


# ------------------------------------------------------------------------------ C6, J2
def daily_trend(df: DataFrame) -> DataFrame:
    """(day, complaints): per-day counts, gap-filled from the first to the last day.

    Days are counted once (partial aggregation); each counted day then brings the empty days
    up to the next counted one.  The window that finds it is over one row a day of the
    calendar, which does not grow with the complaints.
    """
    counts = df.where(F.col("created_at").isNotNull()).groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("complaints"))
    following = F.lead("day").over(Window.orderBy("day"))
    runs = counts.select("day", "complaints", F.coalesce(F.date_sub(following, 1), "day").alias("_last"))
    days = F.sequence("day", "_last", F.expr("INTERVAL 1 DAY"))
    return runs.select(F.posexplode(days).alias("_i", "_day"), "complaints").select(
        F.col("_day").alias("day"), F.when(F.col("_i") == 0, F.col("complaints")).otherwise(0).cast("bigint").alias("complaints"))


# ------------------------------------------------------------------------------ C7
def week_over_week_counts(df: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """(ord, category, label, last_7, prev_7) for all four categories.

    last = ``created_at > now-7d`` (no upper bound); prev = ``now-14d < created_at <= now-7d``.
    Only rows newer than ``now-14d`` can count, so that filter goes first (and reaches
    the parquet scan when the table is stored with ``created_at``).
    """
    n = _now(now)
    recent = df.filter(F.col("created_at") > n - F.expr("INTERVAL 14 DAYS"))
    counts = recent.groupBy(F.col("category").alias("code")).agg(
        F.count_if(last_7(n)).alias("_last"), F.count_if(prev_7(n)).alias("_prev"))
    dom = tables.domain(df.sparkSession, "category").select("ord", "code", "label")
    return dom.join(counts, "code", "left").select(
        "ord", F.col("code").alias("category"), "label",
        F.coalesce(F.col("_last"), F.lit(0)).cast("bigint").alias("last_7"),
        F.coalesce(F.col("_prev"), F.lit(0)).cast("bigint").alias("prev_7"))


def category_trend(df: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """C7 plus the change ratio and its direction."""
    w = week_over_week_counts(df, now)
    change = F.when(F.col("prev_7") > 0, (F.col("last_7") - F.col("prev_7")) / F.col("prev_7"))
    direction = (F.when(F.col("prev_7") > 0,
                        F.when(F.col("last_7") > F.col("prev_7"), "increase")
                        .when(F.col("last_7") < F.col("prev_7"), "decrease").otherwise("flat"))
                 .when(F.col("last_7") > 0, "new").otherwise("none"))
    return w.select("*", change.cast("double").alias("change"), direction.alias("direction"))


# ------------------------------------------------------------------------- C8-C11
def high_priority_health(df: DataFrame) -> DataFrame:
    high = F.col("priority") == "high"
    return df.agg(
        F.coalesce(F.avg(high.cast("double")), F.lit(0.0)).alias("high_share"),
        F.count_if(high & _not_closed()).alias("open_high"))


def upset_share(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.avg(F.col("sentiment").isin("angry", "frustrated").cast("double")),
                             F.lit(0.0)).alias("upset_share"))


def top_category(df: DataFrame) -> DataFrame:
    """Largest category (ties: domain order) with its share; one scan, no sort."""
    agg = df.agg(F.count(F.lit(1)).alias("total"),
                 *[F.count_if(F.col("category") == c).alias(f"c{i}") for i, c in enumerate(D.CATEGORIES)])
    cands = F.array(*[F.struct((-F.col(f"c{i}")).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("category"),
                               F.lit(D.CATEGORY_LABELS[c]).alias("label"), F.col(f"c{i}").alias("n"))
                      for i, c in enumerate(D.CATEGORIES)])
    best = F.array_min(cands)
    return agg.filter(F.col("total") > 0).select(
        best["category"].alias("category"), best["label"].alias("label"), best["n"].alias("n"),
        (best["n"] / F.col("total")).alias("share"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- C12, S19
def _pct(x: Column) -> Column:
    """``format(x, '.0%')``: half-even percent text."""
    return F.concat(F.bround(x * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def _summary_row(df: DataFrame, now: Column) -> DataFrame:
    """Every number the text reports need, in one aggregation row."""
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(_not_closed()).alias("open"),
            F.count_if(_closed()).alias("closed"),
            F.count_if(F.col("priority") == "high").alias("high"),
            F.count_if((F.col("priority") == "high") & _not_closed()).alias("open_high"),
            F.count_if(F.col("sentiment").isin("angry", "frustrated")).alias("upset")]
    for d, o, c, _ in D.domain_rows():
        if d != "status":
            aggs.append(F.count_if(F.col(d) == c).alias(f"{d}__{o}"))
    for i, c in enumerate(D.CATEGORIES):
        aggs.append(F.count_if((F.col("category") == c) & last_7(now)).alias(f"last__{i}"))
        aggs.append(F.count_if((F.col("category") == c) & prev_7(now)).alias(f"prev__{i}"))
    return df.agg(*aggs)


def stats_text(df: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """One row, one column ``stats``: the compact statistics text."""
    n = _now(now)
    s = _summary_row(df, n)

    def by(domain: str) -> Column:
        parts = [F.concat(F.lit(f"{lbl}="), F.col(f"{d}__{o}").cast("string"))
                 for d, o, _, lbl in D.domain_rows() if d == domain]
        return F.concat_ws(", ", *parts)

    lines = [
        F.concat(F.lit("Total complaints: "), F.col("total").cast("string"),
                 F.lit(" (open/in progress: "), F.col("open").cast("string"),
                 F.lit(", closed: "), F.col("closed").cast("string"), F.lit(")")),
        F.concat(F.lit("By category: "), by("category")),
        F.concat(F.lit("By priority: "), by("priority")),
        F.concat(F.lit("By sentiment: "), by("sentiment")),
    ]
    week = [F.when(F.col("total") > 0, F.concat(
        F.lit(f"{D.CATEGORY_LABELS[c]} last 7 days="), F.col(f"last__{i}").cast("string"),
        F.lit(", previous 7 days="), F.col(f"prev__{i}").cast("string")))
        for i, c in enumerate(D.CATEGORIES)]
    return s.select(F.concat_ws("\n", *lines, *week).alias("stats"))


def insights(df: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """(ord, insight): the plain-language findings, in order; one fixed line when empty."""
    n = _now(now)
    s = _summary_row(df, n)
    total = F.col("total")
    cands = F.array(*[F.struct((-F.col(f"category__{i}")).alias("neg"), F.lit(i).alias("ord"),
                               F.lit(D.CATEGORY_LABELS[c]).alias("label"), F.col(f"category__{i}").alias("n"))
                      for i, c in enumerate(D.CATEGORIES)])
    top = F.array_min(cands)
    lines = [
        F.concat(F.lit("**"), top["label"], F.lit("** is the largest complaint category: "),
                 top["n"].cast("string"), F.lit(" cases ("), _pct(top["n"] / total),
                 F.lit(" of all complaints).")),
        F.concat(_pct(F.col("high") / total), F.lit(" of complaints are high priority; **"),
                 F.col("open_high").cast("string"),
                 F.lit("** high-priority complaint(s) are still unresolved.")),
        F.concat(_pct(F.col("upset") / total), F.lit(" of customers sound angry or frustrated.")),
    ]
    for i, c in enumerate(D.CATEGORIES):
        last, prev, label = F.col(f"last__{i}"), F.col(f"prev__{i}"), D.CATEGORY_LABELS[c]
        change = (last - prev) / prev
        lines.append(
            F.when(prev > 0,
                   F.when(last > prev, F.concat(
                       F.lit(f"{label} complaints **increased by "), _pct(change),
                       F.lit("** vs the previous 7 days ("), prev.cast("string"), F.lit(" → "),
                       last.cast("string"), F.lit(")."))).when(last < prev, F.concat(
                           F.lit(f"{label} complaints **decreased by "), _pct(F.abs(change)),
                           F.lit("** vs the previous 7 days ("), prev.cast("string"), F.lit(" → "),
                           last.cast("string"), F.lit(")."))))
            .when(last > 0, F.concat(F.lit(f"{label}: "), last.cast("string"),
                                     F.lit(" new complaint(s) this week (none in the previous 7 days)."))))
    items = F.array(*[F.struct(F.lit(i).cast("int").alias("ord"), x.alias("insight")) for i, x in enumerate(lines)])
    empty = F.array(F.struct(F.lit(0).cast("int").alias("ord"), F.lit(D.NO_DATA_INSIGHT).alias("insight")))
    chosen = F.when(total > 0, items).otherwise(empty)
    return s.select(F.inline(chosen)).filter(F.col("insight").isNotNull())


# ------------------------------------------------------------------------------ C13
def age_band(age: Column) -> Column:
    return F.when(age > 10, "over_10_days").when(age > 3, "4_to_10_days").otherwise("0_to_3_days")


def ageing_by_status(df: DataFrame, now: dt.datetime | Column | None = None) -> DataFrame:
    """(age_band, status, n): complaints by age band at ``now`` and status."""
    n = _now(now)
    return (df.groupBy(age_band(age_days(F.col("created_at"), n)).alias("age_band"), "status")
            .agg(F.count(F.lit(1)).alias("n")))

