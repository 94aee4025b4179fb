"""URL filter: list rules, and gradient-boosted trees on lexical features for the rest.

DataFrame functions and the machine-learning library's DataFrame API only.  The trees
learn from URLs that a rule has labelled, so they carry a list's taste to hosts and paths
it does not name.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import LOWER, UPPER, spread_join
from plaint.session import materialize

#: (verdict, host/path) rules; a host covers its subdomains.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Distinct URLs, half of them of each label, first by a hash, that the trees are trained on.
SAMPLE_ROWS, TREES, DEPTH = 8000, 20, 4
#: Suffixes, and bytes of them, up to which their statistics are broadcast.
BROADCAST_SUFFIXES, BROADCAST_BYTES = 200_000, 8 << 20
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/%=&?:#+"
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy", "parameters",
            "escapes", "longest_label", "suffix_length", "suffix_count", "suffix_hosts")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _occurrences(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that one URL gives, from columns url, host and path."""
    url = F.lower(F.coalesce("url", F.lit("")))
    counts = F.array(*(_occurrences(url, c).cast("double") for c in ALPHABET))
    df = df.withColumn("_counts", counts)
    total = F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * F.log2(F.greatest(x, F.lit(1.0))))
    digits = F.aggregate(F.slice("_counts", 27, 10), F.lit(0.0), lambda a, x: a + x)
    at = ALPHABET.index
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return (
        df.withColumn("length", F.length(url).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("path_length", F.length("path").cast("double"))
        .withColumn("depth", _occurrences(F.col("path"), "/").cast("double"))
        .withColumn("labels", (_occurrences(F.col("host"), ".") + 1).cast("double"))
        .withColumn("digit_ratio", digits / F.greatest(F.length(url), F.lit(1)))
        .withColumn("hyphens", F.col("_counts")[at("-")])
        .withColumn("escapes", F.col("_counts")[at("%")])
        .withColumn("entropy", F.when(total > 0, F.log2(F.greatest(total, F.lit(1.0))) - bits / F.greatest(total, F.lit(1.0))).otherwise(0.0))
        .withColumn("parameters", F.when(query != "", _occurrences(query, "&") + 1).otherwise(0).cast("double"))
        .withColumn("longest_label", F.length(F.regexp_extract("host", "^([^.]*)", 1)).cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -2))
        .withColumn("suffix_length", F.length("suffix").cast("double"))
        .drop("_counts"))


def suffix_statistics(rows: DataFrame) -> DataFrame:
    """(suffix, n, suffix_count, suffix_hosts): pages and distinct hosts of each suffix of ``rows``."""
    hosts = rows.groupBy(F.substring_index("host", ".", -2).alias("suffix"), "host").agg(F.count("*").alias("n"))
    return hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.log1p(F.sum("n")).alias("suffix_count"), F.log1p(F.count("*")).alias("suffix_hosts"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of each row of ``pages``.

    verdict: the longest fitting rule's, else the trees' (score: their probability of
    block).  Null URLs and those without ``://`` have an empty host and path and go to the
    trees too.  Where the rules label no URL, or all alike, that label (or allow) is the
    verdict of the rest and the score is null.  Repeated rows have equal results.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    labelled = rows.where("ruled is not null").select("url", "host", "path", "ruled").dropDuplicates(["url"])

    def first(kind: str) -> DataFrame:
        return labelled.where(F.col("ruled") == kind).orderBy(F.xxhash64("url"), "url").limit(max(1, SAMPLE_ROWS // 2))

    sample = materialize(lexical(first("allow").union(first("block"))).withColumn("label", (F.col("ruled") == "block").cast("double")))
    seen = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if len(seen) < 2:
        only = "block" if 1.0 in seen else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(only)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    total = seen[0.0] + seen[1.0]
    weight = F.when(F.col("label") == 1.0, total / (2 * seen[1.0])).otherwise(total / (2 * seen[0.0]))
    suffixes = materialize(suffix_statistics(rows))
    amount = suffixes.agg(F.count("*"), F.sum(F.octet_length("suffix")), F.sum("n")).first()
    small = amount[0] <= BROADCAST_SUFFIXES and amount[1] <= BROADCAST_BYTES

    def described(df: DataFrame, dealt: bool = False) -> DataFrame:
        # the table holds the suffix of every page
        if dealt and not small:
            df = df.withColumn("deal", F.xxhash64("page_id", "url"))
            known = spread_join(df, suffixes, "suffix", "deal", amount[2]).drop("deal")
        else:
            known = df.join(F.broadcast(suffixes) if small else suffixes, "suffix")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)

    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, labelCol="label", weightCol="weight").fit(
        described(sample).select("features", "label", weight.alias("weight")))
    rest = trees.transform(described(lexical(rows), dealt=True))
    score = F.element_at(vector_to_array("probability"), 2)
    return rest.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))

