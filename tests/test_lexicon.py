"""Keywords from one pass over a text equal one test a keyword."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from plaint import domains as D
from plaint.functions import lexicon as L
from plaint.functions import rules
from plaint.sources import fixtures as FX
from plaint.sources.tables import table

EDGES = [None, "", "emi", "app apps application", "fees, fee; bill-billing", "unauthorizedfraudulent", "did not make not me!!!!", "éapp appé app",
         "log in login", "scam scammed", "HACKED by hack", "a_app app_a app", "😀loan😀"]


def test_hits_equal_single_tests(spark):
    rows = D.lexicon()
    texts = table(spark, SF001, "documents").select("text").union(FX.templates(spark).select("txt"))
    texts = texts.union(spark.createDataFrame([(t,) for t in [*EDGES, *(f"x {r.keyword} y" for r in rows)]], "text string")).withColumn("lt", F.lower("text"))
    single = F.filter(F.array(*[F.when(rules.keyword_hit(F.col("lt"), r), F.lit(i)) for i, r in enumerate(rows)]), lambda x: x.isNotNull())
    out = texts.select(L.keyword_hits(F.col("lt"), rows).alias("a"), single.alias("b"), "text").collect()
    assert all(r.a == r.b for r in out) and {i for r in out for i in r.a} == set(range(len(rows)))
    assert "Python" not in texts.select(L.keyword_hits(F.col("lt"), rows))._jdf.queryExecution().executedPlan().toString()


def test_lexicons_with_shared_beginnings_equal_brute_force(spark):
    rng = random.Random(3)
    word = "[^\\W]"
    for _ in range(6):
        keywords = ["".join(rng.choice("ab .(é") for _ in range(rng.randint(1, 4))) for _ in range(30)]
        keywords += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(20)]
        rows = [D.LexiconRow(rng.choice(["category", "high"]), "x", 1.0, k) for k in keywords]
        texts = ["".join(rng.choice("ab .(é") for _ in range(rng.randint(0, 12))) for _ in range(40)]

        def holds(text, row):
            at = re.escape(row.keyword)
            return bool(re.search(f"(?<!{word}){at}(?!{word})" if row.whole_word else at, text))

        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        got = dict(df.select("i", L.keyword_hits(F.col("text"), rows)).collect())
        assert got == {i: [n for n, r in enumerate(rows) if holds(t, r)] for i, t in enumerate(texts)}


def test_large_empty_and_refused_lexicons(spark):
    df = spark.createDataFrame([("w17 w1999 x",), (None,), ("",)], "text string")
    rows = [D.LexiconRow("high", "high", 1.0, f"w{i}") for i in range(2000)]
    counts = {r.keyword: r.complaints for r in L.keyword_report(df, "text", rows).collect()}
    assert len(counts) == 2000 and {k for k, n in counts.items() if n} == {"w1", "w17", "w19", "w199", "w1999"}
    assert L.keyword_report(df, "text", []).count() == 0
    assert [r[0] for r in df.select(L.keyword_hits(F.col("text"), [])).collect()] == [[], [], []]
    with pytest.raises(ValueError):
        L.keyword_hits(F.col("text"), [D.LexiconRow("high", "high", 1.0, "")])
