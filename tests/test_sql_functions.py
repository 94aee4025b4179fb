"""SQL functions equal the Columns, and stay in the JVM."""

from pyspark.sql import functions as F

from conftest import SF001
from plaint.functions import rules
from plaint.functions import sql as SF
from plaint.functions.text import clean_text, mask_cards
from plaint.sources import fixtures as FX
from plaint.sources.tables import table

EDGES = [None, "", "  \t x ", "Paid Rs. 25,000 and ₹1,2 or ५०० rupees", "card 4111 1111 1111 1234!", "it's a 'quoted' \\ text", "emi app, lag",
         "rs , rs 12.5rs"]


def test_sql_functions_equal_columns(spark):
    docs = table(spark, SF001, "documents").select("text").union(spark.createDataFrame([(t,) for t in EDGES], "text string"))
    docs = docs.union(FX.templates(spark).select("txt"))
    assert SF.register(spark) == SF.register(spark)
    docs.createOrReplaceTempView("sql_function_texts")
    got = spark.sql("""SELECT text, complaint_clean(text) AS cleaned, complaint_mask(text) AS masked, complaint_amount(text) AS amount,
        complaint_category(text) AS category, complaint_sentiment(text) AS sentiment,
        complaint_priority('loan', text) AS priority FROM sql_function_texts""")
    lowered = F.lower("text")
    scores = {c: rules.category_score(lowered, c) for c in ("fraud", "loan", "billing", "app_issue")}
    want = docs.select("text", clean_text(F.col("text")).alias("cleaned"), mask_cards(F.col("text")).alias("masked"),
                       rules.amount(F.col("text")).alias("amount"), rules.category_from_scores(scores).alias("category"),
                       rules.sentiment(lowered).alias("sentiment"),
                       rules.priority(F.lit("loan"), lowered, rules.amount(F.col("text"))).alias("priority"))
    key = lambda r: repr(tuple(r))
    a, b = sorted(map(tuple, got.collect()), key=key), sorted(map(tuple, want.collect()), key=key)
    assert [x for x in a if x[0] is not None] == [x for x in b if x[0] is not None] and len(a) == len(b)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
