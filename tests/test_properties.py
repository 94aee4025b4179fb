"""Property tests over many generated inputs, one Spark job each."""

import random
import re

from pyspark.sql import functions as F

from conftest import SF01
from plaint import domains as D
from plaint.functions.rules import amount
from plaint.functions.text import mask_cards
from plaint.plans import views as V

# The card spec (fixed value): 4-4-4-x grouped digits or 13-19 contiguous digits, word-bounded.
CARD_SPEC = re.compile(r"\b(?:\d{4}[ -]){3}\d{1,7}\b|\b\d{13,19}\b")


def _texts(n=3000, seed=11):
    rnd = random.Random(seed)
    alphabet = "0123456789" * 4 + "  --ab.,"
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            if rnd.random() < 0.5:
                groups = [str(rnd.randint(0, 9999)).zfill(4) for _ in range(3)]
                tail = "".join(rnd.choice("0123456789") for _ in range(rnd.randint(1, 8)))
                sep = rnd.choice([" ", "-"])
                parts.append(sep.join(groups + [tail]))
            else:
                parts.append("".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))))
        text = rnd.choice([" ", " card ", "/"]).join(parts)
        if rnd.random() < 0.2:  # the digits of another script
            text = text.translate(str.maketrans("0123456789", rnd.choice(["०१२३४५६७८९", "٠١٢٣٤٥٦٧٨٩", "０１２３４５６７８９"])))
        out.append(text)
    return out


def test_mask_properties(spark):
    """Every card found by a left-to-right scan of the input is masked, in order, keeping
    its last four digits; nothing else is.  (Masking is not idempotent: a mask's last four
    digits may chain with digit groups after it into a new card-shaped run.)"""
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("t", mask_cards(F.col("t")).alias("m")).collect()
    total = 0
    for r in rows:
        cards = [re.sub(r"\D", "", m.group())[-4:] for m in CARD_SPEC.finditer(r.t)]
        masks = re.findall(r"XXXX-XXXX-XXXX-(\d{4})", r.m)
        assert masks == cards, (r.t, r.m)
        total += len(cards)
    assert total > 500


def test_amounts_in_any_script(spark):
    df = spark.createDataFrame([("₹ ५०००",), ("Rs. १,२३४.५ paid",), ("٧٠٠ rupees",), ("₹ 5०0",), ("𝟗𝟗 rs",)], "t string")
    assert [r.a for r in df.select(amount(F.col("t")).alias("a")).collect()] == [5000.0, 1234.5, 700.0, 500.0, 99.0]


def test_labels_are_in_their_domains_and_ids_are_gap_free(spark):
    c = V.complaints(spark, SF01, keep_source=True).cache()
    assert c.filter(~F.col("category").isin(D.CATEGORIES) | ~F.col("priority").isin(D.PRIORITIES)
                    | ~F.col("sentiment").isin(D.SENTIMENTS) | ~F.col("status").isin(D.STATUSES)).count() == 0
    seq = F.substring("complaint_id", 10, 10).cast("int")
    per_year = c.groupBy(F.year("created_at").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("complaint_id").alias("d"),
        F.min(seq).alias("lo"), F.max(seq).alias("hi")).collect()
    for r in per_year:
        assert r.n == r.d == r.hi and r.lo == 1
    c.unpersist()
