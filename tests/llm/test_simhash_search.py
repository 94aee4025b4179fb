"""The search by permuted block tables against all pairs, with blocks and fingerprints that many rows share."""

import random

import pytest
from pyspark.sql import functions as F

from plaint.llm import simhash


@pytest.mark.parametrize("frequent, radius", [(5, 3), (4000, 3), (50, 1), (50, 7)])
def test_neighbours_of_rows_equal_all_pairs(spark, monkeypatch, frequent, radius):
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    rng = random.Random(radius)
    marks = [rng.getrandbits(128) for _ in range(120)]
    for m in list(marks):
        for _ in range(rng.randrange(9)):
            m ^= 1 << rng.randrange(128)
        marks.append(m)
    family = rng.getrandbits(128)  # a third of all: one block in common, and many equal
    marks += [family ^ rng.getrandbits(2) for _ in range(60)] + [family ^ (rng.getrandbits(40) << 80) for _ in range(60)]
    rows = [(i, f"{m:032x}") for i, m in enumerate(marks)] + [(7, f"{marks[7]:032x}"), (None, f"{family:032x}"), (400, None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    got = sorted(simhash.with_neighbours(df.where("fingerprint is not null"), F.col("doc_id") % 7 == 0, radius).collect(), key=str)
    held = [(i, int(f, 16)) for i, f in rows if f]
    want = [(i, f"{m:032x}", sum((m ^ x).bit_count() <= radius for _, x in held) - 1 if i is not None and i % 7 == 0 else None) for i, m in held]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    pairs = [tuple(r) for r in simhash.neighbours(df, df, radius).select("query", "fingerprint", "distance").collect()]
    distinct = {m for _, m in held}
    assert sorted(pairs) == sorted((f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in distinct for b in distinct if (a ^ b).bit_count() <= radius)


def test_search_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, fingerprint string")
    assert simhash.with_neighbours(df, F.col("doc_id") % 50 == 0).columns == ["doc_id", "fingerprint", "n_near"]
    assert simhash.with_neighbours(df, F.col("doc_id") % 50 == 0).collect() == []
