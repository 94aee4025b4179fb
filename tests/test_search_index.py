"""Keyword search by trigrams: the rows of a full scan, from fewer texts."""

import datetime as dt

from plaint.operators import search_index as SX
from plaint.operators import store as ST

TEXTS = ["EMI deducted twice", "Ünauthorised txn of ₹500", "the app CRASHES daily", "ab", "", "refund pending, refund denied", "a%b_c literal",
         "back\\slash", "ΟΔΟΣ closed", "İstanbul branch"]
TERMS = ["emi", " EMI ", "crash", "refund", "r%fund", "ref_nd p", "₹5", "₹50", "ünauth", "ab", "b_c", "%", "___", "slash", "k\\s", "οδος", "İsta",
         "cmp-2024-01", "user 1", "no such text", "", "x" * 50, "%%twice", "d t%e"]


def _store(spark, path, n=60):
    for batch in ("a", "b"):
        rows = [(f"{batch}{i}", dt.datetime(2023 + i % 2, 5, 1, 10, 0, i % 60), f"User {i % 7}", f"{TEXTS[i % len(TEXTS)]}", "loan", "low",
                 "neutral", "ok") for i in range(n)]
        ST.append(spark.createDataFrame(rows, "source_id string, created_at timestamp_ntz, customer_name string, complaint string, "
                                              "category string, priority string, sentiment string, response string"), path, batch=batch)


def test_index_finds_what_a_scan_finds(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/store"
    _store(spark, path)
    SX.index_batch(spark, path, "a")  # "b" has no postings: it is read in full
    for round_ in range(2):
        for i, term in enumerate(TERMS):
            monkeypatch.setattr(SX, "CANDIDATES", 5 if i % 2 else 10_000)
            got = sorted(r.complaint_id for r in SX.search(spark, path, term).collect())
            want = sorted(r.complaint_id for r in ST.list_complaints(ST.read(spark, path), search=term).collect())
            assert got == want, term
        SX.index_batch(spark, path, "b")
    assert SX.search(spark, f"{tmpdir_path}/none", "emi").count() == 0


def _texts_scanned(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(x.metrics().apply("numOutputRows").value() for x in found)


def test_a_rare_term_reads_few_texts(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/store"
    monkeypatch.setitem(ST.LAYOUT, "parquet.block.size", str(1 << 16))
    monkeypatch.setitem(ST.LAYOUT, "parquet.page.size", "4096")
    rows = spark.range(20_000).selectExpr(
        "id as source_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) as created_at", "'' as customer_name",
        "if(id = 7777, 'zebra crossing', concat('complaint ', repeat(sha(string(id)), 3))) as complaint", "'loan' as category",
        "'low' as priority", "'neutral' as sentiment", "'ok' as response")
    ST.append(rows, path, batch="a")
    SX.index_batch(spark, path, "a")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = SX.search(spark, path, "Zebra C")
        assert [r.complaint for r in found.collect()] == ["zebra crossing"]
        assert _texts_scanned(SX.search(spark, path, "Zebra C")) < 3000
        assert _texts_scanned(ST.list_complaints(ST.read(spark, path), search="Zebra C", ordered=False)) == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_an_index_of_lists_a_block_at_a_time(spark, tmpdir_path, monkeypatch):
    """One list for each trigram of a block, without a shuffle; also for complaints without a time."""
    path = f"{tmpdir_path}/store"
    at = dt.datetime(2024, 5, 1)
    rows = [(f"CMP-{y or 'null'}-{i:03d}", at if y else None, "", f"parcel {'lost' if i % 3 else 'late'}", "loan", "low", "neutral", "ok", "Open", "ai",
             str(i), 1, y, "a") for y in (2023, 2024, None) for i in range(1, 61)]
    loose = "complaint_id string, created_at timestamp_ntz, customer_name string, complaint string, category string, priority string, " \
            "sentiment string, response string, status string, mode string, source_key string, occurrence bigint, year int, batch string"
    ST.write_rows(spark.createDataFrame(rows, loose).coalesce(1), path)
    monkeypatch.setattr(SX, "BLOCK", 500)
    SX.index_batch(spark, path, "a")
    lists = SX.read_postings(spark, path).where("gram = 'lat'").collect()
    assert sorted((r.year or 0, s) for r in lists for s in r.seqs) == sorted((y or 0, i) for y in (2023, 2024, None) for i in range(3, 61, 3))
    assert 3 < len(lists) < 30
    for few in (10_000, 5):
        monkeypatch.setattr(SX, "CANDIDATES", few)
        for term in ("late", "CMP-null-01", "parcel l"):
            got = sorted(r.complaint_id for r in SX.search(spark, path, term).collect())
            assert got and got == sorted(r.complaint_id for r in ST.list_complaints(ST.read(spark, path), search=term).collect()), term
