"""Store: yearly IDs, idempotent appends, filters, search, lookup, status log."""

import datetime as dt
from pathlib import Path

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from plaint.operators import store as ST
from plaint.operators.evaluate import exact_median
from plaint.operators.sequence import sequence_within


def _rows(spark, items):
    return spark.createDataFrame(
        [(i, ts, name, text, cat, pri, "neutral", "ok") for i, ts, name, text, cat, pri in items],
        "source_id bigint, created_at timestamp_ntz, customer_name string, complaint string, category string, "
        "priority string, sentiment string, response string")


def test_ids_filters_and_status(spark, tmpdir_path):
    path = f"{tmpdir_path}/store"
    t = dt.datetime(2024, 5, 1, 10, 0, 0, 500000)
    a = ST.append(_rows(spark, [(1, t, "  Asha ", "EMI deducted twice", "loan", "medium")]), path, batch="b1")
    b = ST.append(_rows(spark, [(2, t, "", "Unauthorized txn", "fraud", "high")]), path, batch="b2")
    assert a.first().complaint_id == "CMP-2024-001" and b.first().complaint_id == "CMP-2024-002"
    # Replaying a batch replaces it instead of duplicating or renumbering.
    ST.append(_rows(spark, [(2, t, "", "Unauthorized txn", "fraud", "high")]), path, batch="b2")
    df = ST.read(spark, path)
    assert df.count() == 2
    first = df.filter(F.col("complaint_id") == "CMP-2024-001").first()
    assert first.customer_name == "Asha" and first.status == "Open" and first.created_at == t.replace(microsecond=0)
    assert ST.list_complaints(df, categories=["fraud"]).count() == 1
    assert ST.list_complaints(df, search="emi").count() == 1
    assert ST.list_complaints(df, search="   ").count() == 2
    assert ST.get(df, " cmp-2024-001 ").first().category == "loan"
    changes = spark.createDataFrame(
        [(1, "CMP-2024-001", t, "In Progress"), (2, "CMP-2024-001", t + dt.timedelta(hours=1), "Closed"),
         (3, "CMP-0000-999", t, "Closed"), (4, "CMP-2024-002", t, "Nonsense"), (5, "cmp-2024-002", t, "Closed")],
        ST.CHANGE_SCHEMA)
    applied = {r.complaint_id: r for r in ST.apply_status_updates(df, changes).collect()}
    assert applied["CMP-2024-001"].status == "Closed" and applied["CMP-2024-002"].status == "Open"
    assert {r.change_id for r in ST.unmatched_changes(df, changes).collect()} == {3, 5}
    assert [r.error for r in ST.status_change_rejects(changes).collect()] == ["Invalid status: 'Nonsense'"]


def test_ids_continue_and_grow_past_three_digits(spark, tmpdir_path):
    path = f"{tmpdir_path}/store"
    base = dt.datetime(2023, 1, 1)
    ST.append(_rows(spark, [(i, base + dt.timedelta(minutes=i), "", "x" * 12, "loan", "low") for i in range(999)]),
              path, batch="first")
    more = ST.append(_rows(spark, [(5000, dt.datetime(2023, 12, 31), "", "y" * 12, "loan", "low"),
                                   (5001, dt.datetime(2024, 1, 1), "", "z" * 12, "loan", "low")]), path, batch="2")
    assert sorted(r.complaint_id for r in more.collect()) == ["CMP-2023-1000", "CMP-2024-001"]


def test_clear_gives_typed_empty(spark, tmpdir_path):
    path = f"{tmpdir_path}/store"
    ST.clear(spark, path)
    assert ST.read(spark, path).count() == 0 and ST.read(spark, f"{tmpdir_path}/missing").count() == 0


def test_sequence_equals_row_number_with_hot_group(spark):
    rng = np.random.default_rng(7)
    n = 5000
    grp = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 5, n))   # one group holds ~60% of rows
    df = spark.createDataFrame([(int(i), int(g), int(rng.integers(0, 50))) for i, g in enumerate(grp)],
                               "k bigint, g int, t int")
    got = sequence_within(df, ["g"], ["t", "k"], "seq", partitions=7, size_col="size")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("t", "k")))
    j = got.join(want, ["k", "g", "t"])
    assert j.filter(F.col("seq") != F.col("rn")).count() == 0 and j.count() == n
    sizes = {r.g: r.size for r in got.select("g", "size").distinct().collect()}
    assert sizes == {r.g: r["count"] for r in df.groupBy("g").count().collect()}


def test_exact_median_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = [(int(i), "a" if i % 3 else "b", float(round(rng.random() * 10, 2))) for i in range(1001)]
    df = spark.createDataFrame(vals, "k bigint, p string, v double")
    got = {r.p: r.m for r in exact_median(df, ["p"], "v", "k", "m").collect()}
    for p in ("a", "b"):
        assert got[p] == float(np.median([v for _, q, v in vals if q == p]))


def _at(day, year=2024):
    return dt.datetime(year, 5, day, 10)


def _load(spark, path, batch, items):
    rows = ST.append(_rows(spark, [(i, ts, "", "x" * 12, "loan", "low") for i, ts in items]), path, batch=batch)
    return {r.created_at: r.complaint_id for r in rows.collect()}


def test_no_id_is_issued_twice_after_a_load_died_before_its_marks(spark, tmpdir_path):
    import shutil
    path = f"{tmpdir_path}/store"
    _load(spark, path, "a", [(1, _at(1)), (2, _at(2))])
    _load(spark, path, "b", [(3, _at(3)), (4, _at(4))])
    shutil.rmtree(f"{path}/_hwm/batch=b")                       # its rows were written, its marks were not
    assert sorted(_load(spark, path, "c", [(5, _at(5))]).values()) == ["CMP-2024-005"]
    ids = [r.complaint_id for r in ST.read(spark, path).collect()]
    assert len(ids) == len(set(ids)) == 5


def test_replay_of_an_older_batch_keeps_ids_and_drops_stale_years(spark, tmpdir_path):
    path = f"{tmpdir_path}/store"
    first = _load(spark, path, "a", [(1, _at(1)), (2, _at(2)), (9, _at(1, 2023))])
    _load(spark, path, "b", [(3, _at(3))])
    again = _load(spark, path, "a", [(1, _at(1)), (2, _at(2)), (7, _at(7))])
    assert again == {_at(1): first[_at(1)], _at(2): first[_at(2)], _at(7): "CMP-2024-004"}
    assert ST.read(spark, path).where(F.year("created_at") == 2023).count() == 0
    # the dropped row's ID is not issued again
    assert _load(spark, path, "d", [(8, _at(8, 2023))])[_at(8, 2023)] == "CMP-2023-002"


def test_lookup_and_window_read_one_year(spark, tmpdir_path):
    path = f"{tmpdir_path}/store"
    _load(spark, path, "a", [(1, _at(1)), (2, _at(2, 2022))])
    assert ST.lookup(spark, path, " cmp-2022-001 ").first().created_at == _at(2, 2022)
    assert ST.lookup(spark, path, "nonsense").count() == 0
    assert ST.read(spark, path, since=_at(1, 2023)).count() == 1
    plan = ST.lookup(spark, path, "CMP-2022-001")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def _files(path):
    return {str(f) for f in Path(path).rglob("*.parquet") if "_hwm" not in str(f)}


KEYED = ("source_id bigint, created_at timestamp_ntz, customer_name string, complaint string, category string, "
         "priority string, sentiment string, response string")


def test_append_gives_every_row_its_own_id(spark, tmpdir_path):
    """Null and repeated keys, equal rows included: one row in, one ID out; a replay keeps them."""
    path = f"{tmpdir_path}/store"
    rows = [(k, _at(day), "", text, "loan", "low", "neutral", "ok") for k, day, text in
            [(1, 1, "first text"), (1, 1, "other text"), (1, 1, "other text"), (2, 2, "second"), (None, 3, "no key"),
             (None, 3, "no key"), (None, 4, "no key either"), (7, 1, "first text")]]
    first = ST.append(spark.createDataFrame(rows, KEYED), path, batch="a").collect()
    assert sorted(r.complaint_id for r in first) == [f"CMP-2024-{i:03d}" for i in range(1, 9)]
    assert sorted(r.complaint for r in first) == sorted(r[3] for r in rows)
    # the batch comes again in another order, with one more row without a key
    more = [*reversed(rows), (None, _at(1), "", "a new one", "loan", "low", "neutral", "ok")]
    again = ST.append(spark.createDataFrame(more, KEYED), path, batch="a").collect()
    assert set(first) < set(again) and len(again) == len(rows) + 1
    assert [r.complaint_id for r in again if r.complaint == "a new one"] == ["CMP-2024-009"]


def test_append_numbers_a_key_that_holds_most_rows(spark, tmpdir_path):
    rows = spark.range(3000).selectExpr(
        "if(id % 3 = 0, id, null) as source_id", "timestamp_ntz'2024-05-01 10:00:00' as created_at", "'' as customer_name",
        "if(id % 3 = 1, 'same text here', concat('text number ', id)) as complaint", "'loan' as category", "'low' as priority",
        "'neutral' as sentiment", "'ok' as response")
    got = ST.append(rows, f"{tmpdir_path}/store", batch="a")
    numbers = sorted(int(r[0][9:]) for r in got.select("complaint_id").collect())
    assert numbers == list(range(1, 3001))


def test_append_evaluates_its_rows_once(spark, tmpdir_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    rows = _rows(spark, [(i % 40, _at(1 + i % 9), "", f"text {i}", "loan", "low") for i in range(50)])
    ST.append(rows.withColumn("complaint", counted("complaint")), f"{tmpdir_path}/store", batch="a")
    assert seen.value == 50


def test_merge_rewrites_changed_partitions_only(spark, tmpdir_path):
    path = f"{tmpdir_path}/store"
    for name, day, year in (("a", 1, 2024), ("b", 2, 2024), ("c", 1, 2022)):
        _load(spark, path, name, [(i, _at(day + i, year)) for i in range(3)])
    ids = sorted(r.complaint_id for r in ST.read(spark, path).where(F.year("created_at") == 2024).collect())
    t = dt.datetime(2024, 6, 1)
    changes = spark.createDataFrame(
        [(1, ids[0], t, "Closed"), (2, ids[0], t + dt.timedelta(days=1), "In Progress"), (3, ids[4], t, "Open"),
         (4, "CMP-2022-777", t, "Closed"), (5, "cmp-2022-001", t, "Closed"), (6, ids[5], t, "Gone"), (7, None, t, "Closed"),
         (8, "CMP-x", t, "Closed")], ST.CHANGE_SCHEMA)
    before, want = _files(path), sorted(ST.current(ST.read(spark, path), changes).collect())
    touched = [tuple(r) for r in ST.merge_status(spark, path, changes).collect()]
    assert touched == [(2024, "a", 1)]
    assert sorted(ST.read(spark, path).collect()) == want
    after = _files(path)
    assert {f for f in before if "year=2024/batch=a" not in f} == {f for f in after if "year=2024/batch=a" not in f}
    assert not {f for f in before if "year=2024/batch=a" in f} & after
    assert ST.merge_status(spark, path, changes).count() == 0 and _files(path) == after
    # what an append relies on is still there
    assert _load(spark, path, "d", [(99, _at(9))])[_at(9)] == "CMP-2024-007"


def _scanned(df):
    """Rows that the file scan of ``df`` hands on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_lookup_skips_row_groups_of_other_ids(spark, tmpdir_path, monkeypatch):
    path = f"{tmpdir_path}/store"
    monkeypatch.setitem(ST.LAYOUT, "parquet.block.size", str(1 << 16))
    monkeypatch.setitem(ST.LAYOUT, "parquet.page.size", "4096")
    rows = spark.range(20_000).selectExpr(
        "id as source_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) as created_at", "'' as customer_name",
        "repeat(md5(string(id)), 8) as complaint", "'loan' as category", "'low' as priority", "'neutral' as sentiment", "'ok' as response")
    ST.append(rows, path, batch="a")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = ST.lookup(spark, path, "cmp-2024-12345")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(complaint_id,CMP-2024-12345)" in plan
        assert [r.created_at for r in found.collect()] == [dt.datetime(2024, 1, 9, 13, 44)]
        assert _scanned(ST.lookup(spark, path, "cmp-2024-12345")) < 2000
        assert _scanned(ST.lookup(spark, path, "cmp-2024-12345x")) == 0  # inside the bounds of a row group: its bloom filter
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
