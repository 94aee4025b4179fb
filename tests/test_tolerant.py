"""Tolerant reads: broken lines go aside with a reason, good ones come through."""

import datetime as dt
import os

from plaint.operators import export as X
from plaint.sources import tolerant as TL

JSON = ['{"source_id": 1, "ts": "2024-01-02 03:04:05", "customer_name": "A", "raw_text": "one\\ntwo"}', '{"source_id": 2, "ts": "2024-01-02', "",
        "   ", "not json", "[1, 2]", '{"source_id": "x", "ts": "2024-01-02 03:04:05"}', '{"source_id": 3, "ts": "02.01.2024"}',
        '{"source_id": 4, "ts": "2024-02-30 00:00:00"}', '{"source_id": 5}', '{"source_id": null, "ts": "2024-01-02 03:04:05", "more": 1}']


def _write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write("\n".join(lines))


def test_json_lines(spark, tmpdir_path):
    _write(f"{tmpdir_path}/in", "a.json", JSON)
    got = TL.read_complaints(spark, f"{tmpdir_path}/in")
    assert sorted(map(tuple, got.rows.collect()), key=repr) == sorted([
        (1, dt.datetime(2024, 1, 2, 3, 4, 5), "A", "one\ntwo"), (None, dt.datetime(2024, 1, 2, 3, 4, 5), None, None)], key=repr)
    assert sorted((r.reason, r.line) for r in got.rejects.collect()) == sorted([
        ("malformed", JSON[1]), ("malformed", JSON[4]), ("malformed", JSON[5]), ("malformed", JSON[6]), ("bad time: ts", JSON[7]),
        ("bad time: ts", JSON[8]), ("missing: ts", JSON[9])])
    assert {r.file for r in got.rejects.collect()} == {"a.json"}
    none = TL.read_complaints(spark, f"{tmpdir_path}/missing")
    assert none.rows.count() == 0 and none.rejects.count() == 0


def test_csv_lines(spark, tmpdir_path):
    lines = ['1,2024-01-02 03:04:05,A,"text, with ""quotes"""', "x,2024-01-02 03:04:05,A,b", "2,yesterday,A,b", "3,2024-01-02 03:04:05,,=cmd"]
    _write(f"{tmpdir_path}/in", "a.csv", lines)
    got = TL.read_complaints(spark, f"{tmpdir_path}/in", "csv")
    assert sorted((r.source_id, r.raw_text) for r in got.rows.collect()) == [(1, 'text, with "quotes"'), (3, "=cmd")]
    assert sorted((r.reason, r.line) for r in got.rejects.collect()) == [("bad time: ts", lines[2]), ("malformed", lines[1])]


def test_results_with_broken_lines(spark, tmpdir_path):
    _write(f"{tmpdir_path}/in", "r.json", ['{"key": "hosted", "complaint_id": 1, "ok": true, "checks": {"safe": true}}', '{"key": "hosted", "complaint',
                                           '{"key": "hosted", "ok": true}'])
    got = X.read_results_checked(spark, f"{tmpdir_path}/in")
    assert [(r.key, r.complaint_id, r.checks) for r in got.rows.collect()] == [("hosted", 1, {"safe": True})]
    assert sorted(r.reason for r in got.rejects.collect()) == ["malformed", "missing: complaint_id"]


def test_intake_job_of_json_lines(spark, tmpdir_path):
    from plaint import jobs
    from plaint.operators import search_index as SX
    good = '{"source_id": 9, "ts": "2024-01-02 03:04:05", "customer_name": "", "raw_text": "My EMI was deducted twice"}'
    _write(f"{tmpdir_path}/in", "a.json", [good, "broken"])
    args = [f"--{k}={tmpdir_path}/{v}" for k, v in (("raw", "in"), ("store", "store"), ("quarantine", "q"))]
    jobs.main(["intake", *args, "--batch=b1", "--format=json", "--index"])
    assert [r.complaint_id for r in SX.search(spark, f"{tmpdir_path}/store", "emi").collect()] == ["CMP-2024-001"]
    assert [r.reason for r in spark.read.parquet(f"{tmpdir_path}/q_lines").collect()] == ["malformed"]
