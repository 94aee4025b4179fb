"""Very long texts and item sets: equal results in parts, and bounded memory of one process."""

import random
import re
import subprocess
import sys

import numpy as np
import pytest

from plaint.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def peak_mb(code: str) -> int:
    """Highest resident memory of a fresh process that runs ``code``."""
    code += "\nimport resource\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    return int(done.stdout.split()[-1])


def occurrences(text, items, window):
    words = WORD.findall((text or "").encode().lower())
    hit, found = set(), set()
    for item, t in items:
        part = WORD.findall((t or "").encode().lower())
        n = min(window, len(part))
        for k in range(len(part) - n + 1 if n and item is not None else 0):
            for a in range(len(words) - n + 1):
                if words[a : a + n] == part[k : k + n]:
                    hit.update(range(a, a + n))
                    found.add(str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [3, 20, 1 << 20])
def test_windows_in_parts_equal_brute_force(monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", part_bytes)
    rng = random.Random(part_bytes)
    for _ in range(40):
        alphabet = ["a", "b", "C", "dé", "9"][: rng.randint(1, 5)]

        def text(n, alphabet=alphabet):
            return rng.choice([" ", "-", "  "]).join(rng.choice(alphabet) for _ in range(n))

        items = [(rng.choice([1, 2, 3, 10, None]), rng.choice([None, text(rng.randint(0, 14))])) for _ in range(rng.randint(0, 6))]
        window = rng.choice([1, 2, 4, 10])
        tables = decontaminate.Windows(items, window)
        for t in ["", *(text(rng.randint(0, 40)) for _ in range(6))]:
            raw = np.frombuffer(t.encode(), np.uint8)
            n, hits, found = decontaminate._long(raw, 0, len(raw), tables)
            assert (n, hits.tolist(), found) == occurrences(t, items, window)


def test_contamination_memory():
    assert peak_mb("""
import pyarrow as pa
from plaint.llm import decontaminate as d
(n, hits, items), = d._matches(pa.array(["test " * (2 << 20)]), d.Windows([(1, "test " * 12)]))
assert n == len(hits) == 2 << 20 and items == ["1"]
""") < 600
    assert peak_mb("""
from plaint.llm import decontaminate as d
words = [f"w{i * 7919 % 1000003}" for i in range(1_100_000)]
d.Windows([(k, " ".join(words[k : k + 100])) for k in range(0, len(words), 100)])
""") < 1000


def test_personal_data_memory():
    """8 MB of numbers: over a million mentions in one graph."""
    assert peak_mb("""
from plaint.llm import pii
text = " ".join(str(100000 + i * 7919 % 900000) for i in range(1_170_000))
(base, added), = pii.find([text], pii.Field.prior())
assert not base and not added
""") < 800


def test_weights_come_from_distinct_whole_texts(spark, monkeypatch):
    """A text on a third of all rows is one example; texts beyond the token bound are left out, none is cut."""
    import plaint.llm.pii as pii
    long = " ".join(f"+1 (988) 555-{i:04d}" for i in range(300))
    rows = [(i, f"call +1 (988) 555-24{i:02d} or 98855524{i:02d}" if i % 3 else long) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(pii, "train", lambda examples: seen.append(examples))
    pii.fit(docs)
    assert sorted(len(e[1]) for e in seen[0]) == [4] * 60 + [900]
    pii.fit(docs, tokens=500)
    assert [len(e[1]) for e in seen[1]] == [4] * 60
    pii.fit(docs, tokens=3)
    assert seen[2] == []
