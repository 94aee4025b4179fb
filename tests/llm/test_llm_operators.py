"""The training-data operators against brute force on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re
import zlib
from html import unescape

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaint.llm import bpe, catalog, common, decontaminate, html, language, minhash, ngram, pii, simhash, toxicity, urls
from plaint.llm.common import table
from plaint.llm.components import components

SF = "/root/testdata/sf0.001"
LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string"


@pytest.fixture(scope="module")
def rows(spark):
    """Documents of the smallest table and awkward ones: (id, text)."""
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    base = " ".join(f"word{i}" for i in range(60))
    return docs + [
        (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two"), (9005, "ONE  two"), (9006, base), (9007, base + " tail"),
        (9008, base), (9009, "x " * 30_000), (9010, "日本語 テキスト ünï 😀 ½ \x1c"), (9011, "0" * 5000 + "@" * 50), (9012, "a" * 20_000), (9012, "a" * 20_000),
        (None, base), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, None, None, 1.0, "x") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(i):
    return zlib.crc32(str(i).encode())


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (5, 5), (7, 6), (6, 8), (8, 9), (9, 1), (None, 4), (20, 21), (20, 21)] + [(i, i + 1) for i in range(100, 160)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    want = {1: 1, 2: 1, 3: 1, 6: 1, 7: 1, 8: 1, 9: 1, 4: 4, 5: 4, 20: 20, 21: 20, **{i: 100 for i in range(100, 161)}}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_star_centre_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD_PARTS", 20)
    star = spark.range(1, 3001).selectExpr("id as u", "0L as v").union(spark.range(5000, 5010).selectExpr("id as u", "id + 1 as v"))
    got = dict(components(star).collect())
    assert got == {**{i: 0 for i in range(3001)}, **{i: 5000 for i in range(5000, 5011)}}
    rows = star.selectExpr("v as k", "u").union(spark.sql("select null, 7L"))
    per_key = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    joined = common.spread_join(rows, per_key, "k", "u", 3011)
    assert sorted(joined.collect()) == sorted(rows.join(per_key, "k").select(joined.columns).collect())


@pytest.mark.parametrize("parts", [5, 10_000])
def test_components_of_random_links(spark, monkeypatch, parts):
    monkeypatch.setattr(common, "SPREAD_PARTS", parts)
    rng = random.Random(parts)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(rng.randrange(400, 700), 400) for _ in range(200)]
    top = {x: x for e in edges for x in e}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        top[b] = a
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert len(got) == len(linked) and dict(got) == {x: root(x) for x in linked}


def test_components_take_few_tasks(spark):
    """Links in a table of 40 parts, told apart from stars by one count; a round is five shuffles, not eight, of one scan each."""
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    tracker, tasks = spark.sparkContext.statusTracker(), {}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        for kind, links in (("stars", "id - id % 5"), ("chains", "if(id % 5 = 0, id, id - 1)")):
            spark.sparkContext.setJobGroup(kind, kind)
            assert components(spark.range(500).selectExpr("id as u", f"{links} as v")).count() == 500
            found = {s for j in tracker.getJobIdsForGroup(kind) for s in tracker.getJobInfo(j).stageIds}
            tasks[kind] = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, found) if i)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks["stars"] <= 40 * 8 and tasks["chains"] <= 40 * 40, tasks


def test_large_clusters_are_dealt_over_parts(spark, monkeypatch):
    """The join of clusters with their sizes, like that of keys, gives no task one cluster's rows."""
    monkeypatch.setattr(common, "SPREAD_PARTS", 10)
    keys = []
    monkeypatch.setattr(minhash, "spread_join", lambda rows, per, key, by, total: keys.append(key) or common.spread_join(rows, per, key, by, total))
    base = [f"word{i}" for i in range(200)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(1, 41)] + [(100 + i, f"other {i // 2} " + " ".join(f"w{i // 2}x{j}" for j in range(50 + i % 2))) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 1) for i in range(1, 41)} | {(100 + i, 100 + i - i % 2) for i in range(40)}
    assert keys == ["key", "cluster"]


def test_duplicates_are_found_once(spark, docs, monkeypatch):
    """What the pipeline removes is counted and joined from a checkpoint, not from two runs of the last joins."""
    import corpus_pipeline
    plans = []
    monkeypatch.setattr(corpus_pipeline, "bounded", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df)
    named = docs.where("doc_id is not null and doc_id <> 9012")
    for rows in (named, named.union(named.limit(3))):
        corpus_pipeline.drop_near_duplicates(spark, rows, SF)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, docs, rows, words, percent):
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(shingles(t, words))
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if x and y):
                u, v = sorted((find(a), find(b)))
                top[v] = u
    got = minhash.near_duplicates(docs, words=words, percent=percent).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == collections.Counter(
        (i, len(shingles(t, words)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_near_copies_in_blocks_keep_every_chain(spark, monkeypatch):
    """A chain of near copies stays one group when blocks hold two documents each."""
    monkeypatch.setattr(minhash, "SET_BLOCK", 2)
    monkeypatch.setattr(minhash, "SIGNATURE_BLOCK", 3)
    words = [f"w{i}" for i in range(400)]
    chain = [(k, " ".join(words[5 * k : 5 * k + 200])) for k in range(30)] + [(100, " ".join(words[::-1]))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()}
    assert got == {**{k: 0 for k in range(30)}, 100: 100}


@pytest.mark.parametrize("percent", [85, 80])
def test_near_pairs_of_distance_are_found(spark, percent):
    """Of 2,000 pairs of signatures at the distance threshold 99 % are candidates, all that the chunks' pigeonhole covers, and none beyond it."""
    import numpy as np
    rng = np.random.default_rng(4)
    far, near = minhash.max_distance(percent), 2 * minhash.chunk_count(percent) - 1
    rows, size = [], []
    for i in range(2510):
        sign = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype("<u2")
        other = sign.copy()
        size.append(far if i < 2000 else near if i < 2500 else far + 1)
        at = rng.permutation(64)[: size[-1]]
        other[at] ^= rng.integers(1, 1 << 16, len(at)).astype("<u2")
        rows += [(2 * i, sign.tobytes()), (2 * i + 1, other.tobytes())]
    nodes = spark.createDataFrame([(n, bytearray(s)) for n, s in rows], "node long, signature binary")
    got = {min(u, v) // 2 for u, v in minhash.candidates(nodes, percent).collect()}
    assert len(got & set(range(2000))) >= 1980 and set(range(2000, 2500)) <= got and not got & set(range(2500, 2510))


@pytest.mark.parametrize("percent", [90, 85, 80])
def test_every_pair_within_the_distance_has_a_key(spark, percent):
    """Errors dealt so that as few chunks as possible have at most one: none is left out."""
    import numpy as np
    rng = np.random.default_rng(9)
    far, rows = minhash.max_distance(percent), []
    assert 2 * minhash.chunk_count(percent) > far
    for i in range(300):
        sign = rng.integers(0, 1 << 16, minhash.SYMBOLS).astype("<u2")
        other = sign.copy()
        at = [c * minhash.SIZE + (i + j) % minhash.SIZE for c in range(minhash.SYMBOLS // minhash.SIZE) for j in range(2)][:far]
        other[at] ^= 1
        rows += [(2 * i, bytearray(sign.tobytes())), (2 * i + 1, bytearray(other.tobytes()))]
    got = {min(u, v) // 2 for u, v in minhash.candidates(spark.createDataFrame(rows, "node long, signature binary"), percent).collect()}
    assert got == set(range(300))


def test_keys_of_the_same_members_are_compared_once(spark, monkeypatch):
    """Equal but for one symbol: of 40 keys or more that two share, and of those that three share, one each is dealt."""
    import numpy as np
    sign = np.arange(minhash.SYMBOLS).astype("<u2")
    rows = []
    for node in range(3):
        other = sign.copy()
        other[node] ^= 1
        rows.append((node, bytearray(other.tobytes())))
    dealt = []
    monkeypatch.setattr(minhash, "_blocks", lambda df, size, real=minhash._blocks: dealt.append(df.count()) or real(df, size))
    got = minhash.candidates(spark.createDataFrame(rows, "node long, signature binary"), 85).collect()
    assert len({frozenset((u, v)) for u, v in got}) == 2
    assert sum(dealt) <= 3 + 3 * 2


def test_a_similarity_that_chunks_cannot_promise_is_refused():
    with pytest.raises(ValueError):
        minhash.chunk_count(50)


def windows_hit(text, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        p = split(t)
        n = min(10, len(p))
        for i in range(len(p) - n + 1 if n and item is not None else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("table_bytes", [1 << 20, 400])
def test_contamination_equals_brute_force(spark, docs, rows, table_bytes):
    items = [(1, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11"), (2, "ONE two"), (3, "x"), (4, None), (5, "..."),
             (None, "word1 word2"), (10, "word20 Word21-word22 word23 word24 word25 word26 word27 word28 word29 word30"), (10, "x x x")]
    small = [(i, t[:3000] if t else t) for i, t in rows if i is None or i > 9000 or i < 40]
    df = spark.createDataFrame(small, "doc_id long, text string").withColumn("hits", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(0))
    marks = decontaminate.hits(df, bench, table_bytes=table_bytes).collect()
    got = collections.Counter((r.doc_id, r.n_words, len(r.hits), len(r["items"]), decontaminate.item_digest(r["items"]), bool(r.hits)) for r in marks)
    assert got == collections.Counter((i, *windows_hit(t, items)) for i, t in small)
    kept = decontaminate.keep_clean(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not windows_hit(t, items)[-1] for _, t in small)
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), bench).count() == 0


def test_lm_base_is_exact_and_pairs_help(spark, docs, rows):
    tokens = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").translate(LOW)) if w] + ["\0"]
    held = lambda i: i is None or crc(i) % 10 == 0
    count = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, distinct = sum(count.values()), len(count)
    got = collections.Counter()
    for r in ngram.lm_scores(docs).collect():
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)] += 1
        assert r.score <= 0
    want = collections.Counter((i, held(i), len(ts := tokens(t)), sum(count[w] > 0 for w in ts), total,
                                round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ts), 3)) for i, t in rows)
    assert got == want
    real = ngram.lm_scores(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert real[0] > real[1]
    assert ngram.lm_scores(empty(spark)).count() == 0


def test_filter_never_undercounts(spark):
    import numpy as np
    keys = ngram.constants(5000, 3) & np.uint64((1 << 8 * ngram._WIDTH[ngram.PAIR]) - 1)
    counts = np.arange(1, 5001) % 40 + 1
    f = ngram.Filter({0: ngram.segment(keys, counts, 1 << 18)}, 1, 1 << 18)
    assert (f.counts(keys) >= 2.0 ** (ngram.levels(counts) - 1)).all()
    assert (f.counts(ngram.constants(5000, 9) & np.uint64((1 << 8 * ngram._WIDTH[ngram.PAIR]) - 1)) > 0).mean() < 0.02


def test_filter_keeps_every_ngram_whatever_its_size():
    import numpy as np
    keys = ngram.constants(5000, 3) & np.uint64((1 << 8 * ngram._WIDTH[ngram.PAIR]) - 1)
    counts = np.arange(1, 5001) % 40 + 1
    f = ngram.Filter({0: ngram.segment(keys, counts, 8)}, 1, 8)
    assert (f.counts(keys) >= 2.0 ** (ngram.levels(counts) - 1)).all()
    assert (f.counts(ngram.constants(5000, 9) & np.uint64((1 << 8 * ngram._WIDTH[ngram.PAIR]) - 1)) > 0).mean() < 0.02


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOW)) if w] + ["\0"]


class PairModel:
    """The pair model by plain counting."""

    def __init__(self, rows):
        train = [words_of(t) for i, t in rows if i is not None and crc(i) % 10]
        self.one = collections.Counter(w for ts in train for w in ts)
        self.two = collections.Counter(p for ts in train for p in zip([None, *ts], ts))
        self.total, self.rows = sum(self.one.values()), len(train)

    def probability(self, a, b):
        alone = (self.one[b] + 0.1) / (self.total + 0.1 * (len(self.one) + 1))
        context, pair = self.rows if a is None else self.one[a], self.two[a, b]
        return ((2 ** (pair.bit_length() - 1) if pair else 0) + ngram.PRIOR * alone) / (context + ngram.PRIOR)


@pytest.mark.parametrize("pair_bits", [1 << 28, 8])
def test_lm_score_within_and_beyond_the_broadcast_bound(spark, docs, rows, monkeypatch, pair_bits):
    """The filter's levels are those of the counts but for a false probe in many."""
    model = PairModel(rows)
    want = sorted((i or -1, sum(math.log10(model.probability(a, b)) for a, b in zip([None, *ts], ts)), len(ts)) for i, t in rows for ts in [words_of(t)])
    monkeypatch.setattr(ngram, "PAIR_BITS", pair_bits)
    got = sorted((r.doc_id or -1, r.score) for r in ngram.lm_scores(docs).collect())
    error = [abs(g - w) / n for (_, g), (_, w, n) in zip(got, want)]
    assert len(got) == len(want) and max(error[i] for i in range(len(want)) if want[i][2] > 100) < 0.05, sorted(error)[-5:]
    assert sum(error) / len(error) < 0.01
    assert ngram.lm_scores(empty(spark)).count() == 0


def test_lm_paths_give_equal_scores(spark, docs, monkeypatch):
    """The same segments, broadcast and asked at their shards, in large and small blocks."""
    def scores():
        return sorted(((r.doc_id or -1, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ngram.lm_scores(docs).collect()))

    monkeypatch.setattr(ngram, "LEAST_BITS", 1 << 20)
    broadcast = scores()
    monkeypatch.setattr(ngram, "PAIR_BITS", 8)
    assert scores() == broadcast
    monkeypatch.setattr(ngram, "BLOCK_TOKENS", 3000)
    assert scores() == broadcast


def test_lm_probabilities_add_up(spark):
    """After each context the brute-force model's probabilities add up to 1 but for what quantisation rounds off, never above."""
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").limit(60).collect()]
    model = PairModel(docs)
    unseen = 0.1 / (model.total + 0.1 * (len(model.one) + 1))
    assert abs(sum((c + 0.1) / (model.total + 0.1 * (len(model.one) + 1)) for c in model.one.values()) + unseen - 1) < 1e-9
    for a in [None, *list(model.one)[:40], *[w for w, _ in model.one.most_common(20)]]:
        mass = sum(model.probability(a, b) for b in model.one) + ngram.PRIOR * unseen / ((model.rows if a is None else model.one[a]) + ngram.PRIOR)
        pairs = {p: c for p, c in model.two.items() if p[0] == a}
        context = model.rows if a is None else model.one[a]
        rounded = sum(c - 2 ** (c.bit_length() - 1) for c in pairs.values()) + context - sum(pairs.values())
        assert mass <= 1 + 1e-9 and abs(mass + rounded / (context + ngram.PRIOR) - 1) < 1e-9


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, rows):
    import tiktoken
    path, pattern = catalog.tokenizer()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.encode(docs, path, pattern, with_ids=True)
    want = [(i, enc.encode_ordinary(t or ""), t or "") for i, t in rows]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in coded.collect()) == collections.Counter(
        (i, len(x), sha(",".join(map(str, x)).encode()), sha(t.encode()), tuple(x)) for i, x, t in want)
    assert collections.Counter((r.doc_id, r.text) for r in bpe.decode(coded, path).collect()) == collections.Counter((i, t) for i, _, t in want)
    assert bpe.encode(empty(spark), path, pattern).count() == 0


def test_bpe_codebook_of_any_size_gives_the_same_ids(spark, docs, monkeypatch):
    path, pattern = catalog.tokenizer()
    texts = docs.select("text").repartition(6)
    want = sorted(map(str, bpe.encode(docs, path, pattern, with_ids=True).collect()))
    full = bpe.codebook(texts, path, pattern)
    replay = bpe.load(path)
    spelt = full.words.to_pylist()
    assert len(set(spelt)) == len(spelt) > 300 and all(len(w) <= bpe.LONG_WORD and w.encode() not in replay.ranks for w in spelt)
    assert [full.ids[a:b].tolist() for a, b in zip(full.begin[:-1], full.begin[1:])] == [replay.encode_alone(w.encode()) for w in spelt]
    # Every word of two blocks or more, and no other one.
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1)
    monkeypatch.setattr(common, "CHUNK_BYTES", 1)
    split, standing = bpe.splitter(pattern), collections.Counter()
    for r in texts.collect():
        standing.update({w for w in split(r.text or "") if len(w) <= bpe.LONG_WORD and w.encode() not in replay.ranks})
    by_row = lambda b: [pa.RecordBatch.from_arrays([b.column(0).slice(i, 1)], names=["text"]) for i in range(b.num_rows)]
    table_of = pa.RecordBatch.from_arrays([pa.array([r.text for r in texts.collect()], pa.string())], names=["text"])
    counted = collections.Counter()
    for out in bpe._count(iter(by_row(table_of)), path, pattern):
        counted.update(dict(zip(out.column("word").to_pylist(), out.column("n").to_pylist())))
    assert counted == standing
    monkeypatch.undo()
    for words, most in ((len(spelt) // 3, 1 << 20), (1 << 20, 500), (0, 0)):
        monkeypatch.setattr(bpe, "BOOK_WORDS", words)
        monkeypatch.setattr(bpe, "BOOK_BYTES", most)
        part = bpe.codebook(texts, path, pattern)
        assert part is None or len(part.words) <= words and sum(len(w.encode()) for w in part.words.to_pylist()) <= most
        assert (part is None) or set(part.words.to_pylist()) < set(spelt)
        assert sorted(map(str, bpe.encode(docs, path, pattern, with_ids=True).collect())) == want


def test_bpe_takes_a_lower_rank_that_a_merge_gives_rise_to():
    """Here merging b+c gives a pair that ranks below it, so equal merges to the right must wait."""
    ranks = {bytes([i]): i for i in range(256)}
    ranks |= {b"bcb": 256, b"bc": 257, b"cb": 258, b"bcbc": 259}
    replay = bpe.Replay(ranks)
    words = [b"bcbcbc", b"abcbcbcbcb", b"bcb" * 7, b"cbcb", b"zz"]
    ids, begin = replay.encode(words)
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [[ranks[w]] if w in ranks else replay.encode_alone(w) for w in words]


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def test_pii_base_spans(spark, docs, rows):
    for r in pii.detect(docs).collect():
        spans = [s for s in r.spans.split(",") if s]
        texts = {pii.written(base(t or "")) for i, t in rows if i == r.doc_id}
        assert any(hashlib.sha256(t.encode()).hexdigest() == r.base_sha256 and set(filter(None, t.split(","))) <= set(spans) for t in texts)
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len(spans)
    import random
    random.seed(5)
    bits = ["1", "2", "55", ".", ".", "@", "a", "-", " ", "+", "(", ")", "4539578763621486", "255", "192.168.1.1", "x@y.z", "é"]
    for _ in range(3000):
        t = "".join(random.choice(bits) for _ in range(random.randint(0, 25)))
        assert pii.base_spans(t) == base(t), t
    assert pii.detect(empty(spark)).count() == 0


def test_pii_mentions_agree_across_a_document(spark):
    field = pii.fit(table(spark, "/root/testdata/sf0.01", "documents"))
    text = "Call +1 (988) 555-2485 today. " + "the of and " * 200 + "Then 988 555-2485 again; part 777 12-34 and 4041.8949."
    (found, added), = pii.find([text], field)
    assert [text[a:b] for a, _, b in found] == ["+1 (988) 555-2485"]
    assert {text[a:b] for a, _, b in added} == {"988 555-2485"} and {k for _, k, _ in added} == {3}
    assert "555" not in pii.mask(text, found + added) and "777" in pii.mask(text, found + added)
    assert pii.find(["nothing here", "", "call 555-2485"], field)[0] == ([], [])


@pytest.mark.parametrize("repeats", [3, 20, 500])
def test_pii_evidence_reaches_every_mention(repeats):
    field = pii.Field.prior()
    text = "Call +1 (988) 555-2485 today. " + "Then 988 555-2485 again; " * repeats + "part 777 12-34 and 4041.8949."
    other = "mail a@b.example and " + "words " * 5 + "ring 988 555-2485 or 988 555-2485"
    (found, added), (_, none) = pii.find([text, other], field)
    assert [text[a:b] for a, _, b in found] == ["+1 (988) 555-2485"]
    assert [text[a:b] for a, _, b in added] == ["988 555-2485"] * repeats and {k for _, k, _ in added} == {3}
    assert not none and pii.find([text], field) == [(found, added)]


def test_redaction_keeps_rows_and_columns(spark, docs):
    out = pii.redact(docs, length_col="n_chars")
    assert out.schema == docs.schema and out.count() == docs.count()


def test_language_held_out_accuracy(spark, docs, rows):
    real = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.identify(real).join(real.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert held[0] > 0.95 and held[1] < 0.02
    assert got.where("score < 0 or score > 1").count() == 0
    models = language.fit(real)
    odd = {(r.doc_id, r.lang_pred) for r in language.identify(docs, models=models).where("lang_pred = 'und'").collect()}
    assert {i for i, _ in odd} == {i for i, t in rows if not any(c.isalpha() for c in t or "")}
    assert language.keep_identified(docs, models=models).columns == docs.columns
    assert {r.lang_pred for r in language.identify(docs).collect()} <= {"en", "und"}
    assert language.identify(empty(spark)).count() == 0
    names, _, rejected = models.decide(["xq zzkw pqrt vvvv kjhgf wqxz", "the and of the"])
    assert rejected.tolist() == [True, False] and names[1] == "en"


def test_kneser_ney_is_a_distribution():
    import numpy as np
    keys, _, _ = language.characters(["the cat sat on the mat", "a cat"])
    k, n = np.unique(keys, return_counts=True)
    letters = np.unique(k & np.uint64(0xFFFF))
    model = language.Language(k, n, len(letters))
    for context in np.unique(k >> np.uint64(16))[:20]:
        p = model.probability((context << np.uint64(16)) | letters)
        assert (p > 0).all() and p.sum() <= 1 + 1e-9 and p.sum() > 0.9


def test_simhash_edits(spark, docs, rows):
    ring = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = collections.Counter()
    for k, (i, t) in enumerate(ring):
        nxt, h = ring[(k + 1) % len(ring)][1], len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()] += 1
    got = simhash.edit_likeness(docs).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    marks = {r.doc_id: r.fingerprint for r in got}
    assert marks[9006] == marks[9008] and simhash.likeness(bytes.fromhex(marks[9006]), bytes.fromhex(marks[9007])) > 0.85
    assert simhash.edit_likeness(empty(spark)).count() == 0
    one = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    assert simhash.edit_likeness(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_simhash_search_equals_brute_force(spark):
    import random
    random.seed(2)
    marks = [random.getrandbits(128) for _ in range(60)]
    marks += [m ^ (1 << random.randrange(128)) ^ (1 << random.randrange(128)) for m in marks[:30]] + marks[:5]
    df = spark.createDataFrame([(f"{m:032x}",) for m in marks] + [(None,)], "fingerprint string")
    got = {(r.query, r.fingerprint, r.distance) for r in simhash.neighbours(df, df, radius=3).collect()}
    assert got == {(f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in marks for b in marks if (a ^ b).bit_count() <= 3}


def test_url_rules(spark):
    cases = {
        "http://A.Example.COM/en/1?x": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/q#f": ("x.www.example.com", "/en/q", "www.example.com/en/", "allow"),
        "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"), "http://b.net/fr/a": ("b.net", "/fr/a", "net/fr/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"), "http://example.com?q": ("example.com", "", None, None),
        "http://Äb.COM/": ("Äb.com", "/", "com/", "allow"), "no scheme": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None),
        "http://host:80/": ("host:80", "/", None, None), "a://b.com/x://c.net/es/": ("b.com", "/x://c.net/es/", "com/", "allow")}
    pages = spark.createDataFrame(list(enumerate(cases)) + [(99, "http://b.net/es/" + "y" * 50_000)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("label", F.lit(2))
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("page_id in (7, 8)")).collect()} == {"allow"}


def test_url_trees_learn_the_rules(spark):
    got = urls.judge(table(spark, "/root/testdata/sf0.01", "pages")).where("rule is not null")
    assert got.agg(F.avg(((F.col("score") > 0.5) == (F.col("verdict") == "block")).cast("int"))).first()[0] > 0.6


def test_url_statistics_cover_all_pages(spark, monkeypatch):
    monkeypatch.setattr(urls, "SAMPLE_ROWS", 40)
    names = [f"http://h{i}.s{i % 7}.com/" for i in range(100)]
    low = spark.createDataFrame([(u,) for u in names], "url string").orderBy(F.xxhash64("url")).first()[0]
    all_urls = names + [low] * 200 + [f"http://b{i}.net/es/{i}" for i in range(30)] + [f"http://u{i}.s{i % 3}.org/{i}" for i in range(60)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(all_urls)), "page_id long, url string")
    hosts = [(u or "x").partition("://")[2].partition("/")[0] for u in all_urls]
    want = collections.defaultdict(list)
    for h in hosts:
        want[".".join(h.split(".")[-2:])].append(h)
    table_ = {r.suffix: r for r in urls.suffix_statistics(pages.withColumn("host", urls.host(F.col("url")))).collect()}
    assert {k: (r.n, round(math.expm1(r.suffix_count)), round(math.expm1(r.suffix_hosts))) for k, r in table_.items()} == {
        k: (len(v), len(v), len(set(v))) for k, v in want.items()}
    got = sorted(urls.judge(pages).collect())
    assert len(got) == len(all_urls) and all(r.score is not None for r in got)  # both labels are sampled
    monkeypatch.setattr(urls, "BROADCAST_SUFFIXES", 0)
    dealt = sorted(urls.judge(pages).collect())
    assert [r[:5] for r in dealt] == [r[:5] for r in got] and max(abs(a.score - b.score) for a, b in zip(got, dealt)) < 1e-6


def test_toxicity_held_out(spark, docs):
    real, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = toxicity.toxicity(real, labels).join(labels.drop("quality"), "doc_id")
    r = got.where("held_out").agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert r[0] > 0.6 and r[1] < 0.02
    assert got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    none = labels.limit(0)
    assert toxicity.toxicity(docs, none).select("score").distinct().count() == 1
    assert toxicity.toxicity(empty(spark), labels).count() == 0


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("a < b &amp; c", "a < b & c"), ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"), ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"), ("<script>x</script><style>y</style>z<!-- c -->", "z"),
    ("<div hidden>n</div><span style='display:none'>n</span>y", "y"), ("<pre>a\n  b</pre>", "a\n  b"), ("x<br>y", "x\ny"),
    ("<b>a</b><i>b</i> c", "ab c"), ("<details><summary>s</summary>h</details>", "s"), ("<blockquote><p>q</blockquote>w", "  q\n\nw"),
    ("<p title='unclosed>x</p>", "x"), ("<div>" * 3000 + "deep", "deep"), ("<td>cell</td>", "cell"), ("</p></div>t", "t"), ("<p", ""),
    ("<head><title>t</title><h1>A</h1><p>text", "A\n\ntext"), ("<html><head>\n<meta a=b><link c=d><style>s</style>plain <b>text</b>", "plain text"),
    ("<head><title>t</title><noscript><p>n</p></noscript></head><body>y", "y"), ("<head><title>t</title><body><p>x", "x"), ("<head><html lang=en><p>x", "x"),
    ("<svg><title>t</title><defs><text>d</text></defs><g/><text x=1>A <tspan>b</tspan></text>no<text>C</text></svg>z", "A b\nC\nz"), ("<svg><g><p>out", "out")])
def test_html_layout(page, text):
    assert html.to_text(page or "") == text


def test_html_pages(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and "</" not in got[r.page_id].text
        heading = re.search(r"<h1>([^<]*)</h1>", r.html)
        assert heading is None or " ".join(unescape(heading.group(1)).split()) in got[r.page_id].text


def test_pipeline_stages(spark, docs, rows):
    import corpus_pipeline as P
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    known = docs.where("doc_id is not null").withColumn("lang", F.lit("en"))
    left = {r.doc_id for r in P.drop_near_duplicates(spark, known, SF).select("doc_id").collect()}
    assert {9006, 9001, 9002, 9012} <= left and not {9007, 9008} & left
    assert P.drop_near_duplicates(spark, known, SF).where("doc_id = 9012").count() == 1
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names, name
        assert stage(spark, empty(spark), SF).count() == 0
    final = P.run(spark, SF)
    assert final.count() == final.select("doc_id").distinct().count() > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() over rows with repeated ids, of equal and of different texts, null ids and null texts, stage by stage."""
    import os

    import corpus_pipeline as P
    import tiktoken
    real = [tuple(r) for r in table(spark, SF, "documents").limit(150).collect()]
    base = real[5][1]
    long = " ".join(f"the case of the report {i} and the answer" for i in range(40))
    rows = real + [(real[3][0], base + " more", "en", "s", 1), (real[9][0], "The quiet house stands near the old river and the people of the town like it.", "en", "s", 1),
                   (5000, base, "en", "s", 1), (5000, base, "en", "s", 1), (5001, long, "en", "s", 1), (5001, long + " x", "en", "s", 1), (5002, long + " y", "en", "s", 1),
                   (None, base, "en", "s", 1), (None, base, "en", "s", 1), (5003, None, "en", "s", 1), (5004, "123 456", "en", "s", 1)]
    schema = table(spark, SF, "documents").schema
    os.makedirs(f"{tmp_path}/in")
    for name in ("benchmark",):
        table(spark, SF, name).write.parquet(f"{tmp_path}/in/{name}.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in/documents.parquet")
    docs = table(spark, f"{tmp_path}/in", "documents")
    kept = [(r.doc_id, r.text) for r in language.keep_identified(docs).select("doc_id", "text").collect()]
    assert 0 < len(kept) < len(rows) and (5003, None) not in kept and (5004, "123 456") not in kept
    # near-duplicates: of each group of similar texts the row of the smallest id stays, one of equal rows
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))
    sets = [shingles(t, 5) for _, t in order]
    top = list(range(len(order)))
    for i in range(len(order)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if x in (a, b) else x for x in top]
    smallest = {}
    for i, r in enumerate(order):
        smallest.setdefault(top[i], set()).add(r[0])
    left = [next(r for r in order if r[0] == min(ids) and top[order.index(r)] == group) for group, ids in smallest.items()]
    left += [r for r in kept if r[0] is None]
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    clean = [r for r in left if not windows_hit(r[1], items)[-1]]
    final = P.run(spark, f"{tmp_path}/in").collect()
    assert collections.Counter(r.doc_id for r in final) == collections.Counter(i for i, _ in clean)
    redacted = [tuple(r) for r in pii.redact(spark.createDataFrame(clean, "doc_id long, text string")).collect()]
    ranks, pattern = catalog.tokenizer()
    from tiktoken.load import load_tiktoken_bpe
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(ranks), special_tokens={})
    # what personal data is found beyond patterns depends on the rows that the model was fitted on: compare where patterns decide
    same = collections.Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in redacted)
    got = collections.Counter((r.doc_id, r.decoded_sha256) for r in final)
    assert sum((same & got).values()) >= 0.95 * len(clean)
    for r in final[:40]:
        text = enc.decode(list(r.ids))
        assert list(r.ids) == enc.encode_ordinary(text) and hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256


def test_queries_with_sql_match_duckdb(spark):
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, (fn, sql) in catalog.REGISTRY.items():
        if sql:
            got = fn(spark, SF)
            want = con.sql(sql)
            order = [got.columns.index(c) for c in want.columns]
            assert sorted(tuple(r[i] for i in order) for r in got.collect()) == sorted(want.fetchall()), name
