"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees confirmed toxic texts and unlabelled ones, never confirmed clean ones.
Its risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)): the clean part of the
unlabelled risk is what remains after the prior's share of toxic texts is taken out, and
it is not allowed below zero.  Features are the words and word stems of a text that
stand out in the toxic sample; the model is logistic, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import U64, alphanumeric, chunks, remainder, small_batches, utf8

#: Rows of either sample, the most features, and how far a word must stand out (standard errors).
POSITIVE_ROWS, UNLABELLED_ROWS, FEATURES, OUTSTANDING = 3000, 12_000, 1024, 6.0
#: Bytes of the stems that count as features beside the whole word.
STEMS = (4, 5, 6)
#: Buckets of word hashes.
BUCKETS = 1 << 22


@lru_cache(1)
def _words():
    return alphanumeric()


def _rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of words and stems, row within) of blocks of rows."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        first, end, h, row, stems = _words().split(data, offsets[i : j + 1], STEMS)
        size = end - first
        h = np.concatenate([h, *(x[size > n] for x, n in zip(stems, STEMS))])
        yield i, j, (h >> U64(42)).astype(np.int64), np.concatenate([row, *(row[size > n] for n in STEMS)])


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = np.array(batch.column("toxic").to_pylist(), bool)
        found = [[], []]
        for i, j, bucket, row in _rows(batch.column("text")):
            both = np.unique(row * BUCKETS + bucket)
            flag = toxic[i + both // BUCKETS]
            for k in (0, 1):
                found[k].append((both % BUCKETS)[flag == k])
        for k in (0, 1):
            if found[k]:
                bucket, n = np.unique(np.concatenate(found[k]), return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(bucket), bool(k))), pa.array(bucket), pa.array(n)], names=["toxic", "bucket", "n"])


class Classifier:
    """Logistic model over the presence of chosen words."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.buckets, self.weights, self.bias = buckets, weights, bias
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))

    def __reduce__(self):
        return Classifier, (self.buckets, self.weights, self.bias)

    def present(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, rows within, features) of blocks of rows, each pair once."""
        for i, j, bucket, row in _rows(column):
            at = self.place[bucket]
            both = np.unique(row[at >= 0] * max(len(self.buckets), 1) + at[at >= 0])
            yield i, j, both // max(len(self.buckets), 1), both % max(len(self.buckets), 1)

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for i, j, row, feature in self.present(column):
            z = self.bias + np.bincount(row, self.weights[feature] if len(self.weights) else None, minlength=j - i)
            out[i:j] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def train(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss."""
    n = x.shape[1]
    w = np.zeros(n + 1, np.float32)
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    p, u = x[positive], x[~positive]
    m, v = np.zeros(n + 1, np.float32), np.zeros(n + 1, np.float32)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        unlabelled = u.T @ sigmoid(zu) / len(u) - prior * (p.T @ sigmoid(zp)) / len(p)
        # where the clean risk is negative, only a step back on it is taken
        grad = prior * (p.T @ (sigmoid(zp) - 1)) / len(p) + unlabelled if clean >= 0 else -unlabelled
        grad = grad + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = (w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w[:-1].astype(float), float(w[-1])


def _examples(batches: Iterator[pa.RecordBatch], classifier: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, row, feature in classifier.present(batch.column("text")):
            bounds = np.searchsorted(row, np.arange(j - i + 1))
            yield pa.record_batch([batch.column("toxic").slice(i, j - i), pa.array([feature[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64()))],
                                  names=["toxic", "features"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """A classifier from about ``POSITIVE_ROWS`` confirmed toxic and ``UNLABELLED_ROWS`` other texts.

    Only labels of ids whose crc32 modulo 3 is not 1 are read.  The prior is the share of
    toxic ones among them.  Both samples are chosen by a hash of the id.
    """
    learn = F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))
    known = labels.select(F.col("doc_id"), F.col("toxic")).where(learn & F.col("toxic").isNotNull())
    total, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    texts = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    everything = texts.where(learn).agg(F.count("*")).first()[0]
    nothing = Classifier(np.zeros(0, np.int64), np.zeros(0), float(np.log((toxic or 0) + 0.5) - np.log((total or 0) - (toxic or 0) + 0.5)))
    if not toxic or not everything:
        return nothing
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    ids = known.where("toxic = 1").where(hash_ < POSITIVE_ROWS / toxic).select("doc_id", F.lit(True).alias("toxic")).distinct()
    marked = texts.join(F.broadcast(ids), "doc_id").select("text", "toxic")
    other = texts.where(learn).where(hash_ >= 1 - UNLABELLED_ROWS / everything).select("text", F.lit(False).alias("toxic"))
    sample = marked.union(other).where("text is not null")
    seen = sample.mapInArrow(_frequency, "toxic boolean, bucket long, n long")
    rows = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = rows.get(True, 0), rows.get(False, 0)
    if not n1 or not n0:
        return nothing
    p1, p0 = F.col("a") / n1, F.col("b") / n0
    common = (F.col("a") + F.col("b")) / (n1 + n0)
    chosen = (seen.groupBy("bucket").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("b"))
              .withColumn("z", (p1 - p0) / F.sqrt(F.greatest(common * (1 - common), F.lit(1e-9)) * (1 / n1 + 1 / n0)))
              .where((F.col("z") >= OUTSTANDING) & (p1 >= 2 * p0)).orderBy(F.desc("z"), "bucket").limit(FEATURES).select("bucket").collect())
    buckets = np.array(sorted(r[0] for r in chosen), np.int64)
    if not len(buckets):
        return nothing
    found = sample.mapInArrow(partial(_examples, classifier=Classifier(buckets, np.zeros(len(buckets)), 0.0)), "toxic boolean, features array<long>").collect()
    x = np.zeros((len(found), len(buckets)), np.float32)
    for i, r in enumerate(found):
        x[i, r[1]] = 1
    order = np.lexsort([*x.T[:8], np.array([r[0] for r in found])])
    weights, bias = train(x[order], np.array([r[0] for r in found])[order], toxic / total)
    return Classifier(buckets, weights, bias)


def _score(batches: Iterator[pa.RecordBatch], classifier: Classifier) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = classifier.score(batch.column("text"))
        yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.7).astype(np.int32))],
                              names=["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    held_out: crc32(id) modulo 3 is 1 (a null id is held out).  Null, empty and unknown
    texts get the score of a text without any feature; without toxic labels all texts get
    the prior.  Repeated rows and labels are taken as often as they stand.
    """
    classifier = classifier or fit(docs, labels, id_col, text_col)
    out = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(remainder(id_col, 3) == 1, F.lit(True)).alias("held_out"))
    return out.mapInArrow(partial(_score, classifier=classifier),
                          f"doc_id {out.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
