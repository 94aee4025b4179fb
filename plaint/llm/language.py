"""Language identification with interpolated Kneser-Ney character models.

Each language has a character model of order ``ORDER`` whose n-gram keys lie in sorted
arrays.  A text goes to the language with the lowest cross-entropy per character.  The
confidence and the limit for rejection are calibrated on training rows kept out of the
counts.  Letters are lower-cased, each run of anything else is one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import U64, release, remainder, small_batches

ORDER, BITS = 4, 16
#: Rows of each language that the models are fitted on, and one in how many of them calibrates.
SAMPLE_ROWS, KEPT_OUT = 1500, 8
EDGE, SPACE = 1, 32
#: Rejection: standard deviations above a language's usual cross-entropy.
REJECT = 6.0


@lru_cache(1)
def _fold() -> np.ndarray:
    """Code point -> lower-case letter below 2**16 (higher letters share one code), or a space."""
    out = np.full(0x110000, SPACE, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            out[c] = low if low <= 0xFFFF else 0xFFFF
    out[0] = EDGE
    return out


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram key of each character, row of each character, letters of each row)."""
    joined = "\0".join([*(t.replace("\0", " ") for t in texts), ""])
    c = _fold()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != SPACE) | (c[:-1] != SPACE)
    c = c[keep].astype(U64)
    edge = c == EDGE
    row = np.cumsum(edge) - edge
    letters = np.bincount(row[(c != SPACE) & ~edge], minlength=len(texts))
    key = c.copy()
    seen = edge.copy()
    for back in range(1, ORDER):
        before = np.full(len(c), U64(EDGE))
        before[back:] = c[:-back]
        # characters of the row before count as edges
        crossed = np.zeros(len(c), bool)
        crossed[back:] = row[back:] != row[:-back]
        before[crossed] = EDGE
        key |= before << U64(BITS * back)
    del seen
    return key[~edge], row[~edge], letters


class Language:
    """One language's counts in sorted arrays, by order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, letters: int):
        self.letters = letters
        order = np.argsort(keys)
        self.tables = {ORDER: self._table(keys[order], counts[order].astype(float))}
        for n in range(ORDER - 1, 0, -1):  # below the top order, the number of characters seen before
            shorter, number = np.unique(self.tables[n + 1][0] & U64((1 << BITS * n) - 1), return_counts=True)
            self.tables[n] = self._table(shorter, number.astype(float))

    @staticmethod
    def _table(keys: np.ndarray, counts: np.ndarray):
        context, where = np.unique(keys >> U64(BITS), return_inverse=True)
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.75
        return keys, counts, context, np.bincount(where, counts), np.bincount(where).astype(float), discount

    def probability(self, keys: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Interpolated Kneser-Ney probability of each key's last character after its first n - 1."""
        if n == 0:
            return np.full(len(keys), 1.0 / (self.letters + 1))
        keys = keys & U64((1 << BITS * n) - 1 if n < 4 else 0xFFFFFFFFFFFFFFFF)
        lower = self.probability(keys, n - 1)
        own, counts, contexts, total, distinct, discount = self.tables[n]
        if not len(own):
            return lower
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        count = np.where(own[at] == keys, counts[at], 0.0)
        context = keys >> U64(BITS)
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        known = contexts[at] == context
        sum_, kinds = np.where(known, total[at], 1.0), np.where(known, distinct[at], 0.0)
        return np.where(known, np.maximum(count - discount, 0) / sum_ + discount * kinds / sum_ * lower, lower)


class Models:
    """All languages, the keys any of them has seen with their log-probabilities, and the calibration."""

    def __init__(self, names: list[str], languages: list[Language]):
        self.names, self.languages = names, languages
        self.keys = np.unique(np.concatenate([x.tables[ORDER][0] for x in languages])) if languages else np.zeros(0, U64)
        self.logs = np.stack([np.log(x.probability(self.keys)) for x in languages], axis=1).astype(np.float32) if languages else None
        # sorted hash array: the range of keys of each bucket of a multiplicative hash
        self.shift = U64(64 - max(1, int(len(self.keys) * 4).bit_length()))
        hashed = self.keys * U64(0x9E3779B97F4A7C15)
        order = np.argsort(hashed)
        self.hashed, self.logs = hashed[order], self.logs[order] if languages else None
        self.starts = np.searchsorted(self.hashed >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=U64)).astype(np.int32)
        self.deepest = int(np.diff(self.starts).max(initial=0))
        self.slope, self.mean, self.deviation, self.spread = 1.0, None, None, None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in the sorted hash array, -1 if absent."""
        h = keys * U64(0x9E3779B97F4A7C15)
        bucket = (h >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(keys), -1, np.int64)
        left = np.flatnonzero(at < end)
        at = at[left]
        for _ in range(self.deepest):
            if not len(left):
                break
            same = self.hashed[at] == h[left]
            out[left[same]] = at[same]
            on = ~same & (at + 1 < end[left])
            left, at = left[on], at[on] + 1
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character of each language, characters, letters) of each text."""
        k = len(self.names)
        total, size, letters = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        done = 0
        while done < len(texts):
            upto, amount = done, 0
            while upto < len(texts) and (upto == done or amount + len(texts[upto]) < 1_000_000):
                amount += len(texts[upto])
                upto += 1
            keys, row, letters[done:upto] = characters(texts[done:upto])
            n = upto - done
            size[done:upto] = np.bincount(row, minlength=n)
            at = self.find(keys)
            known = at >= 0
            values = self.logs[at[known]]
            bounds = np.searchsorted(row[known], np.arange(n + 1))
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                total[done + full] += np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=np.float64)
            if not known.all():
                for j, language in enumerate(self.languages):
                    total[done:upto, j] += np.bincount(row[~known], np.log(language.probability(keys[~known])), minlength=n)
            done = upto
        return -total / np.maximum(size, 1)[:, None], size, letters

    def calibrate(self, held: pd.DataFrame) -> None:
        """Slope of the confidence, and usual cross-entropy of each language, from rows not counted."""
        k = len(self.names)
        self.mean, self.deviation = np.full(k, np.log(self.languages[0].letters + 1)), np.full(k, 1.0)
        if not len(held):
            return
        h = np.stack(held["entropy"].to_numpy())
        size, truth = held["n"].to_numpy(), held["lang"].map({x: i for i, x in enumerate(self.names)}).to_numpy()
        own = h[np.arange(len(h)), truth]
        for i in range(k):
            some = own[truth == i] if (truth == i).sum() >= 20 else own
            self.mean[i], self.deviation[i] = some.mean(), max(some.std(), 0.01)
        best = np.inf
        for slope in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
            z = -h * (slope * np.sqrt(size))[:, None]
            z -= z.max(axis=1, keepdims=True)
            loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean()
            if loss < best:
                best, self.slope = loss, slope

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language or und, confidence, rejected) of each text."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, size, letters = self.entropies(texts)
        best = h.argmin(axis=1)
        z = -h * (self.slope * np.sqrt(size))[:, None]
        z -= z.max(axis=1, keepdims=True)
        score = 1 / np.exp(z).sum(axis=1)
        limit = self.mean[best] + REJECT * (self.deviation[best] + 1 / np.sqrt(np.maximum(size, 1)))
        wordless = letters == 0
        names = ["und" if w else self.names[b] for w, b in zip(wordless, best)]
        return names, np.where(wordless, 0.0, score), wordless | (h[np.arange(len(h)), best] > limit)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
        for name in sorted(set(lang)):
            keys, _, _ = characters([t for t, x in zip(texts, lang) if x == name])
            keys, counts = np.unique(keys, return_counts=True)
            yield pa.record_batch([pa.array([name] * len(keys)), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def _measure(batches: Iterator[pa.RecordBatch], models: Models) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, size, _ = models.entropies(batch.column("text").to_pylist())
        yield pa.record_batch([batch.column("lang"), pa.array(list(h), pa.list_(pa.float64())), pa.array(size)], names=["lang", "entropy", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Models:
    """Models of every language of ``lang_col``, from about ``rows`` rows of each, chosen by a hash of the id.

    Rows whose crc32(id) modulo 4 is 2, and rows without a language, an id or a letter,
    are never read for it.
    """
    able = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
                       (remainder(id_col, 4) != 2).alias("learn")).where("learn and lang is not null and text is not null")
    able = able.withColumn("hash", F.pmod(F.xxhash64("id"), F.lit(1_000_000)))
    number = able.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("share"))
    chosen = able.join(F.broadcast(number), "lang").where(F.col("hash") < F.col("share") * 1_000_000)
    chosen = chosen.where(F.col("text").rlike("\\p{L}")).withColumn("held", F.pmod(F.xxhash64("id", "hash"), F.lit(KEPT_OUT)) == 0)
    few = F.col("share") >= 1  # a rare language needs all its rows
    grams = chosen.where(~F.col("held") | few).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    letters = len(np.unique(counts["gram"].to_numpy(np.int64).view(U64) & U64(0xFFFF))) if len(counts) else 0
    parts = [counts[counts["lang"] == x] for x in names]
    models = Models(names, [Language(p["gram"].to_numpy(np.int64).view(U64), p["n"].to_numpy(), letters) for p in parts])
    if names:
        models.calibrate(chosen.where("held").select("lang", "text").mapInArrow(
            partial(_measure, models=models), "lang string, entropy array<double>, n long").toPandas())
    return models


def _identify(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, score, rejected = shared.value.decide([t or "" for t in batch.column("text").to_pylist()])
        yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                              names=["doc_id", "held_out", "lang_pred", "score", "rejected"])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", models: Models | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row of ``docs``.

    held_out: crc32(id) modulo 4 is 2 (a null id is held out).  lang_pred is ``und``, with
    score 0, for null and letterless texts and where no language could be learned.
    Repeated rows have equal results.  ``models``: fitted models, else they are fitted on ``docs``.
    """
    models = models or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    out = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(remainder(id_col, 4) == 2, F.lit(True)).alias("held_out"))
    kind = out.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(partial(_identify, shared=shared), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def _keep(batches: Iterator[pa.RecordBatch], shared, text_col: str) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        column = batch.column(batch.schema.names.index(text_col))
        _, _, rejected = shared.value.decide([t or "" for t in column.to_pylist()])
        yield batch.filter(pa.array(~rejected))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", models: Models | None = None) -> DataFrame:
    """The rows of ``docs`` whose text a model accepts, unchanged."""
    models = models or fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return small_batches(docs).mapInArrow(partial(_keep, shared=shared, text_col=text_col), docs.schema)
