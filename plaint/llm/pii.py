"""Personal data: exact patterns, and a skip-chain conditional random field around them.

Tokens with a digit or an at sign are the nodes; all others are outside any entity.  Nodes
that follow one another are linked in a chain; nodes of a document that repeat the same
digits or letters are linked by skip edges, from one mention to the next, however far
apart, and from each mention to every one that is evidence.  All edges of a kind share one
potential.  Sum-product message passing runs on the loopy graph of a whole batch at once,
until each document has converged.  A token inside a pattern match is evidence; other
tokens become spans where the marginal of a kind is high, which makes the mentions of one
entity in a document agree.  Weights come from the patterns' own matches in a bounded
sample, and spoilt copies of them, by pseudo-likelihood.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import release, small_batches, utf8
from plaint.session import materialize

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

# The contract's patterns. Look-behinds and possessive runs keep the same matches in linear time.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^ \t-\r]+")
_MARK = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += _DOUBLED[int(c)] if i % 2 else int(c)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                last = m.end()
    for m in _IP.finditer(text):
        if all(map(_small, m.groups())):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# -- the field ---------------------------------------------------------------------------------

LABELS = 1 + len(KINDS)  # 0: outside
FEATURES = 1 << 12
#: Rounds after which the messages of a document that do not converge are taken as they are.
ROUNDS = 1000
_EDGE = "\"'()[]{}<>,;:!?"


def _shape(token: str) -> str:
    return re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", re.sub(r"[^\W\d_]+", "a", token))


def features(token: str) -> list[int]:
    """Feature numbers of a token: its shape, its characters, and whether it passes the kinds' checks."""
    digits = _NOT_DIGIT.sub("", token)
    parts = token.split(".")
    names = ["bias", "shape=" + _shape(token), f"digits={min(len(digits), 20)}", f"plus={token[:1] == '+'}",
             f"at={token.count('@')}", f"dots={min(token.count('.'), 4)}", f"letters={any(c.isalpha() for c in token)}",
             f"number={14 <= len(digits) <= 19 and luhn(digits)}",
             f"quad={len(parts) == 4 and all(p.isascii() and p.isdigit() and _small(p) for p in parts)}",
             f"address={bool(_AT.search(token)) and token[0] in _LOCAL}"]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


#: Features of each token.
PER_TOKEN = len(features("0"))


def mention(token: str) -> str:
    """What two mentions of an entity have in common: the digits, or the letters of an address."""
    if "@" in token:
        return token.lower()
    digits = _NOT_DIGIT.sub("", token)
    return digits if len(digits) >= 3 else ""


class Document:
    """The candidate tokens of a text, their links, and the labels that the patterns give, as flat arrays.

    ``start``, ``end``: code points of each token; ``follows``: whether it is linked with the
    token before it; ``skip``: rows of (mention, next mention of the same); ``labels``: of
    tokens inside pattern matches, else 0.  ``heard`` are the mentions that are no evidence
    while others of their key are, with the number of those of each label (but for the two
    next to it, whose messages the skip edges carry) in ``evidence``.
    """

    def __init__(self, text: str, spans: list[Span]):
        start, end, follows, numbers, keys = array("q"), array("q"), array("b"), array("h"), array("q")
        linked = 0
        for m in _TOKEN.finditer(text):
            word = m.group()
            core = word.strip(_EDGE).rstrip(".") if _MARK.search(word) else ""
            if not core:
                linked = 0
                continue
            a = m.start() + word.find(core)
            start.append(a)
            end.append(a + len(core))
            follows.append(linked)
            linked = 1
            numbers.extend(features(core))
            key = mention(core)
            keys.append(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big", signed=True) | 1 if key else 0)
        self.start, self.end = np.frombuffer(start, np.int64), np.frombuffer(end, np.int64)
        self.follows, self.features = np.frombuffer(follows, np.int8) > 0, np.frombuffer(numbers, np.int16).reshape(-1, PER_TOKEN)
        self.labels = np.zeros(len(start), np.int8)
        at = 0
        for a, k, b in sorted(spans):
            while at < len(end) and end[at] <= a:
                at += 1
            i = at
            while i < len(start) and start[i] < b:
                self.labels[i] = self.labels[i] or 1 + k
                i += 1
        self._link(np.frombuffer(keys, np.int64))

    def _link(self, keys: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable").astype(np.int32)
        order = order[keys[order] != 0]
        keys, marks = keys[order], self.labels[order]
        again = keys[1:] == keys[:-1]
        self.skip = np.stack([order[:-1][again], order[1:][again]], axis=1)
        group = np.concatenate(([0], np.cumsum(~again)))[: len(order)]
        known = np.flatnonzero(marks)
        count = np.zeros((int(group[-1]) + 1 if len(group) else 0, LABELS), np.int32)
        np.add.at(count, (group[known], marks[known]), 1)
        hears = np.flatnonzero((marks == 0) & count.any(axis=1)[group])
        self.heard, self.evidence = order[hears], count[group[hears]]
        for step in (-1, 1):
            beside = hears + step
            held = np.flatnonzero((beside >= 0) & (beside < len(order)))
            held = held[(group[beside[held]] == group[hears[held]]) & (marks[beside[held]] > 0)]
            self.evidence[held, marks[beside[held]]] -= 1

    @property
    def chain(self) -> np.ndarray:
        """Rows of (token, token that follows it)."""
        to = np.flatnonzero(self.follows).astype(np.int32)
        return np.stack([to - 1, to], axis=1)


class Field:
    """Weights: of features, of chain edges (from, to) and of skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @staticmethod
    def prior() -> Field:
        """No knowledge of tokens; mentions of one thing agree."""
        return Field(np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), 4.0 * np.eye(LABELS))

    def marginals(self, scores: np.ndarray, chain: np.ndarray, skip: np.ndarray, group: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities of each node by loopy message passing; edges: rows of (from, to).

        ``group``: the document of each node. Each one's messages stop when they have converged, whatever else is in the batch.
        Both messages of an edge are renewed together, so edges are worked off a slice at a time from one round's beliefs.
        """
        group = np.zeros(len(scores), np.int32) if group is None else group
        kinds = [(np.asarray(edges, np.int32).reshape(-1, 2), weight.astype(np.float32)) for edges, weight in ((chain, self.chain), (skip, self.skip))]
        sent = [(np.zeros((len(edges), LABELS), np.float32), np.zeros((len(edges), LABELS), np.float32)) for edges, _ in kinds]
        active = [np.arange(len(edges), dtype=np.int32) for edges, _ in kinds]

        def heard(which: list[np.ndarray]) -> np.ndarray:
            belief = scores.astype(np.float32)
            for (edges, _), (there, back), live in zip(kinds, sent, which):
                for part in _slices(live):
                    np.add.at(belief, edges[part, 1], there[part])
                    np.add.at(belief, edges[part, 0], back[part])
            return belief

        def renewed(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
            x = x[:, :, None] + weight
            top = x.max(axis=1, keepdims=True)
            new = (top + np.log(np.exp(x - top).sum(axis=1, keepdims=True)))[:, 0]
            return new - new.max(axis=1, keepdims=True)

        for _ in range(rounds):
            if not any(map(len, active)):
                break
            belief, moved = heard(active), np.zeros(int(group.max()) + 1, np.float32)
            for (edges, weight), (there, back), live in zip(kinds, sent, active):
                for part in _slices(live):
                    a, b = edges[part].T
                    first, second = renewed(belief[a] - back[part], weight), renewed(belief[b] - there[part], weight.T)
                    for old, new in ((there, first), (back, second)):
                        np.maximum.at(moved, group[a], np.abs(new - old[part]).max(axis=1))
                        old[part] = 0.5 * old[part] + 0.5 * new
            active = [live[moved[group[edges[live, 0]]] >= 1e-3] for (edges, _), live in zip(kinds, active)]
        belief = heard([np.arange(len(edges), dtype=np.int32) for edges, _ in kinds])
        for part in _slices(np.arange(len(belief))):
            e = np.exp(belief[part] - belief[part].max(axis=1, keepdims=True))
            belief[part] = e / e.sum(axis=1, keepdims=True)
        return belief


def _slices(index: np.ndarray, size: int = 1 << 16) -> Iterator[np.ndarray]:
    return (index[i : i + size] for i in range(0, len(index), size))


def _spoil(token: str, kind: int) -> str:
    """A copy that the kind's check rejects."""
    if kind == 3:  # one digit off
        i = max(i for i, c in enumerate(token) if c.isdigit())
        return token[:i] + str((int(token[i]) + 1) % 10) + token[i + 1 :]
    if kind == 2:
        return token.replace(".", ".9", 1) + "99"
    if kind == 1:
        return token.replace(".", "")
    return "9" + token.replace("+", "")


def train(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], steps: int = 150) -> Field:
    """Pseudo-likelihood: each label given the token and the labels of its neighbours, with a prior on the weights.

    Each example: features of the tokens, their labels, rows of chain and skip edges, and features of spoilt copies.
    """
    field = Field.prior()
    rng = np.random.default_rng(7)
    rows, labels, left, right, friends = [], [], [], [], []
    for numbers, marks, chain, skip, spoilt in examples:
        n, extra = len(marks), len(spoilt)
        before, after, same = np.full(n + extra, -1), np.full(n + extra, -1), np.zeros((n + extra, LABELS))
        before[chain[:, 1]], after[chain[:, 0]] = marks[chain[:, 0]], marks[chain[:, 1]]
        np.add.at(same, (skip[:, 0], marks[skip[:, 1]]), 1)
        np.add.at(same, (skip[:, 1], marks[skip[:, 0]]), 1)
        for held, part in ((rows, np.concatenate([numbers, spoilt])), (labels, np.append(marks, np.zeros(extra, marks.dtype))), (left, before), (right, after), (friends, same)):
            held.append(part)
    if not sum(map(len, rows)):
        return field
    rows, labels, left, right, friends = map(np.concatenate, (rows, labels, left, right, friends))
    x, y = rows, labels
    hot = np.eye(LABELS + 1)[:, :LABELS]
    before, after, same = hot[left], hot[right], friends
    blind = rng.random(len(x)) < 0.1  # some labels must follow from the neighbours alone
    prior = [field.unary.copy(), field.chain.copy(), field.skip.copy()]
    weights = [w.copy() for w in prior]
    momentum, speed = [np.zeros_like(w) for w in prior], [np.zeros_like(w) for w in prior]
    for step in range(1, steps + 1):
        u, c, s = weights
        z = np.where(blind[:, None], 0, u[x].sum(axis=1)) + before @ c + after @ c.T + same @ s
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        gu = np.zeros_like(u)
        for f in range(x.shape[1]):
            np.add.at(gu, x[~blind, f], p[~blind])
        gs = same.T @ p
        grads = [gu, before.T @ p + (after.T @ p).T, (gs + gs.T) / 2]
        for k, (w, g) in enumerate(zip(weights, grads)):
            g = g + 1e-4 * (w - prior[k])
            momentum[k] = 0.9 * momentum[k] + 0.1 * g
            speed[k] = 0.99 * speed[k] + 0.01 * g * g
            weights[k] = w - 0.1 * (momentum[k] / (1 - 0.9**step)) / (np.sqrt(speed[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*weights)


#: Distinct texts that the weights are learned from, and candidate tokens of all of them together.
SAMPLE_ROWS, SAMPLE_TOKENS = 2000, 200_000
_EXAMPLE = "key long, features array<int>, labels array<int>, chain array<int>, skip array<int>, spoilt array<int>"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            if key in seen:
                continue
            seen.add(key)
            text = text.as_py()
            d = Document(text, base_spans(text))
            spoilt = [features(_spoil(text[d.start[i] : d.end[i]], d.labels[i])) for i in np.flatnonzero((d.labels > 0) & (d.labels < 4)).tolist()]
            flat = [d.features, d.labels, d.chain, d.skip, np.array(spoilt)]
            yield pa.record_batch([pa.array([key]), *(pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel().astype(np.int32))) for x in flat)],
                                  names=["key", "features", "labels", "chain", "skip", "spoilt"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, tokens: int = SAMPLE_TOKENS) -> Field:
    """A field trained on the pattern matches of about ``rows`` distinct texts with candidates, chosen by a hash of the text.

    Texts are used whole, in the order of their hashes while they hold at most ``tokens``
    candidates together; one that would exceed that is left out.  The sizes are known before
    the examples come to the driver, and copies of a text are one example.
    """
    able = small_batches(docs).select(F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    total = able.count()
    if not total:
        return Field.prior()
    share = min(1.0, rows / total)
    chosen = able.withColumn("key", F.xxhash64("text")).where(F.pmod("key", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    found = materialize(chosen.mapInArrow(_examples, _EXAMPLE).dropDuplicates(["key"]))
    left, keys = tokens, []
    for key, n in sorted(map(tuple, found.select("key", F.size("labels")).collect())):
        if n <= left:
            left -= n
            keys.append(key)
    examples = sorted(found.where(F.col("key").isin(keys)).collect(), key=lambda r: r.key) if keys else []
    return train([(np.array(r.features, np.int64).reshape(-1, PER_TOKEN), np.array(r.labels, np.int64), np.array(r.chain, np.int64).reshape(-1, 2),
                   np.array(r.skip, np.int64).reshape(-1, 2), np.array(r.spoilt, np.int64).reshape(-1, PER_TOKEN)) for r in examples])


def find(texts: list[str], field: Field, least: float = 0.9) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, spans that the field adds) of each text."""
    base = [base_spans(t) for t in texts]
    held = [Document(t, s) for t, s in zip(texts, base)]
    offset = np.cumsum([0] + [len(d.labels) for d in held])
    scores = np.zeros((int(offset[-1]), LABELS), np.float32)
    for d, o in zip(held, offset):
        for part in _slices(np.arange(len(d.labels))):
            scores[o + part] = field.unary[d.features[part]].sum(axis=1)
        known = np.flatnonzero(d.labels)
        scores[o + known] = -30.0
        scores[o + known, d.labels[known]] = 0.0
        # the label of evidence is known, so its message to each mention is too
        scores[o + d.heard] += d.evidence @ field.skip
    chain = np.concatenate([np.zeros((0, 2), np.int32), *(d.chain + np.int32(o) for d, o in zip(held, offset))])
    skip = np.concatenate([np.zeros((0, 2), np.int32), *(d.skip + np.int32(o) for d, o in zip(held, offset))])
    p = field.marginals(scores, chain, skip, np.repeat(np.arange(len(held), dtype=np.int32), np.diff(offset)))
    out = []
    for d, spans, o in zip(held, base, offset):
        added: list[Span] = []
        likely = p[o : o + len(d.labels), 1:]
        for i in np.flatnonzero((likely.max(axis=1) >= least) & (d.labels == 0)).tolist():
            a, b, kind = int(d.start[i]), int(d.end[i]), int(likely[i].argmax())
            if added and added[-1][1] == kind and d.follows[i] and added[-1][2] == d.end[i - 1]:
                added[-1] = (added[-1][0], kind, b)
            else:
                added.append((a, kind, b))
        out.append((spans, added))
    return out


def _rows_with_candidates(column: pa.Array) -> np.ndarray:
    data, offsets = utf8(column)
    low = int(offsets[0])
    part = data[low : int(offsets[-1])]
    marked = np.concatenate(([0], np.cumsum(((part >= 48) & (part <= 57)) | (part == 64))))
    at = offsets - low
    return np.flatnonzero(marked[at[1:]] > marked[at[:-1]])


def _found(column: pa.Array, field: Field) -> Iterator[tuple[int, str, list[Span], list[Span]]]:
    rows = _rows_with_candidates(column)
    for k in range(0, len(rows), 500):
        part = rows[k : k + 500]
        texts = column.take(pa.array(part)).to_pylist()
        for i, text, (base, added) in zip(part.tolist(), texts, find(texts, field)):
            yield i, text, base, added


def _detect(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    nothing = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        n = batch.num_rows
        counts, digest, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
        for i, _, base, added in _found(batch.column("text"), field):
            for _, k, _ in base:
                counts[k, i] += 1
            digest[i] = hashlib.sha256(written(base).encode()).hexdigest()
            spans[i] = written(base + added)
        yield pa.record_batch([batch.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans)],
                              names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row of ``docs``.

    Offsets are code points.  Null and empty texts have no spans; repeated rows have equal
    results; an empty table trains no weights and gives no rows.  ``field``: a trained
    field, else one is fitted on ``docs``.
    """
    field = field or fit(docs, id_col, text_col)
    out = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return out.mapInArrow(partial(_detect, field=field), f"doc_id {out.schema['doc_id'].dataType.simpleString()}, n_email long, "
                          "n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind's name."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in sorted(spans):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch], field: Field, text_col: str, length_col: str | None) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        names = batch.schema.names
        column = batch.column(names.index(text_col)).cast(pa.string())
        changed = {i: mask(text, base + added) for i, text, base, added in _found(column, field) if base or added}
        if changed:
            texts = column.to_pylist()
            for i, text in changed.items():
                texts[i] = text
            columns = batch.columns
            columns[names.index(text_col)] = pa.array(texts, column.type)
            if length_col:
                sizes = batch.column(names.index(length_col)).to_pylist()
                for i, text in changed.items():
                    sizes[i] = len(text)
                columns[names.index(length_col)] = pa.array(sizes, batch.column(names.index(length_col)).type)
            batch = pa.record_batch(columns, names=names)
        yield batch


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
           field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in the text replaced by [EMAIL], [IP], [CARD] or [PHONE]; ``length_col`` follows.

    Null and empty texts and texts without personal data stay as they are; repeated rows change alike.
    """
    field = field or fit(docs, id_col, text_col)
    return docs.mapInArrow(partial(_mask, field=field, text_col=text_col, length_col=length_col), docs.schema)
