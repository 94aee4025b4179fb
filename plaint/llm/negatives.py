"""Hard-negative mining with score bounds along a spanning tree of the anchors.

The anchors of a chunk are joined by a minimum spanning tree of their distances.  The
scores of the root's rows are computed; at a child, a row's score lies within its parent's
score plus or minus edge length times the row's norm.  Only rows whose interval overlaps what
the child looks for (better than its k-th positive so far, or inside the score windows of its
positives) are scored again; theirs are exact then, the others' intervals grow by the edge.
The tree is walked with each node's largest subtree last, so that the intervals of few
ancestors (the logarithm of the anchors) are held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaint.llm.vectors import LARGEST, Block, Queries, blocks, chunks, dots, first, reach, rows
from plaint.session import materialize

#: (q, slot) names an anchor and, for negatives, one of its positives.
FOUND = pa.schema([("q", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
HITS = "q long, slot int, id long, score long"
Top = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


class Tree:
    """A minimum spanning tree of ``members`` of ``vectors``, in an order that holds few intervals."""

    def __init__(self, vectors: np.ndarray, members: np.ndarray):
        x = vectors[members].astype(np.float64)
        n = len(x)
        squares = (x * x).sum(axis=1)
        exact = 4 * squares.max(initial=0) < LARGEST
        near, parent, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
        children: list[list[int]] = [[] for _ in range(n)]
        reached, at = [], 0
        for _ in range(n):
            left[at] = False
            reached.append(at)
            apart = squares + squares[at] - 2 * (x @ x[at]) if exact else np.full(n, np.inf)
            nearer = left & (apart < near)
            near[nearer], parent[nearer] = apart[nearer], at
            if not left.any():
                break
            at = int(np.argmin(np.where(left, near, np.inf))) if exact else int(np.flatnonzero(left)[0])
            children[parent[at]].append(at)
        weight = np.ones(n, np.int64)
        for node in reversed(reached[1:]):
            weight[parent[node]] += weight[node]
        #: Edge to the parent, rounded up; equal vectors have none.
        self.edge = np.sqrt(np.maximum(near, 0)) * (1 + 1e-12)
        self.members, self.root = members, 0
        self.children = [sorted(c, key=lambda j: -weight[j]) for c in children]


def walk(tree: Tree, vectors: np.ndarray, block: np.ndarray, norms: np.ndarray,
         wanted: Callable[[int, np.ndarray, np.ndarray], np.ndarray],
         take: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
    """Visits the anchors; ``take(anchor, positions, scores)`` gets what ``wanted(anchor, low, high)`` marks.

    ``low`` and ``high`` bound the scores of the block's rows.
    """
    pending: list[tuple[int, np.ndarray | None, np.ndarray | None]] = [(tree.root, None, None)]
    while pending:
        node, low, high = pending.pop()
        anchor = int(tree.members[node])
        q = vectors[anchor]
        if low is None:
            scores = dots(block, q)
            low = high = scores.astype(np.float64)
            chosen = np.flatnonzero(wanted(anchor, low, high))
            take(anchor, chosen, scores[chosen])
        else:
            if tree.edge[node] > 0:
                with np.errstate(invalid="ignore"):
                    reach = np.where(norms > 0, tree.edge[node] * norms, 0.0)
                low, high = np.floor(low - reach), np.ceil(high + reach)
            chosen = np.flatnonzero(wanted(anchor, low, high))
            known = low[chosen] == high[chosen]
            scores = low[chosen].astype(np.int64) if known.all() else None
            if scores is None and 2 * (~known).sum() > len(low):
                whole = dots(block, q)
                scores, low = whole[chosen], whole.astype(np.float64)
                high = low
            elif scores is None:
                scores = np.where(known, np.where(known, low[chosen], 0).astype(np.int64), 0)
                again = chosen[~known]
                scores[~known] = dots(block[again], q)
                low, high = low.copy(), high.copy()
                low[again] = high[again] = scores[~known]
            take(anchor, chosen, scores)
        pending.extend((child, low, high) for child in tree.children[node])


class Mining:
    """What a chunk of anchors looks for in blocks of rows; keeps the best of each (anchor, slot)."""

    def __init__(self, asked: Queries, k: int):
        self.asked, self.k, self.best = asked, k, Top()

    def keep(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.best:
            scores, ids = np.concatenate([self.best[key][0], scores]), np.concatenate([self.best[key][1], ids])
        at = first(scores, ids, self.k)
        self.best[key] = scores[at], ids[at]

    def least(self, key: tuple[int, int]) -> float:
        """Scores below it cannot enter any more."""
        scores, _ = self.best.get(key, ((), ()))
        return float(scores[-1]) if len(scores) == self.k else -np.inf

    def found(self) -> Iterator[pa.RecordBatch]:
        for (q, slot), (scores, ids) in self.best.items():
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q, np.int64)), pa.array(np.full(n, slot, np.int32)),
                                              pa.array(ids), pa.array(scores)], schema=FOUND)


class Positives(Mining):
    """The best rows of an anchor's own label, of other ids; a tree for each label."""

    def __init__(self, asked: Queries, k: int):
        super().__init__(asked, k)
        self.trees = {d: {int(y): Tree(x, np.flatnonzero(labels == y)) for y in np.unique(labels)}
                      for d, (_, _, labels, x) in asked.by_dim.items()}

    def scan(self, block: Block, norms: np.ndarray) -> None:
        numbers, ids, _, vectors = self.asked.by_dim[block.dim]
        for label, tree in self.trees[block.dim].items():
            a, b = np.searchsorted(block.labels, [label, label + 1])
            if a == b:
                continue
            there = block.ids[a:b]

            def wanted(i, low, high):
                return (high >= self.least((int(numbers[i]), 0))) & (there != ids[i])

            def take(i, at, scores):
                if len(at):
                    self.keep((int(numbers[i]), 0), scores, there[at])

            walk(tree, vectors, block.vectors[a:b], norms[a:b], wanted, take)


class Negatives(Mining):
    """The best rows of other labels inside each score window of an anchor; one tree of all anchors."""

    def __init__(self, asked: Queries, k: int, windows: dict[int, list[tuple[int, int, int]]]):
        super().__init__(asked, k)
        self.windows = windows
        self.trees = {d: Tree(x, np.flatnonzero([int(n) in windows for n in numbers]))
                      for d, (numbers, _, _, x) in asked.by_dim.items()}

    def scan(self, block: Block, norms: np.ndarray) -> None:
        numbers, _, labels, vectors = self.asked.by_dim[block.dim]
        tree = self.trees[block.dim]
        if not len(tree.members):
            return

        def wanted(i, low, high):
            open_ = [(max(lo, self.least((int(numbers[i]), slot))), hi) for slot, lo, hi in self.windows[int(numbers[i])]]
            marked = (high >= min(x for x, _ in open_)) & (low <= max(x for _, x in open_))
            a, b = np.searchsorted(block.labels, [labels[i], labels[i] + 1])
            marked[a:b] = False
            return marked

        def take(i, at, scores):
            for slot, lo, hi in self.windows[int(numbers[i])]:
                key = int(numbers[i]), slot
                inside = np.flatnonzero((scores >= max(lo, self.least(key))) & (scores <= hi))
                if len(inside):
                    self.keep(key, scores[inside], block.ids[at[inside]])

        walk(tree, vectors, block.vectors, norms, wanted, take)


def _scan(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    mining: Mining = sent.value
    mining.best = Top()
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block({c: batch.column(c)[i].as_py() for c in batch.schema.names})
            if block.dim in mining.asked.by_dim:
                x = block.vectors.astype(np.float64)
                if reach(block.vectors, np.full(block.dim, np.abs(mining.asked.by_dim[block.dim][3]).max(initial=0))) < LARGEST:
                    norms = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12)
                else:  # bounds in doubles would not be sure: every row is scored
                    norms = np.full(block.n, np.inf)
                mining.scan(block, norms)
    yield from mining.found()


def _best(spark: SparkSession, index: DataFrame, mining: Mining) -> DataFrame:
    """(q, slot, rank, id, score) of a chunk: the best of each (q, slot) over all blocks."""
    sent = spark.sparkContext.broadcast(mining)
    by_score = Window.partitionBy("q", "slot").orderBy(F.desc("score"), "id")
    hits = index.mapInArrow(lambda batches: _scan(batches, sent), HITS)
    best = materialize(hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= mining.k))
    sent.unpersist()
    return best


def mine(df: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, every: int = 100,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor.

    Anchors are the rows whose id is divisible by ``every``.  An anchor's positives are the
    ``positives`` rows of its label, of other ids, with the highest integer inner product;
    for each, the ``negatives`` highest rows of other labels with low * positive_score <=
    100 * negative_score <= high * positive_score; ties go to the smaller id.  Fewer rows give
    fewer results; a window without a row gives none.  Components become floor(scale * x),
    held to +-2**53; scores are exact and held to the range of a long.  Vectors meet those of
    their own length only.  Rows with a null id, label or vector, or a null or non-finite
    component, take no part; repeated rows count as often as they occur.  An empty table gives
    no rows; other columns are ignored.

    Each chunk of anchors is two scans of the rows' blocks; the driver holds one chunk and its positives.
    """
    spark = df.sparkSession
    members = rows(df, id_col, vector_col, label_col)
    index, found = None, []
    for chunk in chunks(members, every, scale):
        index = index or materialize(blocks(members, scale))
        near = _best(spark, index, Positives(chunk, positives)).selectExpr(
            "q", "rank as slot", "id as positive_id", "score as positive_score")
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for r in near.collect():
            span = -(-low * r.positive_score // 100), high * r.positive_score // 100
            if span[0] <= span[1]:
                windows.setdefault(r.q, []).append((r.slot, *span))
        if not windows:
            continue
        anchors = spark.createDataFrame(
            [(int(q), int(i)) for numbers, ids, _, _ in chunk.by_dim.values() for q, i in zip(numbers, ids)], "q long, anchor_id long")
        hits = _best(spark, index, Negatives(chunk, negatives, windows))
        found.append(hits.join(near, ["q", "slot"]).join(anchors, "q").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    if not found:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
