"""Prefix trie of conversations, from range-minimum queries over sorted LCPs.

A conversation is the sequence of its turns' digests, kept as one binary key; equal ones are
grouped, distinct keys are sorted over all tasks and each task's rows form a block.  LCP[i] is
the number of turns that row i shares with the row before.  A node is a candidate prefix (row
i, depth d) with LCP[i] < d <= length[i].  Its extent to the right, and its parent's to the
left and to the right, are found one by one by binary search over a sparse table of minima of
the LCPs, so there is no stack and each candidate is independent of the others.

Extents that reach the end of a block go on in the next ones.  For each depth that a block's
first row shares with the row before, a block gives a summary of the rows at its head that
have that prefix (and of those at its tail for the block after); chains of such summaries,
which are as many as blocks times shared depths, are added up once and sent to all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import group_bounds, small_batches
from plaint.session import materialize

WIDTH = 16  # bytes of a turn's digest
#: Turns that a block of sorted conversations is sized for.
BLOCK_TURNS = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()
GROUPS = "digest binary, n_convs long, conv_id long, ends_sha256 string"
EDGES = "block int, first binary, last binary"
ENDS = "block int, side string, depth int, whole boolean, n long, least long, leaves long, children long, saved long, bytes long, starts boolean"
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string")
FAR = np.iinfo(np.int64).max


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (digest as hex, text bytes)) of every conversation, in the order of turns.

    Turns go by number, null first; those of one number by the digest of role and text.  A
    null role or text is empty; rows with a null conv_id take no part; repeated rows are turns
    of their own; other columns are ignored.  Texts do not leave their task: the shuffle
    carries a digest and a length for a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct(F.col(turn_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"))
    numbered = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv_id"), one.alias("t"))
    return numbered.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.digest, t.bytes)).alias("turns"))


def rebuilt(convs: DataFrame, base: Column, shared: Column) -> DataFrame:
    """Each conversation's first ``shared`` turns replaced by those of conversation ``base``; the others stay.

    ``shared`` is at most 8.
    """
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    joined = convs.withColumn("base", base).withColumn("shared", shared).join(heads, "base", "left")
    own = F.filter("turns", lambda t, i: i >= F.col("shared"))
    head = F.filter(F.coalesce("head", F.array().cast(joined.schema["head"].dataType)), lambda t, i: i < F.col("shared"))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


# ------------------------------------------------------------------ equal conversations
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of rows sorted by (digest, conv_id); ids go into the hash as they come."""
    schema = pa.schema([("digest", pa.binary()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
    now, state, n, least = None, None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        digests, ids = batch.column("digest").to_numpy(zero_copy_only=False), batch.column("conv_id").to_numpy()
        out = []
        bounds = group_bounds([digests])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if digests[a] != now:
                if now is not None:
                    out.append((now, n, least, state.hexdigest()))
                now, state, n, least = digests[a], hashlib.sha256(), 0, int(ids[a])
            state.update((("," if n else "") + ",".join(map(str, ids[a:b].tolist()))).encode())
            n += int(b - a)
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(list(zip(*out)) or [()] * 4, schema)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip((now, n, least, state.hexdigest()), schema)], schema=schema)


def distinct(convs: DataFrame) -> DataFrame:
    """(key, bytes, n_convs, conv_id, ends_sha256) of each distinct sequence; conv_id is its smallest.

    Only 24 bytes a conversation are dealt by sequence, and a group of copies streams through
    its task; the key itself comes from the group's smallest conversation.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    keyed = materialize(convs.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t.bytes).alias("bytes")))
    short = keyed.select(F.unhex(F.md5("key")).alias("digest"), "conv_id")
    groups = short.repartition("digest").sortWithinPartitions("digest", "conv_id").mapInArrow(_groups, GROUPS)
    return keyed.join(groups.drop("digest"), "conv_id")


# ------------------------------------------------------------------------------ blocks
class Sparse:
    """Minima of all runs of a power of two of ``values``."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (width := 1 << (len(self.levels) - 1)) <= len(values):
            above = self.levels[-1]
            self.levels.append(np.minimum(above[:-width], above[width:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minimum of values[first..last], for each pair."""
        span = (last - first + 1).astype(np.int64)
        level = np.frexp(span.astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """For each pair the last position r >= start with values[start + 1 .. r] >= depth."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            table, width = self.levels[k], 1 << k
            fits = np.flatnonzero(at + 1 + width <= len(self.levels[0]))
            go = fits[table[at[fits] + 1] >= depth[fits]]
            at[go] += width
        return at

    def left(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """For each pair the first position l <= start with values[l + 1 .. start] >= depth."""
        at = start.copy()
        for k in reversed(range(len(self.levels))):
            table, width = self.levels[k], 1 << k
            fits = np.flatnonzero(at - width >= 0)
            go = fits[table[at[fits] - width + 1] >= depth[fits]]
            at[go] -= width
        return at


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with alike."""
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    differ = x != y
    return (int(differ.argmax()) if differ.any() else n) // WIDTH


class Block:
    """The sorted rows of a task: LCPs, candidate nodes and their extents inside the block.

    ``before`` and ``after`` are the turns that the first row shares with the row before it and
    that the last row shares with the row after it; -1 where there is none.
    """

    def __init__(self, rows: pa.Table, before: int, after: int):
        key, size = (rows.column(c).combine_chunks() for c in ("key", "bytes"))
        self.n, self.before, self.after = len(rows), before, after
        self.least_of, self.copies = (rows.column(c).to_numpy() for c in ("conv_id", "n_convs"))
        self.ends = rows.column("ends_sha256")
        size = np.append(size.flatten().to_numpy(), 0)  # the last one stands for the root's text
        keys = key.cast(pa.large_binary())
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + self.n + 1] // WIDTH
        data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)[WIDTH * offsets[0] : WIDTH * offsets[-1]]
        turns, offsets = data.copy().view(np.uint64).reshape(-1, 2), offsets - offsets[0]
        self.length = np.diff(offsets)
        self.lcp = np.empty(self.n, np.int64)
        self.lcp[0] = before
        self.lcp[1:] = self._adjacent(turns, offsets)
        self.next_lcp = np.append(self.lcp[1:], after)
        self.leaf = self.next_lcp < self.length
        self.sparse = Sparse(self.lcp)
        made = self.length - self.lcp  # nodes that begin at a row, with depths lcp + 1 .. length
        self.start = np.repeat(np.arange(self.n), made)
        begins = np.cumsum(made) - made
        self.depth = np.arange(len(self.start)) - begins[self.start] + self.lcp[self.start] + 1
        self.first_node = np.append(begins, len(self.start))
        self.size = size[np.where(self.depth > 0, offsets[self.start] + self.depth - 1, -1)]
        self.last_size = size[offsets[-2] : offsets[-1]]
        self.end = self.sparse.right(self.start, self.depth)
        self.open = (self.end == self.n - 1) & (after >= self.depth)
        self.sum_copies = np.append(0, np.cumsum(self.copies))
        self.sum_leaves = np.append(0, np.cumsum(self.leaf))
        self.by_depth = np.sort(self.lcp * np.int64(self.n + 1) + np.arange(self.n))

    def _adjacent(self, turns: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """LCP of each row but the first with the row before it."""
        both = np.minimum(self.length[1:], self.length[:-1])
        row = np.repeat(np.arange(self.n - 1), both)
        at = np.arange(len(row)) - (np.cumsum(both) - both)[row]
        differ = (turns[offsets[row] + at] != turns[offsets[row + 1] + at]).any(axis=1)
        out = both.copy()
        np.minimum.at(out, row[differ], at[differ])
        return out

    def children(self, first: np.ndarray, last: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Rows of first..last whose LCP is ``depth``: nodes of the next depth that begin there."""
        code = depth * np.int64(self.n + 1)
        return np.searchsorted(self.by_depth, code + last, "right") - np.searchsorted(self.by_depth, code + first, "left")

    def members(self, beyond: dict | None = None) -> np.ndarray:
        """Conversations of each node; ``beyond``: those of open nodes in later blocks, by depth."""
        n = self.sum_copies[self.end + 1] - self.sum_copies[self.start]
        if beyond is not None and self.open.any():
            n[self.open] += np.array([beyond[int(d)] for d in self.depth[self.open]], np.int64)
        return n

    def saved(self, members: np.ndarray) -> np.ndarray:
        """Prefix sums over nodes of (conversations - 1) * bytes."""
        return np.append(0, np.cumsum((members - 1) * self.size))


def _by_block(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last key of a block."""
    first = last = block = None
    for batch in batches:
        if batch.num_rows:
            block = batch.column("block")[0].as_py()
            first = batch.column("key")[0].as_py() if first is None else first
            last = batch.column("key")[-1].as_py()
    if block is not None:
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary())],
                                         names=["block", "first", "last"])


def _ends(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Summaries of a block's head and tail, for each depth shared with the row before and after."""
    rows = _by_block(batches)
    if rows is None:
        return
    number = rows.column("block")[0].as_py()
    block = Block(rows, *sent.value[number])
    columns: dict[str, list[np.ndarray]] = {c.split()[0]: [] for c in ENDS.split(", ")}
    least = Sparse(block.least_of)
    saved = block.saved(block.members())[block.first_node]

    def add(side: str, **values: np.ndarray) -> None:
        n = len(values["depth"])
        for c, held in columns.items():
            held.append(np.full(n, number) if c == "block" else np.full(n, side) if c == "side" else values.get(c, np.zeros(n, np.int64)))

    depth = np.arange(block.before + 1)
    if len(depth):
        zero = np.zeros(len(depth), np.int64)
        end = block.sparse.right(zero, depth)
        add("head", depth=depth, whole=(end == block.n - 1) & (block.after >= depth), n=block.sum_copies[end + 1], least=least.least(zero, end),
            leaves=block.sum_leaves[end + 1], children=block.children(zero, end, depth), saved=saved[end + 1], bytes=zero, starts=zero > 0)
    depth = np.arange(block.after + 1)
    if len(depth):
        last = np.full(len(depth), block.n - 1)
        start = block.sparse.left(last, depth)
        add("tail", depth=depth, whole=(start == 0) & (block.before >= depth), least=least.least(start, last),
            bytes=np.append(0, block.last_size)[depth], starts=block.lcp[start] < depth)
    types = dict(c.split() for c in ENDS.split(", "))
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(v) if v else [], arrow[types[c]]) if c not in ("whole", "starts")
         else pa.array(np.concatenate(v).astype(bool) if v else [], pa.bool_()) for c, v in columns.items()], names=list(columns))


class Chains:
    """Summaries of the rows beyond a block that have a prefix of its last (or first) row, by block and depth."""

    def __init__(self, order: list[int], ends: pa.Table):
        entries: dict[tuple[str, int], dict[int, dict]] = {}
        for r in ends.to_pylist():
            entries.setdefault((r["side"], r["block"]), {})[r["depth"]] = r
        #: For each block and depth: n, least, leaves, children, saved of the rows after it; the smallest id before it.
        self.after: dict[int, dict[int, tuple]] = {}
        self.before: dict[int, dict[int, int]] = {order[0]: {}} if order else {}
        for block, following in zip(reversed(order[:-1]), reversed(order[1:])):
            self.after[block] = {}
            more = self.after.get(following, {})
            # Nodes that begin in the following block and go on beyond it have conversations there too.
            beyond = sum(more[d][0] * t["bytes"] for d, t in entries.get(("tail", following), {}).items() if t["starts"])
            for depth, r in entries.get(("head", following), {}).items():
                n, least, leaves, children, saved = (r[c] for c in ("n", "least", "leaves", "children", "saved"))
                if r["whole"]:
                    m, saved = more[depth], saved + beyond
                    n, least, leaves, children, saved = n + m[0], min(least, m[1]), leaves + m[2], children + m[3], saved + m[4]
                self.after[block][depth] = n, least, leaves, children, saved
        for preceding, block in zip(order, order[1:]):
            self.before[block] = {}
            for depth, r in entries.get(("tail", preceding), {}).items():
                least = r["least"]
                self.before[block][depth] = min(least, self.before[preceding][depth]) if r["whole"] else least


def _nodes(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The trie nodes that begin in a block."""
    rows = _by_block(batches)
    if rows is None:
        return
    neighbours, chains = sent.value
    number = rows.column("block")[0].as_py()
    block = Block(rows, *neighbours[number])
    after, before = chains.after.get(number, {}), chains.before.get(number, {})
    beyond = {c: {d: v[i] for d, v in after.items()} for i, c in enumerate(("n", "least", "leaves", "children", "saved"))}

    def more(name: str, open_: np.ndarray, depth: np.ndarray, nothing: int = 0) -> np.ndarray:
        out = np.full(len(depth), nothing, np.int64)
        out[open_] = [beyond[name][int(d)] for d in depth[open_]]
        return out

    start, end, depth, open_ = block.start, block.end, block.depth, block.open
    least = Sparse(block.least_of)
    members = block.members(beyond["n"])
    # A node's subtree: itself, the nodes after it that begin at its row, and all that begin at further rows.
    saved = block.saved(members)
    subtree = saved[block.first_node[end + 1]] - saved[:-1]
    longer = (block.length[start] > depth).astype(np.int64)
    up = depth - 1
    left, right = block.sparse.left(start, up), block.sparse.right(start, up)
    parent = least.least(left, right)
    wide = np.flatnonzero((right == block.n - 1) & (block.after >= up) & (up >= 0))
    parent[wide] = np.minimum(parent[wide], [beyond["least"][int(d)] for d in up[wide]]) if len(wide) else parent[wide]
    wide = np.flatnonzero((left == 0) & (block.before >= up) & (up >= 0))
    parent[wide] = np.minimum(parent[wide], [before[int(d)] for d in up[wide]]) if len(wide) else parent[wide]
    own = block.ends.to_numpy(zero_copy_only=False)[start]
    ends = pa.array(np.where(depth == block.length[start], own, NOTHING), pa.string())
    out = pa.table({
        "conv_id": np.minimum(least.least(start, end), more("least", open_, depth, FAR)), "depth": depth,
        "parent_conv_id": pa.array(parent, pa.int64(), mask=depth == 0), "n_convs": members,
        "n_children": longer + block.children(start + 1, end, depth) + more("children", open_, depth),
        "n_leaves": block.sum_leaves[end + 1] - block.sum_leaves[start] + more("leaves", open_, depth),
        "saved_tokens": subtree + more("saved", open_, depth), "ends_sha256": ends})
    yield from out.to_batches(max_chunksize=10_000)


def trie(convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of ``convs`` (conv_id, turns: array of (digest, bytes)).

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id, null at the root;
    n_convs: members; n_children; n_leaves: childless nodes in its subtree, itself included;
    saved_tokens: over its subtree, members but one times bytes of the last turn's text;
    ends_sha256: hash of the ids of the members that end there, ascending, comma-joined.

    A conversation without turns is a member of the root; no conversations give no rows.
    Conversations have distinct ids.  A conversation's digests (24 bytes a turn) are one row;
    its texts are not needed here.
    """
    spark = convs.sparkSession
    kinds = materialize(distinct(convs))
    turns = kinds.agg(F.sum(F.size("bytes"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    ordered = kinds.repartitionByRange(parts, "key").sortWithinPartitions("key").withColumn("block", F.spark_partition_id())
    ordered = materialize(small_batches(ordered))
    edges = sorted(ordered.mapInArrow(_edges, EDGES).collect(), key=lambda r: r.block)
    if not edges:
        return spark.createDataFrame([], NODES)
    joints = [shared_turns(a.last, b.first) for a, b in zip(edges, edges[1:])]
    order = [r.block for r in edges]
    neighbours = dict(zip(order, zip([-1, *joints], [*joints, -1])))
    sent = spark.sparkContext.broadcast(neighbours)
    ends = ordered.mapInArrow(partial(_ends, sent=sent), ENDS).toArrow()
    sent = spark.sparkContext.broadcast((neighbours, Chains(order, ends)))
    return ordered.mapInArrow(partial(_nodes, sent=sent), NODES)
