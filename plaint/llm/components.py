"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm import common
from plaint.session import materialize

#: Links for each task of a round, if the session's shuffles have more partitions than that takes.
TASK_LINKS = 10_000


def _few(links: DataFrame, total: int) -> DataFrame:
    """``links``, at most ``total`` rows, in no more tasks than they fill."""
    return links.coalesce(max(1, -(-total // TASK_LINKS)))


def _at_least(rows: DataFrame, least: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """Adds m, the ``least`` (node, m, n: rows; at most ``total`` in all) of the node in ``key``, to each row.

    Only ``rows`` are shuffled, as ``least`` lies by node since its aggregation.  The values of fewer than
    SPREAD_PARTS frequent nodes are broadcast instead, and their rows are dealt by ``by``: a key that
    matches nothing, or a node whose value is not used.
    """
    share = max(1, -(-total // common.SPREAD_PARTS))
    often = F.broadcast(least.where(F.col("n") > share).select(F.col("node").alias(key), F.col("m").alias("often")))
    dealt = rows.join(often, key, "left").withColumn("node", F.when(F.col("often").isNull(), F.col(key)).otherwise(F.xxhash64(by)))
    return dealt.join(least.select("node", "m"), "node", "left").select(*rows.columns, F.coalesce("often", "m").alias("m"))


def _large(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours point to the smallest node around it (edges have u > v)."""
    both = edges.select(F.explode(F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("by")) for a, b in ("uv", "vu")])).alias("end"))
    least = both.select("end.*").groupBy("node").agg(F.least(F.min("by"), F.col("node")).alias("m"), F.count("*").alias("n"))
    return _few(_at_least(edges, least, "v", "u", 2 * total).select("u", F.col("m").alias("v")), total)


def _small(edges: DataFrame, total: int) -> DataFrame:
    """Each node's smaller neighbours, and the node, point to the smallest of them (edges have u > v)."""
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _at_least(edges, least, "u", "v", total).select(
        F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
    return _few(_few(moved, total).distinct(), total)


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of links (u > v), and of nodes that keep them from being stars: with two smaller neighbours, or one and a larger."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("end")).select("end.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    loose = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up")))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(loose)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: bigint); component is its smallest node.

    Links and components stay distributed: each round is two aggregations and two joins,
    written to the shared checkpoint folder; a star's centre is dealt over many tasks.  Loops, nulls and repeated links are harmless;
    no links give no rows.  The number of rounds is logarithmic in the longest chain; links that are stars need none.
    """
    edges = materialize(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        total, loose = _state(edges)
        if not loose:
            break
        edges = materialize(_small(_large(edges, total), total))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
