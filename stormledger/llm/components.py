"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a partition holds at least: a short list isn't spread over as many files as a long one.
PART_EDGES = 200_000
#: Rounds after which something must be wrong: each round at least halves the longest path.
MAX_ROUNDS = 60


def _few(df: DataFrame, edges: int) -> DataFrame:
    """``df``, made of so many edges, in no more partitions than they need."""
    return df.coalesce(max(1, 2 * edges // PART_EDGES))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node's larger neighbours to its smallest one (or itself)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(_few(both.groupBy("u").agg(F.min("v").alias("m")), n))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them; edges point from larger to smaller."""
    least = cut(_few(edges.groupBy("u").agg(F.min("v").alias("m")), n))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node of ``edges`` (columns ``u`` and ``v``, long).

    Rows with a null or with u = v, and repeated rows, change nothing. Each round is cut in the shared folder, and so are the
    nodes' least neighbours: a node with very many edges is then a hot key of a join of two sides that are shuffled
    for it alone, which adaptive execution splits.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    state = _state(edges)
    edges = _few(edges, state[0])
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        n = state[0]
        edges = cut(_few(_small_star(cut(_few(_large_star(edges, n), n)), n), n))
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
