"""Graph patterns as ordered joins over the node and edge tables.

A pattern is a chain of nodes and edges::

    match(nodes, edges, Node("a", F.col("type") == "supplier"), Edge(("located_in",)), Node("n"), Edge(("lives_in",), "in"), Node("c", F.col("conf") > 0.5))

Matching begins at a node with a predicate and grows to both sides, towards
predicates first, so that selective ends are joined early; edge types and
predicates are filters on the scans, and only the columns of the pattern are
read.  No edge occurs twice in a match, nodes may.  An edge of variable length
stands for every chain from its least to its greatest number of edges.

Rows with null ids match nothing; repeated node rows count once, edges with one
id are one edge; self-loops match an undirected edge once; an empty table gives
no match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges that a variable length may ask for.
MAX_HOPS = 6


@dataclass(frozen=True)
class Node:
    """A node by its name in the match; ``where`` is a condition on the columns of the node table."""

    name: str
    where: Column | None = None


@dataclass(frozen=True)
class Edge:
    """An edge of some types (all, if none): ``out`` follows the pattern, ``in`` runs against it, ``any`` is either."""

    types: tuple[str, ...] = ()
    direction: str = "out"
    hops: tuple[int, int] = (1, 1)
    name: str | None = None
    where: Column | None = None

    def __post_init__(self) -> None:
        if self.direction not in ("out", "in", "any"):
            raise ValueError(f"unknown direction {self.direction}")
        if not 1 <= self.hops[0] <= self.hops[1] <= MAX_HOPS:
            raise ValueError(f"hops must be from 1 to {MAX_HOPS}, the least first")


def match(nodes: DataFrame, edges: DataFrame, *pattern: Node | Edge, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each match: the id of every node under its name, the edge ids of every named edge, and ``name_column`` for the columns in ``keep``."""
    chain = list(pattern)
    if not chain or len(chain) % 2 == 0 or any(isinstance(p, Node) == bool(i % 2) for i, p in enumerate(chain)):
        raise ValueError("a pattern is a chain of nodes with an edge between every two")
    names = [p.name for p in chain if p.name]
    if len(set(names)) < len(names):
        raise ValueError("names of a pattern must differ")
    spots = range(0, len(chain), 2)
    at = next((i for i in spots if chain[i].where is not None), 0)
    ids = lambda node: (nodes if node.where is None else nodes.where(node.where)).select(F.col("id").alias("_id")).where("_id IS NOT NULL").distinct()
    now = ids(chain[at]).select(F.col("_id").alias(chain[at].name), F.array().cast("array<string>").alias("_used"))
    low = high = at
    while low > 0 or high < len(chain) - 1:
        ahead = high < len(chain) - 1 and (low == 0 or chain[high + 2].where is not None or chain[low - 2].where is None)
        here, edge, node = (chain[high], chain[high + 1], chain[high + 2]) if ahead else (chain[low], chain[low - 1], chain[low - 2])
        now = _grown(now, here.name, edge, node.name, _steps(edges, edge, ahead), ids(node))
        low, high = (low, high + 2) if ahead else (low - 2, high)
    for name in (chain[i].name for i in spots):
        if keep:
            extra = nodes.groupBy("id").agg(*[F.min(c).alias(f"{name}_{c}") for c in keep]).withColumnRenamed("id", "_id")
            now = now.join(extra, now[name] == extra["_id"]).drop("_id")
    return now.drop("_used")


def _steps(edges: DataFrame, edge: Edge, ahead: bool) -> DataFrame:
    """(_edge, _u, _v): edges of the pattern's type in the direction in which it is walked."""
    rows = edges if edge.where is None else edges.where(edge.where)
    if edge.types:
        rows = rows.where(F.col("pred").isin(*edge.types))
    with_it = rows.select(F.col("id").cast("string").alias("_edge"), F.col("src_id").alias("_u"), F.col("dst_id").alias("_v")).where("_u IS NOT NULL AND _v IS NOT NULL").distinct()
    against = with_it.select("_edge", F.col("_v").alias("_u"), F.col("_u").alias("_v"))
    if edge.direction == "any":
        return with_it.unionByName(against.where("_u <> _v"))
    return with_it if (edge.direction == "out") == ahead else against


def _grown(now: DataFrame, here: str, edge: Edge, there: str, steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Matches with one more edge and node; chains of a variable length grow hop by hop."""
    least, most = edge.hops
    rows, out = now.withColumn("_at", F.col(here)).withColumn("_walk", F.array().cast("array<string>")), None
    for hop in range(1, most + 1):
        rows = rows.join(steps, rows["_at"] == steps["_u"]).where(~F.array_contains("_used", F.col("_edge")))
        rows = rows.withColumn("_at", F.col("_v")).withColumn("_walk", F.array_append("_walk", F.col("_edge"))).withColumn("_used", F.array_append("_used", F.col("_edge"))).drop("_u", "_v", "_edge")
        if hop >= least:
            out = rows if out is None else out.unionByName(rows)
    out = out.join(ends, out["_at"] == ends["_id"], "left_semi").withColumnRenamed("_at", there)
    return out.withColumnRenamed("_walk", edge.name) if edge.name else out.drop("_walk")
