"""Connected components on DataFrames: edges are contracted within their tasks, then, as long as edges are left that are
no stars, alternating large and small stars, each round a table in the shared folder. A round is some ten jobs, whose
plans cost the driver memory and time whatever the number of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methylake.llm.common import discard, map_arrow, split_join, written_at

#: Edges that a task contracts at once.
CHUNK = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it reaches) over the edges (a, b), without the smallest nodes themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, least = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(least, label[x], low)
        np.minimum.at(least, label[y], low)
        while ((further := least[least]) != least).any():
            least = further
        if (least == label).all():
            tied = label != np.arange(len(nodes))
            return nodes[tied], nodes[label[tied]]
        label = least


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with the components of edges: a forest of stars for each chunk of a task's edges."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield close(held)
                held, n = [], 0
        if n:
            yield close(held)

    def close(held):
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in forest(table.column(0).to_numpy(), table.column(1).to_numpy())], ["a", "b"])

    return map_arrow(edges, run, "a long, b long")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Minima are pre-aggregated before the shuffle; in the join back adaptive execution may deal the
    edges of a hub to several tasks."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = split_join(near, least, ["u"])
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end is in one edge only: then each edge ties a node to the smallest one that it reaches."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up")))
    crossed = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max(1 - F.col("up")).alias("down")).where("up > 1 or (up = 1 and down = 1)")
    return not crossed.agg(F.count(F.lit(1))).first()[0]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component the smallest node that it reaches.

    Edges with a null end or between a node and itself are ignored; repeated ones count once. No node, edge or
    label goes to the driver: only whether all edges are stars does, each node an end of one edge alone unless it is
    the smaller end of all its edges. A round's table is deleted when the next one stands.
    """
    spark = edges.sparkSession
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    edges, path = written_at(_contracted(edges), "edges")
    for _ in range(max_rounds):
        if _stars(edges):
            break
        old = path
        edges, path = written_at(_star(_star(edges, True), False), "stars")
        discard(spark, old)
    else:
        raise RuntimeError("connected_components: rounds used up")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
