"""Connected components of a link table by repeated contraction, without collecting links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise

#: So many links, of both directions, are one task's work: contraction ends there, whatever the input was.
LAST_LINKS = 400_000


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links, and the least node of the component of each."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        lo, hi = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, hi, lo)
        while not np.array_equal(jump := label[label], label):
            label = jump
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _last(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            node, to = roots(*(np.concatenate(x) for x in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(to)], names=["node", "to"])

    return materialise(edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, to long"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of ``links(u, v)`` so that linked nodes share a label: ``node, label``.

    In each round every node moves to the node of its closed neighbourhood with the least hash (a new hash each
    round; the name itself in the first, which settles stars around their least node at once), links follow their ends, and loops vanish; expected node counts fall by a constant factor, so the
    rounds grow with the logarithm of the nodes. All rounds are joins and aggregates of written tables. Once at most
    LAST_LINKS links are left, one task finds their components. Nodes are longs. Nulls are no links; loops and repeated links do no harm; no links give an empty result.
    """
    both = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = materialise(both.select("u", "v").union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    moves: list[DataFrame] = []
    for r in range(max_rounds):
        left = edges.count()
        if left <= LAST_LINKS:
            if left:
                moves.append(_last(edges))
            break
        order = F.xxhash64("v", F.lit(r)) if r else F.col("v")
        own = F.xxhash64("u", F.lit(r)) if r else F.col("u")
        least = edges.groupBy("u").agg(F.min(F.struct(order.alias("h"), F.col("v").alias("x"))).alias("m"))
        move = materialise(least.select(F.col("u").alias("node"), F.when(F.struct(own.alias("h"), F.col("u").alias("x")) < F.col("m"), F.col("u")).otherwise(F.col("m.x")).alias("to")))
        moves.append(move)
        a, b = move.alias("a"), move.alias("b")
        new = edges.join(a, F.col("u") == F.col("a.node")).select(F.col("a.to").alias("u"), "v").join(b, F.col("v") == F.col("b.node")).select("u", F.col("b.to").alias("v"))
        edges = materialise(new.where("u <> v").distinct())
    else:
        raise RuntimeError("links did not contract")
    if not moves:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = moves[0].select("node", F.col("to").alias("label"))
    for move in moves[1:]:
        labels = labels.join(move.select(F.col("node").alias("_n"), "to"), F.col("label") == F.col("_n"), "left").select("node", F.coalesce("to", "label").alias("label"))
    return labels
