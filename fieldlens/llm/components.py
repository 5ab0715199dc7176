"""Connected components: edges reduced part by part, then min-label hooking and pointer jumping in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, stored

#: Parts that the children of a node are dealt into, and edges that a task reduces at once.
SALTS, PART_EDGES = 16, 500_000


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``many`` with the row of ``one`` (unique by ``key``): a frequent key's rows are dealt into SALTS parts by ``spread``."""
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(copies, [key, "_salt"], how).drop("_salt")


def _reduced(batches):
    """mapInArrow function over edges (a, b): (node, root) of the components that a task's own edges make."""
    import numpy as np
    import pyarrow as pa

    parts = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    found = pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])
    yield from (found.slice(k, 50_000) for k in range(0, found.num_rows, 50_000))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every endpoint of ``edges`` (a, b: long); root is the smallest node reachable.

    Each task first reduces ``PART_EDGES`` edges, about, to one edge a node;
    where one task holds all, that is the result.  Else the reduced edges go
    through rounds: each hooks a node, and the node it points to, to the smallest
    grandparent among its neighbours, and shortcuts to its own grandparent; the
    rounds grow with the logarithm of the longest path.  The edges are never
    rewritten, so no join key gets more rows than a node has neighbours.  Where
    many nodes share a parent, looking up grandparents is salted: each parent is
    there once for each of ``SALTS`` parts of the nodes.  The driver sees only one
    sum a round: labels only fall, so an equal sum means nothing has changed.
    """
    edges = stored(edges.select("a", "b").where("a <> b"), "cc-given")
    parts = -(-edges.count() // PART_EDGES) or 1
    dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts)
    reduced = stored(dealt.mapInArrow(lean(_reduced), "node long, root long"), "cc-reduced")
    if parts == 1:
        return reduced
    edges = reduced.select(F.col("node").alias("a"), F.col("root").alias("b"))
    both = stored(edges.union(edges.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "cc-labels")
    total = None
    while True:
        parents = labels.select("root").distinct().withColumnRenamed("root", "node").join(labels, "node")
        parents = parents.select(F.col("node").alias("root"), F.col("root").alias("grand"))
        grand = salted_join(labels, parents, "root", "node").select("node", "root", "grand")
        offers = both.join(grand.select(F.col("node").alias("b"), "grand"), "b").groupBy(F.col("a").alias("node")).agg(F.min("grand").alias("offer"))
        moves = grand.join(offers, "node").select(
            F.explode(F.array(
                F.struct(F.col("node"), F.least("grand", "offer").alias("root")),
                F.struct(F.col("root").alias("node"), F.least("grand", "offer").alias("root")),
            )).alias("m")
        ).select("m.*")
        labels = stored(moves.groupBy("node").agg(F.min("root").alias("root")), "cc-labels")
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
