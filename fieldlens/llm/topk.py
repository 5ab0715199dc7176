"""Exact top-k search: tiled matrix products, partial selection per tile, tree merge of the lists.

Queries and candidates are dealt into blocks of a bounded number of rows; each
block of queries meets each block of candidates in one task.  The task multiplies
them tile by tile, takes the best of each tile and merges them into running
lists, so it sends on k rows a query.  The lists of all tasks are merged in two
steps, by query and group of blocks, then by query.  Nothing passes through the
driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import release_memory, stored

#: Queries, and candidates, of a block; rows of a tile of either, and groups of blocks in the first merge.
BLOCK_ROWS, TILE_ROWS, MERGE_GROUPS = 32_768, 2048, 64
LOWEST = -(1 << 63) + 1
HIGHEST = (1 << 63) - 1


def _quantised(lists, scale: float):
    """(valid rows, vectors): floor(scale * x) in doubles, shorter vectors filled up with zeros.

    A vector is valid if it and all its components are there and finite.
    """
    import numpy as np
    import pyarrow.compute as pc

    if not len(lists):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    values = lists.flatten()
    x = np.asarray(values.cast("double").fill_null(float("nan")), np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(x * scale)
    row = np.repeat(np.arange(len(lists)), sizes)
    valid = np.asarray(lists.is_valid()) & (np.bincount(row, ~np.isfinite(x), len(lists)) == 0)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(lists), int(sizes.max(initial=0))))
    kept = valid[row] if len(row) else np.zeros(0, bool)
    out[row[kept], place[kept]] = x[kept]
    rows = np.flatnonzero(valid)
    return rows, out[rows]


def _fit(a, width: int):
    import numpy as np

    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def products(a, b):
    """Integer inner products of all rows of two matrices of whole doubles, held to 64 bits."""
    import numpy as np

    width = max(a.shape[1], b.shape[1])
    a, b = _fit(a, width), _fit(b, width)
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * width < 2**53:  # every partial sum is exact in doubles
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
    return np.clip(whole(a) @ whole(b).T, LOWEST + 1, HIGHEST).astype(np.int64)


def select(scores, ids, k: int):
    """The k best of each row, by score, ties to the smaller id: (scores, ids), best first.  ``ids`` rise."""
    import numpy as np

    n = scores.shape[1]
    if n > k:
        top = int(np.abs(scores).max(initial=0))
        if top < (1 << 61) // n:  # one number that orders by score, then by place
            key = scores * n + np.arange(n - 1, -1, -1)
            at = np.argpartition(key, n - k, axis=1)[:, n - k :]
        else:
            at = np.stack([np.lexsort((np.arange(n), -r))[:k] for r in scores])
        scores, ids = np.take_along_axis(scores, at, 1), ids[at]
    else:
        ids = np.broadcast_to(ids, scores.shape)
    order = np.lexsort((ids, -scores), axis=1)
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _vectors(table, scale: float):
    """(ids, vectors) of a table (vec_id, v), by id, without those that take no part."""
    import numpy as np
    import pyarrow as pa

    table = table.combine_chunks()
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    rows, vectors = _quantised(table.column("v").chunk(0), scale)
    ids = np.asarray(table.column("vec_id").chunk(0).take(pa.array(rows, pa.int64())), np.int64) if len(rows) else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    return ids[order], vectors[order]


def _search(k: int, scale: float):
    """The cogrouped function of a block of queries and a block of candidates: the k best candidates of each query."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        query_ids, q = _vectors(left, scale)
        own, vectors = _vectors(right, scale)
        found = []
        for first in range(0, len(q), TILE_ROWS):
            some, block = query_ids[first : first + TILE_ROWS], q[first : first + TILE_ROWS]
            scores = np.full((len(some), k), LOWEST, np.int64)
            ids = np.full((len(some), k), HIGHEST, np.int64)
            for at in range(0, len(own), TILE_ROWS):
                tile_ids = own[at : at + TILE_ROWS]
                tile = products(block, vectors[at : at + TILE_ROWS])
                tile[some[:, None] == tile_ids] = LOWEST
                more, more_ids = select(tile, tile_ids, k)
                both, both_ids = np.hstack([scores, more]), np.hstack([ids, more_ids])
                order = np.lexsort((both_ids, -both), axis=1)[:, :k]
                scores, ids = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
            good = scores > LOWEST
            found.append((np.broadcast_to(some[:, None], scores.shape)[good], ids[good], scores[good]))
        who, ids, scores = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        release_memory()
        return pa.table({"query_id": who, "part": np.full(len(who), key[1].as_py(), np.int64), "vec_id": ids, "score": scores})

    return run


def _best(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, query_filter, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row of ``df`` that passes ``query_filter``, the k rows of the highest inner product.

    Components are floor(scale * x).  Ties go to the smaller id; a row is no
    candidate for its own id, and of query rows that share an id one counts.
    Vectors that are null, or hold null or non-finite components, and rows
    without an id take no part, nor do those of which floor(scale * x) is beyond
    a double.  Missing components of shorter vectors count as zero.  Scores beyond 64 bits are held to that range.  Other columns are left
    out.  An empty table, or one without queries, gives no rows.
    """
    id_, vector = F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull())
    queries = stored(rows.where(query_filter).select(id_, vector).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    blocks = lambda n: max(1, math.ceil(n / block_rows))
    across, down = blocks(queries.count()), blocks(rows.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # equal ids, or equal vectors, may be many: a row's place deals it out
    place = F.pmod(F.monotonically_increasing_id(), F.lit(down)).cast("int")
    asked = queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int").alias("across"), every(down).alias("down"))
    given = rows.select(id_, vector, place.alias("down")).select("vec_id", "v", every(across).alias("across"), "down")
    key = ["across", "down"]
    found = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(_search(k, scale), "query_id long, part long, vec_id long, score long")
    merged = _best(found.withColumn("part", F.col("part") % MERGE_GROUPS), ["query_id", "part"], k).drop("rank")
    return _best(merged, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
