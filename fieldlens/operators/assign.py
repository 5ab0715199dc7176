"""Minimum-cost assignment for the small matrices of one frame."""

from __future__ import annotations


def assign(cost) -> list[tuple[int, int]]:
    """Pairs (row, column) of a minimum-cost matching of a rectangular matrix, by row.

    Where every row's cheapest column is its own, that is the optimum.  Else rows
    are added one at a time along a shortest augmenting path under dual prices.
    """
    import numpy as np

    cost = np.asarray(cost, float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    best = cost.argmin(axis=1)
    if len(set(best.tolist())) == n:
        return [(r, int(c)) for r, c in enumerate(best)]
    price_row, price_col = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        slack, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        here, column = row, -1
        gone = 0.0
        rows = [(row, 0.0)]
        while True:
            offer = gone + cost[here] - price_row[here] - price_col
            better = ~done & (offer < slack)
            slack[better], via[better] = offer[better], column
            column = int(np.where(done, np.inf, slack).argmin())
            gone = slack[column]
            done[column] = True
            if owner[column] < 0:
                break
            here = owner[column]
            rows.append((here, gone))
        for r, reached in rows:
            price_row[r] += gone - reached
        price_col[done] -= gone - slack[done]
        while column >= 0:  # hand the columns of the path on
            before = via[column]
            owner[column] = row if before < 0 else owner[before]
            column = before
    return sorted((int(r), c) for c, r in enumerate(owner) if r >= 0)
