"""Density clustering of descriptors, group by group, without a matrix of all distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Distances held at once while core distances are worked out.
CHUNK_DISTANCES = 4_000_000


def density_labels(x: np.ndarray, min_size: int = 10, min_samples: int = 5) -> np.ndarray:
    """Cluster of each row, -1 for noise: mutual-reachability tree, condensed, the most stable clusters kept.

    Distances are worked out row by row, so memory follows the rows however
    many there are; the time follows their square.
    """
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    norms, nth = (x**2).sum(1), min(min_samples, n) - 1
    distances = lambda rows: np.sqrt(np.maximum(norms[rows, None] + norms - 2 * x[rows] @ x.T, 0))
    step = max(1, CHUNK_DISTANCES // n)
    core = np.concatenate([np.partition(distances(slice(k, k + step)), nth, axis=1)[:, nth] for k in range(0, n, step)])
    # Prim's minimum spanning tree of mutual reachability
    inside, best, link, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        reach = np.maximum(np.maximum(distances(slice(at, at + 1))[0], core), core[at])
        closer = ~inside & (reach < best)
        best[closer], link[closer] = reach[closer], at
        nxt = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[nxt], link[nxt], nxt))
        at = nxt
    # single-linkage tree: children, height and size of each merge
    root = list(range(2 * n - 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    left, right, height, size = {}, {}, {}, dict.fromkeys(range(n), 1)
    for k, (h, a, b) in enumerate(sorted(edges), n):
        a, b = find(a), find(b)
        left[k], right[k], height[k], size[k] = a, b, max(h, 1e-12), size[a] + size[b]
        root[a] = root[b] = k

    def leaves(k: int) -> list[int]:
        out, todo = [], [k]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += [left[j], right[j]]
        return out

    # condense: a split counts where both sides are large enough
    stability, children, members, order = {0: 0.0}, {0: []}, {0: leaves(2 * n - 2)}, [0]
    todo = [(2 * n - 2, 0, 0.0)]
    while todo:
        node, own, birth = todo.pop()
        while node >= n:
            lam = 1 / height[node]
            a, b = left[node], right[node]
            large = [k for k in (a, b) if size[k] >= min_size]
            if len(large) == 2:
                stability[own] += (lam - birth) * size[node]
                for k in large:
                    new = len(order)
                    order.append(new)
                    stability[new], children[new], members[new] = 0.0, [], leaves(k)
                    children[own].append(new)
                    todo.append((k, new, lam))
                break
            small = sum(size[k] for k in (a, b) if k not in large)
            stability[own] += (lam - birth) * small
            if not large:
                break
            node = large[0]
    chosen: dict[int, list[int]] = {}
    for k in reversed(order):
        below = sum((chosen[c] for c in children[k]), [])
        total = sum(stability[c] for c in below)
        if children[k] and (k == 0 or total > stability[k]):
            chosen[k], stability[k] = below, total
        else:
            chosen[k] = [] if k == 0 else [k]
    out = np.full(n, -1)
    for i, k in enumerate(sorted(chosen[0])):
        out[members[k]] = i
    return out


def cluster(vectors: DataFrame, min_size: int = 10, min_samples: int = 5) -> DataFrame:
    """(grp, id, cluster) of vectors (id, grp, vector), each group for itself and none refused.

    A group is one task's work: memory in proportion to its rows, time to
    their square.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        return pd.DataFrame({"grp": key[0], "id": rows["id"].values, "cluster": density_labels(np.array(rows["vector"].tolist(), float), min_size, min_samples)})

    return vectors.select("id", "grp", "vector").groupBy("grp").applyInPandas(run, "grp long, id long, cluster long")
